"""Graph-pattern queries compiled to DataFrame plans."""
