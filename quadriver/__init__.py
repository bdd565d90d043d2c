"""quadriver: a Spark-native engine for semantic time series.

A value is addressed by context, item, property, millisecond and sequence number; see :mod:`quadriver.schema`.
"""
