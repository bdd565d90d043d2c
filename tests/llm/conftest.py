import random

import pytest

SYLLABLES = {"en": "the ing and tion er re on at en".split(), "de": "der ung ein sch keit ver ü ß auf".split(), "fr": "le que eau oi tion é è dans ç".split()}


def prose(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.05 else "") for w in words)


@pytest.fixture(scope="session")
def texts():
    """doc_id, text, lang, source: copies, edits, odd texts, nulls everywhere."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.randrange(20, 200)), lang, f"s{0 if i % 3 == 0 else i % 5}"))
    base = prose(rng, "en", 300).split(" ")
    for i in range(120, 150):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(10**6))
        rows.append((i, " ".join(copy), "en", "s0"))
    rows += [(150, None, "en", "s1"), (151, "", None, None), (152, " \n\t ", "en", None), (153, "One two", "en", "s2"), (154, "one TWO", "en", "s2"), (155, "123 !!", "en", "s2")]
    rows += [(156, "# $ | < > " * 60, "en", "s1"), (157, "again and again " * 40, "en", "s1"), (158, prose(rng, "de", 20000), "de", "s0"), (160, rows[5][1], "en", "s9"), (None, rows[6][1], "en", "s1"), (None, None, None, None)]
    rows += [rows[7], rows[7]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with columns whose names the operators use themselves."""
    more = ("size", "key", "n", "kept", "shard", "row", "rep", "of")
    return spark.createDataFrame([(*r, *range(len(more))) for r in texts], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{m}` int" for m in more)).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
