"""Each operator against a plain version, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quadriver.llm import chat, common, langid, mixing, neardup, pieces, pii, quality, secrets, sharding, vafile

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_hash(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


# language


def test_language(docs, none, texts):
    found = langid.predict_languages(docs, rows_per_lang=1000)
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(texts)
    held = [r for r in texts[:150] if got[r[0]].held_out]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in texts[:150])
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held) and len(held) > 10
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (150, 151, 152, 155)) and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict_languages(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict_languages(unlabelled).collect()} == {"und"}


def plain_grams(text):
    """Buckets of the 1- to 3-grams of the letters, words apart by a zero, in plain integers."""
    c = [0]
    for x in text:
        x = ord(x.lower() if len(x.lower()) == 1 else x) if x.isalpha() else 0
        c += [x] if x or c[-1] else []
    c += [0] if c[-1] else []
    mod, out = 2**64, []
    for n in (1, 2, 3):
        for g in zip(*(c[k:] for k in range(n)), strict=False):
            if any(g):
                h = g[0] * 0x9E3779B97F4A7C15 if n == 1 else g[0] * 0xC2B2AE3D27D4EB4F + g[1] * 0x165667B19E3779F9 + (g[2] * 0x27D4EB2F165667C5 if n == 3 else 0)
                h %= mod
                out.append(((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % mod) >> 48)
    return sorted(out)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 19])
def test_grams_of_blocks(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(block)
    texts = ["Ab  c1ß", "", "12 ..", "a", "1a1", "  x  ", *("".join(rng.choice("aB ß1é .") for _ in range(rng.randrange(40))) for _ in range(60))]
    for t in texts:
        assert sorted(x for h in langid.grams(t) for x in h.tolist()) == plain_grams(t)


@pytest.mark.parametrize("group", [1, 2, 64])
def test_language_is_plain_naive_bayes(docs, texts, monkeypatch, group):
    monkeypatch.setattr(langid, "GROUP", group)
    of = [(i, t, lang) for i, t, lang, _ in texts if i is not None and i < 158]
    learned = [(t, lang) for i, t, lang in of if lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {k: collections.Counter(g for t, lang in learned if lang == k for g in plain_grams(t)) for k in sorted({lang for _, lang in learned})}
    n = collections.Counter(lang for _, lang in learned)
    got = {r.doc_id: r for r in langid.predict_languages(docs.where("doc_id < 158").dropDuplicates(["doc_id"]), rows_per_lang=10**6).collect()}
    for i, t, _ in of:
        grams = collections.Counter(plain_grams(t or ""))
        if not grams:
            continue
        sums = {k: math.log(n[k] / len(learned)) + sum(m * math.log((c[g] + 0.05) / (c.total() + 0.05 * langid.BUCKETS)) for g, m in grams.items()) for k, c in counts.items()}
        top = max(sums.values())
        assert sums[got[i].lang_pred] == pytest.approx(top, abs=1e-2) and got[i].score == pytest.approx(1 / sum(math.exp(x - top) for x in sums.values()), abs=1e-2)


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 150)}{chr(0x5E00 + i % 150)} " * 5, f"l{i % 150:03}") for i in range(1200)]
    got = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in got.collect()} == {r[2] for r in rows}


# exact top-k


def plain_top(data, k=5):
    best = {}
    for i, v in data:
        if i is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v):
            q = [int((256 * x) // 1) for x in v]
            best[i] = min(best.get(i, q), q)
    out = []
    for i, q in best.items():
        if i % 50 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, w, strict=True)))), j) for j, w in best.items() if j != i and len(w) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [40, 1 << 19])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(vafile, "BLOCK_ITEMS", block)
    rng = random.Random(block)
    data = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(220)]
    data += [(i, [0.5] * 6) for i in range(300, 340)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (450, [1.0, 2.0]), (451, [3.0, 4.0]), (500, [])]
    data += [(600 + i, [1e20 * (i - 2), 1.0, 0.0, -3e15, 0.1, 0.2]) for i in range(5)] + [(700, [2.0**44 + i for i in range(6)]), (650, [1e-3, 0, 0, 0, 0, 1.0])]
    data += [(1000 + i, [10.0 * (i % 3 == k) + rng.gauss(0, 0.1) for k in range(6)]) for i in range(150)]
    data += data[:3] + [(0, [9.0] * 6)]
    data = [(i, v and [x if x is None else float(x) for x in v]) for i, v in data]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in data], "vec_id long, embedding array<double>, rank int, block int")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(tuple(r) for r in vafile.top_k(df).collect()) == plain_top(exact)
    assert vafile.top_k(df.where("false")).count() == 0


# chat


def test_chat(spark):
    odd = ["<|im_end|>", "<\\|x", "a<", "|b", "<|im_start|>assistant\nhi", "", None, "<\\\\|im_end|>\n", "é😀\\", "%7C%"]
    data = [(c, t, r, x) for c, (t, r, x) in enumerate((t, r, x) for t, x in enumerate(odd) for r in ("user", "assistant", "a|b\n%", None))]
    data = [(c % 3, t, r, x) for c, t, r, x in data] + [(None, 0, "user", "q"), (9, None, "assistant", "z"), (9, 1, "assistant", "y"), (9, 1, "assistant", "y")]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], "conv_id long, turn long, role string, text string, n int, at int")
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_chats(df))).collect()}
    of = collections.defaultdict(list)
    for c, t, r, x in data:
        of[c].append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == of.keys()
    for c, turns in of.items():
        turns.sort()
        r, loss = got[c], "".join(x for *_, role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_parts(spark):
    parts = [("text", "look <|image|> ", None, None), ("image", None, "i.png", 784 * 3), ("audio", None, "a.wav", 100), None, ("document", None, "d.pdf", 2), ("odd", "kept", None, None), ("text", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df, text_col="role", parts_col="parts").first()
    assert r.formatted == "<|im_start|>user\nlook <\\|image|> <|image|><|audio|><|document|>kept<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [tuple(a) for a in r.attachments] == [(1, "image", "i.png", 1, 3), (1, "audio", "a.wav", 2, 3), (1, "document", "d.pdf", 3, 512)]
    assert [r.formatted[t.start : t.end] for t in r.turns] == ["look <\\|image|> <|image|><|audio|><|document|>kept", ""] and [t.loss for t in r.turns] == [False, True]


# secrets


def plain_secrets(t):
    found = [(m.start(), m.end(), "assign") for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    return sorted(found + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16], key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_secrets(spark, docs, none, texts):
    pool = ["password", "API_KEY", "apikey", "Token", "ſecret", "=", ": ", '"', " ", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x.y/z+1==", "é", "\n", "word"]
    rng = random.Random(2)
    odd = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(400)] + ["token = \"secret: abcdefghijklmnop", "token=token=abcdefghijklmnop"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    want = collections.Counter()
    for t in odd + [r[1] for r in texts]:
        base = plain_secrets(t or "")
        want[by_hash(f"{k}:{a}:{b}" for a, b, k in base), *(sum(k == x for *_, x in base) for k in secrets.KINDS[:3])] += 1
    got = collections.Counter((r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.secret_scan(df).collect())
    assert got == want
    assert secrets.secret_scan(none).count() == 0


def test_random_strings(spark):
    t = "key qZ7xK2mP9vL4wT8nB3cR6yH1 id 123e4567-e89b-12d3-a456-426614174000 user_profile_settings_version_2 internationalisation"
    df = spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.secret_scan(df).collect()}
    assert spans == {1: "random:4:28", 2: ""}
    assert [r[0] for r in df.select(secrets.redact(F.col("text"))).collect()] == [t.replace(t[4:28], "[secret]"), None]


@pytest.mark.parametrize(
    ("text", "spans", "clean"),
    [
        ("key qZxKmPvLwTnBcRyHgJdFsQaXeUoIpKtV end", "random:4:36", "key [secret] end"),
        ("key qZ7xK2mP9vL40123456789abcdefXn8wB3cR6yH1 end", "random:4:44,hex:15:32", "key [secret] end"),
        ("my_api_key=qZ7xK2mP9vL4wT8nB3cR", "assign:3:31", "my_[secret]"),
        ("qZ7xK2mP9vL4wT8nB3cR6yH1_token=abcdefghijklmnop", "random:0:25,assign:25:47", "[secret][secret]"),
        ("commit/0123456789abcdef0123 Donaudampfschifffahrtsgesellschaft /usr/share/Application-Support --------------------", "hex:7:27", None),
    ],
)
def test_random_strings_of_letters_and_around_patterns(spark, text, spans, clean):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.secret_scan(df).first().spans == spans
    assert df.select(secrets.redact(F.col("text"))).first()[0] == (clean or text.replace(text[7:27], "[secret]"))


# personal data


def plain_pii(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        out += [(m.start(), m.end(), "card")] if 16 <= len(d) <= 19 and total % 10 == 0 else []
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (pii.KINDS.index(x[2]), x[0]))


def test_personal_data(spark, docs, none):
    rng = random.Random(4)
    pool = ["a", "b.c", "@", "@x.y", ".", "1", "255", "256", "4539 1488 0343 6467", "4539148803436467", "+1 (499) 555", "-", " ", "00", "é", "+", "%", "\n", "6500", "٣"]
    odd = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(1500)] + ["1" * 5000 + "." * 5000, "a@" * 2000 + "b.c", None]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, n_ip int")
    got = {r.doc_id: (r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.personal_data(df).collect()}
    for i, t in enumerate(odd):
        base = plain_pii(t or "")
        assert got[i] == (by_hash(f"{k}:{a}:{b}" for a, b, k in base), *(sum(k == x for *_, x in base) for k in pii.KINDS)), t
    assert pii.personal_data(docs).count() == docs.count() and pii.personal_data(none).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("to john.doe (at) example [dot] com now", [("john.doe (at) example [dot] com", "email")]),
        ("jane at mail dot example dot org", [("jane at mail dot example dot org", "email")]),
        ("ｊｏ＠ｅｘ．ｃｏｍ", [("ｊｏ＠ｅｘ．ｃｏｍ", "email")]),
        ("call plus four nine one five one two three four five", [("plus four nine one five one two three four five", "phone")]),
        ("host 192 dot 168 dot 0 dot 12", [("192 dot 168 dot 0 dot 12", "ip")]),
        ("card 4539 1488 oh 0343, 4539 1488 zero three 43 6467", [("4539 1488 zero three 43 6467", "card")]),
        ("+49 151 two three 45678 and plus 49 151 2345678", [("+49 151 two three 45678", "phone"), ("plus 49 151 2345678", "phone")]),
        ("jane.doe at example.com, meet at example.org; jo ( at ) ex [ dot ] com", [("jane.doe at example.com", "email"), ("jo ( at ) ex [ dot ] com", "email")]),
        ("meet me at the dot, one or two of us at home", []),
    ],
)
def test_disguises(text, found):
    base = pii.plain_spans(text)
    assert [(text[a:b], k) for a, b, k in sorted(pii.hidden_spans(text, base)) if (a, b, k) not in base] == found


#: Ten megabytes of each take under half a minute; less is enough to tell linear time from quadratic.
LONG = 2_000_000


@pytest.mark.parametrize("unit", ["a@b.c 1.2.3.4 jo (at) ex (dot) com ", " ", "1", "1 ", "+1 ", "a", "one ", "at ", "a@", "(", "é", "0123456789abcdef ", "qZ7xK2mP9vL4wT8nB3cR6yH1 ", "qZxKmPvL", "token=", "token: abcdefghijklm "])
def test_long_texts_in_linear_time(unit):
    text = unit * (LONG // len(unit))
    began = time.monotonic()
    base = pii.plain_spans(text)
    pii.joined(base + pii.hidden_spans(text, base))
    found = secrets.base_spans(text)
    secrets.random_spans(text, found, 2.0, secrets.VOCABULARY)
    assert time.monotonic() - began < 30


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("jo\u200bhn@ex.com", ["jo\u200bhn@ex.com", "hn@ex.com"]),
        ("to j\u043ehn.doe@example.com now", ["j\u043ehn.doe@example.com", "hn.doe@example.com"]),
        ("a@ex.c\u043em", ["a@ex.c", "a@ex.c\u043em"]),
        ("+49 151 2345\u200b678 or ja\u00adne@ex.com", ["ja\u00adne@ex.com", "ne@ex.com", "+49 151 2345", "+49 151 2345\u200b678"]),
        ("card 4539 1488 0343\u2011646\u200b7, ip 192.168.0.1\u200b2", ["192.168.0.1", "192.168.0.1\u200b2", "4539 1488 0343\u2011646\u200b7"]),
        ("jo@ex.com, r\u0435sume\u200b", ["jo@ex.com"]),
    ],
)
def test_disguise_within_an_identifier(spark, text, found):
    r = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",")]
    assert [text[a:b] for a, b in at] == found
    assert r.base_sha256 == by_hash(f"{k}:{a}:{b}" for a, b, k in plain_pii(text))


# near duplicates


def shingle_set(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_classes(data):
    sets = {i: shingle_set(t) for i, t in data if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("limits", "hot"), [({}, 2000), ({"leaf": 4, "depth": 2, "node_block": 5, "block": 3}, 10), ({"leaf": 2, "depth": 3, "block_items": 500}, 10)])
def test_near_duplicates(docs, texts, limits, hot, monkeypatch):
    # few tables are small, some keys are hot
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    got = neardup.near_duplicates(docs, **limits).collect()
    want = plain_classes([(r[0], r[1]) for r in texts])
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_of_nothing(none, docs):
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.near_duplicates(docs.where("text is null or doc_id in (151, 152)")).where("kept").count() == 4


def test_near_duplicates_where_ids_repeat(spark):
    rng = random.Random(9)
    a, b, c = ([f"w{rng.randrange(10**9)}" for _ in range(120)] for _ in range(3))
    near = [*a[:119], "x"]
    rows = [(1, a), (5, a), (5, b), (5, b), (7, near), (8, c), (8, [*c[:119], "y"]), (None, a), (None, a), (9, [])]
    df = spark.createDataFrame([(i, " ".join(w), n) for n, (i, w) in enumerate(rows)], "doc_id int, text string, n int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=repr)
    want = [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 1, False), (8, 8, True), (8, 8, True), (None, None, True), (None, None, True), (9, 9, True)]
    assert got == sorted(want, key=repr)
    left = neardup.drop_near_duplicates(df).collect()
    assert sorted(map(repr, ((r.doc_id, r.text == " ".join(b)) for r in left))) == sorted(map(repr, [(1, False), (5, True), (8, False), (None, False), (None, False), (9, False)]))
    assert sorted(r.n for r in left) == sorted(r.n for r in neardup.drop_near_duplicates(df.repartition(5)).collect())
    named = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(named).collect()} == {(i and str(i), k and str(k)) for i, k, _ in want}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.rep: r.comp for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == parent


# pieces


def test_pieces(spark, docs, none, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = ["   ", "a    b ", "\t\n x", "日本 😀", "▁ a▁b", "x" * 999, "ab12" * 500]
    df = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = collections.Counter(repr((None if r.ids is None else list(r.ids), r.n_tokens)) for r in pieces.encode_documents(df).collect())
    assert got == collections.Counter(repr((None if t is None else lib.encode(t), None if t is None else len(lib.encode(t)))) for t in odd + [r[1] for r in texts])
    assert pieces.encode_documents(df).where("not round_trip").count() == 0
    back = pieces.encode_documents(df).select(pieces.decoded(F.col("ids")).alias("t"))
    assert collections.Counter(r.t for r in back.collect()) == collections.Counter(None if t is None else t.replace("▁", " ") for t in odd + [r[1] for r in texts])
    assert pieces.encode_documents(none).count() == 0


def test_pieces_of_long_words_share_prefixes():
    """Words on both sides of the length up to which prefixes keep their ids, and one that is a whole long text."""
    import sentencepiece

    model, lib = pieces.Pieces.load(pieces.MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    for n in (63, 64, 65, 66, 130, 100_000):
        for letters in ("abcdefghij", "thequickbrown_.é漢字💡", "ein"):
            word = "".join(rng.choice(letters) for _ in range(n))
            for text in (word, word + "x y " + word[:70] + "z", word[:-1]):
                ids, same = model.encode([text])
                assert ids[0].tolist() == lib.encode(text) and same == [True]



def test_unigram_is_best_by_score():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "▁a": -4.0, "ab": -3.0, "▁ab": -6.5, "ba": -4.1}
    model = pieces.Pieces({p: i for i, p in enumerate(scores)}, scores, {}, unigram=True)

    def best(word):
        options = [(0.0, [])] if not word else []
        options += [(s + t, [p, *r]) for p, s in scores.items() if word.startswith(p) for t, r in [best(word[len(p) :])]]
        return max(options, default=(-1e9, []))

    rng = random.Random(8)
    for t in ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(60)]:
        ids = model.encode([t])[0][0].tolist()
        assert sum(scores[list(scores)[i]] for i in ids) == pytest.approx(best("▁" + t)[0])


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_model_file_as_the_library(tmp_path, monkeypatch, byte_fallback):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    monkeypatch.setattr(pieces, "KNOWN", 50)
    rng = random.Random(21)
    made = pb.ModelProto()
    made.trainer_spec.model_type, made.trainer_spec.byte_fallback, made.trainer_spec.unk_id = pb.TrainerSpec.UNIGRAM, byte_fallback, 0
    made.normalizer_spec.name, made.normalizer_spec.add_dummy_prefix, made.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    made.pieces.add(piece="<unk>", score=0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    if byte_fallback:
        for b in range(256):
            made.pieces.add(piece=f"<0x{b:02X}>", score=0, type=pb.ModelProto.SentencePiece.BYTE)
    words = {"▁", *"abc", *("▁" * rng.randrange(2) + "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(60))} - {"d"}
    for w in sorted(words):
        made.pieces.add(piece=w, score=-rng.random() * 8 - len(w))
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(made.SerializeToString())
    model, lib = pieces.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert model.unigram
    texts = ["".join(rng.choice("aabbccd  é") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "d", "dd d", "  "]
    found, same = model.encode(texts)
    assert [x.tolist() for x in found] == [lib.encode(t) for t in texts]
    assert [x.tolist() for x in model.encode(texts[::-1])[0]] == [lib.encode(t) for t in texts[::-1]]
    # without bytes, unknown characters are lost
    assert same == [model.decode(x.tolist()) == t for t, x in zip(texts, found, strict=True)] and all(same) == byte_fallback


# quality


def test_quality(docs, none, texts):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect())
    want = collections.Counter()
    for i, t, *_ in texts:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    assert got == want
    kept = [r for r in quality.quality_rules(docs).collect() if r.kept]
    assert 158 in {r.doc_id for r in kept} and not {156, 157} & {r.doc_id for r in kept} and not any(r.base_failed for r in kept)
    assert quality.quality_rules(none).count() == 0
    stay = quality.keep_good(docs)
    assert stay.columns == docs.columns and rows(stay.select("doc_id")) == sorted(((r.doc_id,) for r in kept), key=repr)


def test_sketch_bins(spark):
    df = spark.range(5000).select(F.col("id").alias("v")).select("v", quality.bin_of(F.col("v")).alias("b")).select("v", "b", quality.bin_low(F.col("b")).alias("low"))
    assert df.where("low > v or v - low > v / 16").count() == 0 and df.select("b").distinct().count() < 32 + 16 * 8


# mixing


def test_mixing(docs, none, texts):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    sizes = collections.Counter()
    for r in texts:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    weight = {s: n % 3 + 1 for n, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: weight[s] * left / sum(weight[x] for x in sizes if x not in capped) for s in sizes if s not in capped}
        target = {s: 3.0 * sizes[s] if s in capped else share[s] for s in sizes}
        if not (over := {s for s in share if share[s] >= 3 * sizes[s]}):
            break
        capped |= over
    taken, want = sum(r.taken for r in got), sum(round(x) for x in target.values())
    assert taken == want and all(0 <= r.taken <= 3 * r.size for r in got)
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in target.values()}
    assert mixing.mix(none).count() == 0


def test_mixed_rows(docs, none, texts):
    out = mixing.mixed_rows(docs.dropDuplicates(["doc_id"]).where("doc_id is not null"))
    mix = {r.doc_id: r for r in mixing.mix(docs.dropDuplicates(["doc_id"]).where("doc_id is not null")).collect()}
    words = collections.Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert out.columns == docs.columns and {i: r.taken for i, r in mix.items() if r.taken} == dict(words)
    assert mixing.mixed_rows(none).count() == 0


@pytest.mark.parametrize("copies", [2, 5])
def test_mixed_rows_of_repeated_rows(spark, copies):
    for seed in range(1):
        rng = random.Random(10 * copies + seed)
        rows = [(i, " ".join(f"w{k}" for k in range(rng.randrange(1, 9))), rng.choice(["a", "b", None]), 0) for i in range(6)] * copies
        rows += [(None, "x y z", "a", 0)] * copies + [(1, rows[1][1], rows[1][2], n) for n in range(copies)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
        want = collections.Counter()
        for r in mixing.mix(df, seed=str(seed)).collect():
            want[r.doc_id, r.size] += r.taken
        got = collections.Counter()
        size = {i: len(t.split()) for i, t, *_ in rows}
        for r in mixing.mixed_rows(df, seed=str(seed)).collect():
            got[r.doc_id, size[r.doc_id]] += len(r.text.split())
        assert +got == +want


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "RANGES", 2)
    df = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 97}" if i % 98 else None) for i in range(900)], "doc_id long, text string, source string")
    ranks = {r.source: r.rank for r in mixing.ranked(df.select("source").distinct(), "source").collect()}
    assert [s for s, _ in sorted(ranks.items(), key=lambda x: x[1])] == [*sorted(s for s in ranks if s), None] and sorted(ranks.values()) == list(range(1, len(ranks) + 1))
    got = mixing.mix(df).collect()
    for s in ranks:
        mine = [r for r in got if (r.doc_id % 98 and f"s{r.doc_id % 97}" or None) == s]
        assert sum(r.taken for r in mine) == round(mine[0].target)


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n c  d ", 2), ("a", 1), ("a  b", 5), ("x y", 1)], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["a b", "a", "a  b", "x"]


# sharding


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(docs, none, texts):
    got = sharding.shard_documents(docs).collect()
    plain = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_jump(plain(i), 16), plain_jump(plain(i), 17)) for i, t, *_ in texts)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in got)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(none).count() == 0
