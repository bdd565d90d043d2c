"""The pipeline on a small table, stage by stage."""

import gc
import os
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quadriver.llm import common, neardup, pieces


def test_stages(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source").selectExpr("*", "cast(length(text) as int) as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scan", "source mixing", "SentencePiece"]
    now, counts = read, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name.replace(" ", "")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
        counts.append(now.count())
        if name != "SentencePiece":
            assert now.columns == read.columns and now.where("n_chars <> length(text)").count() == 0
    assert counts[0] > counts[1] == counts[2] and now.where("not round_trip").count() == 0 and "ids" in now.columns
    texts = [r.text for r in spark.read.parquet(str(tmp_path / "sourcemixing")).collect()]
    model = pieces.loaded(pieces.MODEL)
    assert sorted(map(len, model.encode(texts)[0])) == sorted(r.n_tokens for r in now.collect())
    assert sorted(map(tuple, (r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(tuple, (r.ids for r in now.collect())))


def test_empty(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source").selectExpr("*", "length(text) as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_below_op5s_similarity(spark):
    rng = random.Random(12)
    rows, gone = [], set()
    for k, edits in enumerate([2, 3, 4, 5] * 6):
        words = [f"w{rng.randrange(10**9)}" for _ in range(154)]
        copy = list(words)
        for e in range(edits):
            copy[10 + 20 * e] = f"edit{e}"
        # 150 shingles each; an edit changes five
        percent = 100 * (150 - 5 * edits) / (150 + 5 * edits)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        gone |= {2 * k + 1} if percent >= 80 else set()
        assert (percent >= 85, percent >= 80) == (edits == 2, edits <= 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {i for i, _ in rows} - gone
    assert neardup.near_duplicates(docs).where("not kept").count() == 6


def test_signatures_agree_enough():
    assert [neardup.agreeing(p) for p in (80, 85, 100)] == [14, 17, 32]
    sigs = np.zeros((2, neardup.TOKENS), np.uint32)
    sigs[1, 15:] = 1
    t = pa.table({"n": [150, 150], "data": [x.tobytes() for x in sigs]})
    assert [len(neardup.Signatures(t, p).candidates(0, np.array([1]))) for p in (80, 85)] == [1, 0]


def test_tasks_drop_what_the_one_before_did_not_use(monkeypatch):
    class Task:
        def __init__(self, n):
            self.taskAttemptId = lambda: n

    loads = []
    for name, value in (("_models", {}), ("_used", set()), ("_task", None)):
        monkeypatch.setattr(common, name, value)
    use = lambda k: common.shared(k, lambda: loads.append(k) or k)
    for task, names, left in [(1, "aba", "ab"), (2, "a", "ab"), (3, "", "a"), (4, "", ""), (5, "a", "a"), (5, "b", "ab"), (6, "ab", "ab")]:
        monkeypatch.setattr(common.TaskContext, "get", lambda t=task: Task(t))
        common.tidy()
        assert [use(k) for k in names] == list(names)
        assert sorted(common._models) == list(left)
    assert loads == ["a", "b", "a", "b"]


def test_workers_let_the_models_of_other_stages_go(spark, docs):
    """Python workers outlive stages; the near-duplicate stage after a SentencePiece stage must not hold its model, too."""

    @F.arrow_udf("string")
    def models(column: pa.Array) -> pa.Array:
        time.sleep(0.3)
        n = sum(type(x) is pieces.Pieces for x in gc.get_objects())
        return pa.array([f"{os.getpid()} {n}"] * len(column))

    def held():
        found = spark.range(0, 64, 1, 16).select(models("id").alias("m")).distinct().collect()
        return {pid: int(n) for pid, n in (r.m.split() for r in found)}

    wide = docs.select("doc_id", "text").repartition(16)
    pieces.encode_documents(wide).write.format("noop").mode("overwrite").save()
    assert any(held().values())
    for _ in range(2):
        neardup.sets(wide, "doc_id", "text", 5).write.format("noop").mode("overwrite").save()
    assert not any(held().values())
    # a stage without a model of its own in between does no harm
    assert pieces.encode_documents(wide).where("not round_trip").isEmpty()


def test_pieces_of_several_groups_in_a_batch(spark, texts):
    """Nulls and empty texts at the edges of groups that are encoded together."""
    given = [None, "", *[t for _, t, *_ in texts], None] * 9
    given = [*given[: pieces.GROUP - 1], None, "", None, *given, ""]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in pieces.encode_documents(df).collect()}
    model = pieces.loaded(pieces.MODEL)
    assert got == {i: None if t is None else model.encode([t])[0][0].tolist() for i, t in enumerate(given)}
