"""Operators, formats, store and feeds on small fixtures."""

import http.server
import json
import random
import threading
import time as clock

import pytest
from pyspark.sql import functions as F

from quadriver import api
from quadriver.__main__ import main
from quadriver.functions import records, values
from quadriver.operators import catalog, fetch, joins, sets
from quadriver.schema import DEFAULT_CONTEXT, HELD, num, text
from quadriver.sources import csv_wide, documents, generator, lf_json, line_protocol, remote, results
from quadriver.sources.values import created, row, typed
from quadriver.store import Store, expiry_ms
from quadriver.streaming import archival, feed

SIX = [(1675324136198, 6.333333333333333), (1675324133196, 6.333333333333333), (1675324130194, 6.25), (1675324127192, 6.2), (1675324124192, 6.166666666666667), (1675324121191, 6.166666666666667)]
DAY = 86_400_000


@pytest.fixture(scope="module")
def six(spark):
    return created(spark, [row("http://example.org/item2", "http://example.org/properties/p2", t, 0, v) for t, v in SIX])


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_sum_in_intervals(six):
    out = rows(fetch.fetch(six, interval=10000, op="sum"), "time", "seqNr", "v_double")
    assert [(t, n) for t, n, _ in out] == [(1675324120000, 2), (1675324130000, 1)]
    assert [x for *_, x in out] == pytest.approx([18.53, 18.91], abs=1e-2)
    assert fetch.fetch(six, limit=2).count() == 2
    with pytest.raises(ValueError):
        fetch.fetch(six, op="median")


def test_sampling(spark):
    points = created(spark, [row("urn:i", "urn:p", t, 0, t) for t in range(100, 10001, 100)])
    assert rows(fetch.fetch(points, begin=9601, end=10000, interval=200), "time", "v_long") == [(9600, 9700), (9800, 9900), (10000, 10000)]


def test_integer_sum_text_max_and_first(spark):
    df = created(spark, [row("urn:i", "urn:p", t, s, v) for t, s, v in ((1, 0, 2), (1, 1, 3), (2, 0, 4))] + [row("urn:i", "urn:s", 1, 0, "b"), row("urn:i", "urn:s", 2, 0, "a")])
    assert rows(fetch.aggregate(df, "sum").where("property = 'urn:p'"), "v_type", "v_long") == [("long", 9)]
    assert rows(fetch.aggregate(df, "max").where("property = 'urn:s'"), "v_string") == [("b",)]
    assert rows(fetch.aggregate(df, "first").where("property = 'urn:s'"), "time", "v_string") == [(0, "a")]


def test_limit_before_filter(spark):
    df = created(spark, [row("urn:i", "urn:p", 1, 0, "x"), row("urn:i", "urn:p", 2, 0, "y")])
    assert fetch.fetch(df, limit=1).where(text() == "x").count() == 0


def test_asof_against_plain(spark):
    rng = random.Random(5)
    left = [(f"k{rng.randrange(3)}", rng.randrange(1000)) for _ in range(200)]
    right = [(f"k{rng.randrange(4)}", rng.randrange(1000), rng.randrange(3), rng.random()) for _ in range(300)]
    a = spark.createDataFrame(left, "item string, time long")
    b = spark.createDataFrame(right, "item string, time long, seqNr int, x double").dropDuplicates(["item", "time", "seqNr"])
    plain = [tuple(r) for r in b.collect()]
    for span in (0, 70):
        got = rows(joins.asof_join(a, b, ["item"], ["x"], "left", span).withColumn("r_x", F.coalesce("r_x", F.lit(-1.0))), "item", "time", "r_x")
        best = lambda k, t: max(((u, s, x) for i, u, s, x in plain if i == k and u <= t), default=(0, 0, -1.0))[2]
        assert got == sorted((k, t, best(k, t)) for k, t in left)


def test_range_join_against_plain(spark):
    a = spark.createDataFrame([("a", 5, 25), ("a", 30, 29), ("b", 0, 100), ("a", None, 3)], "item string, begin long, end long")
    b = spark.createDataFrame([("a", t) for t in range(0, 50, 5)] + [("b", 100), ("b", 101)], "item string, time long")
    assert rows(joins.range_join(a, b, ["item"], span=10), "item", "r_time") == [("a", t) for t in range(5, 30, 5)] + [("b", 100)]


def test_last_write_wins_against_plain(spark):
    rng = random.Random(1)
    data = [("c", f"i{rng.randrange(4)}", "p", rng.randrange(5), 0, v, v) for v in range(80)]
    df = spark.createDataFrame(data, "context string, item string, property string, time long, seqNr int, x int, ingest_ts int")
    want = {d[:5]: d[5] for d in data}
    assert {tuple(r[k] for k in sets.PRIMARY): r.x for r in sets.last_write_wins(df).collect()} == want


def test_catalog(spark):
    items = spark.createDataFrame([("http://ex.org/a/b/c",), ("http://ex.org/a/d",), ("urn:x",)], "item string")
    assert rows(catalog.hierarchy_edges(items), "parent", "child") == [("http://ex.org/a", "http://ex.org/a/b"), ("http://ex.org/a", "http://ex.org/a/d"), ("http://ex.org/a/b", "http://ex.org/a/b/c")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "s int, o int")
    assert catalog.closure(chain).count() == 210


def test_records(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":"x"},"a":2}', "[10,\"s\",{\"k\":true}]")], "r string, l string")
    assert df.select(records.field(F.col("r"), "a"), records.field(F.col("r"), "b", "c"), records.element(F.col("l"), 1), records.element(F.col("l"), 3, "k"), records.element(F.col("l"), 9)).first()[:] == ("1", "x", "10", "true", None)
    assert [(r.p, r.v) for r in records.entries(df, "r", keep_repeats=True).collect()] == [("a", "1"), ("b", '{"c": "x"}'), ("a", "2")]
    pairs = spark.sql("select array(struct('a' as p, 1 as v), struct('b' as p, 2 as v), struct('a' as p, 3 as v)) as x")
    x = F.col("x")
    assert pairs.select(records.first(x, "a"), records.size(records.remove_first(x, "a")), records.first(records.remove_first(x, "a"), "a"), records.size(records.append(x, "c", F.lit(4))), records.size(records.rest(x))).first()[:] == (1, 2, 3, 4, 2)


def test_functions(spark):
    df = spark.createDataFrame([("u:x", "1.234,5", 1675324136198)], "n string, t string, ms long")
    out = df.select(values.expand_name(F.col("n"), {"u": "http://ex/"}), values.number_in(F.col("t")), values.format_time(F.col("ms"), "yyyy-MM-dd HH:mm", -60), values.aas_id(values.aas_uri(F.lit("https://ex/Ä?x=1")))).first()
    assert out[:] == ("http://ex/x", 1234.5, "2023-02-02 08:48", "https://ex/Ä?x=1")
    assert rows(spark.createDataFrame([("2023-10-02",), ("2024-12-31",)], "d string").select(fetch.aligned_week(F.unix_millis(F.col("d").cast("timestamp"))).alias("w")), "w") == [(40,), (53,)]


def test_json(spark, tmp_path):
    body = {"http://ex.org/item1": {"http://ex.org/p1": [{"time": 1, "value": 20.4}, {"time": 2, "seqNr": 3, "value": True}, {"time": 3, "value": 48565664968483514466}, {"time": 4, "value": {"msg": "x", "r": {"@id": "urn:u"}}}, {"time": 5, "value": [1, "a"]}, {"time": 6, "value": {"@id": "urn:u"}}]}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    df = lf_json.read(spark, str(tmp_path / "a.json"))
    assert [r[0] for r in rows(df, "v_type")] == sorted(["double", "bool", "decimal", "record", "array", "uri"])
    back = json.loads(lf_json.written(df).first().json)
    assert sorted(back["http://ex.org/item1"]["http://ex.org/p1"], key=lambda x: x["time"]) == body["http://ex.org/item1"]["http://ex.org/p1"]


def test_json_contexts():
    body = {"@context": {"ex": "http://ex.org/", "q": "ex:q/"}, "ex:i": {"@context": {"p": "http://p.org/"}, "p:a": [{"t": "2023-02-02T07:48:56.198Z", "v": 1}], "q:b": 7, "ex:c": [{"value": 1}, {"value": 2}]}, "rel/": {"ex:d": {"value": {"ex:k": {"@id": "q:z"}}}}}
    found = list(lf_json.parse(json.dumps(body), base="http://base.org/x/"))
    assert [(r[1], r[2], r[4]) for r in found] == [("http://ex.org/i", "http://p.org/a", 0), ("http://ex.org/i", "http://ex.org/q/b", 0), ("http://ex.org/i", "http://ex.org/c", 0), ("http://ex.org/i", "http://ex.org/c", 1), ("http://base.org/x/rel", "http://ex.org/d", 0)]
    assert found[0][3] == 1675324136198 and json.loads(found[-1][-1]) == {"http://ex.org/k": {"@id": "http://ex.org/q/z"}}


@pytest.mark.parametrize("text", ['{"a:b": {"c:d": [{"time": 1}]}}', '{"": {"c:d": 1}}', '{"a:b": {"": 1}}', '{"a b": {"c:d": 1}}', '{"a:b": {"c:d": [{"time": 1, "value": null}]}}', '{"a:b": {'])
def test_json_errors(text):
    with pytest.raises(ValueError):
        list(lf_json.parse(text))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time;<http://ex/item1>@<http://ex/p1>;prop3;seqNr\n1;0.0;"33";"14"\n2;true;"\'x y\'";15\n3;1.234,5;;16\n')
    df = csv_wide.read(spark, str(tmp_path / "a.csv"), "http://base/", ";")
    got = {(r.time, r.property): (r.item, r.seqNr, r.v_type, r.x) for r in df.withColumn("x", text()).collect()}
    assert got[1, "http://ex/p1"] == ("http://ex/item1", 14, "double", "0.0") and got[1, "http://base/prop3"] == ("http://base/", 14, "long", "33")
    assert got[2, "http://ex/p1"][2:] == ("bool", "true") and got[2, "http://base/prop3"][2:] == ("string", "x y")
    assert got[3, "http://ex/p1"][2:] == ("double", "1234.5") and got[3, "http://base/prop3"][2:] == ("string", "")
    wide = csv_wide.pivoted(df, pattern="yyyy")
    assert wide.columns[:2] == ["time", "seqNr"] and wide.first().seqNr == 16 and wide.first().time == "1970"


def test_line_protocol():
    found = list(line_protocol.parse('p1,item=http://ex/i value=42i\np2,item=http://ex/i,x=y value="a \\"b\\", c",z=1 1000000\n\np3,item=http://ex/i value=23.0 1556813561098000000\np4,item=http://ex/i value=F'))
    assert [typed(x) for x in (42, 'a "b", c', 23.0, False)] == [r[5:] for r in found]
    assert found[1][3] == 1 and found[2][3] == 1556813561098
    assert [r[5:7] for r in line_protocol.parse("p1,item=http://ex/i\tvalue=42i\t1000000")] == [("int", 42)]
    for bad in ("nonsense", "p,item=http://ex/i,t=x=y value=1"):
        with pytest.raises(ValueError):
            list(line_protocol.parse(bad))


def test_documents(spark, tmp_path):
    shell = {"id": "urn:m1", "idShort": "M", "modelType": "Submodel", "submodelElements": [{"idShort": "ProductClassId", "valueId": {"keys": [{"type": "GlobalReference", "value": "0173-1#01-BAB253#016"}]}}]}
    (tmp_path / "s.json").write_text(json.dumps(shell))
    triples = documents.read_triples(spark, str(tmp_path / "s.json"), documents.aas_triples)
    hit = catalog.path(triples, *[documents.AAS + k for k in ("valueId", "keys", "value")])
    assert rows(hit, "o") == [("0173-1#01-BAB253#016",)]
    assert documents.resolved({"keys": [{"type": "Submodel", "value": "urn:m1"}]}) == documents.shell_uri("urn:m1") and documents.resolved({"keys": []}) is None
    xml = '<UANodeSet xmlns="http://opcfoundation.org/UA/2011/03/UANodeSet.xsd"><NamespaceUris><Uri>http://my/</Uri></NamespaceUris><Aliases><Alias Alias="HasComponent">i=47</Alias></Aliases><UAObject NodeId="ns=1;i=5" BrowseName="1:Pump"><DisplayName>Pump</DisplayName><References><Reference ReferenceType="HasComponent" IsForward="false">ns=1;i=1</Reference></References></UAObject></UANodeSet>'
    found = list(documents.nodeset_triples(xml))
    assert ("http://my#i=1", "http://opcfoundation.org/UA#i=47", "http://my#i=5", "uri") in found and len(found) == 4


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "hot"))
    start = 1696197600000
    assert store.read().count() == 0
    store.put(generator.generate(spark, 5, 2, 10, start))
    store.put(generator.generate(spark, 2, 2, 10, start + 14 * DAY, item="http://example.org/new"))
    assert store.read().count() == 140 and [w[:2] for w in store.weeks()] == [(2023, 40), (2023, 42)]
    store.put(generator.generate(spark, 1, 1, 5, start).withColumn("v_double", F.lit(-1.0)))
    assert store.read().count() == 140 and store.read().where("v_double = -1").count() == 5
    plan = store.read(begin=start + 13 * DAY)._jdf.queryExecution().toString()
    assert "week" in plan[plan.index("PartitionFilters") :][:300]
    store.put(generator.generate(spark, 1, 1, 2, start).withColumn("v_double", F.lit(-2.0)))
    assert store.delete("http://example.org/item2") == 20 and store.delete("http://example.org/item2") == 0 and store.read().count() == 120
    before = rows(store.read(), "item", "property", "time", "v_double")
    assert store.compact() >= 1 and rows(store.read(), "item", "property", "time", "v_double") == before
    assert dict((w[:2], w[2]) for w in store.weeks())[2023, 40] <= 2
    cold = Store(spark, str(tmp_path / "cold"))
    assert store.archive_to(cold, start + DAY) == 80 and cold.read().count() == 80 and store.read().count() == 40
    assert sets.merged(store.read(), cold.read()).count() == 120
    store.copy_to(cold, "*")
    assert cold.read().count() == 120 and cold.retain(start + 21 * DAY, 8 * DAY) == 1 and cold.read().count() == 40


def test_store_after_a_lost_writer(spark, tmp_path):
    """A writer is lost after each step of a change: nothing is lost, nothing deleted comes back."""
    for step in ("staged", "committed", "moved", "removed"):
        store = Store(spark, str(tmp_path / step))
        for v in range(3):
            store.put(created(spark, [row("urn:a", "urn:p", t, 0, 10 * v + t) for t in (1, 2)]))
        store.delete("urn:a", begin=2)

        class Lost(Exception):
            pass

        class Writer(Store):
            def _commit(self, staged, remove=()):
                if step == "staged":
                    raise Lost
                return super()._commit(staged, remove)

            def _finish(self, manifest):
                fs, where = self._fs(manifest)
                todo = json.loads(open(manifest.removeprefix("file:")).read())
                for old, new in todo["moves"] if step in ("moved", "removed") else []:
                    fs.rename(self._fs(old)[1], self._fs(new)[1])
                for gone in todo["remove"][-1:] if step == "removed" else []:
                    fs.delete(self._fs(gone)[1], True)
                raise Lost

        with pytest.raises(Lost):
            Writer(spark, store.path).compact()
        assert rows(Store(spark, store.path).read(), "time", "v_long") == [(1, 21)], step
        assert Store(spark, store.path).compact(1) == 1 and rows(store.read(), "time", "v_long") == [(1, 21)]
        assert len({store._version(), store._version(), Store(spark, store.path)._version()}) == 3


def test_expiry(spark, tmp_path):
    assert expiry_ms("urn:a?ttl=2d") == 2 * DAY and expiry_ms("urn:a?x=1&ttl=2d") is None and expiry_ms("urn:a") is None
    store = Store(spark, str(tmp_path / "s"))
    store.put(created(spark, [row("urn:a?ttl=1s", "urn:p", t, 0, t) for t in (1000, 5000)] + [row("urn:b", "urn:p", 1, 0, 1)]))
    assert store.expire(5500) == 1 and store.read().count() == 2


def test_api(spark, six, tmp_path):
    assert api.get_values(six, {"item": "http://example.org/item2 nonsense", "limit": "2"}).count() == 2
    with pytest.raises(api.LimitTooLarge):
        api.get_values(six, {"limit": "500001"})
    assert api.values_csv(six, {"limit": "-1"}).count() == 6
    store = Store(spark, str(tmp_path / "s"))
    api.post_values(spark, store, '{"http://ex/a/b": {"http://ex/p": [{"time": 1, "value": 1}, {"time": 2, "value": 2}]}}')
    api.post_values(spark, store, "http://ex/q,item=http://ex/a/c value=1i 1000000", "application/influxdb-line")
    assert rows(api.get_descendants(store.read(), "http://ex/a", {}), "item") == [("http://ex/a/b",), ("http://ex/a/c",)]
    assert rows(api.get_properties(store.read(), {"item": "http://ex/a/b"}), "property") == [("http://ex/p",)]
    assert api.delete_values(store, {"item": "http://ex/a/b", "to": "1"}) == {"deleted": 1}


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "s")
    Store(spark, path).put(created(spark, [row("urn:a", "urn:p", 1, 0, 5)]))
    main([path, "properties", "urn:a"], spark)
    main([path, "copy", "*", str(tmp_path / "t")], spark)
    main([str(tmp_path / "t"), "fetch", "urn:a"], spark)
    Store(spark, path).put(created(spark, [row("urn:a", "urn:p", t, 0, t) for t in range(2, 9)]))
    main([path, "copy", "*", str(tmp_path / "u"), "--limit", "3"], spark)
    main([path, "copy", "*", str(tmp_path / "w"), "--op", "sum", "--model", DEFAULT_CONTEXT], spark)
    assert Store(spark, str(tmp_path / "u")).read().count() == 3 and rows(Store(spark, str(tmp_path / "w")).read(), "v_long") == [(40,)]
    assert capsys.readouterr().out == 'urn:p\n{"urn:a":{"urn:p":[{"time":1,"value":5}]}}\n'


def test_remote(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            found = "urn%3Aa" in self.path
            self.send_response(200 if found else 404)
            self.end_headers()
            if found:
                self.wfile.write(b'{"urn:a": {"urn:p": [{"time": 1, "value": 2}]}}')

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(remote.RemoteValues)
    df = spark.read.format("remote_values").option("url", f"http://127.0.0.1:{server.server_port}/values").option("items", "urn:a urn:b").load()
    assert rows(df, "item", "time", "v_long") == [("urn:a", 1, 2)]
    server.shutdown()


def test_messages(spark):
    df = spark.createDataFrame([("LF/x/host/a/b", '{"urn:p": [{"time": 5, "value": 1}]}'), ("LF/x/own/a", '{"urn:p": 1}'), ("other", "{}")], "topic string, payload string")
    got = remote.messages(df, ["own"])
    assert rows(got, "item", "time", "v_long") == [("http://host/a/b", 5, 1)]
    assert rows(remote.published(got, "me"), "topic", "payload") == [("LF/me/host/a/b", '{"urn:p":[{"time":5,"value":1}]}')]


def test_feeds(spark, tmp_path):
    path = str(tmp_path / "in")
    put = lambda *data: created(spark, [row(i, "urn:p", t, 0, v) for i, t, v in data]).coalesce(1).write.mode("append").parquet(path)
    put(("urn:x/a", 10, 1.0), ("urn:x/a", 20, 2.0), ("urn:y", 5, 3.0))
    seen = []
    for _ in range(2):
        q = feed.updates(feed.subscribe(feed.changes(spark, path), ["urn:x/**"]), lambda df, n: seen.extend((r.item, r.time) for r in df.collect()), str(tmp_path / "c1"), once=True)
        q.awaitTermination()
        put(("urn:x/a", 15, 9.0), ("urn:x/a", 30, 4.0))
    assert sorted(seen) == [("urn:x/a", 10), ("urn:x/a", 15), ("urn:x/a", 20), ("urn:x/a", 30)]
    assert feed.snapshot(spark.read.parquet(path), ["urn:y"]).count() == 1
    one = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = feed.in_order(one).writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    out.awaitTermination()
    times = [r.time for r in spark.table("ordered").where("item = 'urn:x/a'").collect()]
    assert 20 in times and 30 in times
    items = feed.new_items(feed.changes(spark, path)).writeStream.format("memory").queryName("items").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    items.awaitTermination()
    assert rows(spark.table("items"), "item") == [("urn:x/a",), ("urn:y",)]
    sums = feed.intervals(feed.changes(spark, path), 1000, "0 seconds").writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    sums.awaitTermination()
    assert rows(spark.table("sums"), "item", "time") == [("urn:x/a", 0), ("urn:y", 0)]


def test_contexts_and_numbers(spark):
    df = created(spark, [row("urn:i", "urn:p", 1, 0, 1, "urn:b"), row("urn:i", "urn:q", 1, 0, 2, "urn:a"), row("urn:i", "urn:q", 1, 0, 3, "urn:b")])
    assert rows(fetch.in_contexts(df, ["urn:a", "urn:b"]), "property", "v_long") == [("urn:p", 1), ("urn:q", 2)]
    assert fetch.fetch(df).count() == 0 and fetch.fetch(df.withColumn("context", F.lit(DEFAULT_CONTEXT))).count() == 3
    assert df.select(F.sum(num())).first()[0] == 6.0


def test_put_to_an_endpoint(spark):
    posted = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            posted.append((self.path, self.headers["Content-Type"], body))
            self.send_response(500 if "urn:bad" in body else 200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/values"
    values = [1, 2.5, 'a"ü', True, [1, {"k": 2}], {"@id": "urn:x"}]
    data = [row(f"urn:i{n % 2}", 'urn:p"', n, n, v) for n, v in enumerate(values)] + [row("urn:i0", "urn:q", 9, 0, 9, "urn:c")]
    df = created(spark, data)
    assert remote.put(df, url, batch=2) == 7
    assert {kind for _, kind, _ in posted} == {"application/json"} and all(body.count('"time"') <= 2 for _, _, body in posted)
    assert [path for path, _, body in posted if "urn:q" in body] == ["/values?model=urn%3Ac"]
    back = [r for path, _, body in posted for r in lf_json.parse(body, context="urn:c" if "model" in path else None)]
    columns = ("context", "item", "property", "time", "seqNr", "v_type", "v_long", "v_double", "v_string", "v_bool", "v_json")
    assert rows(created(spark, back), *columns) == rows(df, *columns)
    assert remote.put(df.limit(0), url) == 0
    with pytest.raises(Exception, match="500"):
        remote.put(created(spark, [row("urn:bad", "urn:p", 1, 0, 1)]), url)
    server.shutdown()


def test_closure_of_a_cycle_and_a_long_chain(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("a", "b"), ("b", "c"), ("c", "a")]
    found = {tuple(r) for r in catalog.closure(spark.createDataFrame(edges, "s string, o string")).collect()}
    want = {(f"n{i}", f"n{j}") for i in range(10) for j in range(i + 1, 10)} | {(x, y) for x in "abc" for y in "abc"}
    assert found == want
    assert catalog.closure(spark.createDataFrame([], "s string, o string")).isEmpty()


def test_generated_types(spark):
    kinds = ("int", "long", "float", "double", "decimal", "string", "uri", "bool", "record", "array")
    for kind in kinds:
        rows = generator.generate(spark, 2, 2, 3, v_type=kind).collect()
        assert len(rows) == 12 and {r.v_type for r in rows} == {kind} and all(r[HELD[kind]] is not None for r in rows)
    with pytest.raises(ValueError):
        generator.generate(spark, 1, 1, 1, v_type="other")


def test_delete_below(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.put(created(spark, [row(i, "urn:p", 1, 0, 1.0) for i in ("http://x/a", "http://x/a/b", "http://x/a/b/c", "http://x/ab")]))
    assert store.delete("http://x/a", below=True) == 3
    assert [r.item for r in store.read().collect()] == ["http://x/ab"]


def test_archival(spark, tmp_path):
    hot, cold = Store(spark, str(tmp_path / "hot")), Store(spark, str(tmp_path / "cold"))
    day = 86_400_000
    hot.put(created(spark, [row("urn:i", "urn:p", t * day, 0, float(t)) for t in (1, 2, 30)]))
    job = archival.Archival(hot, cold, "P7D", "PT0.2S")
    assert job.once(now=35 * day) == 2 and job.once(now=35 * day) == 0
    assert [r.time for r in hot.read().collect()] == [30 * day] and sorted(r.time for r in cold.read().collect()) == [day, 2 * day]
    job.start()
    for _ in range(300):
        if job.moved:
            break
        clock.sleep(0.1)
    job.stop()
    assert job.moved == 1 and job.error is None and hot.read().isEmpty()
    assert [archival.duration_ms(x) for x in ("P7D", "PT1H30M", "P1DT0.5S", "P2W")] == [7 * day, 5_400_000, day + 500, 14 * day]
    for wrong in ("P", "PT", "7D", "P1M"):
        with pytest.raises(ValueError):
            archival.duration_ms(wrong)


def test_typed_results(spark, tmp_path):
    rows = [("1", "1.5", "true", "007", None, 3, "1"), ("20", "2", "false", "8", None, 4, "x"), (None, None, None, None, None, 5, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f long, `g.h` string")
    results.write(df, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert dict(back.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string", "f": "bigint", "g.h": "string"}
    assert sorted((tuple(r) for r in back.collect()), key=lambda r: r[5]) == [(1, 1.5, True, "007", None, 3, "1"), (20, 2.0, False, "8", None, 4, "x"), (None, None, None, None, None, 5, None)]
