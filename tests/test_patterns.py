"""Graph patterns against plain Python expectations."""

import http.server
import json
import random
import threading
import urllib.parse

import pytest

from quadriver.plans.compiler import Engine, Solutions, to_values
from quadriver.plans.parser import parse
from quadriver.sources.documents import shell_uri
from quadriver.sources.values import created, row
from quadriver.store import Store

BASE = "http://example.org/"
START, ITEMS, POINTS = 1000, 10, 10
random.seed(200)
DATA = {(i, v): (START + (((i - 1) * POINTS) + v) * 10, v + 1, random.random()) for i in range(1, ITEMS + 1) for v in range(POINTS)}


def name(i):
    return f"{BASE}item-{i}"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [row(name(i), "property:value", t, s, x) for (i, _), (t, s, x) in DATA.items()]
    rows += [row(name(50), "property:record", 1000 + v, 0, {f"p:{n}": {"p:nested": float(n + v)} for n in range(5)}) for v in range(5)]
    rows += [row(name(51), "property:array", 1000 + v, 0, [v, "two", {"p:nested": float(v)}]) for v in range(5)]
    rows += [row(name(60 + n), "property:both", 1000 + v, 0, n * 100 + v) for n in range(2) for v in range(6)]
    rows += [row("part:1", f"urn:ch{k}.{kind}", 5000, s, s * k + 0.5) for k in (1, 2) for kind in ("angle", "force") for s in range(20)]
    rows += [row("urn:gtc", "urn:workpiece", 7, n, {"@id": f"urn:wp{n}"}) for n in range(4)]
    rows += [row(f"urn:wp{n}", "urn:section", t, 0, x) for n in range(4) for t, x in ((1, "begin"), (2, "begin" if n % 2 else "end"))]
    rows += [row(f"urn:wp{n}", "urn:size", 3, 0, n) for n in range(4)]
    one = [row(f"{BASE}item1", f"{BASE}p1", 1000, 0, 62.5)]
    two = [row(f"{BASE}item2", f"{BASE}p1", 1000, 0, 53.25)]
    triples = spark.createDataFrame([("urn:f", "urn:contains", "urn:a"), ("urn:a", "urn:contains", "urn:b"), ("urn:b", "urn:contains", name(1)), (name(1), "urn:label", "first")], "s string, p string, o string")
    return Engine(spark, {"ts:": created(spark, rows).cache(), "ts:one": created(spark, one), "ts:two": created(spark, two)}, triples)


def got(engine, text, *names):
    return sorted(tuple(r[n] for n in names) for r in engine.query(text, BASE).collect())


def newest(i, until=10**9, n=1):
    return sorted((x for (k, _), x in DATA.items() if k == i and x[0] <= until), reverse=True)[:n]


def test_newest_until_a_time(engine):
    rows = got(engine, "select * where { values ?item { <item-1> <item-2> } service <ts:> { ?item <property:value> ?v . ?v <ts:to> 1120 ; <ts:limit> 1 . ?v <ts:value> ?value ; <ts:time> ?time } }", "item", "time", "value")
    want = sorted((name(i), newest(i, 1120)[0][0], str(newest(i, 1120)[0][2])) for i in (1, 2))
    assert rows == want


def test_record_fields(engine):
    rows = got(engine, "select * { service <ts:> { <item-50> <property:record> ?v . ?v <ts:value> ?record ; <ts:time> ?time . ?record <p:3> [ <p:nested> ?value ] } }", "time", "value")
    assert rows == [(1000 + v, str(3.0 + v)) for v in range(5)]
    assert len(got(engine, "select ?p ?o { service <ts:> { <item-50> <property:record> [ <ts:value> ?r ; <ts:limit> 1 ] . ?r ?p ?o } }", "p", "o")) == 5


def test_value_json_and_arrays(engine):
    rows = got(engine, "select * { service <ts:> { <item-51> <property:array> [ <ts:valueJson> ?a ; <ts:value> ?b ; <ts:time> ?time ] . ?b rdf:_3 [ <p:nested> ?v3 ] ; rdf:_1 ?v1 } }", "time", "v1", "v3")
    assert rows == [(1000 + v, str(v), str(float(v))) for v in range(5)]
    assert got(engine, "select ?p { service <ts:> { <item-51> <property:array> [ <ts:value> ?b ; <ts:limit> 1 ] . ?b ?p ?x } }", "p")[0] == ("http://www.w3.org/1999/02/22-rdf-syntax-ns#_1",)


def test_limit_from_a_variable(engine):
    text = "select distinct * { values (?item ?limit) { (<item-1> 2) (<item-2> 4) } service <ts:> { ?item <property:value> [ <ts:value> ?value ; <ts:time> ?time ; <ts:limit> ?limit ] } }"
    rows = got(engine, text, "item", "time")
    assert rows == sorted((name(i), x[0]) for i, n in ((1, 2), (2, 4)) for x in newest(i, n=n))


def test_time_join_and_as_of_join(engine):
    rows = got(engine, "select * { service <ts:> { <item-60> <property:both> [ <ts:time> ?t ; <ts:to> 1003 ; <ts:value> ?a ] . <item-61> <property:both> [ <ts:time> ?t ; <ts:value> ?b ] } }", "t", "a", "b")
    assert rows == [(1000 + v, str(v), str(100 + v)) for v in range(4)]
    rows = got(engine, "select * { service <ts:> { <item-3> <property:value> [ <ts:time> ?t ; <ts:value> ?a ] . <item-1> <property:value> [ <ts:to> ?t ; <ts:limit> 1 ; <ts:value> ?b ; <ts:time> ?u ] } }", "t", "u")
    assert rows == [(x[0], newest(1, x[0])[0][0]) for x in sorted(newest(3, n=POINTS))]


def test_range_from_variables(engine):
    text = "select * { values (?a ?b) { (1001 1002) (1004 1009) } service <ts:> { <item-60> <property:both> [ <ts:from> ?a ; <ts:to> ?b ; <ts:time> ?t ] } }"
    assert got(engine, text, "a", "t") == [("1001", 1001), ("1001", 1002), ("1004", 1004), ("1004", 1005)]


def test_machine_shape(engine):
    text = """select * { values ?part { <part:1> } service <ts:> {
      { ?part <urn:ch1.angle> [ <ts:value> ?a1 ; <ts:time> ?t1 ; <ts:index> ?s ] ; <urn:ch1.force> [ <ts:value> ?f1 ; <ts:time> ?t1 ; <ts:index> ?s ] . }
      { ?part <urn:ch2.angle> [ <ts:value> ?a2 ; <ts:time> ?t2 ; <ts:index> ?s ] ; <urn:ch2.force> [ <ts:value> ?f2 ; <ts:time> ?t2 ; <ts:index> ?s ] . } } } order by ?part ?s"""
    rows = engine.query(text, BASE).collect()
    assert [r.s for r in rows] == list(range(20)) and [float(r.a2) for r in rows] == [2 * (19 - s) + 0.5 for s in range(20)]


def test_process_shape(engine):
    text = """select * { service <ts:> {
      { select distinct ?wp { <urn:gtc> <urn:workpiece> [ <ts:value> ?wp ] . } }
      ?wp <urn:section> [ <ts:value> "begin" ; <ts:limit> 1 ] .
      ?wp ?property [ <ts:value> ?v ; <ts:time> ?t ]. } }"""
    rows = got(engine, text, "wp", "property", "t", "v")
    assert rows == sorted((f"urn:wp{n}", p, t, v) for n in (1, 3) for p, t, v in (("urn:section", 1, "begin"), ("urn:section", 2, "begin"), ("urn:size", 3, str(n))))


def test_optional_services_and_sum(engine):
    text = "select (sum(?value) as ?total) { values ?item { <item1> <item2> } optional { service <ts:one> { ?item <p1> [ <ts:limit> 1 ; <ts:value> ?value ] } } optional { service <ts:two> { ?item <p1> [ <ts:limit> 1 ; <ts:value> ?value ] } } }"
    assert [r.total for r in engine.query(text, BASE).collect()] == [115.75]


def test_paths_union_minus_filter(engine):
    assert got(engine, "select ?x { <urn:f> <urn:contains>+ ?x }", "x") == [(name(1),), ("urn:a",), ("urn:b",)]
    assert len(got(engine, "select ?x { <urn:f> <urn:contains>* ?x }", "x")) == 4
    assert got(engine, "select ?l { <urn:a> <urn:contains>/<urn:contains>/<urn:label> ?l }", "l") == [("first",)]
    assert got(engine, "select ?x { ?x ^<urn:contains> <urn:f> }", "x") == [("urn:a",)]
    assert len(got(engine, "select ?x { { ?x <urn:contains> ?y } union { ?x <urn:label> ?y } }", "x")) == 4
    assert got(engine, "select ?x { ?x <urn:contains> ?y minus { ?y <urn:contains> ?z } }", "x") == [("urn:b",)]
    assert got(engine, "select ?x { ?x <urn:contains> ?y filter exists { ?x <urn:contains> <urn:b> } }", "x") == [("urn:a",)]
    text = "select ?item (count(*) as ?n) (max(?v) as ?m) { ?folder <urn:contains> ?item service <ts:> { ?item <property:value> [ <ts:value> ?v ] } filter(?v > 0.2 && ?v < 2) } group by ?item having (?n > 0) order by desc(?n) limit 3 offset 0"
    want = [x for _, _, x in newest(1, n=99) if x > 0.2]
    assert got(engine, text, "item", "n") == [(name(1), len(want))]


def test_aggregate_parameters_and_functions(engine):
    text = 'select ?t ?v (strlen(?v) as ?n) { service <ts:> { <item-60> <property:both> [ <ts:op> "sum" ; <ts:interval> 3 ; <ts:value> ?v ; <ts:time> ?t ] } bind(?t + 1 as ?u) filter(?u > 0) }'
    assert got(engine, text, "t", "v") == [(999, "1"), (1002, "9"), (1005, "5")]
    assert engine.ask("ask { <urn:f> <urn:contains> ?x }") and not engine.ask("ask { <urn:g> <urn:contains> ?x }")


def test_distinct_aggregates_and_separator(engine):
    text = "select (avg(distinct ?v) as ?a) (sum(distinct ?v) as ?s) (group_concat(distinct ?v; separator=',') as ?c) { values ?v { 1 3 3 8 } }"
    r = engine.query(text).first()
    assert (r.a, r.s, sorted(r.c.split(","))) == (4.0, 12.0, ["1", "3", "8"])
    assert got(engine, "select ?x { <urn:f> <urn:contains>? ?x }", "x") == [("urn:a",), ("urn:f",)]


@pytest.mark.parametrize("text", ["select", "select * { ?a }", "describe ?a { ?a ?b ?c }", "select * { x:y ?p ?o }", "select * { ?a ?b ?c"])
def test_malformed(text):
    with pytest.raises(ValueError):
        parse(text)


def test_unbound_parameter(engine):
    with pytest.raises(ValueError):
        engine.query("select * { service <ts:> { <item-1> <property:value> [ <ts:limit> ?n ; <ts:value> ?v ] } }", BASE)


def test_interval_and_op_from_variables(engine):
    # item-60 holds 0..5 at 1000..1005, item-61 holds 100..105
    ask = "select * { values (?item ?step ?how) { %s } service <ts:> { ?item <property:both> [ <ts:interval> ?step ; <ts:op> ?how ; <ts:time> ?t ; <ts:value> ?v ] } }"
    rows = got(engine, ask % '(<item-60> 2 "sum") (<item-61> 3 "max") (<item-61> 4 <http://x/avg>)', "item", "how", "t", "v")
    sums = [(name(60), "sum", t, str(2 * (t - 1000) + 1)) for t in (1000, 1002, 1004)]
    most = [(name(61), "max", 999, "101.0"), (name(61), "max", 1002, "104.0"), (name(61), "max", 1005, "105.0")]
    mean = [(name(61), "http://x/avg", 1000, "101.5"), (name(61), "http://x/avg", 1004, "104.5")]
    assert [r for r in rows if r[1] == "sum"] == sums
    assert [(*r[:3], str(float(r[3]))) for r in rows if r[1] == "max"] == most
    assert [r for r in rows if "avg" in r[1]] == mean
    with pytest.raises(Exception, match="unknown op"):
        got(engine, ask % '(<item-60> 2 "median")', "v")


def test_interval_from_a_variable_samples(engine):
    ask = "select * { values (?item ?step) { (<item-60> 4) (<item-61> 0) } service <ts:> { ?item <property:both> [ <ts:interval> ?step ; <ts:limit> 2 ; <ts:time> ?t ; <ts:value> ?v ] } }"
    assert got(engine, ask, "item", "t", "v") == [(name(60), 1000, "3"), (name(60), 1004, "5"), (name(61), 1004, "104"), (name(61), 1005, "105")]


def test_op_with_a_range_from_variables(engine):
    ask = 'select * { values (?item ?end) { (<item-60> 1003) } service <ts:> { ?item <property:both> [ <ts:to> ?end ; <ts:op> "sum" ; <ts:value> ?v ] } }'
    assert got(engine, ask, "v") == [("6",)]


def test_graph_of_a_variable(spark):
    rows = [row("urn:i", f"urn:{p}", t, 0, t, context) for context, p, t in (("urn:a", "x", 1), ("urn:a", "y", 2), ("urn:b", "x", 3), ("urn:b", "y", 4), ("urn:c", "x", 5))]
    engine = Engine(spark, {"ts:": created(spark, rows)})
    both = "graph ?g { <urn:i> <urn:x> [ <ts:time> ?a ] . <urn:i> <urn:y> [ <ts:time> ?b ] }"
    assert got(engine, f"select * {{ service <ts:> {{ {both} }} }}", "g", "a", "b") == [("urn:a", 1, 2), ("urn:b", 3, 4)]
    assert got(engine, f"select * {{ values ?g {{ <urn:b> }} service <ts:> {{ {both} }} }}", "g", "a", "b") == [("urn:b", 3, 4)]
    asof = "values (?g ?end) { (<urn:a> 9) (<urn:c> 9) } service <ts:> { graph ?g { <urn:i> <urn:x> [ <ts:to> ?end ; <ts:limit> 1 ; <ts:time> ?t ] } }"
    assert got(engine, f"select * {{ {asof} }}", "g", "t") == [("urn:a", 1), ("urn:c", 5)]
    assert got(engine, "select * { service <ts:> { <urn:i> <urn:x> [ <ts:time> ?a ] } }", "a") == []


def test_encoded_names(engine):
    assert got(engine, 'select * { values ?x { "a b*~/" } bind(encode_for_uri(?x) as ?y) }', "y") == [("a%20b%2A~%2F",)]


def test_construct_and_insert(spark, tmp_path):
    rows = [row("urn:i", "urn:x", t, 0, t + 0.5) for t in (1, 2)] + [row("urn:i", "urn:y", 1, 0, {"@id": "urn:z"})]
    triples = spark.createDataFrame([("urn:a", "urn:p", "urn:b")], "s string, p string, o string")
    engine, store = Engine(spark, {"ts:": created(spark, rows)}, triples), Store(spark, str(tmp_path / "s"))
    found = "service <ts:> { <urn:i> <urn:x> [ <ts:time> ?t ; <ts:value> ?v ] }"
    made = {tuple(r) for r in engine.query(f"construct {{ <urn:i> <urn:at> ?t . [] <urn:of> ?t ; <urn:none> ?unbound }} where {{ {found} }}").collect()}
    assert {x for x in made if x[0] == "urn:i"} == {("urn:i", "urn:at", "1"), ("urn:i", "urn:at", "2")}
    nodes = [x for x in made if x[0] != "urn:i"]
    assert sorted(x[1:] for x in nodes) == [("urn:of", "1"), ("urn:of", "2")] and len({x[0] for x in nodes}) == 2
    engine.update(f"insert {{ <urn:b> <urn:p> <urn:c> . <urn:i> <urn:at> ?t }} where {{ {found} }}")
    assert got(engine, "select ?x { <urn:a> <urn:p>+ ?x }", "x") == [("urn:b",), ("urn:c",)]
    assert got(engine, "select ?t { <urn:i> <urn:at> ?t }", "t") == [("1",), ("2",)]
    engine.update('insert data { graph <ts:> { <item-1> <urn:value> 5 , "5" , <urn:u> , true . <item-2> <urn:value> [ <ts:value> 2.5 ; <ts:time> 7 ; <ts:seqNr> 3 ] } graph <ts:urn:other> { <item-3> <urn:value> 1 } }', BASE, store, now=9)
    held = {(r.context, r.item, r.time, r.seqNr, r.v_type, r.v_long, r.v_double, r.v_string, r.v_bool) for r in store.read().collect()}
    nil = "ts:nil"
    one = [h for h in held if h[1] == name(1)]  # the same time and sequence number: one of the four stays
    assert len(one) == 1 and one[0][:4] == (nil, name(1), 9, 0)
    assert held - set(one) == {(nil, name(2), 7, 3, "double", None, 2.5, None, None), ("urn:other", name(3), 9, 0, "long", 1, None, None, None)}
    for wrong in ("select * { ?s ?p ?o }", "insert data { graph <urn:g> { <urn:a> <urn:b> 1 } }", "insert { <urn:a> <urn:p>+ ?o } where { ?a <urn:p> ?o }"):
        with pytest.raises(ValueError):
            engine.update(wrong, store=store)
    with pytest.raises(ValueError):
        engine.query("insert data { <urn:a> <urn:b> 1 }")


def test_typed_values(spark):
    rows = [("urn:a", "urn:p", "5", "any"), ("urn:b", "urn:p", "5", "string"), ("urn:c", "urn:p", "urn:d", "uri"), ("urn:d", "urn:p", "true", "any")]
    found = to_values(spark.createDataFrame(rows, "s string, p string, o string, o_type string"), "ts:")
    assert sorted((r.item, r.v_type, r.v_long, r.v_string, r.v_bool) for r in found.collect()) == [
        ("urn:a", "long", 5, None, None), ("urn:b", "string", None, "5", None), ("urn:c", "uri", None, "urn:d", None), ("urn:d", "bool", None, None, True)]


def test_joins_on_variables_that_may_be_unbound(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    left, right = [("1", "a", "x"), ("2", None, "x"), ("3", "b", None), ("4", None, None)], [("a", "x", "p"), (None, "x", "q"), ("b", None, "r"), ("c", "y", "s")]
    agree = lambda p, q: p is None or q is None or p == q
    one = lambda p, q: q if p is None else p
    engine = Engine(spark, {})
    a = lambda names: Solutions(frame([tuple(r[i] for i in (0, *names)) for r in left], ["id", *["uv"[i - 1] for i in names]]), {"uv"[i - 1] for i in names})
    for how in ("inner", "left"):
        for maybe in ({"u", "v"}, set()):
            kept = [r for r in right if maybe or None not in r]
            b = Solutions(frame(kept, ["u", "v", "w"]), set(maybe))
            found = engine.join(a((1, 2)), b, how)
            want = [(r[0], one(r[1], s[0]), one(r[2], s[1]), s[2]) for r in left for s in kept if agree(r[1], s[0]) and agree(r[2], s[1])]
            want += [(*r, None) for r in left if how == "left" and r[0] not in {w[0] for w in want}]
            assert sorted(map(str, map(tuple, found.df.select("id", "u", "v", "w").collect()))) == sorted(map(str, want))
            assert {n for n in "uvw" if any(r[i] is None for r in want for i in (["id", "u", "v", "w"].index(n),))} <= found.maybe
    empty = engine.join(a((1,)), Solutions(frame([], ["z"])), "left")
    assert len(empty.df.collect()) == 4 and "z" in empty.maybe


def test_second_optional_meets_on_a_key(spark):
    engine = Engine(spark, {}, spark.createDataFrame([("a", "p", "1"), ("a", "q", "1"), ("c", "r", "1"), ("d", "p", "2")], "s string, p string, o string"))
    text = "select * { ?s <p> ?o optional { ?s <q> ?x } optional { ?y <r> ?x } }"
    assert sorted((r.s, r.x, r.y) for r in engine.query(text).collect()) == [("a", "1", "c"), ("d", "1", "c")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = engine.query(text)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan


def test_shells_behind_an_endpoint(spark):
    seen = []
    model = {"id": "urn:m/1", "idShort": "Nameplate", "modelType": "Submodel", "submodelElements": [{"idShort": "Maker", "modelType": "Property", "value": "X"}]}
    shell = lambda n, ids: {"id": f"urn:s{n}", "idShort": f"S{n}", "modelType": "AssetAdministrationShell", "submodels": [{"type": "ModelReference", "keys": [{"type": "Submodel", "value": i}]} for i in ids]}
    answers = {"/api/shells": {"result": [shell(1, ["urn:m/1"]), shell(2, ["urn:m/1", "urn:gone"])], "paging_metadata": {"cursor": "n2"}}, "/api/shells?cursor=n2": {"result": [shell(3, [])], "paging_metadata": {}}, "/api/submodels/" + shell_uri("urn:m/1").removeprefix("urn:aas:"): model}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            self.send_response(200 if self.path in answers else 404)
            self.end_headers()
            self.wfile.write(json.dumps(answers.get(self.path, "")).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    engine = Engine(spark, {})
    service, aas = f"service <aas-api:http://127.0.0.1:{server.server_port}/api>", "prefix aas: <urn:aas-model:>"
    assert got(engine, f"select * {{ {service} {{ <aas-api:endpoint> <aas-api:shells> ?s }} }}", "s") == [(shell_uri(f"urn:s{n}"),) for n in (1, 2, 3)]
    assert len(seen) == len(set(seen)) == 4
    asked = f"{aas} select distinct ?short {{ {service} {{ <aas-api:endpoint> <aas-api:shells> ?shell . ?shell aas:submodels ?sm . ?sm (!<:>)+ ?e . ?e a aas:Property ; aas:idShort ?short }} }}"
    assert got(engine, asked, "short") == [("Maker",)]
    assert len(seen) == 4  # read once
    engine.update(f"{aas} insert {{ ?sm ?p ?o }} where {{ {service} {{ ?shell aas:submodels ?sm . ?sm ?p ?o }} }}")
    assert (shell_uri("urn:m/1"), "Nameplate") in got(engine, f"{aas} select * {{ ?s aas:idShort ?o }}", "s", "o")
    server.shutdown()


def test_remote_services(engine):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query)
            seen.append(asked)
            held = {name(i): {"property:value": [{"time": t, "value": t + i} for t in (3, 2, 1)]} for i in (1, 2)}
            item = asked.get("item", [None])[0]
            held = {i: v for i, v in held.items() if item in (None, i)}
            self.send_response(200 if held and self.path.startswith("/top/values") else 404)
            self.end_headers()
            self.wfile.write(json.dumps(held).encode() if held else b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    service = f"service <ts:http://127.0.0.1:{server.server_port}/top>"
    assert got(engine, f"select * {{ {service} {{ <item-1> <property:value> [ <ts:limit> 1 ; <ts:value> ?v ] }} }}", "v") == [("4",)]
    assert all(s == {"item": [name(1)], "properties": ["property:value"], "limit": ["1"]} for s in seen) and seen
    seen.clear()
    local = "service <ts:> { ?item <property:value> [ <ts:limit> 1 ; <ts:time> ?t ] } filter(?item != <item-9>)"
    two = f"values ?item {{ <item-1> <item-2> <item-3> }} {service} {{ ?item <property:value> [ <ts:to> 2 ; <ts:limit> 1 ; <ts:value> ?v ] }}"
    assert got(engine, f"select * {{ {two} {local} }}", "item", "v") == [(name(1), "3"), (name(2), "4")]
    assert {s["item"][0] for s in seen} == {name(1), name(2), name(3)}
    maybe = f"values ?item {{ <item-1> <item-3> }} optional {{ {service} {{ ?item <property:value> [ <ts:limit> 1 ; <ts:value> ?v ] }} }}"
    assert got(engine, f"select * {{ {maybe} }}", "item", "v") == [(name(1), "4"), (name(3), None)]
    assert len(got(engine, f"select * {{ {service} {{ ?item <property:value> [ <ts:value> ?v ] }} }}", "item")) == 6
    with pytest.raises(ValueError, match="unknown service"):
        engine.query("select * { service <http://127.0.0.1/other> { ?item <property:value> [ <ts:value> ?v ] } }")
    server.shutdown()
