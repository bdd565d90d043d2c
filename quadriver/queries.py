"""Each operator as a query over the given tables, with SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .functions import records, values
from .operators import catalog, fetch, joins, sets
from .plans.compiler import Engine
from .schema import COLUMNS, DEFAULT_CONTEXT, num, text, value_key
from .sources import csv_wide, lf_json, line_protocol
from .sources.values import parsed
from .store import Store, checkpointed, expiry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DAY = 86_400_000
BEGIN, END = 1_704_067_200_000 + 3 * DAY, 1_704_067_200_000 + 17 * DAY
USERS = [f"urn:user:{i}" for i in range(1, 11)]

EVENTS = f"""ev AS (
  SELECT '{DEFAULT_CONTEXT}' AS context, 'urn:user:' || user_id AS item, 'urn:event:' || event_type AS property, epoch_us(ts) // 1000 AS time,
    (event_id % 2147483647)::INT AS "seqNr", value, props
  FROM events
)"""
ORDERS = """od AS (
  SELECT 'http://ex/' || r_name || '/' || n_name || '/c' || c_custkey AS item, epoch_us(o_orderdate) // 1000 AS time,
    (row_number() OVER (PARTITION BY c_custkey, o_orderdate ORDER BY o_orderkey) - 1)::INT AS "seqNr", o_totalprice AS price, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY context, item, property ORDER BY time DESC, "seqNr" DESC) AS rn FROM ev
)"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def ev(spark: SparkSession, d: str, kind: str | None = None, begin: int | None = None, end: int | None = None) -> DataFrame:
    return views.events(spark, d, kind, begin, end)


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("item", "property", "time", "seqNr", *more, num().alias("value"))


COLS = 'item, property, time, "seqNr", value'


@query(f"WITH {EVENTS} SELECT {COLS} FROM ev WHERE time BETWEEN {BEGIN} AND {END}")
def fetch_range(spark, d):
    return shown(fetch.fetch(ev(spark, d, None, BEGIN, END), begin=BEGIN, end=END))


@query(f"WITH {EVENTS}, {RANKED} SELECT {COLS} FROM ranked WHERE rn <= 5")
def fetch_limit_per_series(spark, d):
    return shown(fetch.fetch(ev(spark, d), limit=5))


@query(f"WITH {EVENTS}, {RANKED} SELECT {COLS} FROM ranked WHERE rn <= 3 AND item IN ({', '.join(repr(u) for u in USERS)}) AND property IN ('urn:event:click', 'urn:event:view')")
def fetch_items_batch(spark, d):
    return shown(fetch.fetch(ev(spark, d), USERS, ["urn:event:click", "urn:event:view"], limit=3))


@query(f"WITH {EVENTS}, {RANKED}, k AS (SELECT DISTINCT 'urn:user:' || user_id AS item FROM events WHERE value > 60) SELECT {COLS} FROM ranked SEMI JOIN k USING (item) WHERE rn <= 2")
def fetch_items_table(spark, d):
    keys = views.table(spark, d, "events").where("value > 60").select(F.concat(F.lit("urn:user:"), "user_id").alias("item"))
    return shown(fetch.fetch(ev(spark, d), keys, limit=2))


@query(f"WITH {ORDERS} SELECT item, time, \"seqNr\", price AS value FROM od WHERE time = {852_076_800_000}")
def fetch_time_point(spark, d):
    return fetch.at_time(views.orders(spark, d).where("property = 'http://ex/p/totalprice'"), 852_076_800_000).select("item", "time", "seqNr", num().alias("value"))


@query(f"WITH {EVENTS}, {RANKED} SELECT {COLS} FROM ranked WHERE rn = 1 AND value > 20")
def latest_then_value_filter(spark, d):
    return shown(fetch.fetch(ev(spark, d), limit=1)).where("value > 20")


@query(f"WITH {EVENTS}, {RANKED} SELECT {COLS} FROM ranked WHERE rn <= 4 AND \"seqNr\" % 3 = 0")
def seq_after_limit(spark, d):
    return shown(fetch.fetch(ev(spark, d), limit=4)).where("seqNr % 3 = 0")


@query(f"WITH {EVENTS}, {RANKED} SELECT {COLS}, rn - 1 AS idx FROM ranked WHERE rn - 1 IN (0, 3)")
def index_column(spark, d):
    return shown(fetch.with_index(ev(spark, d)), "idx").where("idx in (0, 3)")


def _bucketed(expr: str, interval: int) -> str:
    at = f"time - time % {interval}" if interval else "0::BIGINT"
    return f"""WITH {EVENTS}, b AS (SELECT item, property, {at} AS t, {expr} AS value FROM ev GROUP BY ALL)
SELECT item, property, t AS time, row_number() OVER (PARTITION BY item, property ORDER BY t DESC)::INT AS "seqNr", value FROM b"""


def _rounded(df: DataFrame) -> DataFrame:
    return shown(df).withColumn("value", F.round("value", 6))


for _op, _expr in (("min", "min(value)"), ("max", "max(value)"), ("avg", "avg(value)"), ("sum", "sum(value)")):

    def _agg(spark, d, op=_op):
        return _rounded(fetch.fetch(ev(spark, d), interval=DAY, op=op))

    _agg.__name__ = f"agg_{_op}"
    query(_bucketed(f"round({_expr}, 6)", DAY))(_agg)


@query(_bucketed("arg_max(value, (time, \"seqNr\"))", DAY))
def agg_first(spark, d):
    return shown(fetch.fetch(ev(spark, d), interval=DAY, op="first"))


@query(_bucketed("round(sum(value), 6)", 0))
def agg_whole_range(spark, d):
    return _rounded(fetch.fetch(ev(spark, d), op="sum"))


@query(f"SELECT * FROM ({_bucketed('round(avg(value), 6)', DAY)}) WHERE \"seqNr\" <= 2")
def agg_limit_buckets(spark, d):
    return _rounded(fetch.fetch(ev(spark, d), interval=DAY, op="avg", limit=2))


@query(f"WITH {ORDERS}, b AS (SELECT item, time - time % {365 * DAY} AS time, sum(\"seqNr\")::BIGINT AS total FROM od GROUP BY ALL) SELECT item, time, total FROM b")
def agg_sum_integers(spark, d):
    o = views.orders(spark, d).where("property = 'http://ex/p/totalprice'")
    whole = o.withColumn("v_long", F.col("seqNr").cast("long")).withColumn("v_double", F.lit(None).cast("double"))
    return fetch.aggregate(whole, "sum", 365 * DAY).select("item", "time", F.col("v_long").alias("total"))


@query(f"WITH {ORDERS} SELECT item, max(status) AS last_status FROM od GROUP BY item")
def agg_max_text(spark, d):
    o = views.orders(spark, d).where("property = 'http://ex/p/status'")
    return fetch.aggregate(o, "max").select("item", F.col("v_string").alias("last_status"))


@query(f"SELECT * FROM ({_bucketed('arg_max(value, (time, \"seqNr\"))', DAY)}) WHERE \"seqNr\" <= 3")
def sample_interval(spark, d):
    return shown(fetch.fetch(ev(spark, d), interval=DAY, limit=3))


@query("SELECT DISTINCT 'urn:event:' || event_type AS property FROM events")
def properties(spark, d):
    return catalog.properties(ev(spark, d))


@query(f"WITH {ORDERS} SELECT DISTINCT item FROM od WHERE starts_with(item, 'http://ex/ASIA/') ORDER BY item LIMIT 40")
def descendants_prefix(spark, d):
    return catalog.descendants(views.orders(spark, d), "http://ex/ASIA", limit=40, strict=True)


@query(f"""WITH {EVENTS}, a AS (SELECT item, time // 3600000 AS time, max(value) AS value FROM ev WHERE property = 'urn:event:click' GROUP BY ALL),
b AS (SELECT item, time // 3600000 AS time, max(value) AS value FROM ev WHERE property = 'urn:event:view' GROUP BY ALL)
SELECT a.item, time, a.value AS l_value, b.value AS r_value FROM a JOIN b USING (item, time)""")
def time_join(spark, d):
    hours = lambda kind: ev(spark, d, kind).groupBy("item", F.expr("time div 3600000").alias("time")).agg(F.max(num()).alias("value"))
    a, b = hours("click"), hours("view")
    return joins.time_join(a, b, by=("item",))


@query(f"""WITH {EVENTS}, {RANKED}, i AS (SELECT *, rn - 1 AS idx FROM ranked)
SELECT a.item, idx, a.time AS l_time, b.time AS r_time, a.value AS l_value, b.value AS r_value FROM i a JOIN i b USING (item, idx) WHERE a.property = 'urn:event:click' AND b.property = 'urn:event:view'""")
def time_index_join(spark, d):
    a, b = (fetch.with_index(ev(spark, d, k)).select("item", "idx", "time", num().alias("value")) for k in ("click", "view"))
    return joins.index_join(a, b, by=("item",))


_ASOF = f"""WITH {EVENTS}, a AS (SELECT * FROM ev WHERE property = 'urn:event:click'),
b AS (SELECT item, time, arg_max(value, "seqNr") AS value FROM ev WHERE property = 'urn:event:view' GROUP BY item, time)
SELECT a.item, a.time, a.value, b.time AS r_time, b.value AS r_value FROM a ASOF {{}} JOIN b ON a.item = b.item AND a.time >= b.time"""


def _asof(spark, d, **options):
    a, b = (ev(spark, d, k).select("item", "time", "seqNr", num().alias("value")) for k in ("click", "view"))
    return joins.asof_join(a.drop("seqNr"), b, ["item"], ["value"], **options)


@query(_ASOF.format(""))
def asof_previous(spark, d):
    return _asof(spark, d)


@query(_ASOF.format("LEFT"))
def asof_left_in_spans(spark, d):
    return _asof(spark, d, how="left", span=7 * DAY)


@query(f"""WITH {EVENTS} SELECT a.item, a.time AS begin, b.time AS r_time, b.value AS r_value FROM ev a JOIN ev b ON a.item = b.item AND b.time BETWEEN a.time AND a.time + {2 * DAY}
WHERE a.property = 'urn:event:error' AND b.property = 'urn:event:click'""")
def range_join(spark, d):
    a = ev(spark, d, "error").select("item", F.col("time").alias("begin"), (F.col("time") + 2 * DAY).alias("end"))
    b = ev(spark, d, "click").select("item", "time", num().alias("value"))
    return joins.range_join(a, b, ["item"]).drop("end")


_PARAMS = [(f"urn:user:{i}", i) for i in range(1, 6)]


@query(f"WITH {EVENTS}, {RANKED}, p(item, lim) AS (VALUES {', '.join(f'({i!r}, {n}::BIGINT)' for i, n in _PARAMS)}) SELECT item, property, time, \"seqNr\", lim, value FROM p JOIN ranked USING (item) WHERE rn <= lim")
def param_limit_join(spark, d):
    params = spark.createDataFrame(_PARAMS, "item string, lim long")
    return shown(joins.limit_join(params, ev(spark, d), ["item"], "lim"), "lim")


_CUSTOMER_ITEM = "SELECT 'http://ex/' || r_name || '/' || n_name || '/c' || c_custkey AS item FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _latest_price(spark, d):
    return fetch.fetch(views.orders(spark, d), properties="http://ex/p/totalprice", limit=1).select("item", num().alias("price"))


_LATEST = 'SELECT item, arg_max(price, (time, "seqNr")) AS price FROM od GROUP BY item'


@query(f"WITH {ORDERS}, c AS ({_CUSTOMER_ITEM}), l AS ({_LATEST}) SELECT item, price FROM c LEFT JOIN l USING (item)")
def optional_left(spark, d):
    return joins.shared_join(views.customer_items(spark, d), _latest_price(spark, d), "left")


@query(f"WITH {ORDERS}, c AS ({_CUSTOMER_ITEM}) SELECT item FROM c ANTI JOIN od USING (item)")
def minus_anti(spark, d):
    return sets.minus(views.customer_items(spark, d), views.orders(spark, d).select("item"))


@query(f"WITH {ORDERS}, c AS ({_CUSTOMER_ITEM}) SELECT item FROM c SEMI JOIN od USING (item)")
def exists_semi(spark, d):
    return joins.shared_join(views.customer_items(spark, d), views.orders(spark, d).select("item"), "left_semi")


@query(f"""WITH {EVENTS}, {ORDERS} SELECT item, time, value AS number, NULL AS status FROM ev WHERE property = 'urn:event:error'
UNION ALL SELECT item, time, NULL, status FROM od""")
def union_series(spark, d):
    a = ev(spark, d, "error").select("item", "time", num().alias("number"))
    b = views.orders(spark, d).where("property = 'http://ex/p/status'").select("item", "time", F.col("v_string").alias("status"))
    return sets.union(a, b)


_KIND = "SELECT 'urn:user:' || user_id AS item FROM events WHERE event_type = '{}'"


def _items_with(spark, d, kind):
    return ev(spark, d, kind).select("item")


@query(f"{_KIND.format('error')} INTERSECT {_KIND.format('purchase')}")
def intersect(spark, d):
    return sets.intersection(_items_with(spark, d, "error"), _items_with(spark, d, "purchase"))


@query(f"SELECT DISTINCT item FROM ({_KIND.format('view')}) EXCEPT {_KIND.format('error')}")
def except_items(spark, d):
    return sets.minus(_items_with(spark, d, "view").distinct(), _items_with(spark, d, "error"))


@query(f"WITH {EVENTS}, {RANKED}, p(item, label) AS (VALUES ('urn:user:1', 'a'), ('urn:user:2', 'b')) SELECT item, label, property, value FROM p JOIN ranked USING (item) WHERE rn = 1")
def values_join(spark, d):
    given = spark.createDataFrame([("urn:user:1", "a"), ("urn:user:2", "b")], "item string, label string")
    return joins.shared_join(given, fetch.fetch(ev(spark, d), limit=1)).select("item", "label", "property", num().alias("value"))


@query("SELECT r_name, n_name FROM region, nation")
def cross_product(spark, d):
    return joins.shared_join(views.table(spark, d, "region").select("r_name"), views.table(spark, d, "nation").select("n_name"))


@query("SELECT 'urn:user:' || user_id AS item, event_id, (props->>'$.k')::BIGINT AS k FROM events")
def record_field(spark, d):
    return views.event_records(spark, d).select("item", F.col("seqNr").cast("long").alias("event_id"), records.field(F.col("v_json"), "k").cast("long").alias("k"))


@query("SELECT event_id, p, props->>('$.' || p) AS v FROM events, unnest(json_keys(props)) AS u(p)")
def record_enumerate(spark, d):
    rows = views.event_records(spark, d).select(F.col("seqNr").cast("long").alias("event_id"), "v_json")
    return records.entries(rows, "v_json").select("event_id", "p", "v")


@query("SELECT 'urn:vec:' || vec_id AS item, embedding[1]::DOUBLE AS first_x, embedding[64]::DOUBLE AS last_x, embedding[65]::DOUBLE AS beyond FROM embeddings")
def array_element(spark, d):
    at = lambda n, name: records.element(F.col("v_json"), n).cast("float").cast("double").alias(name)
    return views.embeddings(spark, d).select("item", at(1, "first_x"), at(64, "last_x"), at(65, "beyond"))


@query("SELECT 'urn:vec:' || vec_id AS item, unnest(range(1, len(embedding) + 1)) AS position, unnest(embedding)::DOUBLE AS x FROM embeddings")
def array_enumerate(spark, d):
    return records.elements(views.embeddings(spark, d).select("item", "v_json"), "v_json", "float").select("item", "position", F.col("element").cast("double").alias("x"))


@query("SELECT 'urn:user:' || user_id AS item, epoch_us(ts) // 1000 AS time, props AS value FROM events")
def value_json(spark, d):
    return views.event_records(spark, d).select("item", "time", text().alias("value"))


@query(f"""WITH {EVENTS} SELECT time, "seqNr", max(value::VARCHAR) FILTER (item = 'urn:user:1' AND property = 'urn:event:click')::DOUBLE AS a, max(value) FILTER (item = 'urn:user:2' AND property = 'urn:event:view') AS b
FROM ev WHERE (item = 'urn:user:1' AND property = 'urn:event:click') OR (item = 'urn:user:2' AND property = 'urn:event:view') GROUP BY ALL""")
def csv_wide_pivot(spark, d):
    names = ["<urn:user:1>@<urn:event:click>", "<urn:user:2>@<urn:event:view>"]
    rows = ev(spark, d).where("(item = 'urn:user:1' and property = 'urn:event:click') or (item = 'urn:user:2' and property = 'urn:event:view')")
    return csv_wide.pivoted(rows, names).select("time", "seqNr", *[F.col(f"`{n}`").cast("double").alias(x) for n, x in zip(names, "ab", strict=True)])


_LINES = "epoch_us(l_shipdate) // 1000 AS time, (l_orderkey * 8 + l_linenumber)::INT AS \"seqNr\""


@query(" UNION ALL ".join(f"SELECT 'urn:part:' || l_partkey AS item, 'urn:{c}' AS property, {_LINES}, l_{c} AS value FROM lineitem" for c in ("quantity", "extendedprice", "discount")))
def unpivot_long(spark, d):
    return shown(views.lineitem(spark, d))


@query(f"""WITH {EVENTS}, copies AS (SELECT *, 1 AS ver FROM ev UNION ALL SELECT context, item, property, time, "seqNr", value + 1, props, 2 FROM ev WHERE value > 30)
SELECT item, property, time, "seqNr", arg_max(value, ver) AS value FROM copies GROUP BY ALL""")
def dedup_last_write(spark, d):
    rows = ev(spark, d).withColumn("ingest_ts", F.lit(1))
    newer = rows.where("v_double > 30").withColumn("v_double", F.col("v_double") + 1).withColumn("ingest_ts", F.lit(2))
    return shown(sets.last_write_wins(rows.unionByName(newer)))


@query(f"WITH e AS (SELECT DISTINCT 'http://ex/' || r_name AS parent, 'http://ex/' || r_name || '/' || n_name AS child FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT * FROM e UNION ALL SELECT regexp_replace(item, '/[^/]*$', ''), item FROM ({_CUSTOMER_ITEM})")
def hierarchy_edges(spark, d):
    return catalog.hierarchy_edges(views.customer_items(spark, d))


@query(f"""WITH RECURSIVE i AS ({_CUSTOMER_ITEM}), e AS (SELECT DISTINCT regexp_replace(item, '/[^/]*/[^/]*$', '') AS s, regexp_replace(item, '/[^/]*$', '') AS o FROM i UNION SELECT regexp_replace(item, '/[^/]*$', ''), item FROM i),
r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, count(*) AS below FROM r GROUP BY s""")
def closure_counts(spark, d):
    edges = catalog.hierarchy_edges(views.customer_items(spark, d)).select(F.col("parent").alias("s"), F.col("child").alias("o"))
    return catalog.closure(edges).groupBy("s").agg(F.count("*").alias("below"))


@query(f"""WITH {EVENTS}, c AS (SELECT *, CASE WHEN property = 'urn:event:click' AND "seqNr" % 2 = 0 AND value < 10 THEN 1 ELSE 2 END AS r FROM ev)
SELECT item, property, time, "seqNr", value FROM (SELECT *, min(r) OVER (PARTITION BY item, property) AS m FROM c) WHERE r = m""")
def context_fallback(spark, d):
    rows = ev(spark, d)
    first = (F.col("property") == "urn:event:click") & (F.col("seqNr") % 2 == 0) & (num() < 10)
    return shown(fetch.in_contexts(rows.withColumn("context", F.when(first, "urn:a").otherwise("urn:b")), ["urn:a", "urn:b"]))


@query(f"WITH {EVENTS}, {RANKED} SELECT item, round(sum(value), 6) AS total, count(DISTINCT property) AS kinds FROM ranked WHERE rn <= 10 GROUP BY item ORDER BY total DESC, item LIMIT 20 OFFSET 5")
def group_order_slice(spark, d):
    rows = fetch.fetch(ev(spark, d), limit=10)
    return rows.groupBy("item").agg(F.round(F.sum(num()), 6).alias("total"), F.count_distinct("property").alias("kinds")).orderBy(F.desc("total"), "item").offset(5).limit(20)


@query(f"WITH {EVENTS} SELECT DISTINCT item, property FROM ev")
def distinct_series(spark, d):
    return ev(spark, d).select("item", "property").distinct()


@query(f"WITH {EVENTS}, {RANKED}, k AS (SELECT item, property, CASE WHEN value = floor(value) THEN 1 ELSE 0 END AS whole FROM ranked WHERE rn = 1) SELECT a.item, a.property, b.item AS other FROM ranked a JOIN ranked b ON a.value = b.value AND a.property = b.property AND a.item < b.item WHERE a.rn = 1 AND b.rn = 1")
def value_equality_join(spark, d):
    latest = fetch.fetch(ev(spark, d), limit=1).select("item", "property", value_key().alias("k"))
    return latest.alias("a").join(latest.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.property") == F.col("b.property")) & (F.col("a.item") < F.col("b.item"))).select("a.item", "a.property", F.col("b.item").alias("other"))


@query(f"WITH {EVENTS} SELECT item, time, make_timestamp(time * 1000) AS at FROM ev")
def date_time(spark, d):
    return ev(spark, d).select("item", "time", values.date_time(F.col("time")).cast("timestamp_ntz").alias("at"))


@query(f"WITH {EVENTS} SELECT item, time, strftime(make_timestamp((time + 7200000) * 1000), '%Y-%m-%d %H:%M:%S') AS at FROM ev")
def date_format(spark, d):
    return ev(spark, d).select("item", "time", values.format_time(F.col("time"), "yyyy-MM-dd HH:mm:ss", -120).alias("at"))


@query("SELECT event_id, 'http://ex/users/' || user_id AS full_name FROM events")
def expand_names(spark, d):
    e = views.table(spark, d, "events")
    return e.select("event_id", values.expand_name(F.concat(F.lit("u:"), "user_id"), {"u": "http://ex/users/"}).alias("full_name"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE l_quantity END AS number FROM lineitem")
def number_in_text(spark, d):
    price = F.format_number("l_extendedprice", 2)
    comma = F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(","))
    x = F.when(F.col("l_linenumber") % 2 == 0, price).otherwise(comma)
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.number_in(x).alias("number"))


@query("SELECT DISTINCT o_orderdate AS day, ceil(dayofyear(o_orderdate) / 7)::INT AS week FROM orders")
def aligned_week(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderdate").alias("day")).distinct()
    return o.select("day", fetch.aligned_week(F.unix_millis(F.col("day").cast("timestamp"))).alias("week"))


@query(f"WITH {EVENTS} SELECT {COLS} FROM ev WHERE NOT (item = 'urn:user:3' AND time BETWEEN {BEGIN} AND {END})")
def delete_complement(spark, d):
    rows = ev(spark, d)
    gone = fetch.in_range(rows.where("item = 'urn:user:3'"), BEGIN, END).select(*sets.PRIMARY)
    return shown(sets.minus(rows, gone))


@query(f"WITH {EVENTS}, e AS (SELECT *, max(time) OVER () AS now FROM ev) SELECT item, property, time, \"seqNr\", value FROM e WHERE property <> 'urn:event:view' OR time >= now - 2 * {DAY}")
def expire_filter(spark, d):
    rows = ev(spark, d)
    now = rows.agg(F.max("time").alias("now"))
    marked = F.when(F.col("property") == "urn:event:view", F.concat("item", F.lit("?ttl=2d"))).otherwise(F.col("item"))
    return shown(rows.join(F.broadcast(now)).where(F.coalesce(F.col("time") >= F.col("now") - expiry(marked), F.lit(True))))


@query("SELECT 'urn:user:' || user_id AS item, sum(length(props) + length((epoch_us(ts) // 1000)::VARCHAR))::BIGINT AS chars, count(*) AS n FROM events GROUP BY ALL")
def json_writer(spark, d):
    """The documents' own parts: each value's JSON and time, read back from the written text."""
    written = lf_json.written(views.event_records(spark, d).withColumn("seqNr", F.lit(0)))
    body = F.regexp_extract("json", r'^\{"[^"]*":\{"urn:props":(.*)\}\}$', 1)
    back = F.from_json(body, "array<struct<time:bigint,value:string>>")
    chars = F.aggregate(back, F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x["value"], ":", ": ")) + F.length(x["time"].cast("string")))
    return written.select("item", chars.alias("chars"), F.size(back).cast("long").alias("n"))


def _folder(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    checkpointed(spark.range(0))  # sets the folder where it is unset
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {EVENTS} SELECT {COLS} FROM ev")
def json_round_trip(spark, d):
    """Values through the text of their documents."""
    return shown(parsed(lf_json.written(ev(spark, d)).select("json"), lf_json.parse))


@query("SELECT 'urn:user:' || user_id AS item, epoch_us(ts) // 1000 AS time, event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_record_round_trip(spark, d):
    back = parsed(lf_json.written(views.event_records(spark, d)).select("json"), lf_json.parse)
    return back.where("property = 'urn:props' and v_type = 'record'").select("item", "time", F.col("seqNr").cast("long").alias("event_id"), records.field(F.col("v_json"), "k").cast("long").alias("k"))


@query(f"""WITH {EVENTS} SELECT item || ',b=c' AS item, property, time, value, NULL AS label FROM ev
UNION ALL SELECT item || ',b=c', property, time, NULL, 'of = ' || item || ', a "quoted" one' FROM ev""")
def line_round_trip(spark, d):
    """Values through lines, with escapes in names and texts and either separator."""
    rows = ev(spark, d)
    body = lambda x, gap: F.concat("property", F.lit(",item="), "item", F.lit(r"\,b\=c" + gap + "value="), x, F.lit(gap), F.col("time") * 1_000_000)
    label = F.concat(F.lit('"of = '), "item", F.lit(r', a \"quoted\" one"'))
    lines = rows.select(F.explode(F.array(body(num().cast("string"), " "), body(label, "\t"))).alias("line"))
    return parsed(lines, line_protocol.parse).select("item", "property", "time", num().alias("value"), F.col("v_string").alias("label"))


@query(" UNION ALL ".join(f"SELECT 'urn:line' AS item, 'urn:{c}' AS property, {_LINES}, l_{c} AS value FROM lineitem" for c in ("quantity", "extendedprice", "discount")))
def csv_round_trip(spark, d):
    """Values through files of a wide table."""
    path, names = _folder(spark, "csv"), ("quantity", "extendedprice", "discount")
    line = views.table(spark, d, "lineitem")
    at = F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("time")
    line.select(at, (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seqNr"), *[F.col(f"l_{n}").alias(f"<urn:line>@<urn:{n}>") for n in names]).write.csv(path, header=True)
    return shown(csv_wide.read(spark, path, "urn:line"))


@query(f"WITH {EVENTS} SELECT c.item AS s, e.item, count(*) AS n FROM (SELECT DISTINCT 'urn:group:' || user_id % 10 AS item, 'urn:user:' || user_id AS o FROM events) c JOIN ev e ON e.item = c.o GROUP BY ALL")
def structure_join(spark, d):
    rows = ev(spark, d)
    groups = rows.select("item").distinct().select(F.concat(F.lit("urn:group:"), F.substring("item", 10, 20).cast("long") % 10).alias("s"), F.lit(catalog.CONTAINS).alias("p"), F.col("item").alias("o"))
    return joins.structure_join(groups, rows, catalog.CONTAINS).groupBy("s", "item").agg(F.count("*").alias("n"))


def _store(spark, name: str):
    """A new store in the shared checkpoint folder."""
    return Store(spark, _folder(spark, name))


def _raised(rows: DataFrame) -> DataFrame:
    return rows.where("v_double > 30").withColumn("v_double", F.col("v_double") + 1)


@query(f"WITH {EVENTS} SELECT item, property, time, \"seqNr\", CASE WHEN value > 30 THEN value + 1 ELSE value END AS value FROM ev")
def store_upsert(spark, d):
    store, rows = _store(spark, "upsert"), ev(spark, d)
    store.put(rows)
    store.put(_raised(rows))
    return shown(store.read())


_NOT_GONE = f"NOT (item = 'urn:user:3' AND time BETWEEN {BEGIN} AND {END}) AND property <> 'urn:event:error'"


@query(f"WITH {EVENTS} SELECT {COLS} FROM ev WHERE {_NOT_GONE}")
def store_delete(spark, d):
    store = _store(spark, "delete")
    store.put(ev(spark, d))
    store.delete("urn:user:3", begin=BEGIN, end=END)
    store.delete(property="urn:event:error")
    return shown(store.read())


@query(f"WITH {EVENTS} SELECT item, property, time, \"seqNr\", CASE WHEN value > 30 THEN value + 1 ELSE value END AS value FROM ev WHERE {_NOT_GONE}")
def store_compact(spark, d):
    store, rows = _store(spark, "compact"), ev(spark, d)
    store.put(rows)
    store.put(_raised(rows))
    store.delete("urn:user:3", begin=BEGIN, end=END)
    store.delete(property="urn:event:error")
    store.compact(2)
    return shown(store.raw())


@query(f"WITH {EVENTS} SELECT {COLS} FROM ev WHERE time >= {BEGIN}")
def store_archive(spark, d):
    hot, cold = _store(spark, "hot"), _store(spark, "cold")
    hot.put(ev(spark, d))
    hot.archive_to(cold, BEGIN)
    return shown(sets.minus(sets.merged(hot.read().select(*COLUMNS), cold.read().select(*COLUMNS)), cold.read().select(*sets.PRIMARY)))


_OLDEST = fetch._year_week(END - 7 * DAY)


@query(f"WITH {EVENTS} SELECT {COLS} FROM ev WHERE year(make_timestamp(time * 1000)) * 100 + ceil(dayofyear(make_timestamp(time * 1000)) / 7) >= {_OLDEST[0] * 100 + _OLDEST[1]}")
def store_retain(spark, d):
    store = _store(spark, "retain")
    store.put(ev(spark, d))
    store.retain(END, 7 * DAY)
    return shown(store.read())


def _ask(spark, d, text_: str) -> DataFrame:
    return Engine(spark, {"ts:": ev(spark, d)}).query(text_)


@query(f"WITH {EVENTS}, {RANKED} SELECT item, time, value::DOUBLE AS value FROM ranked WHERE property = 'urn:event:click' AND rn <= 2")
def gp_limit(spark, d):
    return _ask(spark, d, "select ?item ?time ?value { service <ts:> { ?item <urn:event:click> [ <ts:limit> 2 ; <ts:time> ?time ; <ts:value> ?value ] } }").withColumn("value", F.col("value").cast("double"))


@query(f"WITH {EVENTS}, {RANKED} SELECT item, count(*) AS n, round(avg(DISTINCT value), 6) AS mean FROM ranked WHERE property = 'urn:event:view' AND rn <= 5 GROUP BY item")
def gp_group(spark, d):
    out = _ask(spark, d, "select ?item (count(*) as ?n) (avg(distinct ?v) as ?mean) { service <ts:> { ?item <urn:event:view> [ <ts:limit> 5 ; <ts:value> ?v ] } } group by ?item")
    return out.withColumn("mean", F.round("mean", 6))


@query(f"WITH {EVENTS}, {RANKED}, c AS (SELECT * FROM ranked WHERE property = 'urn:event:click' AND rn = 1), v AS (SELECT * FROM ranked WHERE property = 'urn:event:view' AND rn = 1) SELECT c.item, c.time, v.time AS other FROM c LEFT JOIN v USING (item)")
def gp_optional(spark, d):
    return _ask(spark, d, "select ?item ?time ?other { service <ts:> { ?item <urn:event:click> [ <ts:limit> 1 ; <ts:time> ?time ] } optional { service <ts:> { ?item <urn:event:view> [ <ts:limit> 1 ; <ts:time> ?other ] } } }")


@query(f"WITH {EVENTS}, {RANKED} SELECT DISTINCT item FROM ev WHERE property = 'urn:event:click' AND item NOT IN (SELECT item FROM ranked WHERE property = 'urn:event:error' AND rn = 1 AND value > 10)")
def gp_minus(spark, d):
    return _ask(spark, d, "select distinct ?item { service <ts:> { ?item <urn:event:click> [ <ts:limit> 1 ; <ts:time> ?t ] } minus { service <ts:> { ?item <urn:event:error> [ <ts:limit> 1 ; <ts:value> ?u ] } filter(?u > 10) } }")


@query(f"WITH {EVENTS}, a AS (SELECT * FROM ev WHERE property = 'urn:event:click'), b AS (SELECT DISTINCT item, time FROM ev WHERE property = 'urn:event:view') SELECT a.item, a.time, b.time AS before FROM a ASOF JOIN b ON a.item = b.item AND a.time >= b.time")
def gp_asof(spark, d):
    return _ask(spark, d, "select ?item ?time ?before { service <ts:> { ?item <urn:event:click> [ <ts:time> ?time ] . ?item <urn:event:view> [ <ts:to> ?time ; <ts:limit> 1 ; <ts:time> ?before ] } }")


@query(f"""WITH {EVENTS} SELECT item, property, time - time % {DAY} AS time, round(avg(value), 6) AS value FROM ev WHERE property = 'urn:event:click' GROUP BY ALL
UNION ALL SELECT item, property, time - time % {2 * DAY} AS time, max(value) AS value FROM ev WHERE property = 'urn:event:view' GROUP BY ALL""")
def gp_interval_op(spark, d):
    choice = f'values (?property ?step ?how) {{ (<urn:event:click> {DAY} "avg") (<urn:event:view> {2 * DAY} "max") }}'
    asked = "service <ts:> { ?item ?property [ <ts:interval> ?step ; <ts:op> ?how ; <ts:time> ?time ; <ts:value> ?value ] }"
    return _ask(spark, d, f"select ?item ?property ?time ?value {{ {choice} {asked} }}").withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(f"""WITH {EVENTS}, k AS (SELECT CASE WHEN "seqNr" % 2 = 0 THEN 'urn:a' ELSE 'urn:b' END AS g, * FROM ev),
l AS (SELECT g, item, property, max(time) AS time FROM k GROUP BY ALL)
SELECT a.g, a.item, a.time, b.time AS other FROM l a JOIN l b USING (g, item) WHERE a.property = 'urn:event:click' AND b.property = 'urn:event:view'""")
def gp_graph(spark, d):
    rows = ev(spark, d).withColumn("context", F.when(F.col("seqNr") % 2 == 0, "urn:a").otherwise("urn:b"))
    asked = "graph ?g { ?item <urn:event:click> [ <ts:limit> 1 ; <ts:time> ?time ] . ?item <urn:event:view> [ <ts:limit> 1 ; <ts:time> ?other ] }"
    return Engine(spark, {"ts:": rows}).query(f"select ?g ?item ?time ?other {{ service <ts:> {{ {asked} }} }}")


@query(f"""WITH {EVENTS}, {RANKED}, i AS (SELECT DISTINCT item FROM ev), e AS (SELECT item, time FROM ranked WHERE property = 'urn:event:error' AND rn = 1 AND value > 10),
v AS (SELECT time, value FROM ranked WHERE item = 'urn:user:1' AND property = 'urn:event:view' AND rn <= 3)
SELECT i.item, coalesce(e.time, v.time) AS at, v.value AS other FROM i LEFT JOIN e USING (item) LEFT JOIN v ON e.time IS NULL OR e.time = v.time""")
def gp_optional_chain(spark, d):
    """A second optional part over what the first may leave unbound; unbound agrees with all."""
    rows = ev(spark, d)
    engine = Engine(spark, {"ts:": rows}, rows.select(F.col("item").alias("s"), F.lit("urn:is").alias("p"), F.lit("urn:user").alias("o")).distinct())
    first = "optional { service <ts:> { ?item <urn:event:error> [ <ts:limit> 1 ; <ts:time> ?at ; <ts:value> ?v ] } filter(?v > 10) }"
    second = "optional { service <ts:> { <urn:user:1> <urn:event:view> [ <ts:limit> 3 ; <ts:time> ?at ; <ts:value> ?other ] } }"
    found = engine.query(f"select ?item ?at ?other {{ ?item <urn:is> <urn:user> {first} {second} }}")
    return found.withColumn("other", F.col("other").cast("double"))


@query(f"WITH {EVENTS}, {RANKED}, l AS (SELECT * FROM ranked WHERE property = 'urn:event:click' AND rn = 1) SELECT item AS s, 'urn:last' AS p, time::VARCHAR AS o FROM l UNION ALL SELECT 'urn:users', 'urn:contains', item FROM l")
def gp_construct(spark, d):
    return _ask(spark, d, "construct { ?item <urn:last> ?time . <urn:users> <urn:contains> ?item } where { service <ts:> { ?item <urn:event:click> [ <ts:limit> 1 ; <ts:time> ?time ] } }")


@query(f"WITH {EVENTS}, {RANKED} SELECT item, 'urn:last' AS property, time, 3::INT AS \"seqNr\", value FROM ranked WHERE property = 'urn:event:click' AND rn = 1")
def gp_insert(spark, d):
    """Values that a pattern finds, written to a store and read back."""
    store, engine = _store(spark, "insert"), Engine(spark, {"ts:": ev(spark, d)})
    found = "service <ts:> { ?item <urn:event:click> [ <ts:limit> 1 ; <ts:time> ?time ; <ts:value> ?value ] }"
    engine.update(f"insert {{ graph <ts:> {{ ?item <urn:last> [ <ts:value> ?value ; <ts:time> ?time ; <ts:seqNr> 3 ] }} }} where {{ {found} }}", store=store)
    return shown(store.read().withColumn("context", F.lit(DEFAULT_CONTEXT)))


@query(f"""WITH RECURSIVE i AS ({_CUSTOMER_ITEM}), e AS (SELECT DISTINCT regexp_replace(item, '/[^/]*/[^/]*$', '') AS s, regexp_replace(item, '/[^/]*$', '') AS o FROM i UNION SELECT regexp_replace(item, '/[^/]*$', ''), item FROM i),
r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT o AS item FROM r WHERE s = 'http://ex/ASIA'""")
def gp_path(spark, d):
    edges = catalog.hierarchy_edges(views.customer_items(spark, d)).select(F.col("parent").alias("s"), F.lit(catalog.CONTAINS).alias("p"), F.col("child").alias("o"))
    return Engine(spark, {}, edges).query("select ?item { <http://ex/ASIA> <urn:contains>+ ?item }")
