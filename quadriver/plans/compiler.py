"""Compile parsed graph patterns to DataFrame plans.

A variable is a column (null: unbound).  Times and indexes are numbers, all else is text; records and arrays are JSON,
numbers are read from their text where an operation needs them.

Inside a service over values a statement ``item property node`` is a fetch, and statements of the node in the engine's
namespace (from, to, limit, interval, op, time, seqNr, index, value, valueJson, params) are its parameters and outputs.
Limits apply before any test on value, sequence number or index.  Statements of a value navigate records and arrays.
Parameters that are variables are taken from the solutions so far; fetches are ordered so that these exist.  A fetch
that only has ``to`` from a variable and limit 1 is an as-of join: one exchange, no nested loop.  ``graph ?g`` ranges over
the contexts of values; without a graph it is the default context.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import records
from ..functions.values import AGGREGATES, STANDARD
from ..operators import catalog
from ..operators.fetch import OPS, aggregate, in_range, newest, newest_of_series, sample, series
from ..operators.joins import asof_join
from ..schema import COLUMNS, DEFAULT_CONTEXT, NAMESPACE, VALUES, num, text, value
from ..sources import shells
from ..sources.remote import RemoteValues, asked
from ..store import Store, checkpointed
from . import parser as ast
from .parser import RDF, Call, Iri, Lit, Query, Triple, Var, parse

PARAMETERS = ("from", "to", "limit", "interval", "op", "time", "seqNr", "index", "value", "valueJson")


@dataclass
class Solutions:
    """Rows of bindings; maybe: variables that can be unbound."""

    df: DataFrame
    maybe: set = field(default_factory=set)


@dataclass
class Fetch:
    s: object
    p: object
    params: dict

    def needs(self) -> set[str]:
        return {v.name for k, v in self.params.items() if isinstance(v, Var) and k in ("from", "to", "limit", "interval", "op")}


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def variables(x: object) -> set[str]:
    """Variables of a term, expression or pattern."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, (Triple, Call, ast.Group, ast.Optional_, ast.Union, ast.Minus, ast.Filter, ast.Bind, ast.Service, ast.Graph, ast.Exists)):
        return set().union(*(variables(v) for v in vars(x).values())) if vars(x) else set()
    if isinstance(x, ast.Values):
        return set(x.names)
    if isinstance(x, Query):
        return variables(x.group) if x.select is None else {n for n, _ in x.select}
    if isinstance(x, (list, tuple)):
        return set().union(*map(variables, x)) if x else set()
    return set()


@dataclass
class Remote:
    """Values behind a URL."""

    spark: SparkSession
    url: str
    columns = COLUMNS

    def rows(self, items: str | DataFrame | None, query: dict[str, str]) -> DataFrame:
        """Values of one item, of a table of items (asked for by the tasks that hold them), or of all."""
        if isinstance(items, DataFrame):
            return asked(items, self.url, query)
        self.spark.dataSource.register(RemoteValues)
        return self.spark.read.format("remote_values").options(url=self.url, **({"items": items} if items else {}), **query).load()


class Engine:
    """Named data: services by URL (values, or triples s, p, o), and the triples of the default graph.

    The namespace followed by an http or https URL names a remote service; its values lie at <URL>/values.  aas-api: and
    such a URL names the administration shells behind it, read once for each engine.
    """

    def __init__(self, spark: SparkSession, services: dict[str, DataFrame], triples: DataFrame | None = None, namespace: str = NAMESPACE, span: int = 0):
        """span: milliseconds by which as-of joins split the series (0: not at all), for series too long for one task."""
        self.spark, self.services, self.triples, self.namespace, self.span = spark, services, triples, namespace, span

    def query(self, text_: str, base: str = "") -> DataFrame:
        return self.run(parse(text_, base))

    def ask(self, text_: str, base: str = "") -> bool:
        return not self.run(parse(text_, base)).isEmpty()

    def run(self, q: Query) -> DataFrame:
        """Rows of bindings; of a construct the triples s, p, o."""
        if q.insert is not None:
            raise ValueError("an insert is an update")
        if q.construct is not None:
            return instances(q.construct.parts, self.solve(q).df).select("s", "p", "o").distinct()
        df = self.solve(q).df
        return df.limit(1) if q.ask else df

    def update(self, text_: str, base: str = "", store: Store | None = None, now: int = 0) -> None:
        """insert: triples go to the default graph; those of a graph in the engine's namespace are values and go to the store.

        Such a graph's IRI is the namespace and the context's own IRI; the namespace alone is the default context.  Values
        without a time get now.
        """
        q = parse(text_, base)
        if q.insert is None:
            raise ValueError("an update is an insert")
        df = self.solve(q).df
        values = [p for p in q.insert.parts if isinstance(p, ast.Graph)]
        for p in values:
            if not isinstance(p.context, Iri) or not p.context.value.startswith(self.namespace):
                raise ValueError(f"unknown graph {p.context}")
            if store is None:
                raise ValueError("no store is given")
            context = p.context.value.removeprefix(self.namespace)
            rows = to_values(checkpointed(instances(p.group.parts, df).distinct()), self.namespace, now)
            store.put(rows.withColumn("context", F.lit(context)) if context else rows)
        if plain := [p for p in q.insert.parts if p not in values]:
            new = checkpointed(instances(plain, df).distinct())
            new = new.select("s", "p", "o")
            self.triples = new if self.triples is None else self.triples.select("s", "p", "o").union(new).distinct()

    # queries
    def solve(self, q: Query, seed: Solutions | None = None, data: DataFrame | None = None, context: str | Var | None = None) -> Solutions:
        found = self.group(q.group, seed, data, context) or Solutions(self.spark.range(1).select())
        df = found.df
        if q.select is None:
            names = [n for n in df.columns if not n.startswith("_")]
            df = df.select(*map(c, names))
        elif q.by or any(_aggregates(e) for _, e in q.select):
            exprs = [(n, e) for n, e in q.select if e is not None]
            df = df.groupBy(*map(c, q.by)).agg(*[self.expr(e, df)[0].alias(n) for n, e in exprs]) if exprs else df.select(*map(c, q.by)).distinct()
            for h in q.having:
                df = df.where(self.expr(h, df)[0])
            df = df.select(*[c(n) for n, _ in q.select])
        else:
            for n, e in q.select:
                if e is not None:
                    df = df.withColumn(n, self.expr(e, df)[0])
            missing = [n for n, _ in q.select if n not in df.columns]
            df = df.select(*[F.lit(None).cast("string").alias(n) if n in missing else c(n) for n, _ in q.select])
        if q.distinct:
            df = df.distinct()
        if q.order:
            keys = []
            for e, down in q.order:
                x = self.expr(e, df)[0]
                for k in (x.try_cast("double"), x) if isinstance(e, Var) and dict(df.dtypes)[e.name] == "string" else (x,):
                    keys.append(k.desc() if down else k.asc())
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df, found.maybe & set(df.columns))

    # groups
    def group(self, g: ast.Group, seed: Solutions | None, data: DataFrame | None, context: str | Var | None) -> Solutions | None:
        """Solutions of a group, joined with the seed's; data: values of the service that the group is in."""
        now = seed
        first = [p for p in g.parts if isinstance(p, (ast.Values, Query))]
        nested = [p for p in g.parts if isinstance(p, (ast.Group, ast.Union, ast.Service, ast.Graph))]
        for p in first:
            now = self.join(now, self.values(p) if isinstance(p, ast.Values) else self.solve(p, None, data, context))
        later = [p for p in nested if self.waits(p, now, g)]
        for p in (p for p in nested if p not in later):
            now = self.nested(p, now, data, context)
        statements = [p for p in g.parts if isinstance(p, Triple)]
        if statements:
            now = self.fetches(statements, now, data, context) if data is not None and "item" in data.columns else self.patterns(statements, now, data)
        for p in later:
            now = self.nested(p, now, data, context)
        for p in g.parts:
            if isinstance(p, ast.Bind):
                base = now or Solutions(self.spark.range(1).select())
                now = Solutions(base.df.withColumn(p.var.name, self.expr(p.expr, base.df)[0]), base.maybe | {p.var.name})
            elif isinstance(p, ast.Optional_):
                now = self.optional(now, p.group, data, context)
            elif isinstance(p, ast.Minus):
                right = self.group(p.group, None, data, context)
                shared = [n for n in now.df.columns if n in right.df.columns]
                now = Solutions(now.df.join(right.df.select(*map(c, shared)).distinct(), shared, "left_anti"), now.maybe) if shared else now
        for p in g.parts:
            if isinstance(p, ast.Filter):
                now = self.filter(now, p.expr, data, context)
        return now

    def waits(self, part: object, now: Solutions | None, g: ast.Group) -> bool:
        """Whether a part takes parameters that only the group's own statements give."""
        needed = _parameters(part, self.namespace)
        have = set(now.df.columns) if now else set()
        own = set().union(*(variables(t) for t in g.parts if isinstance(t, Triple))) if any(isinstance(t, Triple) for t in g.parts) else set()
        return bool((needed - have) & own)

    def nested(self, p: object, now: Solutions | None, data: DataFrame | None, context: str | Var | None) -> Solutions | None:
        if isinstance(p, ast.Union):
            parts = [self.group(x, now, data, context) for x in p.groups]
            names = set.intersection(*(set(x.df.columns) - x.maybe for x in parts))
            return Solutions(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.df for x in parts)), set().union(*(set(x.df.columns) for x in parts)) - names)
        if isinstance(p, ast.Service):
            return self.group(p.group, now, self.service(p.url), context)
        if isinstance(p, ast.Graph):
            if isinstance(p.context, Iri):
                return self.group(p.group, now, data, p.context.value)
            if data is None or "context" not in data.columns:
                raise ValueError("a graph is chosen by a variable only among the contexts of values")
            return self.group(p.group, now, data, p.context)
        return self.group(p, now, data, context)

    def service(self, url: object) -> DataFrame | Remote:
        if isinstance(url, Iri) and url.value in self.services:
            return self.services[url.value]
        if isinstance(url, Iri) and re.match("https?://", where := url.value.removeprefix(shells.API)) and where != url.value:
            return self.services.setdefault(url.value, shells.read(self.spark, where))
        if isinstance(url, Iri) and re.match("https?://", where := url.value.removeprefix(self.namespace)) and where != url.value:
            return Remote(self.spark, where.rstrip("/") + "/values")
        raise ValueError(f"unknown service {url}")

    def values(self, v: ast.Values) -> Solutions:
        plain = lambda x: None if x is None else str(x.value).lower() if isinstance(x.value, bool) else str(x.value)
        df = self.spark.createDataFrame([tuple(map(plain, r)) for r in v.rows], ", ".join(f"`{n}` string" for n in v.names))
        return Solutions(df, {n for i, n in enumerate(v.names) if any(r[i] is None for r in v.rows)})

    def join(self, a: Solutions | None, b: Solutions | None, how: str = "inner") -> Solutions | None:
        """Join on shared variables; one that can be unbound agrees with anything."""
        if a is None or b is None:
            return a or b
        shared = [n for n in a.df.columns if n in b.df.columns]
        kinds = dict(a.df.dtypes), dict(b.df.dtypes)
        if shared and all(n in a.maybe or n in b.maybe for n in shared) and not (how == "left" and shared[0] in b.maybe):
            return self.apart(a, b, shared[0], how)
        if not shared and how == "left":  # a product; without rows on the right the left ones stay
            alone = a.df.join(b.df.limit(1).select(), F.lit(True), "left_anti")
            return Solutions(a.df.crossJoin(b.df).unionByName(alone, allowMissingColumns=True), a.maybe | set(b.df.columns))
        right = b.df.select(*[c(n).alias(f"_r_{n}" if n in shared else n) for n in b.df.columns])
        test, loose = F.lit(True), set()
        for n in shared:
            x, y = c(n), c(f"_r_{n}")
            if kinds[0][n] != kinds[1][n]:
                x, y = x.cast("string"), y.cast("string")
            equal = x == y
            if n in a.maybe or n in b.maybe:
                loose.add(n)
                equal = equal | x.isNull() | y.isNull()
            test = test & equal
        df = a.df.join(right, test, how) if shared or how != "inner" else a.df.crossJoin(right)
        same = lambda n: F.coalesce(c(n), c(f"_r_{n}").cast(kinds[0][n])) if n in loose else c(n)
        df = df.select(*[same(n).alias(n) for n in a.df.columns], *[c(n) for n in b.df.columns if n not in shared])
        maybe = a.maybe | b.maybe if how == "inner" else a.maybe | (set(b.df.columns) - set(shared)) | loose
        return Solutions(df, maybe - ({n for n in loose if n not in a.maybe or n not in b.maybe} if how == "inner" else set()))

    def apart(self, a: Solutions, b: Solutions, name: str, how: str) -> Solutions:
        """A join whose shared variables can all be unbound: rows with and without the variable join apart, so that the former meet on a key."""
        has = lambda s, bound: Solutions(s.df.where(c(name).isNotNull() if bound else c(name).isNull()), s.maybe - {name})
        without = lambda s: Solutions(has(s, False).df.drop(name), s.maybe - {name})
        parts = []
        if name in a.maybe:
            parts.append((without(a), b))
        if name in b.maybe:
            parts.append((has(a, True), without(b)))
        parts.append((has(a, True) if name in a.maybe else a, has(b, True) if name in b.maybe else b))
        kind = dict(a.df.dtypes)[name]
        found = [self.join(x, y, how).df.withColumn(name, c(name).cast(kind)) for x, y in parts]
        columns = [*a.df.columns, *[n for n in b.df.columns if n not in a.df.columns]]
        df = reduce(DataFrame.unionByName, (x.select(*map(c, columns)) for x in found))
        always = (set(a.df.columns) - a.maybe) | ((set(b.df.columns) - b.maybe) if how == "inner" else set())
        return Solutions(df, set(columns) - always)

    def optional(self, now: Solutions | None, g: ast.Group, data: DataFrame | None, context: str | Var | None) -> Solutions:
        needed = _parameters(g, self.namespace) & set(now.df.columns)
        seed = Solutions(now.df.select(*map(c, sorted(needed))).distinct()) if needed else None
        return self.join(now, self.group(g, seed, data, context), "left")

    def filter(self, now: Solutions, e: object, data: DataFrame | None, context: str | Var | None) -> Solutions:
        if isinstance(e, ast.Exists):
            right = self.group(e.group, None, data, context)
            shared = [n for n in now.df.columns if n in right.df.columns]
            return Solutions(now.df.join(right.df.select(*map(c, shared)).distinct(), shared, "left_semi" if e.positive else "left_anti"), now.maybe)
        return Solutions(now.df.where(self.expr(e, now.df)[0]), now.maybe)

    # triples
    def patterns(self, statements: list[Triple], now: Solutions | None, data: DataFrame | None) -> Solutions:
        triples = data if data is not None else self.triples
        if triples is None:
            raise ValueError("no triples are registered")
        for t in statements:
            now = self.join(now, Solutions(self.pattern(triples, t)))
        return now

    def pattern(self, triples: DataFrame, t: Triple) -> DataFrame:
        if isinstance(t.p, (Var, Iri)):
            df = triples.select("s", "p", "o")
        else:
            df = self.path(triples, t.p).select("s", F.lit(None).cast("string").alias("p"), "o")
        names: dict[str, str] = {}
        for position, x in (("s", t.s), ("p", t.p), ("o", t.o)):
            if isinstance(x, Var):
                if x.name in names:
                    df = df.where(F.col(names[x.name]) == F.col(position))
                names.setdefault(x.name, position)
            elif isinstance(x, (Iri, Lit)):
                df = df.where(F.col(position) == str(x.value))
        return df.select(*[F.col(position).alias(n) for n, position in names.items()])

    def path(self, triples: DataFrame, p: object) -> DataFrame:
        """s, o of a path."""
        if isinstance(p, Iri):
            return triples.where(F.col("p") == p.value).select("s", "o")
        parts = p.parts
        if p.kind == "not":
            return triples.where(F.col("p") != parts[0].value).select("s", "o")
        if p.kind == "inverse":
            return self.path(triples, parts[0]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if p.kind == "alt":
            return reduce(DataFrame.union, (self.path(triples, x) for x in parts))
        if p.kind == "seq":
            step = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o")
            return reduce(step, (self.path(triples, x) for x in parts))
        if p.kind == "optional":
            nodes = triples.select(F.explode(F.array("s", "o")).alias("s")).distinct()
            return self.path(triples, parts[0]).union(nodes.select("s", F.col("s").alias("o"))).distinct()
        return catalog.closure(self.path(triples, parts[0]), zero=p.kind == "star")

    # fetches
    def fetches(self, statements: list[Triple], now: Solutions | None, data: DataFrame, context: str | Var | None) -> Solutions:
        params: dict[object, dict] = {}
        rest: list[Triple] = []
        for t in statements:
            name = t.p.value.removeprefix(self.namespace) if isinstance(t.p, Iri) and t.p.value.startswith(self.namespace) else None
            if name == "params" or name in PARAMETERS:
                params.setdefault(t.s, {})[name] = t.o
            else:
                rest.append(t)
        everywhere: dict = {}
        for s, given in params.items():
            if isinstance(s, Iri) and "params" in given:
                everywhere |= params.get(given["params"], {})
        results = {p[k] for p in params.values() for k in ("value", "valueJson") if isinstance(p.get(k), Var)}
        nodes = {t.o for t in rest}
        # statements about values, and about what these hold, navigate; the rest fetch
        steps, reached, size = [], set(results), -1
        while size != len(steps):
            size = len(steps)
            steps = [t for t in rest if t.s in reached and t.o not in params]
            reached |= {t.o for t in steps if isinstance(t.o, Var)}
        todo = []
        for t in (t for t in rest if t not in steps):
            if not isinstance(t.p, (Iri, Var)):
                raise ValueError("paths do not fetch")
            todo.append(Fetch(t.s, t.p, everywhere | (params.get(t.s, {}) if t.s not in nodes else {}) | params.get(t.o, {})))
        order: list[Fetch] = []
        have = set(now.df.columns) if now else set()
        while todo:
            ready = [f for f in todo if f.needs() <= have] or todo[:1]
            for f in ready:
                order.append(f)
                have |= variables(f.s) | variables(f.p) | {v.name for v in f.params.values() if isinstance(v, Var)}
            todo = [f for f in todo if f not in ready]
        for f in order:
            now = self.fetch(f, now, data, context)
        waiting = list(steps)
        while waiting:
            ready = [t for t in waiting if t.s.name in now.df.columns] or waiting[:1]
            for t in ready:
                now = self.navigate(t, now)
            waiting = [t for t in waiting if t not in ready]
        return now

    def fetch(self, f: Fetch, now: Solutions | None, data: DataFrame, context: str | Var | None) -> Solutions:
        bound = set(now.df.columns) - now.maybe if now else set()
        constant = lambda k: f.params[k].value if isinstance(f.params.get(k), (Lit, Iri)) else None
        varied = {k: f.params[k].name for k in ("from", "to", "limit", "interval", "op") if isinstance(f.params.get(k), Var)}
        if missing := set(varied.values()) - (set(now.df.columns) if now else set()):
            raise ValueError(f"parameters are not bound: {', '.join(sorted(missing))}")
        if isinstance(data, Remote):
            if isinstance(context, Var):
                raise ValueError("a remote graph needs an IRI")
            query = {} if context is None else {"model": context}
            query |= {"properties": f.p.value} if isinstance(f.p, Iri) else {}
            query |= {k: str(constant(k)) for k in ("from", "to") if constant(k) is not None}
            if constant("limit") and not varied and not f.params.keys() & {"interval", "op", "time"}:
                query["limit"] = str(constant("limit"))
            known = isinstance(f.s, Var) and f.s.name in bound
            data = data.rows(f.s.value if isinstance(f.s, Iri) else now.df.select(c(f.s.name).alias("item")).distinct() if known else None, query)
        rows = data if isinstance(context, Var) else data.where(F.col("context") == (context or DEFAULT_CONTEXT))
        keys: dict[str, str] = {}
        for column, x in (("item", f.s), ("property", f.p), *([("context", context)] if isinstance(context, Var) else [])):
            if isinstance(x, Iri):
                rows = rows.where(F.col(column) == x.value)
            elif x.name in bound:
                keys[column] = x.name
                rows = rows.join(now.df.select(c(x.name).alias(column)).distinct(), column, "left_semi")
        limit, interval, op = int(constant("limit") or 0), int(float(constant("interval") or 0)), constant("op")
        begin, end = constant("from"), constant("to")
        rows = in_range(rows, None if begin is None else int(begin), None if end is None else int(end))
        if isinstance(f.params.get("time"), Lit) and op is None:
            rows, limit = in_range(rows, int(constant("time")), int(constant("time"))), 0
        if varied:
            rows, extra = self.varied(f, rows, now, keys, varied, limit, interval, op, isinstance(context, Var)), list(varied.values())
        else:
            extra = []
            if op:
                rows = aggregate(rows, re.split("[/#:]", str(op))[-1], interval, limit)
            elif interval > 0:
                rows = sample(rows, interval, limit)
            else:
                rows = newest_of_series(rows, limit)
        if "index" in f.params:
            partition = Window.partitionBy("context", "item", "property", *[c(f"_p_{n}") for n in dict.fromkeys(extra)]).orderBy(*newest()) if extra else series()
            rows = rows.withColumn("idx", (F.row_number().over(partition) - 1).cast("long"))
        out: dict[str, Column] = {}
        test = F.lit(True)
        fields = {"item": f.s, "property": f.p, **({"context": context} if isinstance(context, Var) else {}), **{k: f.params[k] for k in ("time", "seqNr", "index", "value", "valueJson") if k in f.params}}
        for k, x in fields.items():
            col = {"index": F.col("idx") if "idx" in rows.columns else None, "value": text(), "valueJson": text()}.get(k, F.col(k) if k in rows.columns else None)
            if k == "seqNr":
                col = col.cast("long")
            if isinstance(x, Var):
                if x.name in out:
                    test = test & (out[x.name].cast("string") == col.cast("string"))
                out.setdefault(x.name, col)
            elif k in ("value", "valueJson"):
                test = test & _equals(x)
            elif k not in ("item", "property"):
                test = test & (col == x.value)
        extra = [n for n in dict.fromkeys(extra)]
        rows = rows.where(test)
        names = {f"_p_{n}": n for n in extra}
        for n in extra:
            if n in out:
                rows = rows.where(out[n].cast("string") == c(f"_p_{n}").cast("string"))
        df = rows.select(*[col.alias(n) for n, col in out.items()], *[c(p).alias(n) for p, n in names.items() if n not in out])
        return self.join(now, Solutions(df))

    def varied(self, f: Fetch, rows: DataFrame, now: Solutions, keys: dict[str, str], varied: dict[str, str], limit: int, interval: int, op: str | None, across: bool) -> DataFrame:
        """Values for each choice of parameters that the solutions bring; these are added as _p_<variable>."""
        chosen = list(dict.fromkeys([*keys.values(), *varied.values()]))
        given = now.df.select(*[c(n).alias(f"_p_{n}") for n in chosen]).dropna().distinct()
        number = lambda k: c(f"_p_{varied[k]}").cast("long")
        plain = not op and interval <= 0 and not {"interval", "op"} & varied.keys()
        if plain and set(varied) == {"to"} and limit == 1 and "property" not in keys and not across and isinstance(f.p, Iri) and (isinstance(f.s, Iri) or "item" in keys):
            left = given.withColumn("time", number("to")).withColumn("item", c(f"_p_{keys['item']}") if keys else F.lit(f.s.value))
            rest = [x for x in rows.columns if x not in ("item", "time", "year", "week")]
            found = asof_join(left, rows, ["item"], rest, span=self.span)
            return found.select("item", *[c(f"_p_{n}") for n in chosen], F.col("r_time").alias("time"), *[F.col(f"r_{x}").alias(x) for x in rest])
        test = F.lit(True)
        for column, n in keys.items():
            test = test & (F.col(column) == c(f"_p_{n}"))
        if "from" in varied:
            test = test & (F.col("time") >= number("from"))
        if "to" in varied:
            test = test & (F.col("time") <= number("to"))
        each = Window.partitionBy("context", "item", "property", *[c(f"_p_{n}") for n in chosen]).orderBy(*newest())
        most = number("limit") if "limit" in varied else F.lit(limit)
        step = number("interval") if "interval" in varied else F.lit(interval)
        # keys first: a key's rows meet only its own choices of parameters
        kept = lambda given: rows.join(given, test)
        newest_few = lambda df: df.withColumn("_n", F.row_number().over(each)).where((most <= 0) | (F.col("_n") <= most)).drop("_n")
        if plain:
            return newest_few(kept(given))
        by = tuple(f"_p_{n}" for n in chosen)
        if "op" in varied:
            named = F.lower(F.regexp_extract(c(f"_p_{varied['op']}"), "([^/#:]*)$", 1))
            known = given.where(F.when(named.isin(*OPS), True).otherwise(F.raise_error(F.concat(F.lit("unknown op "), named)).cast("boolean")))
            return reduce(DataFrame.unionByName, (aggregate(kept(known.where(named == x)), x, step, most, by) for x in OPS))
        if op:
            return aggregate(kept(given), re.split("[/#:]", str(op))[-1], step, most, by)
        columns = [*COLUMNS[:5], *VALUES, *by]
        sampled = aggregate(kept(given.where(step > 0)), "first", step, most, by)
        return sampled.select(*columns).unionByName(newest_few(kept(given.where(step <= 0))).select(*columns))

    def navigate(self, t: Triple, now: Solutions) -> Solutions:
        """A statement about a record or an array."""
        df, source = now.df, c(t.s.name)
        if isinstance(t.p, Var):
            array = F.from_json(source, "array<string>")
            pairs = F.from_json(source, "map<string,string>")
            listed = F.transform(array, lambda x, i: F.struct(F.concat(F.lit(RDF + "_"), (i + 1).cast("string")).alias("p"), x.alias("v")))
            named = F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].alias("p"), e["value"].alias("v")))
            df = df.withColumn("_pair", F.explode(F.when(F.startswith(F.ltrim(source), F.lit("[")), listed).otherwise(named)))
            found, value = self.bind(df, t.p, F.col("_pair.p"), now), F.col("_pair.v")
        else:
            place = t.p.value.removeprefix(RDF + "_")
            is_place = t.p.value.startswith(RDF + "_") and place.isdigit()
            value = records.element(source, int(place)) if is_place else records.field(source, t.p.value)
            found = Solutions(df.withColumn("_v", value).where(F.col("_v").isNotNull()), now.maybe)
            value = F.col("_v")
        found = self.bind(found.df, t.o, value, found)
        return Solutions(found.df.drop("_v", "_pair"), found.maybe)

    def bind(self, df: DataFrame, x: object, value: Column, now: Solutions) -> Solutions:
        """Compare with a term, or bind a free variable."""
        if isinstance(x, Var) and x.name not in df.columns:
            return Solutions(df.withColumn(x.name, value), now.maybe)
        if isinstance(x, Var):
            return Solutions(df.where(c(x.name).cast("string") == value), now.maybe)
        wanted = str(x.value).lower() if isinstance(x.value, bool) else str(x.value)
        number = isinstance(x.value, (int, float)) and not isinstance(x.value, bool)
        same = value.try_cast("double") == float(x.value) if number else F.coalesce(F.get_json_object(value, "$['@id']"), value) == wanted
        return Solutions(df.where(same), now.maybe)

    # expressions
    def expr(self, e: object, df: DataFrame) -> tuple[Column, str]:
        """A column, and what it is: num, str, bool or any."""
        if isinstance(e, Var):
            if e.name not in df.columns:
                return F.lit(None).cast("string"), "any"
            return c(e.name), "num" if dict(df.dtypes)[e.name] in ("bigint", "int", "double") else "any"
        if isinstance(e, (Lit, Iri)):
            kind = "bool" if isinstance(e.value, bool) else "num" if isinstance(e.value, (int, float)) else "str"
            return F.lit(e.value), kind
        name, args = e.name, [self.expr(a, df) for a in e.args]
        number = lambda i: args[i][0] if args[i][1] == "num" else args[i][0].try_cast("double")
        if name in ("&&", "||"):
            return (args[0][0] & args[1][0] if name == "&&" else args[0][0] | args[1][0]), "bool"
        if name == "!":
            return ~args[0][0], "bool"
        if name in ("=", "!=", "<", ">", "<=", ">="):
            compare = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}[name]
            kinds = {args[0][1], args[1][1]}
            if "num" in kinds:
                return compare(number(0), number(1)), "bool"
            if kinds == {"any"}:
                both = number(0).isNotNull() & number(1).isNotNull()
                return F.when(both, compare(number(0), number(1))).otherwise(compare(args[0][0], args[1][0])), "bool"
            return compare(args[0][0], args[1][0]), "bool"
        if name in ("+", "-", "*", "/"):
            x, y = number(0), number(1)
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[name](), "num"
        if name == "in":
            return reduce(lambda a, b: a | b, (self.expr(Call("=", (e.args[0], x)), df)[0] for x in e.args[1:])), "bool"
        if name in AGGREGATES:
            if name == "COUNT":
                one = F.lit(1) if e.args[0] == Lit("*") else args[0][0]
                return (F.count_distinct(one) if e.distinct else F.count(one)).cast("long"), "num"
            x = number(0) if name in ("SUM", "AVG") else args[0][0]
            if name in ("MIN", "MAX") and args[0][1] == "any":
                fn = getattr(F, name.lower())
                return F.coalesce(fn(number(0)).cast("string"), fn(args[0][0])), "any"
            if e.distinct and name in ("SUM", "AVG"):
                whole = F.sum_distinct(x)
                return (whole if name == "SUM" else F.try_divide(whole, F.count_distinct(x))), "num"
            if name == "GROUP_CONCAT":
                between = args[1][0] if len(args) > 1 else F.lit(" ")
                return (F.listagg_distinct if e.distinct else F.listagg)(x.cast("string"), between), "str"
            return AGGREGATES[name](x), "num" if name in ("SUM", "AVG") else "any"
        if name not in STANDARD:
            raise ValueError(f"unknown function {name}")
        numeric = name in ("ABS", "ROUND", "CEIL", "FLOOR")
        given = [number(i) if numeric or name == "DATETIME" else a for i, (a, _) in enumerate(args)]
        if name == "DATETIME":
            given = [given[0].cast("long")]
        kind = "num" if numeric or name in ("STRLEN", "YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS", "RAND") else "bool" if name in ("CONTAINS", "STRSTARTS", "STRENDS", "REGEX", "BOUND", "ISNUMERIC") else "any"
        return STANDARD[name](*given), kind


def instances(template: list, df: DataFrame) -> DataFrame:
    """The triples s, p, o, o_type (uri, string or any) of a template for each solution; one with an unbound term is left out.  Nodes without a name are new for each solution."""
    if any(not isinstance(t, Triple) or not isinstance(t.p, (Iri, Var)) for t in template):
        raise ValueError("a template holds plain statements only")
    whole = F.sha2(F.to_json(F.struct(*map(c, df.columns)), {"ignoreNullFields": "false"}), 256) if df.columns else F.lit("")

    def term(x: object) -> Column:
        if not isinstance(x, Var):
            return F.lit(str(x.value).lower() if isinstance(x.value, bool) else str(x.value))
        if x.name in df.columns:
            return c(x.name).cast("string")
        return F.concat(F.lit(f"_:{x.name.lstrip('_')}-"), whole) if x.name.startswith("_") else F.lit(None).cast("string")

    def kind(x: object) -> Column:
        plain = isinstance(x, Lit) and isinstance(x.value, str)
        return F.lit("uri" if isinstance(x, Iri) else "string" if plain else "any").alias("o_type")

    each = F.array(*[F.struct(*[term(x).alias(n) for n, x in (("s", t.s), ("p", t.p), ("o", t.o))], kind(t.o)) for t in template])
    return df.select(F.explode(each).alias("t")).select("t.s", "t.p", "t.o", "t.o_type").dropna()


def _aggregates(e: object) -> bool:
    return isinstance(e, Call) and (e.name in AGGREGATES or any(map(_aggregates, e.args)))


def _equals(x: object) -> Column:
    """The value of a row equals a term, in class and value."""
    if isinstance(x, Iri):
        return (F.col("v_type") == "uri") & (F.col("v_string") == x.value)
    if isinstance(x.value, bool):
        return F.coalesce(F.col("v_bool") == x.value, F.lit(False))
    if isinstance(x.value, (int, float)):
        return F.coalesce(num() == float(x.value), F.lit(False))
    return F.coalesce((F.col("v_type") != "uri") & (F.coalesce("v_string", "v_json") == x.value), F.lit(False))


def _parameters(x: object, namespace: str) -> set[str]:
    """Variables that a pattern takes as parameters of fetches."""
    if isinstance(x, Triple):
        taken = isinstance(x.p, Iri) and x.p.value in {namespace + k for k in ("from", "to", "limit", "interval", "op")}
        return variables(x.o) if taken else set()
    if isinstance(x, Query):
        return _parameters(x.group, namespace)
    if isinstance(x, (ast.Group, ast.Optional_, ast.Union, ast.Minus, ast.Service, ast.Graph)):
        return set().union(*(_parameters(v, namespace) for v in vars(x).values()))
    if isinstance(x, Iterable) and not isinstance(x, (str, bytes)):
        return set().union(*(_parameters(v, namespace) for v in x))
    return set()


def to_values(triples: DataFrame, namespace: str = NAMESPACE, now: int = 0) -> DataFrame:
    """Written triples (s, p, o, and maybe o_type) as rows of values: an object that is a node with a value brings time and seqNr.

    Texts are typed by how they are written unless o_type says uri or string.
    """
    from ..sources.csv_wide import typed_rows

    kind = F.col("o_type") if "o_type" in triples.columns else F.lit("any")
    triples = triples.select("s", "p", "o", kind.alias("k"))
    one = lambda k: F.max(F.when(F.col("p") == namespace + k, F.struct("o", "k")))
    nodes = triples.where(F.col("p").isin([namespace + k for k in ("value", "time", "seqNr")]))
    nodes = nodes.groupBy(F.col("s").alias("o")).agg(one("value").alias("v"), one("time")["o"].cast("long").alias("t"), one("seqNr")["o"].cast("int").alias("n"))
    rows = triples.where(~F.col("p").startswith(namespace)).join(nodes, "o", "left")
    rows = rows.select(
        F.lit(DEFAULT_CONTEXT).alias("context"), F.col("s").alias("item"), F.col("p").alias("property"),
        F.coalesce("t", F.lit(now).cast("long")).alias("time"), F.coalesce("n", F.lit(0)).alias("seqNr"),
        F.coalesce("v.o", "o").alias("raw"), F.when(F.col("v").isNull(), F.col("k")).otherwise(F.col("v.k")).alias("k"),
    )
    said = rows.where("k in ('uri', 'string')")
    said = said.select(*COLUMNS[:5], *value("string", F.col("raw")), "k").withColumn("v_type", F.col("k")).drop("k")
    return typed_rows(rows.where("k = 'any'"), "raw").unionByName(said)
