"""Queries over forests and edge intervals and their SQL equivalents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lociflow.functions.ctmc import _parts
from lociflow.operators import order
from lociflow.operators import pruning as pr
from lociflow.operators import topology as tp
from lociflow.sources import adapters as ad

A, B, PI, DAYS = 0.1, 0.2, (0.6, 0.4), 20000.0
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_EDGES = """e AS (SELECT min(date_diff('day', DATE '1992-01-01', o_orderdate::DATE))::DOUBLE AS "left", max(date_diff('day', DATE '1992-01-01', o_orderdate::DATE))::DOUBLE + 1 AS "right", c_nationkey::BIGINT AS parent, c_custkey AS child FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey),
    pts AS (SELECT DISTINCT x FROM (SELECT "left" AS x FROM e UNION ALL SELECT "right" FROM e UNION ALL SELECT unnest([0::DOUBLE, 20000::DOUBLE]))),
    tr AS (SELECT row_number() OVER (ORDER BY x) - 1 AS tree, x AS "left", lead(x) OVER (ORDER BY x) AS "right" FROM pts WHERE x BETWEEN 0 AND 20000)"""


@register("trees", f'WITH {_EDGES} SELECT tree::BIGINT AS tree, "left", "right" FROM tr WHERE "right" IS NOT NULL')
def _trees(spark, sf):
    return tp.trees(ad.edge_intervals(spark, sf), DAYS, 64.0)


@register("edge_spans", f'WITH {_EDGES} SELECT count(*) AS n, median("right" - "left") AS median, round(avg("right" - "left"), 6) AS mean, min("right" - "left") AS least, max("right" - "left") AS most FROM e')
def _spans(spark, sf):
    return _rounded(tp.edge_span_summary(ad.edge_intervals(spark, sf)))


_PERSIST = f"""WITH {_EDGES}, nd AS (SELECT "left", "right", 'p' || parent AS node FROM e UNION ALL SELECT "left", "right", 'c' || child FROM e),
    q AS (SELECT node, count(DISTINCT tree) AS trees FROM nd JOIN tr ON tr."right" IS NOT NULL AND nd."left" <= tr."left" AND tr."left" < nd."right" GROUP BY node)"""


@register("node_persistence", _PERSIST + "SELECT node, trees FROM q")
def _persistence(spark, sf):
    return tp.node_persistence(ad.edge_intervals(spark, sf), _trees(spark, sf), 64.0)


@register("persistence_summary", _PERSIST + "SELECT count(*) AS n, median(trees) AS median, max(trees) AS most, round(avg((trees = 1)::INT), 6) AS share_of_one FROM q")
def _persistence_summary(spark, sf):
    return _rounded(tp.persistence_summary(_persistence(spark, sf)))


@register("dense_rank_times", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_retailprice) - 1 AS rank FROM part")
def _rank(spark, sf):
    parts = ad.table(spark, sf, "part")
    return parts.select("p_partkey", "p_retailprice").join(order.ranked(parts, "p_retailprice", 10.0).drop("following"), "p_retailprice").select("p_partkey", "rank")


@register("missing_mask", """WITH y AS (SELECT unnest(range(1992, 2026)) AS y), h AS (SELECT DISTINCT o_custkey AS sample, year(o_orderdate) AS y FROM orders),
    m AS (SELECT c_custkey AS sample, y FROM customer, y WHERE y BETWEEN (SELECT min(y) FROM h) AND (SELECT max(y) FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.sample = c_custkey AND h.y = y.y)),
    g AS (SELECT *, y - row_number() OVER (PARTITION BY sample ORDER BY y) AS k FROM m) SELECT sample, min(y)::DOUBLE AS "left", max(y)::DOUBLE + 1 AS "right" FROM g GROUP BY sample, k""")
def _missing(spark, sf):
    present = ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("sample"), F.year("o_orderdate").cast("double").alias("left"))
    years = present.agg(F.min("left").alias("a"), F.max("left").alias("b")).select(F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))).alias("left")).withColumn("left", F.col("left").cast("double"))
    years = years.withColumn("right", F.col("left") + 1)  # one row a year of the calendar
    return tp.missing_mask(ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample")), years, present, 8.0)


@register("nearest_reference", """WITH l AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 5000 THEN (c_acctbal > 7000)::INT END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey),
    a AS (SELECT k, (SELECT min(x.k) FROM l x WHERE x.n = l.n AND x.k <> l.k AND x.label IS NOT NULL) AS near, (SELECT min(x.k) FROM l x WHERE x.r = l.r AND x.k <> l.k AND x.label IS NOT NULL) AS far FROM l)
    SELECT 'c' || a.k AS node, CASE WHEN near IS NOT NULL THEN 2::DOUBLE WHEN far IS NOT NULL THEN 3::DOUBLE END AS depth, x.label FROM a LEFT JOIN l x ON x.k = coalesce(near, far)""")
def _nearest(spark, sf):
    customers = ad.table(spark, sf, "customer")
    leaves = customers.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_custkey").alias("rank"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    refs = customers.where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000)).select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_custkey").alias("rank"), (F.col("c_acctbal") > 7000).cast("int").alias("label"))
    inner = ad.forest(spark, sf).where("level > 0").select("node", "parent", "time")
    return tp.nearest_reference(leaves, inner, refs)


_FOREST = """f AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent, (c_acctbal < 0)::INT AS label, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS w FROM customer),
    em AS (SELECT *, w * (label = 0)::INT + (1::DOUBLE - w) * 0.6::DOUBLE AS e0, w * (label = 1)::INT + (1::DOUBLE - w) * 0.4::DOUBLE AS e1 FROM f)"""


@register("emissions", f"WITH {_FOREST} SELECT node, round(e0, 9) AS e0, round(e1, 9) AS e1 FROM em")
def _emissions(spark, sf):
    return _rounded(pr.emissions(ad.forest(spark, sf), PI).where("level = 0").select("node", "e0", "e1"), 9)


@register("masked_emissions", f"WITH {_FOREST} SELECT node, CASE WHEN substr(node, 2)::BIGINT % 5 = 0 THEN 0.6::DOUBLE ELSE round(e0, 9) END AS e0, CASE WHEN substr(node, 2)::BIGINT % 5 = 0 THEN 0.4::DOUBLE ELSE round(e1, 9) END AS e1 FROM em")
def _masked(spark, sf):
    nodes = ad.forest(spark, sf)
    masked = nodes.where((F.col("level") == 0) & (F.substring("node", 2, 20).cast("long") % 5 == 0))
    return _rounded(pr.emissions(nodes, PI, masked).where("level = 0").select("node", "e0", "e1"), 9)


def _p(t: str, i: int, j: int) -> str:
    s, big, rest = _parts(A, B)
    return f"({big[i, j]!r}::DOUBLE + {rest[i, j]!r}::DOUBLE * exp(-{s!r}::DOUBLE * {t}))".replace("np.float64(", "").replace(")::", "::")


def _msg(t: str, l: str) -> str:
    return ", ".join(f"ln({_p(t, s, 0)} * exp({l}0 - greatest({l}0, {l}1)) + {_p(t, s, 1)} * exp({l}1 - greatest({l}0, {l}1))) + greatest({l}0, {l}1) AS m{s}" for s in (0, 1))


def _down(t: str, h: str) -> str:
    return ", ".join(f"ln(exp(v0 - greatest(v0, v1)) * {_p(t, 0, j)} + exp(v1 - greatest(v0, v1)) * {_p(t, 1, j)}) + greatest(v0, v1) AS u{j}" for j in (0, 1))


_PRUNE = f"""WITH {_FOREST}, l0 AS (SELECT *, ln(e0) AS l0, ln(e1) AS l1 FROM em), u0 AS (SELECT *, {_msg('2::DOUBLE', 'l')} FROM l0),
    n0 AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent, coalesce((SELECT sum(m0) FROM u0 WHERE u0.parent = 'n' || n_nationkey), 0) AS l0, coalesce((SELECT sum(m1) FROM u0 WHERE u0.parent = 'n' || n_nationkey), 0) AS l1 FROM nation),
    u1 AS (SELECT *, {_msg('1::DOUBLE', 'l')} FROM n0),
    r0 AS (SELECT 'r' || r_regionkey AS node, coalesce((SELECT sum(m0) FROM u1 WHERE u1.parent = 'r' || r_regionkey), 0) AS l0, coalesce((SELECT sum(m1) FROM u1 WHERE u1.parent = 'r' || r_regionkey), 0) AS l1 FROM region),
    rt AS (SELECT *, ln(0.6::DOUBLE) AS u0, ln(0.4::DOUBLE) AS u1, ln(0.6::DOUBLE * exp(l0 - greatest(l0, l1)) + 0.4::DOUBLE * exp(l1 - greatest(l0, l1))) + greatest(l0, l1) AS loglik FROM r0),
    nv AS (SELECT u1.*, rt.u0 + rt.l0 - u1.m0 AS v0, rt.u1 + rt.l1 - u1.m1 AS v1 FROM u1 JOIN rt ON u1.parent = rt.node), nd AS (SELECT *, {_down('1::DOUBLE', 'v')} FROM nv),
    cv AS (SELECT u0.node, u0.label, u0.l0, u0.l1, nd.u0 + nd.l0 - u0.m0 AS v0, nd.u1 + nd.l1 - u0.m1 AS v1 FROM u0 JOIN nd ON u0.parent = nd.node), cd AS (SELECT *, {_down('2::DOUBLE', 'v')} FROM cv)"""


def _pruned(spark, sf):
    return pr.prune(pr.emissions(ad.forest(spark, sf), PI), A, B, PI, 3).df


@register("prune_loglik", _PRUNE + "SELECT node, round(loglik, 6) AS loglik FROM rt")
def _loglik(spark, sf):
    return _rounded(_pruned(spark, sf).where("level = 2").select("node", "loglik"))


@register("prune_posterior", _PRUNE + "SELECT node, round(1 / (1 + exp(u1 + l1 - u0 - l0)), 6) AS g0 FROM cd UNION ALL SELECT node, round(1 / (1 + exp(u1 + l1 - u0 - l0)), 6) FROM nd UNION ALL SELECT node, round(1 / (1 + exp(u1 + l1 - u0 - l0)), 6) FROM rt")
def _posterior(spark, sf):
    return _rounded(_pruned(spark, sf).select("node", "g0"))


@register("prune_loo", _PRUNE + "SELECT node, round(1 / (1 + exp(u1 - u0)), 6) AS loo0 FROM cd")
def _loo(spark, sf):
    return _rounded(_pruned(spark, sf).where("level = 0").select("node", "loo0"))


_XI = ", ".join(f"exp(v{i} + ln({_p('2::DOUBLE', i, j)}) + l{j} - greatest(v0 + l0, v0 + l1, v1 + l0, v1 + l1)) AS y{i}{j}" for i in (0, 1) for j in (0, 1))
_XI1 = _XI.replace("2::DOUBLE", "1::DOUBLE")


@register("prune_xi", _PRUNE + f", x AS (SELECT node, {_XI} FROM cv) SELECT node, round(y00 / (y00 + y01 + y10 + y11), 6) AS x00, round(y01 / (y00 + y01 + y10 + y11), 6) AS x01, round(y10 / (y00 + y01 + y10 + y11), 6) AS x10, round(y11 / (y00 + y01 + y10 + y11), 6) AS x11 FROM x")
def _xi(spark, sf):
    return _rounded(_pruned(spark, sf).where("level = 0").select("node", "x00", "x01", "x10", "x11"))


def _reward(t: float, m: int, n: int) -> str:
    from lociflow.functions.ctmc import generator, reward_integral, transition

    unit = np.zeros((2, 2))
    unit[m, n] = 1.0
    weight = reward_integral(generator(A, B), unit, t) / transition(generator(A, B), t)
    return " + ".join(f"y{i}{j} / (y00 + y01 + y10 + y11) * {float(weight[i, j])!r}::DOUBLE" for i in (0, 1) for j in (0, 1))


_STATS = _PRUNE + f""", x AS (SELECT 2 AS t, {_XI} FROM cv UNION ALL SELECT 1, {_XI1} FROM nv),
    s AS (SELECT {', '.join(f"sum(CASE WHEN t = 2 THEN {_reward(2.0, m, n)} ELSE {_reward(1.0, m, n)} END) AS s{m}{n}" for m in (0, 1) for n in (0, 1))} FROM x),
    z AS (SELECT sum(1 / (1 + exp(u1 + l1 - u0 - l0))) AS root0, sum(1 / (1 + exp(u0 + l0 - u1 - l1))) AS root1, sum(loglik) AS loglik FROM rt)"""


@register("suffstats", _STATS + "SELECT round(s00, 5) AS dwell0, round(s11, 5) AS dwell1, round(0.1::DOUBLE * s01, 5) AS jump01, round(0.2::DOUBLE * s10, 5) AS jump10, round(root0, 5) AS root0, round(root1, 5) AS root1, round(loglik, 5) AS loglik FROM s, z")
def _suffstats(spark, sf):
    return _rounded(pr.sufficient_statistics(_pruned(spark, sf), A, B), 5)


@register("m_step", _STATS + "SELECT round(0.1::DOUBLE * s01 / s00, 6) AS a, round(0.2::DOUBLE * s10 / s11, 6) AS b, round(root0 / (root0 + root1), 6) AS pi0 FROM s, z")
def _m_step(spark, sf):
    s = pr.sufficient_statistics(_pruned(spark, sf), A, B)
    return _rounded(s.select(F.try_divide("jump01", "dwell0").alias("a"), F.try_divide("jump10", "dwell1").alias("b"), F.try_divide(F.col("root0"), F.col("root0") + F.col("root1")).alias("pi0")))


def _em_sql(passes: int) -> str:
    """Expectation-maximisation written out: each pass reads the rates that the one before ends with, as columns a, b, p."""
    to = lambda j: "(b / (a + b))" if j == 0 else "(a / (a + b))"
    rest = lambda i, j: f"({int(i == j)} - {to(j)})"
    move = lambda t, i, j: f"({to(j)} + {rest(i, j)} * exp(-(a + b) * {t}))"
    top = lambda x, y: f"greatest({x}, {y})"

    def message(t: str) -> str:
        return ", ".join(f"ln({move(t, s, 0)} * exp(l0 - {top('l0', 'l1')}) + {move(t, s, 1)} * exp(l1 - {top('l0', 'l1')})) + {top('l0', 'l1')} AS m{s}" for s in (0, 1))

    def reward(m: int, n: int) -> str:
        one, last = "(1 - exp(-(a + b) * t)) / (a + b)", "t * exp(-(a + b) * t)"
        part = lambda i, j: f"({to(m)} * {to(j)} * t + {one} * ({to(m)} * {rest(n, j)} + {rest(i, m)} * {to(j)}) + {last} * {rest(i, m)} * {rest(n, j)})"
        return " + ".join(f"y{i}{j} / (y00 + y01 + y10 + y11) / {move('t', i, j)} * {part(i, j)}" for i in (0, 1) for j in (0, 1))

    joint = lambda t: ", ".join(f"exp(v{i} + ln({move(t, i, j)}) + l{j} - greatest(v0 + l0, v0 + l1, v1 + l0, v1 + l1)) AS y{i}{j}" for i in (0, 1) for j in (0, 1))
    sums = lambda under, key: ", ".join(f"coalesce((SELECT sum(m{s}) FROM {under} x WHERE x.parent = {key}), 0) AS l{s}" for s in (0, 1))
    parts = ["f AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent, (c_acctbal < 0)::INT AS label, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS w FROM customer)", f"q0 AS (SELECT {A}::DOUBLE AS a, {B}::DOUBLE AS b, {PI[0]}::DOUBLE AS p)"]
    for k in range(passes):
        parts += [
            f"c{k} AS (SELECT node, parent, ln(w * (label = 0)::INT + (1 - w) * p) AS l0, ln(w * (label = 1)::INT + (1 - w) * (1 - p)) AS l1, a, b, p FROM f, q{k})",
            f"cu{k} AS MATERIALIZED (SELECT *, {message('2')} FROM c{k})",
            f"n{k} AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent, {sums(f'cu{k}', "'n' || n_nationkey")}, a, b, p FROM nation, q{k})",
            f"nu{k} AS MATERIALIZED (SELECT *, {message('1')} FROM n{k})",
            f"r{k} AS (SELECT 'r' || r_regionkey AS node, {sums(f'nu{k}', "'r' || r_regionkey")}, a, b, p FROM region, q{k})",
            f"rt{k} AS MATERIALIZED (SELECT *, ln(p) AS u0, ln(1 - p) AS u1, ln(p * exp(l0 - {top('l0', 'l1')}) + (1 - p) * exp(l1 - {top('l0', 'l1')})) + {top('l0', 'l1')} AS loglik FROM r{k})",
            f"nv{k} AS (SELECT x.*, r.u0 + r.l0 - x.m0 AS v0, r.u1 + r.l1 - x.m1 AS v1 FROM nu{k} x JOIN rt{k} r ON x.parent = r.node)",
            f"nd{k} AS (SELECT *, " + ", ".join(f"ln(exp(v0 - {top('v0', 'v1')}) * {move('1', 0, j)} + exp(v1 - {top('v0', 'v1')}) * {move('1', 1, j)}) + {top('v0', 'v1')} AS u{j}" for j in (0, 1)) + f" FROM nv{k})",
            f"cv{k} AS (SELECT x.*, n.u0 + n.l0 - x.m0 AS v0, n.u1 + n.l1 - x.m1 AS v1 FROM cu{k} x JOIN nd{k} n ON x.parent = n.node)",
            f"x{k} AS (SELECT 2::DOUBLE AS t, a, b, {joint('2')} FROM cv{k} UNION ALL SELECT 1::DOUBLE, a, b, {joint('1')} FROM nv{k})",
            f"s{k} AS (SELECT " + ", ".join(f"sum({reward(m, n)}) AS s{m}{n}" for m in (0, 1) for n in (0, 1)) + f" FROM x{k})",
            f"z{k} AS MATERIALIZED (SELECT sum(1 / (1 + exp(u1 + l1 - u0 - l0))) AS root0, sum(1 / (1 + exp(u0 + l0 - u1 - l1))) AS root1, sum(loglik) AS loglik FROM rt{k})",
            f"q{k + 1} AS MATERIALIZED (SELECT a * s01 / s00 AS a, b * s10 / s11 AS b, root0 / (root0 + root1) AS p FROM s{k}, z{k}, q{k})",
        ]
    rows = " UNION ALL ".join(f"SELECT {k} AS iteration, round(a, 6) AS a, round(b, 6) AS b, round(p, 6) AS pi0, round(1 - p, 6) AS pi1, round(loglik, 6) AS loglik FROM q{k}, z{k}" for k in range(passes))
    return "WITH " + ",\n    ".join(parts) + "\n    " + rows


@register("em_fit", _em_sql(4))
def _em(spark, sf):
    """Four passes; whole fits run to the tolerance by default (pruning.fit, weave.fit)."""
    return _rounded(pr.fit(ad.forest(spark, sf), A, B, PI, 3, iterations=4))
