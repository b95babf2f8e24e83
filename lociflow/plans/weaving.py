"""Queries of painting by edges, three states, and their SQL equivalents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lociflow.cluster import Stored
from lociflow.operators import references, weave
from lociflow.sources import adapters as ad

Q = np.array([[-0.09, 0.05, 0.04], [0.03, -0.08, 0.05], [0.02, 0.06, -0.08]])
PI, DAYS, WIDTH = np.array([0.5, 0.3, 0.2]), 20000.0, 256.0
K, T = 3, 2.0
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _inputs(spark, sf):
    edges, nodes = ad.woven(spark, sf)
    e = F.when(F.col("time") == 0, weave.emissions(nodes, PI)).otherwise(F.array(*[F.lit(1.0)] * K))
    return edges, nodes.select("node", "time", e.alias("e")), nodes.where("time = 0").select(F.col("node").alias("sample"))


_P = weave.transitions(Q, np.array([T]))[0]
#: Rates by time cell, over branches from 0 to T.
CELLS = weave.ByCell(np.stack([Q, 0.5 * Q, 2.0 * Q[::-1, ::-1]]), np.array([0.25, 0.5, 1.25, 4.0]))
_PC = CELLS.moves(np.array([0.0]), np.array([T]))[0]
_n = lambda x: f"{float(x)!r}::DOUBLE"
_plus = " + ".join
def _sql(p: np.ndarray) -> str:
    return f"""WITH e AS (SELECT min(date_diff('day', DATE '1992-01-01', o_orderdate::DATE))::DOUBLE AS a, max(date_diff('day', DATE '1992-01-01', o_orderdate::DATE))::DOUBLE + 1 AS z, c_nationkey AS nation, c_custkey AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey),
    lab AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END END AS label, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS w FROM customer),
    em AS (SELECT k, {", ".join(f"CASE WHEN label IS NULL THEN {_n(PI[s])} ELSE w * (label = {s})::INT + (1::DOUBLE - w) * {_n(PI[s])} END AS e{s}" for s in range(K))} FROM lab),
    m AS (SELECT *, {", ".join("ln(" + _plus(f"{_n(p[s, j])} * e{j}" for j in range(K)) + f") AS m{s}" for s in range(K))} FROM em),
    pt AS (SELECT DISTINCT nation, x FROM (SELECT nation, a AS x FROM e UNION ALL SELECT nation, z FROM e)),
    iv AS (SELECT nation, x AS lo, lead(x) OVER (PARTITION BY nation ORDER BY x) AS hi FROM pt),
    h AS (SELECT iv.nation, lo, hi, m.* FROM iv JOIN e ON e.nation = iv.nation AND e.a <= lo AND lo < e.z JOIN m USING (k) WHERE hi IS NOT NULL),
    s AS (SELECT nation, lo, hi, {", ".join(f"sum(m{s}) AS s{s}" for s in range(K))} FROM h GROUP BY nation, lo, hi),
    c AS (SELECT h.*, {", ".join(f"ln({_n(PI[s])}) + s{s} - m{s} AS v{s}" for s in range(K))} FROM h JOIN s USING (nation, lo, hi)),
    d AS (SELECT *, {", ".join(_plus(f"exp(v{s} - greatest(v0, v1, v2)) * {_n(p[s, j])}" for s in range(K)) + f" AS u{j}" for j in range(K))} FROM c),
    g AS (SELECT k, lo, hi, {", ".join(f"u{j} * e{j} / (u0 * e0 + u1 * e1 + u2 * e2) AS g{j}, u{j} / (u0 + u1 + u2) AS o{j}" for j in range(K))} FROM d)"""


_SQL = _sql(_P)


def _pieces(kind: str) -> str:
    return _SQL + f" SELECT k::BIGINT AS sample, lo AS \"left\", hi AS \"right\", {', '.join(f'round({kind}{j}, 6) AS p{j}' for j in range(K))} FROM g"


def _painted(spark, sf, loo, digits):
    return weave.paint(*_inputs(spark, sf), Q, PI, DAYS, WIDTH, loo, digits)


@register("paint_pieces", _pieces("g"))
def _paint_pieces(spark, sf):
    return _painted(spark, sf, False, None).where("status = 'informative'").select("sample", "left", "right", *[F.round(f"p{s}", 6).alias(f"p{s}") for s in range(K)])


@register("paint_loo_pieces", _pieces("o"))
def _loo_pieces(spark, sf):
    return _painted(spark, sf, True, None).where("status = 'informative'").select("sample", "left", "right", *[F.round(f"p{s}", 6).alias(f"p{s}") for s in range(K)])


_SHARES = _SQL + f", w AS (SELECT k, sum(hi - lo) AS n, {', '.join(f'sum(g{j} * (hi - lo)) AS t{j}' for j in range(K))} FROM g GROUP BY k) SELECT c_custkey::BIGINT AS sample, 20000::DOUBLE - coalesce(n, 0) AS missing, " + ", ".join(f"round((coalesce(t{j}, 0) + (20000::DOUBLE - coalesce(n, 0)) * {_n(PI[j])}) / 20000::DOUBLE, 6) AS p{j}" for j in range(K)) + " FROM customer LEFT JOIN w ON k = c_custkey"


@register("paint_shares", _SHARES)
def _shares(spark, sf):
    """Each sample's share of every state over the whole axis, added up along it; stretches without information count as pi."""
    missing = F.lit(DAYS) - F.col("told")
    return weave.added(*_inputs(spark, sf), Q, PI, DAYS).select("sample", missing.alias("missing"), *[F.round((F.col(f"g{s}") + missing * F.lit(float(PI[s]))) / F.lit(DAYS), 6).alias(f"p{s}") for s in range(K)])


_Y = _plus(f"exp(v{i} - greatest(v0, v1, v2)) * {_n(_P[i, j])} * e{j}" for i in range(K) for j in range(K))
_WEIGHT = {(m, n): weave.rewards(Q, np.array([T]), m, n)[0] / _P for m in range(K) for n in range(K)}
_COUNTS = _SQL + f""", y AS (SELECT hi - lo AS span, {", ".join(f"exp(v{i} - greatest(v0, v1, v2)) * {_n(_P[i, j])} * e{j} / ({_Y}) AS x{i}{j}" for i in range(K) for j in range(K))} FROM d),
    b AS (SELECT {", ".join("sum(span * (" + _plus(f"x{i}{j} * {_n(_WEIGHT[m, n][i, j])}" for i in range(K) for j in range(K)) + f")) * {1.0 if m == n else float(Q[m, n])!r}::DOUBLE AS b{m}{n}" for m in range(K) for n in range(K))} FROM y),
    r AS (SELECT hi - lo AS span, {", ".join(f"ln({_n(PI[s])}) + s{s} AS l{s}" for s in range(K))} FROM s),
    z AS (SELECT {", ".join(f"sum(span * exp(l{s} - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2)))) AS r{s}" for s in range(K))}, sum(span * (greatest(l0, l1, l2) + ln(exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))))) AS loglik FROM r)"""


def _counts(spark, sf):
    edges, nodes, _ = _inputs(spark, sf)
    sums = weave.expected(edges, nodes, Q, PI)
    return weave.statistics(weave.part(sums, "branches", False), weave.part(sums, "roots", False), Q)


@register("edge_statistics", _COUNTS + " SELECT " + ", ".join([*[f"round(b{s}{s}, 3) AS dwell{s}" for s in range(K)], *[f"round(b{i}{j}, 3) AS jump{i}{j}" for i in range(K) for j in range(K) if i != j], *[f"round(r{s}, 3) AS root{s}" for s in range(K)], "round(loglik, 2) AS loglik"]) + " FROM b, z")
def _statistics(spark, sf):
    """Expected time in each state, jumps and root states over all branches, each weighted by its stretch of the axis."""
    at = lambda c, i: F.round(F.get(F.col(c), F.lit(i)), 3)
    return _counts(spark, sf).select(*[at("dwell", s).alias(f"dwell{s}") for s in range(K)], *[at("jumps", i * K + j).alias(f"jump{i}{j}") for i in range(K) for j in range(K) if i != j], *[at("root", s).alias(f"root{s}") for s in range(K)], F.round("loglik", 2).alias("loglik"))


@register("edge_m_step", _COUNTS + " SELECT " + ", ".join([*[f"round(b{i}{j} / b{i}{i}, 6) AS q{i}{j}" for i in range(K) for j in range(K) if i != j], *[f"round(r{s} / (r0 + r1 + r2), 6) AS pi{s}" for s in range(K)]]) + " FROM b, z")
def _m_step(spark, sf):
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    total = at("root", 0) + at("root", 1) + at("root", 2)
    return _counts(spark, sf).select(*[F.round(at("jumps", i * K + j) / at("dwell", i), 6).alias(f"q{i}{j}") for i in range(K) for j in range(K) if i != j], *[F.round(at("root", s) / total, 6).alias(f"pi{s}") for s in range(K)])


def _labelled(spark, sf):
    return ad.woven(spark, sf)[1].where("label IS NOT NULL").select("node", "label")


def _by_kind(spark, sf):
    """(painting by kinds, samples)"""
    edges, nodes, samples = _inputs(spark, sf)
    return weave.by_kind(edges, nodes, Q, PI, samples=samples), samples


def _agreed(spark, sf):
    return references.agreement_along(weave.added(*_inputs(spark, sf), Q, PI, DAYS).withColumnRenamed("sample", "node"), _labelled(spark, sf), K)


_OWN = ", r AS (SELECT g.*, hi - lo AS span, label, CASE label WHEN 0 THEN o0 WHEN 1 THEN o1 ELSE o2 END AS own FROM g JOIN lab USING (k) WHERE label IS NOT NULL)"
_AGREE = _SQL + _OWN + ", a AS (SELECT k, sum(own * span) / sum(span) AS agreement, sum(span) AS told FROM r GROUP BY k)"


@register("reference_agreement", _AGREE + " SELECT lab.k::BIGINT AS node, label, round(agreement, 6) AS agreement, coalesce(told, 0)::DOUBLE AS told FROM lab LEFT JOIN a ON lab.k = a.k WHERE label IS NOT NULL")
def _agreement(spark, sf):
    """What the rest of the genealogy says of each reference's own label, along its informative stretches."""
    got = _agreed(spark, sf)
    return got.select("node", "label", F.round("agreement", 6).alias("agreement"), "told")


@register("learned_credibility", _AGREE + " SELECT lab.k::BIGINT AS node, round((19::DOUBLE + coalesce(agreement * told, 0)) / (19::DOUBLE + coalesce(told, 0)), 6) AS w FROM lab LEFT JOIN a ON lab.k = a.k WHERE label IS NOT NULL")
def _credibility(spark, sf):
    got = references.learned_credibility(_agreed(spark, sf))
    return got.select("node", F.round("w", 6).alias("w"))


@register("reference_tracts", _SQL + _OWN + """, b AS (SELECT k, lo, hi, own, greatest(CASE WHEN label = 0 THEN -1 ELSE o0 END, CASE WHEN label = 1 THEN -1 ELSE o1 END, CASE WHEN label = 2 THEN -1 ELSE o2 END) AS best, label, o0, o1, o2 FROM r),
    f AS (SELECT k, lo, hi, CASE WHEN label <> 0 AND o0 = best THEN 0 WHEN label <> 1 AND o1 = best THEN 1 ELSE 2 END AS state FROM b WHERE best - own >= 0.1::DOUBLE),
    i AS (SELECT *, sum(CASE WHEN ph = lo AND ps = state THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY lo) AS n FROM (SELECT *, lag(hi) OVER w AS ph, lag(state) OVER w AS ps FROM f WINDOW w AS (PARTITION BY k ORDER BY lo)))
    SELECT k::BIGINT AS node, min(lo) AS "left", max(hi) AS "right", state FROM i GROUP BY k, n, state""")
def _tracts(spark, sf):
    return references.flagged_along(_by_kind(spark, sf)[0], _labelled(spark, sf), [f"p{s}" for s in range(K)], 0.1)


def _end_states(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(dwell, jumps) of each cell for a branch whose end states are i and j."""
    x = np.zeros((1, K, K))
    x[0, i, j] = 1.0
    return CELLS.rewards(np.array([0.0]), np.array([T]), x)


_BY_ENDS = [[_end_states(i, j) for j in range(K)] for i in range(K)]


def _cell_weights(c: int, m: int, n: int) -> np.ndarray:
    """What cell c adds for a branch whose end states are i and j, for all i and j."""
    return np.array([[dwell[c, m] if m == n else jumps[c, m, n] for dwell, jumps in row] for row in _BY_ENDS])


_YC = _plus(f"exp(v{i} - greatest(v0, v1, v2)) * {_n(_PC[i, j])} * e{j}" for i in range(K) for j in range(K))
_CELL_SQL = _sql(_PC) + f""", y AS (SELECT hi - lo AS span, {", ".join(f"exp(v{i} - greatest(v0, v1, v2)) * {_n(_PC[i, j])} * e{j} / ({_YC}) AS x{i}{j}" for i in range(K) for j in range(K))} FROM d),
    w AS (SELECT {", ".join(f"sum(span * x{i}{j}) AS x{i}{j}" for i in range(K) for j in range(K))} FROM y) """ + " UNION ALL ".join(
    f"SELECT {c} AS cell, " + ", ".join("round(" + _plus(f"x{i}{j} * {_n(_cell_weights(c, m, n)[i, j])}" for i in range(K) for j in range(K)) + f", 3) AS {'dwell' + str(m) if m == n else f'jump{m}{n}'}" for m in range(K) for n in range(K)) + " FROM w"
    for c in range(len(CELLS.q))
)


@register("time_cell_statistics", _CELL_SQL)
def _time_cells(spark, sf):
    """Time in each state and jumps in each cell of a time grid, under a generator for each cell."""
    edges, nodes, _ = _inputs(spark, sf)
    joints = weave.part(weave.expected(edges, nodes, CELLS, PI), "branches", False)
    at = lambda c, i: F.round(F.get(F.col(c), F.lit(i)), 3)
    return weave.cell_statistics(joints, CELLS).select("cell", *[(at("dwell", m).alias(f"dwell{m}") if m == n else at("jumps", m * K + n).alias(f"jump{m}{n}")) for m in range(K) for n in range(K)])


_FOREIGN = _SQL + """, fo AS (SELECT k, lo, hi, CASE label WHEN 0 THEN 1 - o0 WHEN 1 THEN 1 - o1 WHEN 2 THEN 1 - o2 ELSE (1 - greatest(o0, o1, o2)) / (1 - 1 / 3::DOUBLE) END AS score FROM g JOIN lab USING (k)),
    i AS (SELECT *, sum(CASE WHEN ph = lo THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY lo) AS n FROM (SELECT *, lag(hi) OVER (PARTITION BY k ORDER BY lo) AS ph FROM fo WHERE score >= 0.6::DOUBLE))
    SELECT k::BIGINT AS sample, min(lo) AS "left", max(hi) AS "right", round(sum(score * (hi - lo)) / sum(hi - lo), 5) AS score FROM i GROUP BY k, n"""


@register("foreign_by_the_rest", _FOREIGN)
def _foreign_tracts(spark, sf):
    """Stretches that the rest of the genealogy withholds from a reference's label, or that fit no state, from real leave-one-out tracks."""
    got = references.foreign_along(*_by_kind(spark, sf), _labelled(spark, sf), [f"p{s}" for s in range(K)], 0.6)
    return got.select("sample", "left", "right", F.round("score", 5).alias("score"))


@register("reference_summary", _AGREE + """, f AS (SELECT k, sum(span) AS f FROM r WHERE greatest(CASE WHEN label = 0 THEN -1 ELSE o0 END, CASE WHEN label = 1 THEN -1 ELSE o1 END, CASE WHEN label = 2 THEN -1 ELSE o2 END) - own >= 0.1::DOUBLE GROUP BY k),
    ck AS (SELECT lab.k, label, agreement, row_number() OVER (ORDER BY coalesce(agreement, -1) DESC, lab.k) AS place, count(*) OVER () AS n FROM lab LEFT JOIN a ON a.k = lab.k WHERE label IS NOT NULL)
    SELECT ck.k::BIGINT AS node, label, round(agreement, 6) AS agreement, place <= round_even(0.5::DOUBLE * n, 0) AS is_anchor, round(coalesce(f, 0) / 20000::DOUBLE, 6) AS foreign_share FROM ck LEFT JOIN f ON f.k = ck.k""")
def _summary(spark, sf):
    """What an audit reads from one leave-one-out painting: agreement, who may be an anchor, and how much of the axis is foreign."""
    states = [f"p{s}" for s in range(K)]
    kinds, refs = _by_kind(spark, sf)[0], Stored(_labelled(spark, sf), "references").df
    agreed = Stored(references.agreement_along(kinds.totals(K), refs, K), "agreement").df
    best = references.anchors(agreed).withColumn("is_anchor", F.lit(True))
    table = agreed.join(best, "node", "left").withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))
    foreign = references.flagged_along(kinds, refs, states, 0.1).groupBy("node").agg(F.sum(F.col("right") - F.col("left")).alias("__f"))
    got = table.join(foreign, "node", "left").withColumn("foreign_share", F.coalesce("__f", F.lit(0.0)) / F.lit(DAYS))
    return got.select("node", "label", F.round("agreement", 6).alias("agreement"), "is_anchor", F.round("foreign_share", 6).alias("foreign_share"))


@register("reference_audit")
def _audit(spark, sf):
    """The whole audit, two passes of learning each: credibility of every reference, its anchors and its foreign share."""
    edges, nodes = ad.woven(spark, sf)
    told = references.audit(edges, nodes.select("node", "time"), _labelled(spark, sf), Q, PI, DAYS, WIDTH, iterations=2)
    got = told.summary([f"p{s}" for s in range(K)], DAYS)
    return got.select("node", "label", *[F.round(c, 6).alias(c) for c in ("agreement", "learned", "credibility")], "is_anchor", F.round("foreign_share", 6).alias("foreign_share"))
