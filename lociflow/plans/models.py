"""Queries of smoothing, hidden states, depths, dating, genotypes, formats and streams, and their SQL equivalents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociflow.cluster import Folder
from lociflow.functions import splines
from lociflow.operators import chains, genotypes, order
from lociflow.operators import intervals as iv
from lociflow.operators import metrics as mt
from lociflow.plans.tracks import BIN, STATES, _BOTH, _tracks_sql
from lociflow.sources import adapters as ad
from lociflow.sources import arrays, formats
from lociflow.streaming.windows import scratch, stream_windows

EPSILON, MU, SD = 0.05, (50.0, 150.0), (40.0, 60.0)
HMM = np.array([[0.95, 0.05], [0.1, 0.9]])
START = np.array([0.8, 0.2])
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


def _chain_sql(rows: str, a: np.ndarray, pi: np.ndarray) -> str:
    """rows: a CTE c0(sample, "left", e0, e1, ...); gives g(sample, "left", g0)."""
    (p, q), (r, s) = a.tolist()
    return f"""{rows}, c AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY "left") AS n, count(*) OVER (PARTITION BY sample) AS k FROM c0),
    fw AS (SELECT sample, n, {pi[0]}::DOUBLE * e0 / ({pi[0]}::DOUBLE * e0 + {pi[1]}::DOUBLE * e1) AS a0 FROM c WHERE n = 1
           UNION ALL SELECT c.sample, c.n, (a0 * {p}::DOUBLE + (1 - a0) * {r}::DOUBLE) * e0 / ((a0 * {p}::DOUBLE + (1 - a0) * {r}::DOUBLE) * e0 + (a0 * {q}::DOUBLE + (1 - a0) * {s}::DOUBLE) * e1) FROM fw JOIN c ON c.sample = fw.sample AND c.n = fw.n + 1),
    bw AS (SELECT sample, n, 0.5::DOUBLE AS b0 FROM c WHERE n = k
           UNION ALL SELECT c.sample, c.n - 1, ({p}::DOUBLE * e0 * b0 + {q}::DOUBLE * e1 * (1 - b0)) / (({p + r}::DOUBLE) * e0 * b0 + ({q + s}::DOUBLE) * e1 * (1 - b0)) FROM bw JOIN c ON c.sample = bw.sample AND c.n = bw.n AND c.n > 1),
    g AS (SELECT c.*, a0 * b0 / (a0 * b0 + (1 - a0) * (1 - b0)) AS g0 FROM c JOIN fw USING (sample, n) JOIN bw USING (sample, n))"""


_SMOOTH = (1 - EPSILON) * np.eye(2) + EPSILON / 2


@register("smoother", "WITH RECURSIVE " + _tracks_sql() + ", " + _chain_sql('c0 AS (SELECT *, p0 / 0.5::DOUBLE AS e0, p1 / 0.5::DOUBLE AS e1 FROM t)', _SMOOTH, np.array([0.5, 0.5])) + ' SELECT sample, "left", "right", round(CASE WHEN k < 2 THEN p0 ELSE g0 END, 6) AS p0, status FROM g')
def _smoother(spark, sf):
    return _rounded(chains.smooth(ad.event_tracks(spark, sf), EPSILON, 7 * BIN).select("sample", "left", "right", "p0", "status"))


def _three_sql() -> str:
    """Forward and backward steps for three states, whose chance of a fresh draw is EPSILON."""
    stay, fresh = 1 - EPSILON, EPSILON / 3
    step = lambda a, j: f"({stay!r}::DOUBLE * {a}{j} + {fresh!r}::DOUBLE * ({a}0 + {a}1 + {a}2))"
    norm = lambda x: ", ".join(f"{v} / ({' + '.join(x)})" for v in x)
    on = [f"{step('f.f', j)} * c.e{j}" for j in range(3)]
    back = [f"({stay!r}::DOUBLE * c.e{j} * b.b{j} + {fresh!r}::DOUBLE * (c.e0 * b.b0 + c.e1 * b.b1 + c.e2 * b.b2))" for j in range(3)]
    return f"""c AS (SELECT *, p0 / 0.5::DOUBLE AS e0, p1 * 0.6::DOUBLE / 0.3::DOUBLE AS e1, p1 * 0.4::DOUBLE / 0.2::DOUBLE AS e2, row_number() OVER (PARTITION BY sample ORDER BY "left") AS n, count(*) OVER (PARTITION BY sample) AS k FROM t),
    fw(sample, n, f0, f1, f2) AS (SELECT sample, n, {norm(["e0", "e1", "e2"])} FROM c WHERE n = 1 UNION ALL SELECT c.sample, c.n, {norm(on)} FROM fw f JOIN c ON c.sample = f.sample AND c.n = f.n + 1),
    bw(sample, n, b0, b1, b2) AS (SELECT sample, n, 1::DOUBLE, 1::DOUBLE, 1::DOUBLE FROM c WHERE n = k UNION ALL SELECT c.sample, c.n - 1, {norm(back)} FROM bw b JOIN c ON c.sample = b.sample AND c.n = b.n AND c.n > 1)
    SELECT sample, "left", "right", {", ".join(f"round(CASE WHEN k < 2 THEN {'p0' if j == 0 else 'p1 * ' + str((0.6, 0.4)[j - 1]) + '::DOUBLE'} ELSE f{j} * b{j} / (f0 * b0 + f1 * b1 + f2 * b2) END, 6) AS p{j}" for j in range(3))} FROM c JOIN fw USING (sample, n) JOIN bw USING (sample, n)"""


@register("smoother_three", "WITH RECURSIVE " + _tracks_sql() + ", " + _three_sql())
def _smoother_three(spark, sf):
    """Tracks of three states, smoothed along each sample."""
    tracks = ad.event_tracks(spark, sf).withColumns({"p1": F.col("p1") * 0.6, "p2": F.col("p1") * 0.4})
    return _rounded(chains.smooth(tracks, EPSILON, 7 * BIN, (0.5, 0.3, 0.2)).select("sample", "left", "right", "p0", "p1", "p2"))


def _depths(spark, sf):
    tiled = iv.tile_markers(ad.event_markers(spark, sf), ["sample"], "pos", ad.LENGTH, ["event_id"], ad.BIN)
    return tiled.select("sample", "left", "right", F.when(F.col("event_type") != "error", F.col("value")).alias("depth"), F.when(F.col("event_type") == "error", "missing-info").otherwise("informative").alias("status"))


_GAUSS = ", ".join(f"CASE WHEN event_type = 'error' THEN 1::DOUBLE ELSE greatest(exp(-0.5::DOUBLE * pow((value - {MU[k]}::DOUBLE) / {SD[k]}::DOUBLE, 2)) / {SD[k]}::DOUBLE, 1e-300) END AS e{k}" for k in (0, 1))
_GHOST = "WITH RECURSIVE " + _tracks_sql() + ", " + _chain_sql(f"""c0 AS (SELECT sample, "left", "right", event_type, {_GAUSS} FROM t_m WHERE "left" < "right")""", HMM, START)


def _decoded(spark, sf):
    depths = _depths(spark, sf)
    got = chains.forward_backward(chains.gaussian_emissions(depths, MU, SD), "sample", HMM, START, 7 * BIN)
    return depths.join(got.select("sample", "left", F.col("g1").alias("p1")), ["sample", "left"])


@register("ghost_decode", _GHOST + ' SELECT sample, "left", round(1 - g0, 6) AS p1 FROM g')
def _ghost(spark, sf):
    return _rounded(_decoded(spark, sf).select("sample", "left", "p1"))


@register("ghost_burden", _GHOST + """ SELECT sample, round(sum(CASE WHEN event_type <> 'error' THEN (1 - g0) * ("right" - "left") END) / sum(CASE WHEN event_type <> 'error' THEN "right" - "left" END), 6) AS burden FROM g GROUP BY sample""")
def _burden(spark, sf):
    return _rounded(chains.burden(_decoded(spark, sf)))


@register("ghost_fit")
def _ghost_fit(spark, sf):
    return _rounded(chains.ghost_fit(_depths(spark, sf), (MU[0], SD[0]), 90.0, 7 * BIN), 4)


_W = 'd AS (SELECT sample, "left", "right" - "left" AS w, CASE WHEN event_type <> \'error\' THEN value END AS depth FROM t_m WHERE "left" < "right")'


@register("depth_rank", f'WITH {_tracks_sql()}, {_W} SELECT sample, "left", CASE WHEN depth IS NOT NULL THEN round(sum(w) FILTER (depth IS NOT NULL) OVER (ORDER BY depth RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) FILTER (depth IS NOT NULL) OVER (), 6) END AS share FROM d')
def _depth_rank(spark, sf):
    rows = _depths(spark, sf).withColumn("w", F.col("right") - F.col("left"))
    return _rounded(order.cumulative_share(rows, [], "depth", "w", 5.0).select("sample", "left", "share"))


@register("depth_anchor", f"""WITH {_tracks_sql()}, {_W}, s AS (SELECT sum(w * depth) / sum(w) AS mean FROM d WHERE depth IS NOT NULL),
    f AS (SELECT depth, sum(w) OVER (ORDER BY depth RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER () AS f FROM d WHERE depth IS NOT NULL)
    SELECT round(mean, 6) AS mean, round(greatest(0.001::DOUBLE, (SELECT sqrt(sum(w * pow(depth - mean, 2)) / sum(w)) FROM d WHERE depth IS NOT NULL)), 6) AS sd, (SELECT min(depth) FROM f WHERE f >= 0.95::DOUBLE) AS upper FROM s""")
def _anchor(spark, sf):
    """Weighted mean, deviation (0.001 at least) and the first depth whose weighted rank reaches 0.95."""
    rows = _depths(spark, sf).where("depth IS NOT NULL").withColumn("w", F.col("right") - F.col("left"))
    ranks = order.cumulative_share(rows, [], "depth", "w", 5.0)
    mean = F.sum(F.col("w") * F.col("depth")) / F.sum("w")
    variance = F.sum(F.col("w") * F.col("depth") ** 2) / F.sum("w") - mean * mean
    return _rounded(ranks.agg(mean.alias("mean"), F.greatest(F.lit(0.001), F.sqrt(F.greatest(F.lit(0.0), variance))).alias("sd"), F.min(F.when(F.col("share") >= 0.95, F.col("depth"))).alias("upper")))


def _loo_tracks(spark, sf):
    """Leave-one-out posteriors of references: the label of a sample is its parity."""
    return ad.event_tracks(spark, sf).withColumn("label", (F.col("sample") % 2).cast("int")).withColumns({"own": F.when(F.col("label") == 0, F.col("p0")).otherwise(F.col("p1")), "other": F.when(F.col("label") == 0, F.col("p1")).otherwise(F.col("p0"))})


_LOO = f"""WITH {_tracks_sql()}, k AS (SELECT *, CASE WHEN sample % 2 = 0 THEN p0 ELSE p1 END AS own, CASE WHEN sample % 2 = 0 THEN p1 ELSE p0 END AS other FROM t)"""
_ISLANDS = """, i AS (SELECT *, sum(CASE WHEN pr = "left" THEN 0 ELSE 1 END) OVER (PARTITION BY sample ORDER BY "left") AS g FROM (SELECT *, lag("right") OVER (PARTITION BY sample ORDER BY "left") AS pr FROM h))"""


@register("foreign_tracts", _LOO + """, h AS (SELECT sample, "left", "right", 1 - own AS score FROM k WHERE status = 'informative' AND 1 - own >= 0.6)""" + _ISLANDS + """ SELECT sample, min("left") AS "left", max("right") AS "right", round(sum(score * ("right" - "left")) / sum("right" - "left"), 6) AS score FROM i GROUP BY sample, g""")
def _foreign(spark, sf):
    rows = _loo_tracks(spark, sf).where("status = 'informative'").withColumn("score", F.lit(1.0) - F.col("own")).where("score >= 0.6")
    return _rounded(iv.merge_runs(rows.select("sample", "left", "right", "score"), ["sample"], [], ad.BIN, weighted="score").select("sample", "left", "right", "score"))


@register("qc_flagged", _LOO + """, h AS (SELECT sample, "left", "right" FROM k WHERE status = 'informative' AND other - own >= 0.4)""" + _ISLANDS + """ SELECT sample, (1 - sample % 2)::INT AS state, min("left") AS "left", max("right") AS "right" FROM i GROUP BY sample, g""")
def _flagged(spark, sf):
    rows = _loo_tracks(spark, sf).where("status = 'informative' AND other - own >= 0.4")
    return iv.merge_runs(rows.select("sample", "left", "right", (1 - F.col("label")).alias("state")), ["sample"], ["state"], BIN).select("sample", "state", "left", "right")


_QC = _LOO + """, q AS (SELECT sample, sum(CASE WHEN status = 'informative' THEN own * ("right" - "left") END) / sum(CASE WHEN status = 'informative' THEN "right" - "left" END) AS agreement, sum(CASE WHEN status = 'informative' AND other - own >= 0.4 THEN "right" - "left" ELSE 0 END) / 2592000::DOUBLE AS foreign_share FROM k GROUP BY sample)"""


def _qc(spark, sf):
    w = F.col("right") - F.col("left")
    ok = F.col("status") == "informative"
    return _loo_tracks(spark, sf).groupBy("sample").agg(F.try_divide(F.sum(F.when(ok, F.col("own") * w)), F.sum(F.when(ok, w))).alias("agreement"), (F.sum(F.when(ok & (F.col("other") - F.col("own") >= 0.4), w).otherwise(0.0)) / F.lit(ad.LENGTH)).alias("foreign_share"))


@register("qc_summary", _QC + " SELECT sample, round(agreement, 6) AS agreement, round(foreign_share, 6) AS foreign_share FROM q")
def _qc_summary(spark, sf):
    return _rounded(_qc(spark, sf))


@register("top_anchors", _QC + " SELECT sample, round(agreement, 6) AS agreement FROM (SELECT *, row_number() OVER (ORDER BY coalesce(round(agreement, 9), -1) DESC, sample) AS r, count(*) OVER () AS n FROM q) WHERE r <= least(n - 1, greatest(1, round_even(0.5 * n, 0)))")
def _anchors(spark, sf):
    """The half of the references (one at least, never all) that agree best with their labels; one row a reference."""
    every = W.partitionBy(F.lit(0))
    rows = _qc(spark, sf).withColumn("n", F.count(F.lit(1)).over(every)).withColumn("r", F.row_number().over(every.orderBy(F.coalesce(F.round("agreement", 9), F.lit(-1.0)).desc(), "sample")))
    return rows.where(F.col("r") <= F.least(F.col("n") - 1, F.greatest(F.lit(1), F.bround(0.5 * F.col("n"))))).select("sample", F.round("agreement", 6).alias("agreement"))


EDGES = [float(2**k) for k in range(13)]


def _cells(spark, sf):
    """(cell, branches, exposure, events) of branches from the earlier to the later of order and ship day, over a grid of doubling times."""
    start = F.lit("1991-12-31").cast("date")
    rows = ad.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag").join(ad.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.datediff(F.col("o_orderdate").cast("date"), start).cast("double"), F.datediff(F.col("l_shipdate").cast("date"), start).cast("double")
    rows = rows.select(F.least(a, b).alias("child"), F.greatest(a, b).alias("parent"), (F.col("l_returnflag") == "R").cast("double").alias("event")).where("child < parent")
    cell = lambda t: sum(((t >= F.lit(e)).cast("int") for e in EDGES[1:-1]), F.lit(0))
    rows = rows.withColumn("cell", F.explode(F.sequence(cell(F.col("child")), cell(F.col("parent")))))
    edge = F.array(*[F.lit(e) for e in EDGES])
    low = F.when(F.col("cell") == 0, F.lit(float("-inf"))).otherwise(F.get(edge, F.col("cell")))
    high = F.when(F.col("cell") == len(EDGES) - 2, F.lit(float("inf"))).otherwise(F.get(edge, F.col("cell") + 1))
    part = F.least("parent", high) - F.greatest("child", low)
    share = part / (F.col("parent") - F.col("child"))
    return rows.withColumns({"part": part, "share": share}).where("part > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("branches"), F.sum("part").alias("exposure"), F.sum(F.col("event") * F.col("share")).alias("events"))


@register("time_cells", f"""WITH b AS (SELECT date_diff('day', DATE '1991-12-31', o_orderdate::DATE)::DOUBLE AS x, date_diff('day', DATE '1991-12-31', l_shipdate::DATE)::DOUBLE AS y, (l_returnflag = 'R')::INT::DOUBLE AS event FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    c AS (SELECT k AS cell, CASE WHEN k = 0 THEN '-inf'::DOUBLE ELSE pow(2, k) END AS lo, CASE WHEN k = {len(EDGES) - 2} THEN 'inf'::DOUBLE ELSE pow(2, k + 1) END AS hi FROM (SELECT unnest(range({len(EDGES) - 1})) AS k)),
    p AS (SELECT cell, least(greatest(x, y), hi) - greatest(least(x, y), lo) AS part, event, greatest(x, y) - least(x, y) AS whole FROM b, c WHERE x <> y AND least(greatest(x, y), hi) - greatest(least(x, y), lo) > 0)
    SELECT cell::INT AS cell, count(*) AS branches, round(sum(part), 3) AS exposure, round(sum(event * part / whole), 3) AS events FROM p GROUP BY cell""")
def _time_cells(spark, sf):
    return _rounded(_cells(spark, sf), 3)


def _rates(spark, sf):
    rows = _cells(spark, sf).orderBy("cell").collect()  # at most as many as the grid has cells
    centers = splines.cell_centers(np.array(EDGES))
    events, exposure = np.zeros(len(centers)), np.zeros(len(centers))
    for r in rows:
        events[r.cell], exposure[r.cell] = r.events, r.exposure
    return centers, events, exposure


@register("rate_splines")
def _splines(spark, sf):
    centers, events, exposure = _rates(spark, sf)
    rates, smoothing = splines.best_spline(centers, events, exposure)
    return spark.createDataFrame([(float(c), float(e), float(x), round(float(r), 9), smoothing) for c, e, x, r in zip(centers, events, exposure, rates, strict=True)], "center double, events double, exposure double, rate double, smoothing double")


_CELLS = f"""WITH b AS (SELECT date_diff('day', DATE '1991-12-31', o_orderdate::DATE)::DOUBLE AS x, date_diff('day', DATE '1991-12-31', l_shipdate::DATE)::DOUBLE AS y, (l_returnflag = 'R')::INT::DOUBLE AS event FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    c AS (SELECT k AS cell, CASE WHEN k = 0 THEN '-inf'::DOUBLE ELSE pow(2, k) END AS lo, CASE WHEN k = {len(EDGES) - 2} THEN 'inf'::DOUBLE ELSE pow(2, k + 1) END AS hi FROM (SELECT unnest(range({len(EDGES) - 1})) AS k)),
    p AS (SELECT cell, least(greatest(x, y), hi) - greatest(least(x, y), lo) AS part, event, greatest(x, y) - least(x, y) AS whole FROM b, c WHERE x <> y AND least(greatest(x, y), hi) - greatest(least(x, y), lo) > 0),
    t AS (SELECT cell, sum(part) AS exposure, sum(event * part / whole) AS events FROM p GROUP BY cell)"""


@register("split_time", _CELLS + """, u AS (SELECT cell, events / exposure AS r, row_number() OVER (ORDER BY cell) AS n, count(*) OVER () AS k FROM t WHERE exposure >= 0.01::DOUBLE * (SELECT max(exposure) FROM t)),
    h AS (SELECT min(r) + 0.5::DOUBLE * (max(r) - min(r)) AS half, max(k) AS k, avg(r) FILTER (n > k - greatest(1, k // 4)) >= avg(r) FILTER (n <= greatest(1, k // 4)) AS rising, max(r) > 0 AND max(r) > min(r) AS moves FROM u)
    SELECT CASE WHEN max(moves::INT) = 1 AND max(h.k) >= 2 THEN round(sqrt(pow(2::DOUBLE, min(cell)) * pow(2::DOUBLE, min(cell) + 1)), 6) END AS split_time FROM u, h WHERE CASE WHEN rising THEN r >= half ELSE r <= half END""")
def _split(spark, sf):
    centers, events, exposure = _rates(spark, sf)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = splines.split_time(centers, events / exposure, exposure)
    return spark.createDataFrame([(None if at is None else round(at, 6),)], "split_time double")


def _calls(spark, sf):
    """Haplotypes = suppliers, two to an individual, individuals in two groups; sites = parts; alleles = parity of the quantity."""
    rows = ad.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("hap")).agg((F.sum("l_quantity").cast("long") % 2).cast("int").alias("allele"))
    return rows.withColumn("individual", F.floor(F.col("hap") / 2)).withColumn("grp", (F.col("individual") % 2).cast("int"))


_CALLS = "WITH c AS (SELECT l_partkey AS site, l_suppkey AS hap, (sum(l_quantity)::BIGINT % 2)::INT AS allele, l_suppkey // 2 AS individual, ((l_suppkey // 2) % 2)::INT AS grp FROM lineitem GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY l_partkey, l_suppkey")


@register("estimate_ne", _CALLS + """, p AS (SELECT x.site, x.allele <> y.allele AS d FROM c x JOIN c y ON x.site = y.site AND x.grp = y.grp AND x.hap < y.hap AND x.individual <> y.individual), s AS (SELECT count(DISTINCT site) AS sites FROM c), a AS (SELECT sum(d::INT)::BIGINT AS differences, count(*) AS pairs FROM p)
    SELECT sites, differences, pairs, round(differences / pairs * sites / 1e6::DOUBLE, 9) AS pi, round(differences / pairs * sites / 1e6::DOUBLE / 4e-8::DOUBLE, 3) AS ne FROM a, s""")
def _ne(spark, sf):
    df = genotypes.estimate_ne(_calls(spark, sf), 1e6, 1e-8)
    return df.select("sites", "differences", "pairs", F.round("pi", 9).alias("pi"), F.round("ne", 3).alias("ne"))


@register("infer_sex", _CALLS + """, p AS (SELECT individual, site, count(DISTINCT hap) AS n, count(DISTINCT allele) AS k FROM c GROUP BY 1, 2), h AS (SELECT individual, avg(CASE WHEN n >= 2 THEN (k > 1)::INT END) AS het, max(n) AS copies FROM p GROUP BY 1), l AS (SELECT quantile_cont(het, 0.9) * 0.1::DOUBLE AS lim FROM h)
    SELECT individual, round(het, 6) AS het, CASE WHEN copies < 2 OR het <= lim THEN 'M' ELSE 'F' END AS sex FROM h, l""")
def _sex(spark, sf):
    return _rounded(genotypes.infer_sex(_calls(spark, sf)))


@register("genotype_from_text", "SELECT p_partkey::DOUBLE AS pos, 's' || (k - 1) AS name, h AS hap, (CASE WHEN (p_partkey + k * 2 + h) % 7 = 3 THEN 0 ELSE (p_partkey + k + h) % 2 END)::TINYINT AS allele, (p_partkey + k * 2 + h) % 7 = 3 AS missing FROM part, (SELECT unnest([1, 2, 3]) AS k), (SELECT unnest([0, 1])::INT AS h) WHERE p_partkey % 11 <> 5")
def _vcf(spark, sf):
    call = lambda k, h: F.when((F.col("p_partkey") + k * 2 + h) % 7 == 3, ".").otherwise(((F.col("p_partkey") + k + h) % 2).cast("string"))
    alt = F.when(F.col("p_partkey") % 11 == 5, "T,G").otherwise("T")
    body = ad.table(spark, sf, "part").select(F.concat_ws("\t", F.lit("1"), F.col("p_partkey").cast("string"), F.lit("."), F.lit("A"), alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("DP:GT"), *[F.concat(F.lit("9:"), call(k, 0), F.lit("|"), call(k, 1)) for k in (1, 2, 3)]).alias("value"))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1\ts2",)], "value string")
    return formats.read_vcf(head.unionAll(body)).select("pos", "name", "hap", "allele", "missing")


@register("array_store", "SELECT p_partkey::DOUBLE AS pos, 'A' AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE 'G' END AS alt, 's' || k AS name, h AS hap, (CASE WHEN (p_partkey + k * 2 + h) % 7 = 3 THEN 0 ELSE (p_partkey + k + h) % 2 END)::TINYINT AS allele, (p_partkey + k * 2 + h) % 7 = 3 AS missing FROM part, (SELECT unnest([1, 2, 3]) AS k), (SELECT unnest([0, 1])::INT AS h) WHERE p_partkey >= 100")
def _store(spark, sf):
    """Calls written as chunks of an array store, and those from a position on read back from their chunks only."""
    p, k, h = F.col("p_partkey"), F.col("k"), F.col("h")
    cells = ad.table(spark, sf, "part").select(p, F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select(p, k, F.explode(F.sequence(F.lit(0), F.lit(1))).alias("h"))
    calls = cells.select(p.cast("double").alias("pos"), F.lit("A").alias("ref"), F.when(p % 2 == 0, "T").otherwise("G").alias("alt"), F.concat(F.lit("s"), k.cast("string")).alias("name"), h.alias("hap"), ((p + k + h) % 2).alias("allele"), ((p + k * 2 + h) % 7 == 3).alias("missing"))
    store = Folder(spark, "calls").path
    arrays.write_calls(calls, store, 4096.0, sites=2000, samples=2)
    return arrays.read_calls(spark, store, left=100.0)


@register("panel_resolve", "SELECT l_partkey AS site, count(DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END) AS query_haps, count(DISTINCT CASE WHEN l_suppkey % 2 = 1 THEN l_suppkey END) AS reference_haps FROM lineitem GROUP BY 1 HAVING query_haps > 0 AND reference_haps > 0")
def _panel(spark, sf):
    calls = _calls(spark, sf)
    sides = [calls.where(F.col("hap") % 2 == k).groupBy("site").agg(F.count(F.lit(1)).alias(n)) for k, n in ((0, "query_haps"), (1, "reference_haps"))]
    return genotypes.join_panels(*sides)


@register("gap_windows", """WITH g AS (SELECT 100000 + 36000 * n_nationkey AS s, 100000 + 36000 * n_nationkey + 4000 * (1 + n_regionkey) AS e FROM nation), w AS (SELECT k, k * 10000::DOUBLE AS lo, least((k + 1) * 10000, 1234567)::DOUBLE AS hi FROM (SELECT unnest(range(124))::INT AS k))
    SELECT k AS "window", lo AS "left", hi AS "right" FROM w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.s < hi AND lo < g.e)""")
def _gaps(spark, sf):
    """Windows of the axis that no gap touches; gaps and windows meet in equal bins."""
    k = F.col("n_nationkey") * 36000.0 + 100000.0
    gaps = ad.table(spark, sf, "nation").select(F.lit(0).alias("axis"), k.alias("left"), (k + 4000.0 * (1 + F.col("n_regionkey"))).alias("right"))
    windows = spark.range(124).select(F.lit(0).alias("axis"), F.col("id").cast("int").alias("window"), (F.col("id") * 10000.0).alias("left"), F.least((F.col("id") + 1) * 10000.0, F.lit(1234567.0)).alias("right"))
    touched = iv.overlap_join(windows, gaps, ["axis"], 10000.0).select("window").distinct()
    return windows.join(touched, "window", "left_anti").select("window", "left", "right")


_GRID = " UNION ALL ".join(f"SELECT '{n}' AS painter, sample, p0, status, \"left\", \"right\" FROM {n}" for n in ("a", "b", "c"))


@register("score_grid", "WITH " + ", ".join(_tracks_sql(n, s) for n, s in (("a", 30.0), ("b", 50.0), ("c", 80.0))) + _BOTH[_BOTH.index(", truth AS") : _BOTH.index(",\n    o AS")] + f""", u AS ({_GRID})
    SELECT painter, round(sum(CASE WHEN (p0 >= 1::DOUBLE - p0) = (state = 0) THEN w ELSE 0 END) / sum(w), 6) AS accuracy FROM (SELECT painter, p0, state, least(u."right", truth."right") - greatest(u."left", truth."left") AS w FROM u JOIN truth ON u.sample = truth.sample AND u."left" < truth."right" AND truth."left" < u."right" WHERE status = 'informative') GROUP BY painter""")
def _grid(spark, sf):
    found = None
    for n, s in (("a", 30.0), ("b", 50.0), ("c", 80.0)):
        one = ad.event_tracks(spark, sf, s).withColumn("painter", F.lit(n))
        found = one if found is None else found.unionByName(one)
    both = iv.overlap_join(mt.informative(found), ad.event_truth(spark, sf), ["sample"], BIN)
    hit = F.when(mt.top(STATES) == F.col("state"), mt.span()).otherwise(0.0)
    return _rounded(both.groupBy("painter").agg(mt.ratio(hit, mt.span()).alias("accuracy")))


@register("stream_windows", "SELECT floor((epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE / 259200)::INT AS \"window\", count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _stream(spark, sf):
    out, state = scratch(spark, "stream")
    table = stream_windows(spark, sf, "events", ad.table(spark, sf, "events").schema, 259200.0, out, state)
    return table.groupBy("window").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


#: Calls of a sex chromosome: one site a line item, two copies of its supplier; males' copies are alike but near both ends.
_SEX = """lx AS (SELECT 8 * (max(o_orderkey) + 1)::DOUBLE AS len FROM orders),
    ca AS (SELECT (l_orderkey * 8 + l_linenumber)::DOUBLE AS pos, l_suppkey AS name, l_quantity::INT % 2 AS a, CASE WHEN l_suppkey % 2 = 0 AND l_orderkey * 8 + l_linenumber BETWEEN 0.3 * len AND 0.7 * len THEN l_quantity::INT % 2 ELSE l_linenumber % 2 END AS b, l_discount > 0.085 AS ma, l_tax > 0.075 AS mb, len FROM lineitem, lx),
    hs AS (SELECT name, count(*) FILTER (NOT ma AND NOT mb AND a <> b) / nullif(count(*) FILTER (NOT ma AND NOT mb), 0)::DOUBLE AS h FROM ca WHERE pos >= 0.25 * len AND pos < 0.75 * len GROUP BY name),
    sx AS (SELECT name, CASE WHEN coalesce(h, 0) <= 0.1 * (SELECT quantile_cont(coalesce(h, 0), 0.9) FROM (SELECT DISTINCT name FROM ca) LEFT JOIN hs USING (name)) THEN 'M' ELSE 'F' END AS sex FROM (SELECT DISTINCT name FROM ca) LEFT JOIN hs USING (name)),
    pl AS (SELECT DISTINCT pos FROM (SELECT pos FROM ca JOIN sx USING (name) WHERE sex = 'M' AND NOT ma AND NOT mb AND a <> b UNION ALL SELECT 0 UNION ALL SELECT len FROM lx)),
    gp AS (SELECT pos AS lo, hi FROM (SELECT pos, lead(pos) OVER (ORDER BY pos) AS hi FROM pl) WHERE hi IS NOT NULL ORDER BY hi - pos DESC, pos LIMIT 1)"""


def _sex_calls(spark, sf):
    length = 8.0 * (ad.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] + 1)
    pos = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    a = F.col("l_quantity").cast("int") % 2
    b = F.when((F.col("l_suppkey") % 2 == 0) & pos.between(0.3 * length, 0.7 * length), a).otherwise(F.col("l_linenumber") % 2)
    copy = lambda hap, allele, missing: F.struct(F.lit(hap).alias("hap"), allele.cast("int").alias("allele"), missing.alias("missing"))
    lines = ad.table(spark, sf, "lineitem").withColumn("call", F.monotonically_increasing_id())  # before the copies are taken apart
    rows = lines.select(pos.cast("double").alias("pos"), F.col("l_suppkey").alias("name"), "call", F.explode(F.array(copy(0, a, F.col("l_discount") > 0.085), copy(1, b, F.col("l_tax") > 0.075))).alias("x"))
    return rows.select("pos", "name", "call", "x.*"), length  # an order can have a line number twice: two records of one place


@register("haploid_copies", f"""WITH {_SEX}, ro AS (SELECT name, sex, 0 AS hap, a AS allele, ma AS missing FROM ca JOIN sx USING (name) UNION ALL SELECT name, sex, 1, b, mb OR (sex = 'M' AND NOT (pos < lo OR pos >= hi)) FROM ca JOIN sx USING (name), gp)
    SELECT name, sex, hap, count(*) AS calls, count(*) FILTER (missing) AS missing, sum(allele)::BIGINT AS alleles FROM ro GROUP BY ALL""")
def _haploid(spark, sf):
    """Sex and pseudo-autosomal ends inferred from the calls, then a row for each real copy; males' second ones are missing between the ends."""
    calls, length = _sex_calls(spark, sf)
    sex = genotypes.sexes(calls, length)
    ends = genotypes.pseudo_autosomal(calls, sex, length, length / 100)
    got = genotypes.haploid(calls, sex, ends, keep=True).join(sex, "name")
    return got.groupBy("name", "sex", "hap").agg(F.count(F.lit(1)).alias("calls"), F.count_if("missing").alias("missing"), F.sum("allele").alias("alleles"))
