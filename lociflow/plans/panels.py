"""Queries of the small steps around painting and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.operators import intervals as iv
from lociflow.operators import panels as pn
from lociflow.plans.tracks import BIN, _BOTH, _TRUTH, _tracks_sql
from lociflow.sources import adapters as ad

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = 86_400.0


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@register("range_count", f"""WITH {_TRUTH}, e AS (SELECT user_id AS sample, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS pos FROM events)
    SELECT t.sample, t."left", t."right", count(e.pos) AS n FROM truth t LEFT JOIN e ON e.sample = t.sample AND t."left" <= e.pos AND e.pos < t."right" GROUP BY 1, 2, 3""")
def _range_count(spark, sf):
    tiles = ad.event_truth(spark, sf).select("sample", "left", "right")
    return pn.range_count(tiles, ad.event_markers(spark, sf), ["sample"], "pos", BIN)


@register("keep_draws", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS d FROM orders) WHERE u > 2 AND d <= 5""")
def _keep(spark, sf):
    return pn.keep_draws(ad.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 2, 5).select("o_custkey", "o_orderkey")


@register("first_seen", """SELECT user_id AS sample, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def _first(spark, sf):
    return pn.first_seen(ad.event_markers(spark, sf), ["sample"], "event_type", "event_id")


@register("in_all_windows", """WITH w AS (SELECT user_id AS sample, floor((epoch_us(ts) - 1704067200000000) / 259200000000) AS k FROM events) SELECT sample FROM w GROUP BY sample HAVING count(DISTINCT k) = (SELECT count(DISTINCT k) FROM w)""")
def _all(spark, sf):
    rows = ad.event_markers(spark, sf).withColumn("window", F.floor(F.col("pos") / F.lit(3 * DAY)))
    return pn.in_all_windows(rows, "sample", "window")


@register("stitched_windows", f"""WITH {_tracks_sql()}, s AS (SELECT sample, "left", "right", (p0 < p1)::INT AS state, status FROM t),
    i AS (SELECT *, sum(CASE WHEN pr = "left" AND ps = state AND pt = status THEN 0 ELSE 1 END) OVER (PARTITION BY sample ORDER BY "left") AS g FROM (SELECT *, lag("right") OVER w AS pr, lag(state) OVER w AS ps, lag(status) OVER w AS pt FROM s WINDOW w AS (PARTITION BY sample ORDER BY "left")))
    SELECT sample, state, status, min("left") AS "left", max("right") AS "right" FROM i GROUP BY sample, g, state, status""")
def _stitched(spark, sf):
    """Tracks cut at the edges of three-day windows, as windows are painted one by one, and put together again."""
    windows = spark.range(10).select(F.col("id").alias("window"), (F.col("id") * 3 * DAY).alias("left"), ((F.col("id") + 1) * 3 * DAY).alias("right"))
    parts = iv.clip(ad.event_tracks(spark, sf), windows, BIN).withColumn("state", (F.col("p0") < F.col("p1")).cast("int"))
    return pn.stitch(parts.select("sample", "left", "right", "state", "status"), ["sample"], ["state", "status"], BIN).select("sample", "state", "status", "left", "right")


@register("tract_scores", _BOTH + """, f AS (SELECT sample, "left", "right" FROM t WHERE status = 'informative' AND p1 >= 0.5::DOUBLE), r AS (SELECT * FROM truth WHERE state = 1),
    x AS (SELECT sum(least(f."right", r."right") - greatest(f."left", r."left")) AS o FROM f JOIN r ON f.sample = r.sample AND f."left" < r."right" AND r."left" < f."right")
    SELECT round(o / (SELECT sum("right" - "left") FROM r), 6) AS recall, round(o / (SELECT sum("right" - "left") FROM f), 6) AS precision FROM x""")
def _scores(spark, sf):
    found = ad.event_tracks(spark, sf).where("status = 'informative' AND p1 >= 0.5")
    got = pn.tract_scores(found, ad.event_truth(spark, sf).where("state = 1"), ["sample"], BIN)
    return got.select(F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@register("reference_purity", f"""WITH {_tracks_sql()}, h AS (SELECT sample, (p0 < p1)::INT AS state, "right" - "left" AS w FROM t) SELECT sample, (sample % 2)::INT AS label, round(sum(CASE WHEN state = sample % 2 THEN w ELSE 0 END) / sum(w), 6) AS purity FROM h GROUP BY sample""")
def _purity(spark, sf):
    segments = ad.event_tracks(spark, sf).select("sample", "left", "right", (F.col("p0") < F.col("p1")).cast("int").alias("state"))
    labels = segments.select("sample").distinct().withColumn("label", (F.col("sample") % 2).cast("int"))
    return pn.purity(segments, labels, "sample").select("sample", "label", F.round("purity", 6).alias("purity"))


@register("over_members", """WITH o AS (SELECT o_custkey, round(o_totalprice * 100)::BIGINT AS x FROM orders WHERE o_totalprice IS NOT NULL)
    SELECT o_custkey, count(*) AS n, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.05), 4) AS low, round(quantile_cont(x, 0.95), 4) AS high FROM o GROUP BY 1""")
def _members(spark, sf):
    """In cents, whose sums are exact."""
    got = pn.over_members(ad.table(spark, sf, "orders").withColumn("x", F.round(F.col("o_totalprice") * 100).cast("long")), ["o_custkey"], "x", 0.9)
    return got.select("o_custkey", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "low", "high")])


@register("first_ancestor", """SELECT 'c' || c_custkey AS node, CASE WHEN c_custkey % 7 = 0 THEN 'c' || c_custkey WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey WHEN n_regionkey % 2 = 0 THEN 'r' || n_regionkey END AS ancestor FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _ancestor(spark, sf):
    nodes = ad.forest(spark, sf)
    number, kind = F.substring("node", 2, 20).cast("long"), F.substring("node", 1, 1)
    marked = F.when(kind == "c", number % 7 == 0).when(kind == "n", number % 3 == 0).otherwise(number % 2 == 0)
    return pn.first_ancestor(nodes.where("level = 0"), nodes.select("node", "parent", marked.alias("marked")))


@register("split_names", r"""SELECT c_custkey, regexp_replace(name, '_\d+$', '') AS individual, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_custkey % 2 + 1 END::BIGINT AS haplotype FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '_' || (c_custkey % 2) END AS name FROM customer)""")
def _names(spark, sf):
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat_ws("_", "c_name", (F.col("c_custkey") % 2).cast("string")))
    rows = ad.table(spark, sf, "customer").select("c_custkey", name.alias("name"))
    individual, haplotype = pn.split_names(F.col("name"))
    return rows.select("c_custkey", individual.alias("individual"), haplotype.alias("haplotype"))


@register("map_states", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 END AS state FROM customer""")
def _map(spark, sf):
    names = spark.createDataFrame([("BUILDING", 0), ("MACHINERY", 1)], "c_mktsegment string, state int")
    return pn.map_states(ad.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), names, "c_mktsegment")


@register("subset_sites", """SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_partkey >= 20 AND l_partkey < 120 AND (l_returnflag IN ('A', 'R') OR starts_with(l_returnflag, 'A_') OR starts_with(l_returnflag, 'R_'))""")
def _subset(spark, sf):
    return pn.subset(ad.table(spark, sf, "lineitem"), "l_partkey", 20, 120, ["A", "R"], "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag")
