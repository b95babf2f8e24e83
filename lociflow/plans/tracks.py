"""Queries over posterior tracks and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.operators import intervals as iv
from lociflow.operators import metrics as mt
from lociflow.operators.segmentation import hard_segments
from lociflow.sources import adapters as ad

STATES, BIN = ["p0", "p1"], 4 * ad.TILE
SIZES = [float(ad.TILE) * k for k in (0, 1, 2, 3, 5, 10)]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _tracks_sql(name: str = "t", scale: float = 50.0, where: str = "TRUE") -> str:
    return f"""{name}_e AS (SELECT user_id AS sample, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS pos, event_id, event_type, value FROM events WHERE {where}),
    {name}_m AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0::DOUBLE ELSE pos END AS "left", coalesce(lead(pos) OVER w, 2592000::DOUBLE) AS "right" FROM {name}_e WINDOW w AS (PARTITION BY sample ORDER BY pos, event_id)),
    {name} AS (SELECT sample, "left", "right", value / (value + {scale}::DOUBLE) AS p0, 1::DOUBLE - value / (value + {scale}::DOUBLE) AS p1, CASE WHEN event_type = 'error' THEN 'missing-info' ELSE 'informative' END AS status FROM {name}_m WHERE "left" < "right")"""


_TRUTH = """truth AS (SELECT sample, k * 21600::DOUBLE AS "left", (k + 1) * 21600::DOUBLE AS "right", ((sample + k) % 2)::INT AS state FROM (SELECT DISTINCT user_id AS sample FROM events), (SELECT unnest(range(120)) AS k))"""
_BOTH = f"""WITH {_tracks_sql()}, {_TRUTH},
    o AS (SELECT t.sample, greatest(t."left", truth."left") AS lo, least(t."right", truth."right") AS hi, p0, p1, status, state, truth."left" AS segment FROM t JOIN truth ON t.sample = truth.sample AND t."left" < truth."right" AND truth."left" < t."right"),
    oi AS (SELECT *, hi - lo AS w, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS s FROM o WHERE status = 'informative'),
    ti AS (SELECT *, "right" - "left" AS w FROM t WHERE status = 'informative'),
    ts AS (SELECT sample, "left" AS pos FROM (SELECT *, lag(state) OVER (PARTITION BY sample ORDER BY "left") AS b FROM truth) WHERE b <> state),
    fs AS (SELECT sample, "left" AS pos FROM (SELECT *, p0 >= p1 AS s, lag(p0 >= p1) OVER (PARTITION BY sample ORDER BY "left") AS b FROM t) WHERE b <> s)"""


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def overlaps(spark, sf):
    return iv.overlap_join(ad.event_tracks(spark, sf), ad.event_truth(spark, sf).withColumn("segment", F.col("left")), ["sample"], BIN)


def found_switches(spark, sf):
    return iv.switches(ad.event_tracks(spark, sf).withColumn("s", mt.top(STATES)), ["sample"], "s", ad.BIN)


def true_switches(spark, sf):
    return iv.switches(ad.event_truth(spark, sf), ["sample"], "state", ad.BIN)


@register("per_base_accuracy", _BOTH + "SELECT count(*) AS n, round(sum(CASE WHEN s = state THEN w ELSE 0 END) / sum(w), 6) AS accuracy FROM oi")
def _accuracy(spark, sf):
    return _rounded(mt.per_base_accuracy(overlaps(spark, sf), STATES))


@register("balanced_accuracy", _BOTH + "SELECT count(*) AS classes, round(avg(a), 6) AS balanced_accuracy FROM (SELECT state, sum(CASE WHEN s = state THEN w ELSE 0 END) / sum(w) AS a FROM oi GROUP BY state)")
def _balanced(spark, sf):
    return _rounded(mt.balanced_accuracy(overlaps(spark, sf), STATES))


@register("mean_confidence", _BOTH + "SELECT round(sum((greatest(p0, p1) - 0.5::DOUBLE) / 0.5::DOUBLE * w) / sum(w), 6) AS confidence FROM ti")
def _confidence(spark, sf):
    return _rounded(mt.mean_confidence(ad.event_tracks(spark, sf), STATES))


@register("global_proportion", _BOTH + "SELECT round(sum(p0 * w) / sum(w), 6) AS share_p0, round(sum(p1 * w) / sum(w), 6) AS share_p1 FROM ti")
def _share(spark, sf):
    return _rounded(mt.proportions(ad.event_tracks(spark, sf), STATES))


@register("true_proportion", _BOTH + 'SELECT state, round(sum("right" - "left") / (SELECT sum("right" - "left") FROM truth), 6) AS share FROM truth GROUP BY state')
def _true_share(spark, sf):
    return _rounded(mt.true_proportions(ad.event_truth(spark, sf)))


@register("reliability_curve", _BOTH + "SELECT least(floor(p0 * 10), 9)::INT AS bin, round(sum(p0 * w) / sum(w), 6) AS predicted, round(sum(CASE WHEN state = 0 THEN w ELSE 0 END) / sum(w), 6) AS observed, round(sum(w), 3) AS weight FROM oi GROUP BY 1")
def _reliability(spark, sf):
    df = mt.reliability_curve(overlaps(spark, sf), "p0", 0)
    return df.select("bin", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"), F.round("weight", 3).alias("weight"))


_STEPS = _BOTH + """, st AS (SELECT sample, "left" AS pos, abs(p0 - lp) AS step, (s <> ls)::INT AS flip FROM (SELECT *, p0 >= p1 AS s, lag(p0) OVER w AS lp, lag(p0 >= p1) OVER w AS ls, lag(status) OVER w AS lstatus FROM t WINDOW w AS (PARTITION BY sample ORDER BY "left")) WHERE status = 'informative' AND lstatus = 'informative')"""


@register("flicker", _STEPS + "SELECT count(*) AS boundaries, round(coalesce(avg(step), 0), 6) AS mean_step, round(coalesce(avg(flip), 0), 6) AS flip_rate FROM st")
def _flicker(spark, sf):
    return _rounded(mt.flicker(ad.event_tracks(spark, sf), STATES, ad.BIN))


@register("flicker_at_off_true", _STEPS + ", f AS (SELECT *, EXISTS (SELECT 1 FROM ts WHERE ts.sample = st.sample AND abs(ts.pos - st.pos) <= 3600) AS at_true FROM st) SELECT at_true, count(*) AS boundaries, round(avg(step), 6) AS mean_step, round(avg(flip), 6) AS flip_rate FROM f GROUP BY at_true")
def _flicker_true(spark, sf):
    return _rounded(mt.flicker_by_truth(ad.event_tracks(spark, sf), STATES, true_switches(spark, sf), 3600.0, ad.BIN))


@register("boundary_error", _BOTH + ", d AS (SELECT ts.sample, ts.pos, coalesce(min(abs(ts.pos - fs.pos)), 'inf'::DOUBLE) AS d FROM ts LEFT JOIN fs ON fs.sample = ts.sample GROUP BY 1, 2) SELECT count(*) AS n, round(median(d), 6) AS median, round(avg(d), 6) AS mean FROM d")
def _boundary(spark, sf):
    return _rounded(mt.boundary_error(true_switches(spark, sf), found_switches(spark, sf), ad.BIN))


@register("breakpoint_pr", _BOTH + """, p AS (SELECT sample, avg(EXISTS (SELECT 1 FROM ts WHERE ts.sample = fs.sample AND abs(ts.pos - fs.pos) <= 12960)::INT) AS x FROM fs GROUP BY sample),
    r AS (SELECT sample, avg(EXISTS (SELECT 1 FROM fs WHERE ts.sample = fs.sample AND abs(ts.pos - fs.pos) <= 12960)::INT) AS x FROM ts GROUP BY sample) SELECT round((SELECT avg(x) FROM p), 6) AS precision, round((SELECT avg(x) FROM r), 6) AS recall""")
def _breakpoints(spark, sf):
    return _rounded(mt.breakpoint_scores(true_switches(spark, sf), found_switches(spark, sf), 0.005 * ad.LENGTH, ad.BIN))


@register("switch_density", _BOTH + "SELECT s.sample, count(fs.pos) AS switches, round(count(fs.pos) / 2592000::DOUBLE, 12) AS density FROM (SELECT DISTINCT sample FROM t) s LEFT JOIN fs USING (sample) GROUP BY s.sample")
def _density(spark, sf):
    return _rounded(mt.switch_density(found_switches(spark, sf), ad.event_tracks(spark, sf).select("sample").distinct(), ad.LENGTH), 12)


@register("switch_ratio", _BOTH + "SELECT (SELECT count(*) FROM fs) AS found, (SELECT count(*) FROM ts) AS true_ones, round((SELECT count(*) FROM fs) / (SELECT count(*) FROM ts)::DOUBLE, 6) AS ratio")
def _ratio(spark, sf):
    both = found_switches(spark, sf).select(F.lit(1).alias("f"), F.lit(0).alias("t")).unionAll(true_switches(spark, sf).select(F.lit(0).alias("f"), F.lit(1).alias("t")))
    return both.agg(F.sum("f").alias("found"), F.sum("t").alias("true_ones")).withColumn("ratio", F.round(F.try_divide("found", "true_ones"), 6))


def _true_runs(spark, sf):
    """Truth with runs of two different lengths: neighbours join where the third tile follows."""
    tiles = ad.event_truth(spark, sf).withColumn("state", F.floor((F.col("left") / F.lit(ad.TILE) + F.col("sample")) / 3).cast("int") % 2)
    return iv.merge_runs(tiles, ["sample"], ["state"], BIN)


_RUNS = """, tr AS (SELECT sample, "left", "right", (floor(("left" / 21600::DOUBLE + sample) / 3)::INT % 2) AS state FROM truth),
    rn AS (SELECT *, sum(n) OVER (PARTITION BY sample ORDER BY "left") AS g FROM (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS n FROM tr WINDOW w AS (PARTITION BY sample ORDER BY "left"))),
    runs AS (SELECT sample, state, min("left") AS "left", max("right") AS "right" FROM rn GROUP BY sample, g, state)"""


@register("run_merge", _BOTH + _RUNS + 'SELECT sample, state, "left", "right" FROM runs')
def _runs(spark, sf):
    return _true_runs(spark, sf).select("sample", "state", "left", "right")


@register("merge_scored", f"""WITH {_tracks_sql()}, a AS (SELECT *, lag("right") OVER w AS pr, lag("left") OVER w AS pl FROM t WHERE p0 >= 0.5 WINDOW w AS (PARTITION BY sample ORDER BY "left")),
    b AS (SELECT *, sum(CASE WHEN pr = "left" THEN 0 ELSE 1 END) OVER (PARTITION BY sample ORDER BY "left") AS g FROM a)
    SELECT sample, min("left") AS "left", max("right") AS "right", round(sum(p0 * ("right" - "left")) / sum("right" - "left"), 6) AS score FROM b GROUP BY sample, g""")
def _scored(spark, sf):
    rows = ad.event_tracks(spark, sf).where("p0 >= 0.5").select("sample", "left", "right", F.col("p0").alias("score"))
    return iv.merge_runs(rows, ["sample"], [], weighted="score").select("sample", "left", "right", F.round("score", 6).alias("score"))


@register("accuracy_by_size", _BOTH + _RUNS + f""", q AS (SELECT runs.sample, runs."left" AS segment, runs."right" - runs."left" AS size, runs.state, p0, p1, status, least(runs."right", t."right") - greatest(runs."left", t."left") AS w FROM runs JOIN t ON t.sample = runs.sample AND t."left" < runs."right" AND runs."left" < t."right"),
    e AS (SELECT unnest(range(5)) AS bin, unnest([{", ".join(f"{x}::DOUBLE" for x in SIZES[:-1])}]) AS low, unnest([{", ".join(f"{x}::DOUBLE" for x in SIZES[1:])}]) AS high)
    SELECT e.bin::INT AS bin, count(DISTINCT (q.sample, segment)) FILTER (q.sample IS NOT NULL) AS segments, round(sum(CASE WHEN status = 'informative' AND (CASE WHEN p0 >= p1 THEN 0 ELSE 1 END) = state THEN w ELSE 0 END) / nullif(sum(CASE WHEN status = 'informative' THEN w ELSE 0 END), 0), 6) AS accuracy
    FROM e LEFT JOIN q ON size >= low AND size < high GROUP BY e.bin""")
def _by_size(spark, sf):
    runs = _true_runs(spark, sf).withColumns({"segment": F.col("left"), "size": F.col("right") - F.col("left")})
    return _rounded(mt.accuracy_by_size(iv.overlap_join(ad.event_tracks(spark, sf), runs, ["sample"], BIN), STATES, SIZES))


@register("painting_summary", _BOTH + """SELECT (SELECT round(sum(CASE WHEN s = state THEN w ELSE 0 END) / sum(w), 6) FROM oi) AS accuracy, (SELECT round(avg(a), 6) FROM (SELECT sum(CASE WHEN s = state THEN w ELSE 0 END) / sum(w) AS a FROM oi GROUP BY state)) AS balanced_accuracy,
    (SELECT round(sum((greatest(p0, p1) - 0.5::DOUBLE) / 0.5::DOUBLE * w) / sum(w), 6) FROM ti) AS confidence, (SELECT count(*) FROM fs) AS found, (SELECT count(*) FROM ts) AS true_ones""")
def _summary(spark, sf):
    o, t = overlaps(spark, sf), ad.event_tracks(spark, sf)
    parts = [mt.per_base_accuracy(o, STATES).select("accuracy"), mt.balanced_accuracy(o, STATES).select("balanced_accuracy"), mt.mean_confidence(t, STATES), _ratio(spark, sf).select("found", "true_ones")]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p))
    return _rounded(out)


def _hard_sql(deadband: float) -> str:
    return f"""WITH {_tracks_sql()},
    r AS (SELECT *, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS top, status = 'informative' AND abs(p0 - p1) >= {deadband}::DOUBLE AS anchor FROM t),
    a AS (SELECT *, CASE WHEN anchor THEN top END AS a, CASE WHEN anchor THEN "left" END AS al, CASE WHEN anchor THEN "right" END AS ar FROM r),
    b AS (SELECT *, last_value(a IGNORE NULLS) OVER back AS pa, first_value(a IGNORE NULLS) OVER ahead AS na, first_value(al IGNORE NULLS) OVER ahead AS nl,
          last_value(a IGNORE NULLS) OVER prev AS lpa, last_value(ar IGNORE NULLS) OVER prev AS lpr, lag(top) OVER o AS before,
          sum(p0 * ("right" - "left")) OVER (PARTITION BY sample) AS s0, sum(p1 * ("right" - "left")) OVER (PARTITION BY sample) AS s1 FROM a
          WINDOW o AS (PARTITION BY sample ORDER BY "left"), back AS (PARTITION BY sample ORDER BY "left" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), prev AS (PARTITION BY sample ORDER BY "left" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ahead AS (PARTITION BY sample ORDER BY "left" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    c AS (SELECT *, 0.5::DOUBLE * (lpr + nl) AS mid, CASE WHEN lpa <> na AND before <> top THEN abs("left" - 0.5::DOUBLE * (lpr + nl)) END AS far FROM b),
    d AS (SELECT *, min(far) OVER (PARTITION BY sample, lpr, nl) AS least FROM c),
    e AS (SELECT *, count(CASE WHEN far <= least + 1e-9 THEN 1 END) OVER g AS ties, min(CASE WHEN far <= least + 1e-9 THEN "left" END) OVER g AS border FROM d WINDOW g AS (PARTITION BY sample, lpr, nl)),
    f AS (SELECT sample, "left", "right", CASE WHEN anchor THEN top WHEN pa IS NULL AND na IS NULL THEN (CASE WHEN s0 >= s1 THEN 0 ELSE 1 END) WHEN pa IS NULL THEN na WHEN na IS NULL THEN pa WHEN pa = na THEN pa
          WHEN ties >= 2 THEN (CASE WHEN ("left" + "right") / 2 < mid THEN lpa WHEN ("left" + "right") / 2 > mid THEN na ELSE least(lpa, na) END) WHEN "left" < border THEN lpa ELSE na END AS state FROM e),
    h AS (SELECT *, sum(CASE WHEN ls = state THEN 0 ELSE 1 END) OVER (PARTITION BY sample ORDER BY "left") AS g FROM (SELECT *, lag(state) OVER (PARTITION BY sample ORDER BY "left") AS ls FROM f))
    SELECT sample, state::INT AS state, min("left") AS "left", max("right") AS "right" FROM h GROUP BY sample, g, state"""


@register("hard_segments_00", _hard_sql(0.0))
def _hard0(spark, sf):
    return hard_segments(ad.event_tracks(spark, sf), STATES, 0.0).select("sample", "state", "left", "right")


@register("hard_segments_04", _hard_sql(0.4))
def _hard4(spark, sf):
    return hard_segments(ad.event_tracks(spark, sf), STATES, 0.4).select("sample", "state", "left", "right")


@register("posteriors_frame", f"""WITH {_tracks_sql()} SELECT sample AS haplotype, "left", "right", p0 AS A, p1 AS B, status FROM t""")
def _posteriors(spark, sf):
    return ad.event_tracks(spark, sf).select(F.col("sample").alias("haplotype"), "left", "right", F.col("p0").alias("A"), F.col("p1").alias("B"), "status")


@register("segments_frame", "SELECT sample AS haplotype, \"left\" AS start, \"right\" AS \"end\", chr(65 + state) AS ancestry FROM (" + _hard_sql(0.0) + ")")
def _segments(spark, sf):
    return _hard0(spark, sf).select(F.col("sample").alias("haplotype"), F.col("left").alias("start"), F.col("right").alias("end"), F.char(65 + F.col("state")).alias("ancestry"))


@register("posterior_at", f"""WITH {_tracks_sql()}, p AS (SELECT sample, k * 86400::DOUBLE + 0.5::DOUBLE AS pos FROM (SELECT DISTINCT sample FROM t), (SELECT unnest(range(30)) AS k)) SELECT p.sample, pos, p0, status FROM p ASOF JOIN t ON p.sample = t.sample AND p.pos >= t."left" WHERE pos < "right" """)
def _posterior_at(spark, sf):
    tracks = ad.event_tracks(spark, sf)
    probes = tracks.select("sample").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("sample", (F.col("k") * 86400.0 + 0.5).alias("pos"))
    return iv.points_in(probes, tracks, ["sample"], "pos", BIN).select("sample", "pos", "p0", "status")


_MEMBERS = ", ".join(_tracks_sql(f"m{k}", s, f"event_id % 3 <> {k}") for k, s in enumerate((30.0, 50.0, 80.0)))


@register("ensemble_merge", f"""WITH {_MEMBERS}, m AS (SELECT 0 AS member, * FROM m0 UNION ALL SELECT 1, * FROM m1 UNION ALL SELECT 2, * FROM m2),
    b AS (SELECT DISTINCT sample, x FROM (SELECT sample, "left" AS x FROM m UNION ALL SELECT sample, "right" FROM m)),
    s AS (SELECT * FROM (SELECT sample, x AS lo, lead(x) OVER (PARTITION BY sample ORDER BY x) AS hi FROM b) WHERE hi IS NOT NULL)
    SELECT s.sample, lo AS "left", hi AS "right", round(avg(p0), 6) AS p0, round(stddev_pop(p0), 6) AS p0_std, round(avg(p1), 6) AS p1, round(stddev_pop(p1), 6) AS p1_std, count(CASE WHEN status = 'informative' THEN 1 END) AS n_informative,
           CASE WHEN count(CASE WHEN status = 'informative' THEN 1 END) > 0 THEN 'informative' ELSE 'missing-info' END AS status
    FROM s JOIN m ON m.sample = s.sample AND m."left" < hi AND lo < m."right" GROUP BY s.sample, lo, hi""")
def _ensemble(spark, sf):
    return _rounded(iv.merge_members(ad.ensemble(spark, sf), ["sample"], "member", STATES, BIN).select("sample", "left", "right", "p0", "p0_std", "p1", "p1_std", "n_informative", "status"))


@register("clip_windows", f"""WITH {_tracks_sql()}, w AS (SELECT k AS "window", k * 259200::DOUBLE AS wl, (k + 1) * 259200::DOUBLE AS wr FROM (SELECT unnest(range(10))::INT AS k))
    SELECT "window", sample, greatest("left", wl) AS "left", least("right", wr) AS "right", p0, status FROM t JOIN w ON "left" < wr AND wl < "right" """)
def _clip(spark, sf):
    windows = spark.range(10).select(F.col("id").cast("int").alias("window"), (F.col("id") * 259200.0).alias("left"), ((F.col("id") + 1) * 259200.0).alias("right"))
    return iv.clip(ad.event_tracks(spark, sf), windows, BIN).select("window", "sample", "left", "right", "p0", "status")


@register("fill_missing", f"""WITH {_tracks_sql()}, a AS (SELECT c_custkey AS sample FROM customer WHERE c_custkey NOT IN (SELECT sample FROM t))
    SELECT sample, "left", "right", p0, p1, status FROM t UNION ALL SELECT sample, 0::DOUBLE, 2592000::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 'missing-info' FROM a""")
def _fill(spark, sf):
    keys = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample"))
    return iv.fill_missing(ad.event_tracks(spark, sf), keys, ["sample"], ad.LENGTH, {"p0": F.lit(0.5), "p1": F.lit(0.5), "status": F.lit("missing-info")})


@register("strict_positions", """WITH e AS (SELECT user_id AS sample, event_id, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE / 3600 AS pos FROM events),
    n AS (SELECT *, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY sample ORDER BY pos)) SELECT sample, event_id, n + greatest(0, max(floor(pos)::BIGINT - n) OVER (PARTITION BY sample ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS position FROM n""")
def _strict(spark, sf):
    markers = ad.event_markers(spark, sf).select("sample", "event_id", (F.col("pos") / 3600).alias("pos"))
    return iv.increasing(markers, ["sample"], "pos").select("sample", "event_id", F.col("position").cast("long").alias("position"))
