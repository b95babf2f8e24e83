"""Message passing on forests, level by level: each level is one join and one aggregation over all trees at once.

Nodes are rows (node, parent, time, level, e0, e1): e is the emission, 1 where a node has none; a parent's level is one above
its children's. Messages are kept in log space; a zero is -inf and is never subtracted: a parent with impossible children
sums the others explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.cluster import Stored
from lociflow.functions.ctmc import reward_columns, transition_columns


def emissions(nodes: DataFrame, pi: tuple[float, float], masked: DataFrame | None = None) -> DataFrame:
    """nodes with e0, e1: w on the label and (1 - w) of pi; pi for leaves without label (or masked), 1 above."""
    labelled = F.col("label").isNotNull() & (F.col("level") == 0)
    if masked is not None:
        nodes = nodes.join(masked.select("node", F.lit(True).alias("__masked")), "node", "left")
        labelled = labelled & F.col("__masked").isNull()
    w = F.coalesce("w", F.lit(1.0))
    e = [F.when(labelled, w * (F.col("label") == k).cast("double") + (F.lit(1.0) - w) * F.lit(pi[k])).when(F.col("level") == 0, F.lit(pi[k])).otherwise(F.lit(1.0)) for k in range(2)]
    return nodes.withColumns({"e0": e[0], "e1": e[1]}).drop("__masked")


def _ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf")))


def _lse(x: Column, y: Column) -> Column:
    top = F.greatest(x, y)
    return F.when(top == F.lit(float("-inf")), top).otherwise(top + F.ln(F.exp(x - top) + F.exp(y - top)))


def prune(nodes: DataFrame, a: float, b: float, pi: tuple[float, float], levels: int) -> Stored:
    """Posterior marginals of every node: node, parent, level, t (its branch), g0, g1, loo0, loo1 (own emission left out), x00..x11 (joint with the parent's state) and loglik (of a root's tree)."""
    by_level = {}
    sums = None
    for k in range(levels):
        own = nodes.where(F.col("level") == k)
        if sums is None:
            own = own.withColumns({**{f"f{s}": F.lit(0.0) for s in range(2)}, **{f"n{s}": F.lit(0).cast("long") for s in range(2)}})
        else:
            own = own.join(sums, "node", "left").withColumns({**{f"f{s}": F.coalesce(f"f{s}", F.lit(0.0)) for s in range(2)}, **{f"n{s}": F.coalesce(f"n{s}", F.lit(0)) for s in range(2)}})
        own = own.withColumns({f"c{s}": F.when(F.col(f"n{s}") > 0, F.lit(float("-inf"))).otherwise(F.col(f"f{s}")) for s in range(2)})
        own = own.withColumns({f"l{s}": _ln(F.col(f"e{s}")) + F.col(f"c{s}") for s in range(2)})
        if k + 1 < levels:
            times = nodes.where(F.col("level") == k + 1).select(F.col("node").alias("parent"), F.col("time").alias("__pt"))
            own = own.join(times, "parent", "left").withColumn("t", F.col("__pt") - F.col("time")).drop("__pt")
            p = transition_columns(a, b, F.col("t"))
            own = own.withColumns({f"m{s}": _lse(_ln(p[s][0]) + F.col("l0"), _ln(p[s][1]) + F.col("l1")) for s in range(2)})
        else:
            own = own.withColumns({"t": F.lit(None).cast("double"), "m0": F.lit(None).cast("double"), "m1": F.lit(None).cast("double")})
        by_level[k] = Stored(own, f"up-{k}").df
        sums = by_level[k].groupBy(F.col("parent").alias("node")).agg(*[F.sum(F.when(F.col(f"m{s}") > float("-inf"), F.col(f"m{s}"))).alias(f"f{s}") for s in range(2)], *[F.count_if(F.col(f"m{s}") == float("-inf")).alias(f"n{s}") for s in range(2)])
    root = by_level[levels - 1].withColumns({"u0": F.lit(float(pi[0])), "u1": F.lit(float(pi[1]))}).withColumns({"u0": _ln(F.col("u0")), "u1": _ln(F.col("u1"))})
    out, above = None, None
    for k in reversed(range(levels)):
        if k == levels - 1:
            here = root.withColumns({f"x{i}{j}": F.lit(None).cast("double") for i in range(2) for j in range(2)})
            here = here.withColumn("loglik", _lse(F.col("u0") + F.col("l0"), F.col("u1") + F.col("l1")))
        else:
            from_above = above.select(F.col("node").alias("parent"), *[(F.col(f"u{s}") + _ln(F.col(f"e{s}"))).alias(f"h{s}") for s in range(2)], *[F.col(f"f{s}").alias(f"all{s}") for s in range(2)], *[F.col(f"n{s}").alias(f"none{s}") for s in range(2)])
            here = by_level[k].join(from_above, "parent")
            # the siblings' messages: without this child's own, be it finite or not
            lost = [F.col(f"m{s}") == float("-inf") for s in range(2)]
            others = [F.when(F.col(f"none{s}") > lost[s].cast("int"), F.lit(float("-inf"))).otherwise(F.col(f"all{s}") - F.when(lost[s], F.lit(0.0)).otherwise(F.col(f"m{s}"))) for s in range(2)]
            here = here.withColumns({f"cav{s}": F.col(f"h{s}") + others[s] for s in range(2)})
            p = transition_columns(a, b, F.col("t"))
            here = here.withColumns({f"u{j}": _lse(F.col("cav0") + _ln(p[0][j]), F.col("cav1") + _ln(p[1][j])) for j in range(2)})
            raw = {f"x{i}{j}": F.col(f"cav{i}") + _ln(p[i][j]) + F.col(f"l{j}") for i in range(2) for j in range(2)}
            here = here.withColumns(raw)
            here = here.withColumn("__top", F.greatest("x00", "x01", "x10", "x11"))
            total = sum((F.exp(F.col(x) - F.col("__top")) for x in raw), F.lit(0.0))
            here = here.withColumn("__sum", total).withColumns({x: F.exp(F.col(x) - F.col("__top")) / F.col("__sum") for x in raw}).withColumn("loglik", F.lit(None).cast("double"))
        z = _lse(F.col("u0") + F.col("l0"), F.col("u1") + F.col("l1"))
        y = _lse(F.col("u0") + F.col("c0"), F.col("u1") + F.col("c1"))
        here = here.withColumns({**{f"g{s}": F.exp(F.col(f"u{s}") + F.col(f"l{s}") - z) for s in range(2)}, **{f"loo{s}": F.exp(F.col(f"u{s}") + F.col(f"c{s}") - y) for s in range(2)}})
        above = here
        part = here.select("node", "parent", "level", "t", "label", "g0", "g1", "loo0", "loo1", "x00", "x01", "x10", "x11", "loglik")
        out = part if out is None else out.unionByName(part)
    return Stored(out, "pruned")


def sufficient_statistics(pruned: DataFrame, a: float, b: float) -> DataFrame:
    """One row: dwell0, dwell1, jump01, jump10, root0, root1 and loglik, summed over all branches and roots; branches of no length don't count."""
    t = F.col("t")
    p = transition_columns(a, b, t)

    def expected(m: int, n: int) -> Column:
        v = reward_columns(a, b, t, m, n)
        value = sum((F.col(f"x{i}{j}") * v[i][j] / F.greatest(p[i][j], F.lit(1e-300)) for i in range(2) for j in range(2)), F.lit(0.0))
        return F.sum(F.when(t > 0, value))

    root = F.col("loglik").isNotNull()
    return pruned.agg(expected(0, 0).alias("dwell0"), expected(1, 1).alias("dwell1"), (F.lit(a) * expected(0, 1)).alias("jump01"), (F.lit(b) * expected(1, 0)).alias("jump10"), F.sum(F.when(root, F.col("g0"))).alias("root0"), F.sum(F.when(root, F.col("g1"))).alias("root1"), F.sum("loglik").alias("loglik"))


def fit(nodes: DataFrame, a: float, b: float, pi: tuple[float, float], levels: int, iterations: int = 200, tolerance: float = 1e-6, estimate_root: bool = True) -> DataFrame:
    """Expectation-maximisation of rates and root distribution: a row for each iteration (iteration, a, b, pi0, pi1, loglik).

    Every iteration is one pass over the stored nodes; only the seven sums reach the driver.
    """
    spark, rows, last = nodes.sparkSession, [], None
    for k in range(iterations):
        done = prune(emissions(nodes, pi), a, b, pi, levels)
        s = sufficient_statistics(done.df, a, b).first()
        done.drop()
        rows.append((k, float(a), float(b), float(pi[0]), float(pi[1]), float(s.loglik)))
        if last is not None and abs(s.loglik - last) < tolerance:
            break
        last = s.loglik
        a, b = (s.jump01 / s.dwell0 if s.dwell0 else 0.0), (s.jump10 / s.dwell1 if s.dwell1 else 0.0)
        if estimate_root and s.root0 + s.root1 > 0:
            pi = (s.root0 / (s.root0 + s.root1), s.root1 / (s.root0 + s.root1))
    return spark.createDataFrame(rows, "iteration int, a double, b double, pi0 double, pi1 double, loglik double")
