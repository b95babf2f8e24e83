"""Text formats as DataFrames of lines (one string column `value`), read and written with split and explode only.

Readers keep the fixed rules of each format; lines that don't have its shape are skipped as stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.operators.intervals import merge_runs, tile_markers


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _header(rows: DataFrame, test: Column) -> str | None:
    found = rows.where(test).select("value").first()
    return found.value if found else None


def source_kind(source: object) -> str:
    """'tables' for a DataFrame or parquet folder of tree tables, 'vcf' by suffix, else 'zarr'."""
    if isinstance(source, DataFrame) or str(source).rstrip("/").endswith((".parquet", ".trees")):
        return "tables"
    return "vcf" if str(source).endswith((".vcf", ".vcf.gz")) else "zarr"


def read_vcf(rows: DataFrame) -> DataFrame:
    """(pos, ref, alt, name, hap, allele, missing): biallelic rows of ten columns or more; every allele but 0 and . counts as 1."""
    head = _header(rows, F.col("value").startswith("#CHROM")) or ""
    names = head.split("\t")[9:]
    cells = rows.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c")).where((F.size("c") >= 10) & ~F.col("c")[4].contains(","))
    gt = F.array_position(F.split(F.col("c")[8], ":"), "GT").cast("int")
    cells = cells.where(gt > 0).select(F.col("c")[1].cast("double").alias("pos"), F.col("c")[3].alias("ref"), F.col("c")[4].alias("alt"), F.posexplode(F.slice("c", 10, max(1, len(names)))).alias("at", "cell"), gt.alias("gt"))
    named = F.element_at(F.array(*[F.lit(n) for n in names] or [F.lit(None).cast("string")]), F.col("at") + 1)
    calls = cells.select("pos", "ref", "alt", named.alias("name"), F.posexplode(F.split(F.translate(F.get(F.split("cell", ":"), F.col("gt") - 1), "|", "/"), "/")).alias("hap", "call"))
    return calls.select("pos", "ref", "alt", "name", "hap", F.when(F.col("call").isin(".", "0"), 0).otherwise(1).cast("tinyint").alias("allele"), (F.col("call") == ".").alias("missing"))


def write_vcf(variants: DataFrame, contig: str = "1") -> DataFrame:
    """Lines of a haploid VCF of (pos, hap, allele, missing), one row a position in text order: header and body apart by their `section`."""
    calls = F.sort_array(F.collect_list(F.struct("hap", F.when(F.col("missing"), ".").otherwise(F.col("allele").cast("string")).alias("c"))))
    body = variants.groupBy("pos").agg(F.array_join(F.transform(calls, lambda x: x["c"]), "\t").alias("calls"))
    return body.select(F.col("pos").cast("long").alias("pos"), F.concat_ws("\t", F.lit(contig), F.col("pos").cast("long").cast("string"), F.lit("."), F.lit("A"), F.lit("T"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "calls").alias("value"))


def write_sites(variants: DataFrame) -> DataFrame:
    """(pos, value): a line a variable site with all haplotypes' letters, N where missing; sites where all agree go."""
    letter = F.when(F.col("missing"), "N").when(F.col("allele") == 0, "A").otherwise("T")
    sites = variants.groupBy("pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hap", letter.alias("c")))), lambda x: x["c"]), "").alias("s"), F.count_distinct(F.when(~F.col("missing"), F.col("allele"))).alias("kinds"))
    return sites.where("kinds > 1").select("pos", F.concat_ws("\t", F.col("pos").cast("long").cast("string"), "s").alias("value"))


def read_sample_map(rows: DataFrame) -> DataFrame:
    """(sample, population, state): blank-separated lines, # skipped; populations that are all integers are their own states, else they count by first appearance."""
    table = rows.select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("c")).where((F.size("c") >= 2) & ~F.col("c")[0].startswith("#")).select("line", F.col("c")[0].alias("sample"), F.col("c")[1].alias("population"))
    order = table.groupBy("population").agg(F.min("line").alias("first"))
    order = order.withColumn("place", F.row_number().over(W.orderBy("first")) - 1)  # one row a population
    digits = order.agg(F.every(F.col("population").rlike(r"^\d+$")).alias("digits"))
    order = order.join(F.broadcast(digits)).select("population", F.when(F.col("digits"), F.expr("try_cast(population AS int)")).otherwise(F.col("place")).cast("int").alias("state"))
    return table.join(order, "population").select("sample", "population", "state")


def write_sample_map(samples: DataFrame) -> DataFrame:
    return samples.select(F.concat_ws("\t", "sample", "population").alias("value"))


def write_genetic_map(positions: DataFrame, rate: float, contig: str = "1") -> DataFrame:
    """Lines contig, position, centimorgans at a constant rate."""
    return positions.select(F.concat_ws("\t", F.lit(contig), F.col("pos").cast("string"), F.round(F.col("pos") * rate * 100, 9).cast("string")).alias("value"))


def _tracks(markers: DataFrame, length: float, k: int) -> DataFrame:
    """Marker rows (sample, pos, p array) to a tiling with equal neighbours joined."""
    tiled = tile_markers(markers, ["sample"], "pos", length)
    wide = tiled.select("sample", "left", "right", *[F.round(F.get("p", F.lit(i)), 12).alias(f"p{i}") for i in range(k)])
    return merge_runs(wide, ["sample"], [f"p{i}" for i in range(k)]).withColumn("status", F.lit("informative"))


def _normalised(p: Column, k: int) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(F.array_repeat(F.lit(1.0 / k), k))


def read_fb(rows: DataFrame, length: float, states: dict[str, int] | None = None) -> DataFrame:
    """Posteriors by marker: columns name:::hapN:::population after the fixed ones; populations are states by label if integers, else by rank."""
    head = _header(rows, F.col("value").contains(":::")) or ""
    names = [c.split(":::") for c in head.split("\t")]
    at = [(i, f"{n[0]}_{n[1][-1]}", n[2]) for i, n in enumerate(names) if len(n) == 3]
    kinds = sorted({p for _, _, p in at})
    place = states or ({p: int(p) for p in kinds} if all(p.isdigit() for p in kinds) else {p: i for i, p in enumerate(kinds)})
    k = max(place.values(), default=0) + 1
    body = rows.where(~F.col("value").contains(":::") & ~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c"))
    cells = F.array(*[F.struct(F.lit(s).alias("sample"), F.lit(place[p]).alias("state"), F.expr(f"try_cast(get(c, {i}) AS double)").alias("p")) for i, s, p in at])
    long = body.select(F.expr("try_cast(get(c, 1) AS double)").alias("pos"), F.explode(cells).alias("x")).select("pos", "x.*")
    wide = long.groupBy("sample", "pos").agg(*[F.coalesce(F.sum(F.when(F.col("state") == i, F.col("p"))), F.lit(0.0)).alias(f"s{i}") for i in range(k)])
    return _tracks(wide.select("sample", "pos", _normalised(F.array(*[f"s{i}" for i in range(k)]), k).alias("p")), length, k)


def read_msp(rows: DataFrame, length: float) -> DataFrame:
    """Hard windows: a line `#Subpopulation order/codes: name=code ...`, a header of six fixed columns and one a haplotype."""
    codes = _header(rows, F.col("value").startswith("#Subpopulation")) or ""
    k = max([int(x.split("=")[1]) for x in codes.split() if "=" in x and x.split("=")[1].isdigit()], default=1) + 1
    head = (_header(rows, F.col("value").startswith("#chm")) or "").split("\t")[6:]
    body = rows.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c"))
    named = F.array(*[F.struct(F.lit(n.replace(".", "_")).alias("sample"), F.expr(f"try_cast(get(c, {6 + i}) AS int)").alias("state")) for i, n in enumerate(head)])
    long = body.select(F.expr("try_cast(get(c, 1) AS double)").alias("pos"), F.explode(named).alias("x")).select("pos", "x.*")
    return _tracks(long.select("sample", "pos", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("state")).cast("double")).alias("p")), length, k)


def read_segments(rows: DataFrame, length: float, k: int) -> DataFrame:
    """One line a haplotype: name, then triples start, end, state; the first begins at 0, the last ends at the length."""
    table = rows.select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 4)
    triples = F.transform(F.sequence(F.lit(1), F.size("c") - 3, F.lit(3)), lambda i: F.struct(F.get("c", i).cast("double").alias("pos"), F.get("c", i + 2).cast("int").alias("state")))
    long = table.select(F.col("c")[0].alias("sample"), F.explode(triples).alias("x")).select("sample", "x.*")
    return _tracks(long.select("sample", "pos", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("state")).cast("double")).alias("p")), length, k)


def read_flare(rows: DataFrame, length: float) -> DataFrame:
    """A VCF with ##ANCESTRY=<name=code,...>: soft fields ANP1, ANP2 where present, else hard fields AN1, AN2."""
    codes = _header(rows, F.col("value").startswith("##ANCESTRY")) or "<>"
    k = max(1, codes.count("="))
    k = len([x for x in codes[codes.index("<") + 1 : codes.rindex(">")].split(",") if "=" in x]) or 1
    names = (_header(rows, F.col("value").startswith("#CHROM")) or "").split("\t")[9:]
    body = rows.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 10)
    cells = body.select(F.col("c")[1].cast("double").alias("pos"), F.split(F.col("c")[8], ":").alias("f"), F.posexplode(F.slice("c", 10, max(1, len(names)))).alias("at", "cell"))
    named = F.element_at(F.array(*[F.lit(n) for n in names] or [F.lit("")]), F.col("at") + 1)
    both = cells.select("pos", "f", F.split("cell", ":").alias("v"), named.alias("name"), F.explode(F.array(F.lit(1), F.lit(2))).alias("h"))
    soft = F.get("v", F.array_position("f", F.concat(F.lit("ANP"), F.col("h").cast("string"))).cast("int") - 1)
    hard = F.get("v", F.array_position("f", F.concat(F.lit("AN"), F.col("h").cast("string"))).cast("int") - 1).cast("int")
    p = F.when(soft.isNotNull(), F.transform(F.split(soft, ","), lambda x: x.cast("double"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == hard).cast("double")))
    return _tracks(both.select(F.concat_ws("_", "name", (F.col("h") - 1).cast("string")).alias("sample"), "pos", _normalised(p, k).alias("p")), length, k)


@F.udtf(returnType="node: string, parent: string, age: double")
class _Newick:
    """Rows of a Newick tree whose nodes carry [&&NHX:age=x]: one small string at a time."""

    def eval(self, text: str):
        import re

        stack, last, rows = [[]], None, []
        for part in re.findall(r"[(),;]|[^(),;]+", text or ""):
            if part == "(":
                stack.append([])
            elif part == ")":
                last = stack.pop()
            elif part not in ",;":
                name, age = re.match(r"[^:\[]*", part)[0], re.search(r"age=([0-9.eE+-]+)", part)
                for child, child_age in last or []:
                    rows.append((child, name, child_age))
                stack[-1].append((name, float(age[1]) if age else 0.0))
                last = None
        yield from rows
        for name, age in stack[0]:
            yield name, None, age


def read_smc(rows: DataFrame) -> DataFrame:
    """(left, right, node, parent, age) of lines `TREE start end newick`, starts counted from 1; edges that go on through touching trees are one."""
    trees = rows.where(F.col("value").startswith("TREE")).select(F.split("value", "\t").alias("c")).select((F.col("c")[1].cast("double") - 1).alias("left"), F.col("c")[2].cast("double").alias("right"), F.col("c")[3].alias("newick"))
    spark = rows.sparkSession
    spark.udtf.register("lociflow_newick", _Newick)
    view = "lociflow_smc_trees"
    trees.createOrReplaceTempView(view)
    nodes = spark.sql(f"SELECT left, right, n.node, n.parent, n.age FROM {view}, LATERAL lociflow_newick(newick) n")
    return merge_runs(nodes.withColumn("age", F.round("age", 6)), ["node", "parent", "age"], [])


def read_ghost_components(table: DataFrame, states: dict[str, int], k: int) -> DataFrame:
    """Columns sample, pos and prob_<component>: components are summed by state and rescaled."""
    sums = [sum((F.col(f"prob_{c}") for c, s in states.items() if s == i), F.lit(0.0)) for i in range(k)]
    return table.select("sample", "pos", _normalised(F.array(*sums), k).alias("p"))


TRACKS = T.StructType([T.StructField("sample", T.LongType()), T.StructField("left", T.DoubleType()), T.StructField("right", T.DoubleType()), T.StructField("p0", T.DoubleType()), T.StructField("p1", T.DoubleType()), T.StructField("status", T.StringType())])


def save_painting(tracks: DataFrame, samples: DataFrame, path: str, partition: str | None = None) -> None:
    """Tracks and all sample names as two tables below path, so samples without spans survive."""
    writer = tracks.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/tracks")
    samples.write.mode("overwrite").parquet(f"{path}/samples")


def load_painting(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/tracks"), spark.read.parquet(f"{path}/samples")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """JSON with NaN as null."""
    metrics.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in metrics.dtypes]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
