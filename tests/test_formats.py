from pyspark.sql import functions as F

from lociflow.operators import genotypes
from lociflow.sources import formats


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.strip("\n").split("\n")], "value string").coalesce(1)


def test_vcf(spark):
    got = formats.read_vcf(lines(spark, "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n1\t10\t.\tA\tT\t.\t.\t.\tDP:GT\t3:0|1\t4:./1\n1\t20\t.\tA\tT,G\t.\t.\t.\tGT\t0|1\t1|1\nshort\trow"))
    assert sorted((r.pos, r.name, r.hap, r.allele, r.missing) for r in got.collect()) == [(10.0, "a", 0, 0, False), (10.0, "a", 1, 1, False), (10.0, "b", 0, 0, True), (10.0, "b", 1, 1, False)]
    wide = formats.write_vcf(got.withColumn("hap", F.concat("name", "hap"))).collect()
    assert wide[0].value.split("\t")[9:] == ["0", "1", ".", "1"]
    assert formats.source_kind("x.vcf.gz") == "vcf" and formats.source_kind("x.zarr") == "zarr" and formats.source_kind(got) == "tables"


def test_sample_map(spark):
    got = formats.read_sample_map(lines(spark, "# c\ns1 pop2\ns2\tpop1\ns3 pop2"))
    assert {r.sample: r.state for r in got.collect()} == {"s1": 0, "s2": 1, "s3": 0}
    assert {r.sample: r.state for r in formats.read_sample_map(lines(spark, "s1 3\ns2 1")).collect()} == {"s1": 3, "s2": 1}


def rows(df):
    return sorted((r.sample, r.left, r.right, r.p0, r.p1) for r in df.collect())


def test_posterior_readers(spark):
    fb = "chm\tpos\tgpos\tidx\tq0:::hap1:::0\tq0:::hap1:::1\n1\t10\t0\t0\t0.9\t0.1\n1\t20\t0\t1\t0.9\t0.1\n1\t30\t0\t2\t0\t0"
    assert rows(formats.read_fb(lines(spark, fb), 50.0)) == [("q0_1", 0.0, 30.0, 0.9, 0.1), ("q0_1", 30.0, 50.0, 0.5, 0.5)]
    msp = "#Subpopulation order/codes: A=0\tB=1\n#chm\tspos\tepos\tsgpos\tegpos\tn\tq0.0\tq0.1\n1\t0\t20\t0\t0\t1\t0\t1\n1\t20\t40\t0\t0\t1\t1\t1"
    assert rows(formats.read_msp(lines(spark, msp), 40.0)) == [("q0_0", 0.0, 20.0, 1.0, 0.0), ("q0_0", 20.0, 40.0, 0.0, 1.0), ("q0_1", 0.0, 40.0, 0.0, 1.0)]
    assert rows(formats.read_segments(lines(spark, "h0 5 20 1 20 30 0"), 40.0, 2)) == [("h0", 0.0, 20.0, 0.0, 1.0), ("h0", 20.0, 40.0, 1.0, 0.0)]
    flare = "##ANCESTRY=<A=0,B=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tq\n1\t5\t.\tA\tT\t.\t.\t.\tGT:AN1:AN2\t0|1:0:1"
    assert rows(formats.read_flare(lines(spark, flare), 9.0)) == [("q_0", 0.0, 9.0, 1.0, 0.0), ("q_1", 0.0, 9.0, 0.0, 1.0)]


def test_smc_trees(spark):
    text = "NAMES\ta\tb\nTREE\t1\t10\t(0:1[&&NHX:age=0.0],1:1[&&NHX:age=0.0])2[&&NHX:age=5.0];\nTREE\t11\t20\t(0:1[&&NHX:age=0.0],1:1[&&NHX:age=0.0])2[&&NHX:age=5.0];"
    got = sorted((r.node, r.parent, r.left, r.right, r.age) for r in formats.read_smc(lines(spark, text)).collect() if r.parent)
    assert got == [("0", "2", 0.0, 20.0, 0.0), ("1", "2", 0.0, 20.0, 0.0)]


def test_round_trip_keeps_empty_samples(spark, tmp_path):
    tracks = spark.createDataFrame([(1, 0.0, 5.0, 0.3, 0.7, "informative")], formats.TRACKS)
    formats.save_painting(tracks, spark.createDataFrame([(1,), (2,)], "sample long"), f"{tmp_path}/p")
    back, samples = formats.load_painting(spark, f"{tmp_path}/p")
    assert back.collect() == tracks.collect() and samples.count() == 2
    formats.write_metrics(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double"), f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m").first().value == '{"a":null,"b":1.0}'


def test_diversity_equals_counting_every_pair(spark):
    import itertools
    import random

    rng = random.Random(17)
    ploidy = {0: (0, 2), 1: (0, 1), 2: (1, 2), 3: (1, 2), 4: (1, 3), 5: (0, 2)}  # individual: (group, haplotypes)
    calls = [(site, 10 * i + h, i, g, rng.choice((0, 0, 1))) for site in range(37) for i, (g, n) in ploidy.items() for h in range(n) if rng.random() < 0.9]
    different, pairs = 0, 0
    for x, y in itertools.combinations(calls, 2):
        if x[0] == y[0] and x[3] == y[3] and x[2] != y[2]:
            pairs += 1
            different += x[4] != y[4]
    got = genotypes.estimate_ne(spark.createDataFrame(calls, "site long, hap long, individual long, grp int, allele int"), 5000.0, 2e-8).first()
    assert (got.sites, got.differences, got.pairs) == (37, different, pairs)
    assert abs(got.ne - different / pairs * 37 / 5000 / 8e-8) < 1e-6 * got.ne
