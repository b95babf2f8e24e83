"""Sex, pseudo-autosomal ends and copies on literal calls."""

from lociflow.operators import genotypes, mutations

CALLS = "pos double, name string, hap int, allele int, missing boolean"


def rows(name, first, second, gone=()):
    """Two copies at positions 5, 15, ...; None: no second copy."""
    out = []
    for i, a in enumerate(first):
        pos = 10.0 * i + 5
        out.append((pos, name, 0, a, (name, i) in gone))
        if second is not None:
            out.append((pos, name, 1, second[i], False))
    return out


def test_copies_of_a_sex_chromosome(spark):
    female = rows("f", [0, 1] * 5, [1, 0] * 5) + rows("g", [0] * 10, [1, 1, 0, 1, 0, 1, 1, 0, 1, 1], {("g", 3)})
    male = rows("m", [0, 1, 1, 0, 1, 0, 1, 0, 0, 1], [1, 1, 1, 0, 1, 0, 1, 0, 0, 0]) + rows("one", [1] * 10, None)
    calls = spark.createDataFrame(female + male, CALLS)
    sex = genotypes.sexes(calls, 100.0)
    assert {r["name"]: r.sex for r in sex.collect()} == {"f": "F", "g": "F", "m": "M", "one": "M"}
    told = spark.createDataFrame([("g", "M")], "name string, sex string")
    assert {r["name"]: r.sex for r in genotypes.sexes(calls, 100.0, told).collect()}["g"] == "M"
    ends = genotypes.pseudo_autosomal(calls, sex, 100.0, 10.0)
    assert sorted(tuple(r) for r in ends.collect()) == [(0.0, 5.0), (95.0, 100.0)]
    plain = genotypes.haploid(calls, sex, ends)
    assert plain.groupBy("name").count().rdd.collectAsMap() == {"f": 20, "g": 20, "m": 10, "one": 10}
    assert plain.where("missing").count() == 1
    kept = genotypes.haploid(calls, sex, ends, keep=True).where("name = 'm' AND hap = 1").collect()
    assert {r.pos: r.missing for r in kept} == {5.0: True, **{10.0 * i + 5: True for i in range(1, 9)}, 95.0: False}
    none = genotypes.pseudo_autosomal(calls.where("name = 'one'"), sex, 100.0, 10.0)
    assert none.count() == 0 and genotypes.haploid(calls.limit(0), sex, none).count() == 0


def test_younger_mutations_override(spark):
    edges = spark.createDataFrame([(0.0, 10.0, 5, 1), (0.0, 10.0, 5, 2), (0.0, 6.0, 6, 5), (0.0, 10.0, 6, 3), (6.0, 10.0, 7, 5)], "left double, right double, parent long, child long")
    nodes = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, 1.0), (6, 2.0), (7, 3.0)], "node long, time double")
    marks = spark.createDataFrame([(2.0, 6, 1, 2.5), (2.0, 5, 2, 1.5), (2.0, 5, 3, 1.2), (2.0, 1, 4, 0.5), (8.0, 6, 1, 2.5), (8.0, 7, 6, 3.5), (3.0, 4, 7, 0.1), (20.0, 2, 8, 0.1)], "pos double, node long, state long, time double")
    samples = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "sample long")
    want = {(2.0, 1, 4), (2.0, 2, 3), (2.0, 3, 1), (8.0, 3, 1), (8.0, 1, 6), (8.0, 2, 6), (3.0, 4, 7), (20.0, 2, 8)}
    for least in (4096, 1):
        assert {(r.pos, r["sample"], r.state) for r in mutations.genotypes(edges, nodes, marks, samples, least).collect()} == want


def test_records_of_one_place_count_each(spark):
    """Two records of a at 50, of which only the second differs; paired across records neither would be told apart right."""
    rows = [(50.0, "a", 1, 0, 0, False), (50.0, "a", 1, 1, 0, False), (50.0, "a", 2, 0, 1, False), (50.0, "a", 2, 1, 0, False), (50.0, "b", 3, 0, 1, True), (50.0, "b", 3, 1, 0, False)]
    calls = spark.createDataFrame(rows, "pos double, name string, call long, hap int, allele int, missing boolean")
    got = sorted((r.name, r.told, r.differ) for r in genotypes._copies(calls).collect())
    assert got == [("a", True, False), ("a", True, True), ("b", False, False)]
