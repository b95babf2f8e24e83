from lociflow import cli
from lociflow.operators import painters
from lociflow.sources import arrays
from tests.test_nearest import EDGE, NODE, genealogy


def test_segments_and_score_from_tables(spark, tmp_path):
    tracks = [(1, 0.0, 4.0, 0.9, 0.1, "informative"), (1, 4.0, 10.0, 0.2, 0.8, "informative")]
    spark.createDataFrame(tracks, "sample long, left double, right double, p0 double, p1 double, status string").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(1, 0.0, 5.0, 0), (1, 5.0, 10.0, 1)], "sample long, left double, right double, state int").write.parquet(f"{tmp_path}/truth")
    cli.main(["segments", "--tracks", f"{tmp_path}/t", "--out", f"{tmp_path}/s"])
    assert sorted((r.left, r.right, r.state) for r in spark.read.parquet(f"{tmp_path}/s").collect()) == [(0.0, 4.0, 0), (4.0, 10.0, 1)]
    cli.main(["score", "--tracks", f"{tmp_path}/t", "--truth", f"{tmp_path}/truth", "--width", "3", "--out", f"{tmp_path}/m"])
    assert spark.read.parquet(f"{tmp_path}/m").first().accuracy == 0.9


def test_every_command_writes_its_table(spark, tmp_path):
    edges, times = genealogy(41)
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    put(edges, EDGE, "edges")
    put(list(times.items()), NODE, "nodes")
    put([(0, 0, 1.0), (3, 1, 1.0), (5, 1, 0.9), (6, 0, 0.9)], "node long, label int, w double", "labels")
    put([(s, 0.0, 40.0, s % 2) for s in range(9)], "sample long, left double, right double, state int", "truth")
    put([(4.5, 101, 1, 9.0), (4.5, 2, 2, 0.5)], "pos double, node long, state long, time double", "mutations")
    put([(0, 3.0, 9.0)], "node long, left double, right double", "masks")
    put([("a", "p", k, "m", float(k)) for k in range(3)], "scenario string, painter string, seed int, metric string, value double", "scores")
    put([(0, s, float(k), k + 1.0, 1.0 + (s * 7 + k) % 5) for s in range(4) for k in range(6)], "member int, sample long, left double, right double, depth double", "depths")
    common = ["--length", "40", "--width", "9", "--iterations", "2", "--rate", "0.2"]
    tables = {name: f"{tmp_path}/{name}" for name in ("edges", "nodes", "labels", "truth", "mutations", "scores", "depths")} | {"folder": f"file://{tmp_path}/folder"}

    def run(name, *more):
        inputs = [x for t in cli.COMMANDS[name][1] for x in (f"--{t}", tables[t])]
        cli.main([name, *inputs, "--out", f"{tmp_path}/out-{name}", *common, *more])
        return spark.read.parquet(f"{tmp_path}/out-{name}")

    painted = run("paint", "--masks", f"{tmp_path}/masks", "--smoothing", "0.1")
    assert painted.where("left = 0").count() == 9
    tables["tracks"] = f"{tmp_path}/out-paint"
    assert run("windows", "--size", "15").where("left = 0").count() == 9
    assert run("nearest").where("left = 0").count() == 9
    assert run("compare").count() == 4 * len(painters.PAINTERS)
    assert {r["sample"] for r in run("detect").collect()} == {1, 2, 4, 7, 8}
    assert run("genotypes").where("sample = 2 AND state = 2").count() == 1
    calls = spark.createDataFrame([(5.0 + k, "A", "T", "m", h, k % 2, False) for k in range(6) for h in range(2)], "pos double, ref string, alt string, name string, hap int, allele int, missing boolean")
    arrays.write_calls(calls, f"file://{tmp_path}/calls.vcz", 9.0)
    put([("m", "M")], "name string, sex string", "sex")
    tables["source"] = f"file://{tmp_path}/calls.vcz"
    assert run("variants", "--sex", f"{tmp_path}/sex").count() == 6
    fitted = run("fit")
    assert len(fitted.first().q) == 4
    assert run("paint", "--params", f"{tmp_path}/out-fit").count() > 0
    assert run("date", "--cells", "6").count() == 12
    assert run("qc").count() == 4
    run("introgress", "--least-score", "0.1")
    assert run("segments").count() > 0 and run("smooth").count() == spark.read.parquet(tables["tracks"]).count()
    assert run("score").first().n > 0 and run("aggregate").first()["mean"] == 1.0 and run("ghost").count() == 2
    again = spark.read.parquet(tables["tracks"])
    again.unionByName(again).selectExpr("*", "0 AS member").write.mode("overwrite").parquet(f"{tmp_path}/members")
    tables["tracks"] = f"{tmp_path}/members"
    assert run("merge").count() > 0
    assert set(cli.COMMANDS) == {p.name[4:] for p in tmp_path.iterdir() if p.name.startswith("out-")}
