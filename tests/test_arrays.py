"""Array stores: what is written is read again, by ranges of chunks; a literal store of format 3; what isn't known raises."""

import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lociflow.sources import arrays, formats


def test_digits_match_exactly():
    for lo in (0, 1, 7, 9, 10, 37, 99, 100, 980):
        for hi in (*range(lo, lo + 140, 7), 1005, 2345):
            if hi >= lo:
                globs = [re.compile(g + "$") for g in arrays._digits(lo, hi)]
                got = [k for k in range(0, 12000) if any(g.match(str(k)) for g in globs)]
                assert got == list(range(lo, hi + 1)), (lo, hi, arrays._digits(lo, hi))


def calls(spark):
    rows = [(10.0 * k, "A", "TG"[k % 2], f"s{s}", h, 0 if (k + s + h) % 5 == 0 else (k + s * h) % 2, (k + s + h) % 5 == 0) for k in range(23) for s in range(5) for h in range(2) if (k, s) != (4, 2)]
    return rows, spark.createDataFrame(rows, "pos double, ref string, alt string, name string, hap int, allele int, missing boolean")


def test_round_trip_by_chunks(spark, tmp_path):
    rows, df = calls(spark)
    store = f"file://{tmp_path}/s.vcz"
    arrays.write_calls(df, store, 50.0, sites=4, samples=2)
    arrays.write_calls(df, store, 50.0, sites=4, samples=2)  # again: the same files
    assert not list(Path(tmp_path).rglob("*.part"))
    want = set(rows) | {(40.0, "A", "T", "s2", h, 0, True) for h in (0, 1)}
    assert {tuple(r) for r in arrays.read_calls(spark, store).collect()} == want
    assert [(r.sample, r.hap, r.name) for r in arrays.sample_names(spark, store).orderBy("sample", "hap").collect()][:3] == [(0, 0, "s0_0"), (0, 1, "s0_1"), (1, 0, "s1_0")]
    for k in (0, 1, 4, 5):  # chunks outside the range are never opened
        for f in (tmp_path / "s.vcz" / "call_genotype").glob(f"{k}.*"):
            f.write_bytes(b"damage")
    part = arrays.read_calls(spark, store, 85.0, 155.0)
    assert {tuple(r) for r in part.collect()} == {w for w in want if 85 <= w[0] < 155}
    (tmp_path / "s.vcz" / "call_genotype" / "2.1.0").unlink()  # no file: all missing
    assert {(r.name, r.missing) for r in arrays.read_calls(spark, store, 85.0, 111.0).where("name IN ('s2', 's3')").collect()} == {("s2", True), ("s3", True)}
    assert arrays.read_calls(spark, store, 1e6, 2e6).count() == 0


def test_empty_calls(spark, tmp_path):
    store = f"file://{tmp_path}/e.vcz"
    arrays.write_calls(calls(spark)[1].limit(0), store, 50.0)
    assert arrays.read_calls(spark, store).count() == 0 and arrays.sample_names(spark, store).count() == 0


def third(folder, name, data, codec=None, sep="/"):
    at = folder / name
    (at / "c").mkdir(parents=True)
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec}] if codec else [])
    about = {"zarr_format": 3, "node_type": "array", "shape": data.shape, "data_type": str(data.dtype), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": data.shape}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": sep}}, "codecs": codecs, "fill_value": 0}
    (at / "zarr.json").write_text(json.dumps(about))
    file = at / "/".join(["c"] + ["0"] * data.ndim)
    file.parent.mkdir(parents=True, exist_ok=True)
    raw = data.tobytes()
    file.write_bytes(pa.compress(raw, codec=codec, asbytes=True) if codec else raw)


def test_format_three_and_what_is_not_known(spark, tmp_path):
    block = np.array([[[0], [1]], [[-1], [2]]], dtype=np.int8)
    third(tmp_path, "call_genotype", block, "gzip")
    third(tmp_path, "variant_position", np.array([5, 9], dtype=np.int32))
    got = sorted((r.pos, r.ref, r.name, r.hap, r.allele, r.missing) for r in arrays.read_calls(spark, f"file://{tmp_path}").collect())
    assert got == [(5.0, None, None, 0, 0, False), (5.0, None, None, 0, 1, False), (9.0, None, None, 0, 0, True), (9.0, None, None, 0, 1, False)]
    assert arrays.sample_names(spark, f"file://{tmp_path}") is None
    about = json.loads((tmp_path / "call_genotype" / "zarr.json").read_text())
    about["codecs"][1]["name"] = "blosc"
    (tmp_path / "call_genotype" / "zarr.json").write_text(json.dumps(about))
    with pytest.raises(ValueError, match="blosc"):
        arrays.read_calls(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="no call_genotype"):
        arrays.read_calls(spark, f"file://{tmp_path}/nowhere")
    with pytest.raises(ValueError, match="tree tables"):
        arrays.read_variants(spark, "x.parquet")


def test_vcf_of_a_sex_chromosome(spark, tmp_path):
    rows = [f"X\t{10 * k + 5}\t.\tA\tT\t.\tPASS\t.\tGT\t{k % 2}|{(k + 1) % 2}\t{k % 2}|{k % 2}" for k in range(10)]
    (tmp_path / "x.vcf").write_text("\n".join(["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tf\tm", *rows]) + "\n")
    sex = spark.createDataFrame([("m", "M"), ("f", "F")], "name string, sex string")
    got = arrays.read_variants(spark, f"{tmp_path}/x.vcf", sex)
    assert {r["name"]: r["count"] for r in got.groupBy("name").count().collect()} == {"f": 20, "m": 10}
    assert arrays.read_variants(spark, f"{tmp_path}/x.vcf").count() == 40
    assert formats.source_kind("a.vcz") == "zarr"
