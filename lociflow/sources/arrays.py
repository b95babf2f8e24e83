"""Chunked array stores of variant calls (folders of zarr arrays, formats 2 and 3) as DataFrames.

A chunk is a file, and a row of Spark's binaryFile source: tasks read and decode chunks, and nothing else of the store is read but
the arrays' small descriptions. A range of positions is turned into a range of chunks, and only those files are listed and opened.
Sites and sample names are brought to the chunks as arrays of one chunk's length, so the join moves compressed chunks, not calls.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.cluster import ship
from lociflow.operators import genotypes
from lociflow.operators.order import numbered, ranked
from lociflow.sources import formats

#: Calls sent on at once from one chunk.
SLICE = 100_000
CALLS = "pos double, ref string, alt string, name string, hap int, allele tinyint, missing boolean"


@dataclass(frozen=True)
class Array:
    """What a store says of one array. codec: none, zlib, gzip or zstd; text: strings, each with its length before it."""

    name: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codec: str
    fill: object
    text: bool
    prefix: str
    separator: str
    order: str = "C"

    def grid(self, axis: int) -> int:
        return -(-self.shape[axis] // self.chunks[axis])

    def decode(self, raw: bytes | None) -> np.ndarray:
        """A whole chunk, cells beyond the array's edge included; None: the chunk has no file."""
        count = int(np.prod(self.chunks))
        if raw is None:
            empty = "" if self.text else np.zeros((), self.dtype)[()]
            return np.full(self.chunks, empty if self.fill is None else self.fill, dtype=object if self.text else self.dtype)
        if self.codec == "zlib":
            raw = zlib.decompress(raw)
        elif self.codec != "none":
            raw = pa.CompressedInputStream(pa.BufferReader(raw), self.codec).read()
        if not self.text:
            return np.frombuffer(raw, dtype=self.dtype, count=count).reshape(self.chunks, order=self.order)
        out, at = [], 4
        for _ in range(int.from_bytes(raw[:4], "little")):
            end = at + 4 + int.from_bytes(raw[at : at + 4], "little")
            out.append(raw[at + 4 : end].decode())
            at = end
        return np.array(out, dtype=object).reshape(self.chunks, order=self.order)


def _codec(name: str | None) -> str:
    known = {None: "none", "zlib": "zlib", "gzip": "gzip", "zstd": "zstd"}
    if name not in known:
        raise ValueError(f"chunks compressed by {name} aren't read; known: none, zlib, gzip, zstd")
    return known[name]


def _second(name: str, d: dict) -> Array:
    """Format 2: .zarray."""
    text = d["dtype"] == "|O"
    filters = [f["id"] for f in d.get("filters") or []]
    if filters != (["vlen-utf8"] if text else []):
        raise ValueError(f"array {name}: filters {filters} aren't read")
    return Array(name, tuple(d["shape"]), tuple(d["chunks"]), d["dtype"], _codec((d["compressor"] or {}).get("id")), None if text else d["fill_value"], text, "", d.get("dimension_separator", "."), d["order"])


def _third(name: str, d: dict) -> Array:
    """Format 3: zarr.json."""
    codecs = {c["name"]: c.get("configuration") or {} for c in d["codecs"]}
    text = codecs.pop("vlen-utf8", None) is not None
    little = codecs.pop("bytes", {}).get("endian", "little") == "little"
    if len(codecs) > 1:
        raise ValueError(f"array {name}: codecs {sorted(codecs)} aren't read")
    keys = d["chunk_key_encoding"]
    plain = keys["name"] == "v2"
    separator = (keys.get("configuration") or {}).get("separator", "." if plain else "/")
    dtype = "|O" if text else np.dtype(d["data_type"]).newbyteorder("<" if little else ">").str
    return Array(name, tuple(d["shape"]), tuple(d["chunk_grid"]["configuration"]["chunk_shape"]), dtype, _codec(next(iter(codecs), None)), d["fill_value"], text, "" if plain else "c" + separator, separator)


def _small(spark: SparkSession, path: str) -> str | None:
    """A description's text through the cluster's own file systems; None where there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def describe(spark: SparkSession, store: str, name: str) -> Array | None:
    """The array's description, without any chunk; None where the store has no such array."""
    second = _small(spark, f"{store}/{name}/.zarray")
    if second:
        return _second(name, json.loads(second))
    third = _small(spark, f"{store}/{name}/zarr.json")
    return _third(name, json.loads(third)) if third else None


def _digits(lo: int, hi: int) -> list[str]:
    """Globs that match the whole numbers from lo to hi and no others: few, however many numbers."""
    out, at = [], lo
    while at <= hi:
        step = 1
        while at % (step * 10) == 0 and at and at + step * 10 - 1 <= hi:
            step *= 10
        last = min(hi, at + 9 * step + step - 1 - at % (step * 10))
        top = (last - at + 1) // step
        low = at // step % 10
        head = str(at // (step * 10)) if at >= step * 10 else ""
        out.append(f"{head}[{low}-{low + top - 1}]" + "[0-9]" * (len(str(step)) - 1))
        at += top * step
    return out


def _chunks(spark: SparkSession, store: str, a: Array, lo: int, hi: int) -> DataFrame:
    """(i, j, content) of the chunks lo to hi along the first axis, j along the second (0 without one); null content: no file."""
    if len(a.shape) > 2 and a.grid(2) > 1:
        raise ValueError(f"array {a.name}: chunks must hold all copies of a sample")
    tail = (a.separator + "*") * (len(a.shape) - 1)
    glob = f"{store}/{a.name}/{a.prefix}{{{','.join(_digits(lo, hi))}}}{tail}"
    wide = a.grid(1) if len(a.shape) > 1 else 1
    cells = spark.range(lo * wide, (hi + 1) * wide).select(F.expr(f"id DIV {wide}").alias("i"), (F.col("id") % wide).alias("j"))
    at = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not len(found):
        return cells.withColumn("content", F.lit(None).cast("binary"))
    key = F.regexp_extract("path", r"/" + re.escape(a.prefix) + r"(\d+(?:" + re.escape(a.separator) + r"\d+)*)$", 1)
    parts = F.split(key, re.escape(a.separator))
    files = spark.read.format("binaryFile").load(glob).select(parts[0].try_cast("long").alias("i"), F.coalesce(F.get(parts, F.lit(1)).try_cast("long"), F.lit(0).cast("long")).alias("j"), "content")
    return cells.join(files, ["i", "j"], "left")


def values(spark: SparkSession, store: str, a: Array, lo: int = 0, hi: int | None = None, column: int = 0) -> DataFrame:
    """(at, value) of a one-column array, or of one column of a two-column one whose columns lie in one chunk; chunks lo to hi only."""
    ship(spark)
    hi = a.grid(0) - 1 if hi is None else hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                got = a.decode(r["content"])
                got = got if got.ndim == 1 else got[:, column]
                first = r["i"] * a.chunks[0]
                n = min(len(got), a.shape[0] - first)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(got[:n].tolist(), pa.string() if a.text else pa.float64())], ["at", "value"])

    return _chunks(spark, store, a, lo, hi).mapInArrow(run, f"at long, value {'string' if a.text else 'double'}")


def sample_names(spark: SparkSession, store: str) -> DataFrame | None:
    """(sample, hap, name): ids of the copies `<id>_<copy>`, or the ids alone where there is one copy; reads no calls. None without ids."""
    ids, calls = describe(spark, store, "sample_id"), describe(spark, store, "call_genotype")
    if ids is None:
        return None
    ploidy = calls.shape[2] if calls else 1
    name = F.concat_ws("_", "value", F.col("hap").cast("string")) if ploidy > 1 else F.col("value")
    return values(spark, store, ids).select(F.col("at").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(ploidy - 1))).alias("hap"), "value").select("sample", "hap", name.alias("name"))


def read_calls(spark: SparkSession, store: str, left: float | None = None, right: float | None = None) -> DataFrame:
    """(pos, ref, alt, name, hap, allele, missing) of the calls at left <= pos < right, as `formats.read_vcf` gives them.

    Calls below 0 are missing and count as 0, those above 0 as 1. Stores without alleles or sample ids give nulls there.
    """
    ship(spark)
    calls, at = describe(spark, store, "call_genotype"), describe(spark, store, "variant_position")
    if calls is None or at is None:
        raise ValueError(f"{store} has no call_genotype or no variant_position")
    sites = values(spark, store, at).select("at", F.col("value").alias("pos"))
    sites = sites.where((F.col("pos") >= F.lit(left)) if left is not None else F.lit(True)).where((F.col("pos") < F.lit(right)) if right is not None else F.lit(True))
    lo, hi = 0, calls.shape[0] - 1
    if left is not None or right is not None:
        lo, hi = sites.agg(F.min("at"), F.max("at")).first()
    if lo is None or hi < 0:
        return spark.createDataFrame([], CALLS)
    alleles = describe(spark, store, "variant_allele")
    letters = [F.lit(None).cast("string").alias(n) for n in ("ref", "alt")]
    if alleles is not None:
        for k, n in enumerate(("ref", "alt")[: alleles.shape[1]]):
            part = values(spark, store, alleles, lo // alleles.chunks[0], hi // alleles.chunks[0], k)
            sites = sites.join(part.withColumnRenamed("value", n), "at", "left")
        letters = [F.col(n) if n in sites.columns else F.lit(".").alias(n) for n in ("ref", "alt")]
    high, wide, copies = calls.chunks
    sites = sites.select("at", "pos", *letters).groupBy(F.expr(f"at DIV {high}").alias("i")).agg(F.sort_array(F.collect_list(F.struct(F.expr(f"CAST(at % {high} AS INT)").alias("row"), "pos", "ref", "alt"))).alias("sites"))
    chunks = _chunks(spark, store, calls, lo // high, hi // high).join(sites, "i")
    ids = describe(spark, store, "sample_id")
    if ids is None:
        chunks = chunks.withColumn("names", F.array().cast("array<string>"))
    else:
        names = values(spark, store, ids).groupBy(F.expr(f"at DIV {wide}").alias("j")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("names"))
        chunks = chunks.join(names, "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = calls.decode(r["content"])
                n = min(wide, calls.shape[1] - r["j"] * wide)
                names = np.array(r["names"] or [None] * n, dtype=object)[:n]
                each = n * calls.shape[2]
                step = max(1, SLICE // max(1, each))
                for k in range(0, len(r["sites"]), step):
                    some = r["sites"][k : k + step]
                    got = block[[s["row"] for s in some], :n, : calls.shape[2]].reshape(-1)
                    of = np.repeat(np.arange(len(some)), each)
                    cols = [pa.array([s[c] for s in some], t).take(pa.array(of)) for c, t in (("pos", pa.float64()), ("ref", pa.string()), ("alt", pa.string()))]
                    who = pa.array(np.tile(np.repeat(names, calls.shape[2]), len(some)).tolist(), pa.string())
                    hap = pa.array(np.tile(np.arange(calls.shape[2], dtype=np.int32), len(some) * n))
                    yield pa.RecordBatch.from_arrays([*cols, who, hap, pa.array((got > 0).astype(np.int8)), pa.array(got < 0)], ["pos", "ref", "alt", "name", "hap", "allele", "missing"])

    return chunks.select("i", "j", "content", "sites", "names").mapInArrow(run, CALLS)


def _put(store: str, name: str, data: bytes) -> None:
    """A file whole or not at all: written beside its name, then moved, so that a repeated task does no harm."""
    fs, path = pafs.FileSystem.from_uri(f"{store}/{name}")
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def _texts(values: list[str | None]) -> bytes:
    coded = [(v or "").encode() for v in values]
    return len(coded).to_bytes(4, "little") + b"".join(len(c).to_bytes(4, "little") + c for c in coded)


def _coded(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def write_calls(calls: DataFrame, store: str, width: float, sites: int = 10_000, samples: int = 1_000, ploidy: int = 2) -> None:
    """calls (pos, ref, alt, name, hap, allele, missing) as a store of format 2, a task a chunk; calls that no row tells are missing.

    store: a URI that all workers can write to. width: of the bins in which sites are put in order; samples are in order of their
    names (a row a sample). sites, samples: of a chunk, which bound a task. Of rows that tell the same call, one counts.
    """
    spark = calls.sparkSession
    ship(spark)
    place = ranked(calls, "pos", width).select("pos", F.col("rank").alias("site"))
    people = numbered(calls.where("name IS NOT NULL"), "name", "sample")
    letters = calls.where("pos IS NOT NULL").groupBy("pos").agg(F.min("ref").alias("ref"), F.min("alt").alias("alt")).join(place, "pos").withColumn("i", F.expr(f"site DIV {sites}"))
    rows = calls.join(place, "pos").join(people, "name").where((F.col("hap") >= 0) & (F.col("hap") < ploidy))
    cell = F.struct(F.expr(f"site DIV {sites}").alias("i"), F.expr(f"CAST(sample DIV {samples} AS LONG)").alias("j"))
    rows = rows.select(cell.alias("at"), F.expr(f"CAST(site % {sites} AS INT)").alias("row"), (F.col("sample") % samples).alias("col"), "hap", F.when(F.col("missing"), -1).otherwise(F.col("allele")).cast("tinyint").alias("call")).select("at.*", "row", "col", "hap", "call")

    def block(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        got = np.full((sites, samples, ploidy), -1, dtype=np.int8)
        got[table["row"].to_numpy(), table["col"].to_numpy(), table["hap"].to_numpy()] = table["call"].to_numpy()
        _put(store, f"call_genotype/{i}.{j}.0", _coded(got.tobytes()))
        return pa.table({"n": pa.array([1], pa.int64())})

    def heads(table: pa.Table) -> pa.Table:
        table, i = table.sort_by("site"), table["i"][0].as_py()
        pos = np.zeros(sites, dtype="<f8")
        pos[: len(table)] = table["pos"].to_numpy()
        _put(store, f"variant_position/{i}", _coded(pos.tobytes()))
        both = [x for pair in zip(table["ref"].to_pylist(), table["alt"].to_pylist()) for x in pair]
        _put(store, f"variant_allele/{i}.0", _coded(_texts(both + [""] * (2 * sites - len(both)))))
        return pa.table({"n": pa.array([len(table)], pa.int64())})

    def ids(table: pa.Table) -> pa.Table:
        table, j = table.sort_by("sample"), table["j"][0].as_py()
        names = table["name"].to_pylist()
        _put(store, f"sample_id/{j}", _coded(_texts(names + [""] * (samples - len(names)))))
        return pa.table({"n": pa.array([len(names)], pa.int64())})

    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_sites = total(letters.groupBy("i").applyInArrow(heads, "n long"))
    n_samples = total(people.withColumn("j", F.expr(f"CAST(sample DIV {samples} AS LONG)")).groupBy("j").applyInArrow(ids, "n long"))
    total(rows.groupBy("i", "j").applyInArrow(block, "n long"))
    about = {"zarr_format": 2, "order": "C", "compressor": {"id": "zstd", "level": 1}}
    for name, shape, chunks, dtype, dims in (
        ("call_genotype", (n_sites, n_samples, ploidy), (sites, samples, ploidy), "|i1", ("variants", "samples", "ploidy")),
        ("variant_position", (n_sites,), (sites,), "<f8", ("variants",)),
        ("variant_allele", (n_sites, 2), (sites, 2), "|O", ("variants", "alleles")),
        ("sample_id", (n_samples,), (samples,), "|O", ("samples",)),
    ):
        more = {"shape": shape, "chunks": chunks, "dtype": dtype, "fill_value": -1 if dtype == "|i1" else 0, "filters": [{"id": "vlen-utf8"}] if dtype == "|O" else None}
        _put(store, f"{name}/.zarray", json.dumps(about | more).encode())
        _put(store, f"{name}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": dims}).encode())
    _put(store, ".zgroup", json.dumps({"zarr_format": 2}).encode())


def read_variants(spark: SparkSession, source: str, sex: DataFrame | None = None, length: float | None = None) -> DataFrame:
    """Calls of a VCF file or an array store. sex (name, sex): a sex chromosome, of which males keep one copy outside its pseudo-autosomal ends.

    length: of the chromosome; one beyond the last position where it isn't given.
    """
    kind = formats.source_kind(source)
    if kind == "tables":
        raise ValueError("tree tables have no calls of their own; see mutations.genotypes")
    calls = formats.read_vcf(formats.lines(spark, source)) if kind == "vcf" else read_calls(spark, source)
    if sex is None:
        return calls
    if length is None:
        length = float((calls.agg(F.max("pos")).first()[0] or 0.0) + 1)
    known = genotypes.sexes(calls, length, sex)
    ends = genotypes.pseudo_autosomal(calls, known, length, max(1.0, length / 100))
    return genotypes.haploid(calls, known, ends, keep=True).where("NOT missing OR hap = 0")
