"""Near-duplicate embeddings by randomised-rotation binary codes.

A random rotation spreads each unit vector over its coordinates; their signs are its code, and the share of the vector
that the code holds is stored as its correction factor. A 4-bit rounding of another rotated vector against the code gives,
divided by the factor, an unbiased estimate of the inner product; what code and rounding don't see is bounded, and only pairs
whose bound reaches the threshold are computed exactly in double precision. Candidates are vectors that share one of
BANDS bands of BITS code bits (over several rotations): a pair at cosine 0.98 is missed with a chance of about 1e-6, a closer pair
far less often. Large buckets are compared block by block, so no task holds a bucket.

Equal vectors of a label are one class from the start, linked among themselves. Vectors that are null, empty, zero or
hold null or non-finite components, and vectors without a label, link with nothing; nor do vectors of different
lengths. Repeated rows stay and count as vectors of their own. A component's id is the smallest non-null id in it, so ties mean nothing;
vectors of any length are compared whole. Empty tables give empty results. Other columns than id, label and vector aren't read, so their
names don't matter; the id column comes back under its own name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.cluster import Stored, ship
from lociflow.functions.groups import whole_groups
from lociflow.llm.common import steady
from lociflow.llm.components import connected_components
from lociflow.llm.text import mix

COSINE, BITS, BANDS, BLOCK = 0.98, 16, 32, 512
_LEVELS = 15  # of the 4-bit rounding


@lru_cache(8)
def _rotations(dimensions: int) -> np.ndarray:
    """Random rotations of the padded space, one below the other; enough rows for all bands."""
    rng, rows = np.random.default_rng([dimensions, 98]), []
    while sum(map(len, rows)) < BITS * BANDS:
        rows.append(np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0])
    return np.concatenate(rows)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, padded with zeros to a multiple of 64."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return np.pad(v, ((0, 0), (0, -v.shape[1] % 64)))


def band_bits(units: np.ndarray) -> np.ndarray:
    """(rows, BANDS) numbers of BITS code bits."""
    signs = units @ _rotations(units.shape[1])[: BITS * BANDS].T > 0
    return (signs.reshape(len(units), BANDS, BITS) << np.arange(BITS)).sum(axis=2)


class Codes:
    """Binary codes, correction factors and 4-bit roundings of unit vectors; bound() compares rows pairwise."""

    def __init__(self, units: np.ndarray):
        d = units.shape[1]
        self.d, rotated = d, units @ _rotations(d)[:d].T
        self.code = np.packbits(rotated > 0, axis=1, bitorder="little").view(np.uint64)
        self.factor = np.abs(rotated).sum(axis=1) / np.sqrt(d)
        low, high = rotated.min(axis=1, keepdims=True), rotated.max(axis=1, keepdims=True)
        self.step = np.maximum((high - low) / _LEVELS, 1e-12)
        levels = np.rint((rotated - low) / self.step).astype(np.uint8)
        self.low, self.lost = low[:, 0], np.linalg.norm(rotated - (low + levels * self.step), axis=1)
        self.planes = np.stack([np.packbits(levels >> k & 1, axis=1, bitorder="little").view(np.uint64) for k in range(4)], axis=1)
        self.step, self.total = self.step[:, 0], levels.sum(axis=1)
        self.ones = np.bitwise_count(self.code).sum(axis=1).astype(np.int64)

    def estimate(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the part of row j along row i's code, the unbiased estimate of their inner product)."""
        hit = sum(np.bitwise_count(self.code[i] & self.planes[j, k]).sum(axis=1).astype(np.int64) << k for k in range(4))
        part = (2 * (self.step[j] * hit + self.low[j] * self.ones[i]) - (self.step[j] * self.total[j] + self.low[j] * self.d)) / np.sqrt(self.d)
        return part, part / self.factor[i]

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """No inner product is above this: what the code holds, plus all that both vectors have beside it."""
        part, own = self.estimate(i, j)[0] + self.lost[j], self.factor[i]
        part = np.minimum(part, 1.0)
        return np.where(part >= own, 1.0, own * part + np.sqrt(np.maximum(0, 1 - own**2)) * np.sqrt(np.maximum(0, 1 - part**2)))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of the vectors in the column."""
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield d, at, flat[begin[at][:, None] + np.arange(d)]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, label, v) to (cid, key), a row for each band."""
    for batch in batches:
        cid, label = batch.column("cid").to_numpy(), batch.column("lh").to_numpy()
        for d, at, vectors in _by_length(batch.column("v")):
            bits = band_bits(unit(vectors))
            seed = (label[at].astype(np.uint64) ^ np.uint64(d))[:, None]
            with np.errstate(over="ignore"):
                keys = mix(mix(seed + np.arange(BANDS, dtype=np.uint64)) + bits.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid[at], BANDS)), pa.array(keys.ravel().astype(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(at)))], ["cid", "key", "band"])


def _linked(threshold: float):
    def compare(batch: pa.RecordBatch, rows: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, lo, hi, side, band = (batch.column(c).to_numpy()[rows] for c in ("key", "lo", "hi", "side", "band"))
        group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        units = unit(vectors)
        codes, bands = Codes(units), band_bits(units)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at, d = np.arange(len(group)), 0
        while True:
            d += 1
            at = at[at + d < len(group)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            i = at[(lo[at] == hi[at]) | (side[at] != side[at + d])]
            i = i[codes.bound(i, i + d) >= threshold - 1e-9]
            i = i[np.einsum("ij,ij->i", units[i], units[i + d]) >= threshold]
            found.append((i, i + d))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        counted = np.argmax(bands[i] == bands[j], axis=1) == band[i] if len(i) else np.zeros(0, bool)
        return rows[i], rows[j], counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["key", "lo", "hi"]):
            parts = [compare(batch, rows, vectors) for _, rows, vectors in _by_length(batch.column("v"))]  # a group's vectors have one length
            i, j, counted = (np.concatenate([p[k] for p in parts]) for k in range(3))
            cid, n = batch.column("cid").to_numpy(), batch.column("n").to_numpy()
            links = np.zeros(len(cid), dtype=np.int64)
            np.add.at(links, i[counted], n[j[counted]])
            np.add.at(links, j[counted], n[i[counted]])
            root = np.arange(len(cid))
            while True:  # the smallest row that linked rows lead to
                before = root.copy()
                np.minimum.at(root, i, root[j])
                np.minimum.at(root, j, root[i])
                root = root[root]
                if (root == before).all():
                    break
            some = np.flatnonzero((links > 0) | (root != np.arange(len(cid))))
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(cid[root[some]])], ["cid", "links", "root"])

    return run


def near_duplicates(df: DataFrame, vector_col: str = "embedding", label_col: str = "label", id_col: str = "vec_id", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links join rows of equal label with a cosine of `cosine` or more."""
    ship(df.sparkSession)
    v = F.col("v")
    sound = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.withColumn("h", F.when(sound & F.exists(v, lambda x: x != 0), F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64(F.lit(1), "v", "label").alias("b"))))
    groups = rows.where("h is not null").groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first(F.xxhash64("label")).alias("lh"), F.first("v").alias("v"))
    classes = Stored(groups.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    keys = Stored(classes.df.select("cid", "lh", "v").mapInArrow(steady(_coded), "cid long, key long, band int"), "codes")
    several = keys.df.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    members = keys.df.join(several, "key").withColumn("side", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("cid", "key", "band", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    filled = members.join(classes.df.select("cid", "n", "v", F.size("v").alias("d")), "cid")
    found = Stored(filled.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "cid").mapInArrow(steady(_linked(cosine)), "cid long, links long, root long"), "vector-links")
    links = found.df.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.df, "cid", "root").withColumnsRenamed({"node": "cid"})
    reach = classes.df.select("h", "cid", "n", "least").join(links, "cid", "left").join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = reach.groupBy("component").agg(F.min("least").alias("component_id"))
    reach = reach.join(names, "component").select(F.col("h").alias("rh"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "h").join(reach, F.col("h") == F.col("rh"), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))
