"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Two permutations make the whole signature: the first spreads the shingles over the places 0..2**22-1, the second,
shifted by k places, gives coordinate k. BANDS bands of ROWS coordinates miss a pair at the threshold with a chance
under 1e-5. Texts with equal shingle sets are one class from the start. The classes of a bucket are compared on their
full sets with a few leaders of it; where a bucket still holds several components, all its pairs across components are
estimated from the signatures, block by block (a block's full sets have about BLOCK_BYTES; one larger set is a block of its own), and those that may reach the threshold (their estimate is above it less SLACK,
over four standard deviations) are compared on their full sets there, each pair in the first band it shares, as 32 bits of
each band's key tell (another band agrees in them by chance in 1.4e-8 of the pairs). Only links leave
the tasks, so no group is paired with itself as a whole.

Null and empty texts have no shingle and link with nothing; texts under `width` words have their whole sequence as their
one shingle; texts of any length are read whole. Ties mean nothing: the least id names a component. Other columns than id and text
aren't read, so their names don't matter; the id column comes back under its own name. Rows that repeat stay, each with its class's component; a component's id ignores null ids, and rows with null
ids stay. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.cluster import Stored, ship
from lociflow.functions.groups import whole_groups
from lociflow.llm.common import steady
from lociflow.llm.components import connected_components
from lociflow.llm.text import Words, mix, shingles, slices

WIDTH, PERCENT = 5, 75
ROWS, BANDS = 6, 60
#: Leaders of a bucket; classes of a block and bytes of their sets, about; what an estimate may lack to the threshold.
LEADERS, BLOCK, BLOCK_BYTES, SLACK = 2, 512, 1 << 24, 0.1
_PLACES, _BLOCK = 1 << 22, 2048
_MASKS = np.random.default_rng(23).integers(1, 2**62, LEADERS - 1).tolist()
_SALTS = np.random.default_rng(22).integers(1, 2**63, ROWS + 1, dtype=np.uint64) | np.uint64(1)


@lru_cache(1)
def _circle() -> np.ndarray:
    """Row p holds the second permutation at p, p + 1, ...: coordinate k of a shingle at place p is row p's entry k."""
    second = np.random.default_rng(75).permutation(_PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: ROWS * BANDS]]), ROWS * BANDS)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The coordinates of each set hashes[bounds[i]:bounds[i + 1]]; an empty set has the largest value everywhere."""
    first = (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(42)).astype(np.int64)
    circle, out = _circle(), np.full((len(bounds) - 1, ROWS * BANDS), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for k in range(a, b, _BLOCK):
            np.minimum(out[i], circle[first[k : min(b, k + _BLOCK)]].min(axis=0), out=out[i])
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands differ."""
    rows = coordinates.reshape(len(coordinates), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix((rows * _SALTS[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _SALTS[ROWS]).astype(np.int64)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _signed(batches):
    """text to n (shingles), fp (128 bits of the set) and bands."""
    for batch in batches:
        texts = batch.column("text")
        for i, j in slices(texts):
            part = texts.slice(i, j - i)
            h, owner = shingles(Words(part), WIDTH)
            bounds = np.searchsorted(owner, np.arange(j - i + 1))
            data = h.tobytes()
            prints = [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            keys = band_keys(signatures(h, bounds))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(np.diff(bounds).astype(np.int64)), _binary(prints), bands], ["id", "th", "n", "fp", "bands"])


def _sets(batches):
    """(cid, text) to (cid, its sorted shingle hashes, the low byte of each coordinate, the low half of each band's key)."""
    for batch in batches:
        texts = batch.column("text")
        for i, j in slices(texts):
            h, owner = shingles(Words(texts.slice(i, j - i)), WIDTH)
            bounds = np.searchsorted(owner, np.arange(j - i + 1))
            signed, ends, data = signatures(h, bounds), (bounds * 8).tolist(), h.tobytes()
            low, checks = signed.astype(np.uint8), band_keys(signed).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("cid").slice(i, j - i), _binary([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]), _binary([x.tobytes() for x in low]), _binary([x.tobytes() for x in checks])], ["cid", "shingles", "low", "checks"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity; nothing links with an empty set."""
    if not len(x) or not len(y):
        return False
    same = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return same > 0 and 100 * same >= percent * (len(x) + len(y) - same)


def _across(percent: int):
    """Sorted (key, lo, hi) groups to the links across components."""
    floor = percent / 100 - SLACK
    least = int((floor + (1 - floor) / 256) * ROWS * BANDS)

    def run(batches):
        for batch in whole_groups(batches, ["key", "lo", "hi"]):
            key, lo, hi, side, cid, component, n, band = (batch.column(c).to_numpy() for c in ("key", "lo", "hi", "side", "cid", "component", "n", "band"))
            low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(len(cid), -1)
            checks = np.frombuffer(b"".join(batch.column("checks").to_pylist()), np.uint32).reshape(len(cid), BANDS)
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("shingles")]
            group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            at, d, a, b = np.arange(len(cid)), 0, [], []
            while True:
                d += 1
                at = at[at + d < len(cid)]
                at = at[group[at] == group[at + d]]
                if not len(at):
                    break
                i = at[((lo[at] == hi[at]) | (side[at] != side[at + d])) & (component[at] != component[at + d])]
                i = i[100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])]
                i = i[(low[i] == low[i + d]).sum(axis=1) >= least]
                first = (checks[i] == checks[i + d]).argmax(axis=1) if len(i) else i
                for k in i[first == band[i]].tolist():
                    if _linked(sets[k], sets[k + d], percent):
                        a.append(int(cid[k]))
                        b.append(int(cid[k + d]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _overlaps(percent: int):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("sa"), batch.column("sb"), strict=True)
            keep = [_linked(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), percent) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    return run


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: links are pairs with 100 * intersection >= percent * union."""
    ship(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
    kind = dict(docs.dtypes)["id"]
    signed = Stored(docs.mapInArrow(steady(_signed), f"id {kind}, th long, n long, fp binary, bands array<long>"), "signed")
    groups = signed.df.where("n > 0").groupBy("fp", "n", "bands").agg(F.min("id").alias("least"), F.min(F.struct("id", "th")).alias("rep"))
    classes = Stored(groups.withColumn("cid", F.monotonically_increasing_id()), "classes")
    keys = classes.df.select("cid", "n", F.posexplode("bands").alias("band", "key"))
    masks = [0, *_MASKS]
    picked = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *[F.min(F.col("cid").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)).alias(f"lead{k}") for k, x in enumerate(masks)]).where("m > 1")
    members = Stored(keys.join(picked, "key").select("key", "band", "cid", "n", "m", F.array_distinct(F.array(*[f"lead{k}" for k in range(len(masks))])).alias("leads")), "buckets")

    wanted = classes.df.join(members.df.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("rep.id").alias("ri"), F.col("rep.th").alias("rt"))
    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("ri")) & (F.col("th") == F.col("rt"))).select("cid", "text")
    sets = Stored(texts.mapInArrow(steady(_sets), "cid long, shingles binary, low binary, checks binary").dropDuplicates(["cid"]), "sets")
    led = members.df.select("cid", F.explode("leads").alias("lead")).where("cid <> lead")
    pairs = led.select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")).distinct()
    both = pairs.join(sets.df.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.df.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
    links = Stored(both.select("a", "b", "sa", "sb").mapInArrow(steady(_overlaps(percent)), "a long, b long"), "links-to-leaders")
    first = Stored(connected_components(links.df, "a", "b"), "components")

    placed = members.df.select("key", "band", "cid", "n", "m").join(first.df.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # a bucket's largest component is not compared with itself: its blocks meet those of the others only
    sized = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(8 * F.col("n")).alias("b"))
    sized = sized.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max(F.struct("c", "component", "b"))["b"].alias("mb"), F.max("c").alias("mc"), F.sum("c").alias("c"), F.sum("b").alias("b")).where("mc < c")
    blocks = lambda count, size: F.greatest(F.ceil(count / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
    sized = sized.select("key", "main", blocks(F.col("mc"), F.col("mb")).alias("mains"), blocks(F.col("c") - F.col("mc"), F.col("b") - F.col("mb")).alias("others"))
    inner, spot = F.col("component") == F.col("main"), F.xxhash64("cid")
    rest = placed.join(sized, "key").withColumn("side", F.when(inner, F.pmod(spot, F.col("mains"))).otherwise(F.col("mains") + F.pmod(spot, F.col("others"))).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.when(inner, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)))
    rest = rest.select("key", "band", "cid", "n", "component", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    rest = rest.join(sets.df, "cid").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "cid")
    across = Stored(rest.mapInArrow(steady(_across(percent)), "a long, b long"), "links-across")
    found = Stored(connected_components(first.df.select(F.col("node").alias("a"), F.col("component").alias("b")).union(across.df), "a", "b"), "components")
    for table in (links, across, first):
        table.drop()
    sets.drop()
    members.drop()
    reach = classes.df.select("fp", "cid", "least").join(found.df.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = reach.groupBy("component").agg(F.min("least").alias("component_id"))
    reach = reach.join(names, "component").select("fp", "component_id")
    out = signed.df.select("id", "n", "fp").join(reach, "fp", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))
