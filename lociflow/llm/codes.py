"""Vector codes: each part of a vector is named by the nearest entry of that part's codebook.

Vectors become whole numbers, floor(SCALE * x), so all sums and distances are exact and reruns agree. A part's coarse cell (its numbers divided by a
width taken from the codebook, rounded down) is looked up among the cells a worker remembers. A new cell's box is compared
with all entries once: an entry stays where its least distance to the box is no more than the smallest of all entries' largest
distances; no other can be nearest to anything in the box, ties included. Then only these entries are computed exactly.

A round sums up parts inside the tasks: a task sends one row for each part and entry that it met, and the driver gets the sums of one codebook, whose size is
fixed. Ids are compared for the first codebook only, ENTRIES rows a task.

Dropped are null vectors, vectors with null or non-finite components or one of size LIMIT / SCALE or more (sums would leave 64 bits), and vectors
not as long as the one of the smallest id. Lengths that PARTS doesn't divide give parts whose lengths differ by one. Null ids
come last, equal ids are ordered by vector; with fewer than ENTRIES vectors the codebook is smaller. Repeated rows stay. Empty tables give empty results. Other
columns than id, label and vector aren't read; id and label come back under their own names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.cluster import Stored, ship
from lociflow.llm.common import steady

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26
#: Cells along the widest side of a part's codebook; cells a worker remembers a part, then it starts anew; tasks that first rows are gathered in.
ALONG, CELLS, GATHERED = 8, 1 << 16, 64
#: A label with more than this share of all rows has its total broadcast: there are fewer than 1 / HOT of them.
HOT = 1e-4
_ODD = np.random.default_rng(1313).integers(1, 2**62, 4096, dtype=np.int64) | 1


def borders(length: int, parts: int = PARTS) -> list[int]:
    """Where each part begins, and the end."""
    return [k * length // parts for k in range(parts + 1)]


def numbers(vectors: pa.Array) -> np.ndarray:
    """(rows, length) whole numbers of equally long vectors."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(vectors), -1)


class Book:
    """One part's entries and the cells met."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries)
        self.width = max(1, int(np.ptp(entries, axis=0).max(initial=0)) // ALONG) if entries.size else 1
        self.known: dict[bytes, np.ndarray] = {}
        self.computed = 0

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries that may be nearest to something in each cell's box, in ascending order."""
        out = []
        for i in range(0, len(cells), 256):
            low = (cells[i : i + 256] * self.width)[:, None, :]
            high, e = low + self.width - 1, self.entries[None]
            least = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(axis=2)
            most = (np.maximum(np.abs(e - low), np.abs(e - high)) ** 2).sum(axis=2)
            out += [np.flatnonzero(x) for x in least <= most.min(axis=1, keepdims=True)]
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; ties go to the lower entry."""
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if not x.size:
            return code, error
        cells = x // self.width
        with np.errstate(over="ignore"):
            hashed = (cells * _ODD[np.arange(cells.shape[1]) % len(_ODD)]).sum(axis=1)
        _, first, of = np.unique(hashed, return_index=True, return_inverse=True)
        if not (cells == cells[first][of]).all():  # two cells of one hash
            _, first, of = np.unique(cells, axis=0, return_index=True, return_inverse=True)
            of = of.ravel()
        cells = np.ascontiguousarray(cells[first])
        keys = [c.tobytes() for c in cells]
        new = [i for i, key in enumerate(keys) if key not in self.known]
        if len(self.known) + len(new) > CELLS:
            self.known, new = {}, list(range(len(keys)))
        self.known.update(zip([keys[i] for i in new], self._candidates(cells[new]), strict=True))
        found = [self.known[key] for key in keys]
        sizes = np.array([len(f) for f in found])
        for n in np.unique(sizes).tolist():
            these = np.flatnonzero(sizes == n)
            rank = np.full(len(sizes), -1)
            rank[these] = np.arange(len(these))
            rows = np.flatnonzero(rank[of] >= 0)
            near = np.stack([found[i] for i in these])[rank[of[rows]]]
            for a in range(0, len(rows), max(1, (1 << 20) // (n * x.shape[1]))):
                b = a + max(1, (1 << 20) // (n * x.shape[1]))
                apart = ((self.entries[near[a:b]] - x[rows[a:b], None, :]) ** 2).sum(axis=2)
                best = apart.argmin(axis=1)
                code[rows[a:b]], error[rows[a:b]] = near[np.arange(a, min(b, len(rows))), best], apart[np.arange(len(best)), best]
            self.computed += n * len(rows)
        return code, error


def _books(codebook: np.ndarray) -> list[Book]:
    ends = borders(codebook.shape[1])
    return [Book(codebook[:, a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _first(batches):
    """The ENTRIES first rows of a task, by id (null last) and vector."""
    held: list[tuple] = []
    for batch in batches:
        rows = [(i is None, 0 if i is None else i, v) for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True)]
        if len(held) == ENTRIES:
            rows = [r for r in rows if r < held[-1]]
        if rows:
            held = sorted([*held, *rows])[:ENTRIES]
        kinds = batch.schema
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([None if r[0] else r[1] for r in held], kinds.field("id").type), pa.array([r[2] for r in held], kinds.field("v").type)], ["id", "v"])


def first_codebook(rows: DataFrame) -> np.ndarray | None:
    """The vectors of the smallest ids, as long as the very first, as whole numbers; None for an empty table."""
    kinds = rows.schema.simpleString()[7:-1].replace(":", " ", 1).replace(",v:", ",v ")
    few = rows.mapInArrow(_first, kinds).repartition(GATHERED).mapInArrow(_first, kinds)
    got = few.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    if any(len(r.v) != len(got[0].v) for r in got):
        return first_codebook(rows.where(F.size("v") == len(got[0].v)))
    return np.floor(np.array([r.v for r in got], float) * SCALE).astype(np.int64) if got else None


def _sums(codebook: np.ndarray):
    ends = borders(codebook.shape[1])

    def run(batches):
        books = _books(codebook)
        count, total = np.zeros((PARTS, len(codebook)), np.int64), np.zeros(codebook.shape, np.int64)
        for batch in batches:
            x = numbers(batch.column("v"))
            for p, book in enumerate(books):
                code, _ = book.nearest(x[:, ends[p] : ends[p + 1]])
                count[p] += np.bincount(code, minlength=len(codebook))
                for k in range(ends[p], ends[p + 1]):  # a batch's sums are exact: under 2^53
                    total[:, k] += np.bincount(code, weights=x[:, k], minlength=len(codebook)).astype(np.int64)
        part, entry = np.nonzero(count)
        sums = [total[e, ends[p] : ends[p + 1]] for p, e in zip(part.tolist(), entry.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(sums, pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def refined(rows: DataFrame, codebook: np.ndarray) -> np.ndarray:
    """The codebook after one round: each entry the mean of its parts, rounded down; entries without parts stay."""
    ends = borders(codebook.shape[1])
    tasks = rows.select("v").mapInArrow(steady(_sums(codebook)), "part int, entry int, n long, sums array<long>")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    counts = tasks.select("part", "entry", "n", F.posexplode("sums").alias("k", "x")).groupBy("part", "entry", "k").agg(wide("n").alias("n"), wide("x").alias("x"))
    after = codebook.copy()
    for r in counts.collect():  # a number for each component of the codebook
        after[r.entry, ends[r.part] + r.k] = int(r.x) // int(r.n)
    return after


def trained(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    codebook = first_codebook(rows)
    if codebook is not None:
        same = rows.where(F.size("v") == codebook.shape[1])
        for _ in range(rounds):
            codebook = refined(same, codebook)
    return codebook


def kept(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v) of the vectors that take part."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < LIMIT / SCALE) & ~F.isnan(x)))


def digest(codebook: np.ndarray) -> str:
    """Of all components by part, entry and position within the part, as decimal numbers with commas between."""
    ends = borders(codebook.shape[1])
    listed = [str(x) for a, b in zip(ends[:-1], ends[1:], strict=True) for x in codebook[:, a:b].ravel().tolist()]
    return hashlib.sha256(",".join(listed).encode()).hexdigest()


def encode(rows: DataFrame, codebook: np.ndarray) -> DataFrame:
    """rows (id, label, v) to (id, label, code, error): two hex digits a part, and the squared distances added up."""
    ship(rows.sparkSession)
    ends = borders(codebook.shape[1])

    def run(batches):
        books = _books(codebook)
        for batch in batches:
            x = numbers(batch.column("v"))
            code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                c, e = book.nearest(x[:, ends[p] : ends[p + 1]])
                code[:, p] = c
                error += e
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kinds = rows.select("id", "label").schema.fields
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in kinds], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.where(F.size("v") == codebook.shape[1]).mapInArrow(steady(run), out)


def decode(df: DataFrame, codebook: np.ndarray, code_col: str = "code") -> DataFrame:
    """df with decoded: the entries' numbers back in the vectors' scale; null codes give null."""
    ship(df.sparkSession)
    ends = borders(codebook.shape[1])

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(codes: pa.Array) -> pa.Array:
        picked = [None if c is None else bytes.fromhex(c) for c in codes.to_pylist()]
        return pa.array([None if c is None else np.concatenate([codebook[e, a:b] for e, a, b in zip(c, ends[:-1], ends[1:], strict=True)]) / SCALE for c in picked], pa.list_(pa.float64()))

    return df.withColumn("decoded", run(F.col(f"`{code_col}`")))


def _with_totals(rows: DataFrame) -> DataFrame:
    """rows with label_error, the errors of all rows of an equal label (nulls are equal) added up."""
    totals = Stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-totals").df
    every = totals.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") > HOT * every
    hot, rest = (totals.where(c).select(F.col("label").alias("l"), "label_error") for c in (large, ~large))
    same = F.col("label").eqNullSafe(F.col("l"))
    near = rows.join(F.broadcast(hot), same)  # under 1 / HOT rows
    far = rows.join(F.broadcast(hot.select("l")), same, "left_anti").join(rest, same)
    return near.unionByName(far).drop("l")


def compress(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of the vectors that take part, by codebooks trained on all of them."""
    ship(df.sparkSession)
    rows = kept(df, id_col, label_col, vector_col)
    codebook = trained(rows.select("id", "v"))
    if codebook is None:
        codebook = np.zeros((0, 0), np.int64)
    coded = Stored(encode(rows, codebook), "codes").df
    out = _with_totals(coded).withColumn("codebooks_sha256", F.lit(digest(codebook)))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", "codebooks_sha256")
