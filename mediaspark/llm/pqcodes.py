"""Vector codes: a product quantizer over integer vectors, with exact distances from limb-split matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors whose distances are held at once.
BLOCK = 2048
#: Integers up to this size are exact in a double.
EXACT_BITS = 53
_HEX = np.array([f"{i:02x}" for i in range(256)])


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Doubles of at most ``bits`` bits that add up to ``x``, each times 2^bits more than the one before."""
    out, low = [], (1 << bits) - 1
    while x.size and (int(x.max()) >= 1 << bits or int(x.min()) < -(1 << bits)):
        out.append((x & low).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, exactly: no product of limbs adds up to more than 2^53."""
    bits = (EXACT_BITS - max(1, x.shape[1] - 1).bit_length() - 1) // 2
    total = np.zeros((len(x), len(y)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(y, bits)):
            total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries of each row, and its squared distance."""
    far = (book * book).sum(1)[None, :] - 2 * exact_dot(x, book)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(1)


def largest(dim: int, parts: int) -> int:
    """Integer components must be smaller than this, so that a squared distance fits a long."""
    return 1 << (62 - max(1, dim // parts - 1).bit_length()) // 2 - 1


def integers(vectors: pa.Array, dim: int, parts: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be coded, and their components as integers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    values = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * scale)
        good = (np.abs(scaled) < largest(dim, parts)).all(1)
    ok = fits.to_numpy(zero_copy_only=False).astype(bool)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, scaled[good].astype(np.int64)


def _codable(column: str, dim: int | None, parts: int, scale: int) -> Column:
    """``integers``' choice as a condition."""
    v = F.col(column)
    size = (F.size(v) > 0) & (F.size(v) % parts == 0) if dim is None else F.size(v) == dim
    bound = float("inf") if dim is None else float(largest(dim, parts))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x.cast("double") * scale) if dim else x.cast("double")) < F.lit(bound))
    return F.coalesce(v.isNotNull() & size & F.forall(v, fits), F.lit(False))


def start(vectors: DataFrame, *, parts: int = 4, entries: int = 256, scale: int = 1024, column: str = "embedding", key: str = "vec_id") -> np.ndarray:
    """Codebooks (part, entry, component) of the vectors with the smallest keys; their length is all others'."""
    pick = lambda dim: vectors.where(F.col(key).isNotNull() & _codable(column, dim, parts, scale)).select(F.col(key).alias("k"), F.col(column).alias("v")).orderBy("k", "v").limit(entries).collect()
    rows = pick(None)
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    dim = len(rows[0]["v"])
    rows = pick(dim)
    found = np.array([np.floor(np.array(r["v"], dtype=np.float64) * scale) for r in rows]).reshape(-1, dim).astype(np.int64)
    return np.ascontiguousarray(found.reshape(len(rows), parts, dim // parts).transpose(1, 0, 2))


def _partials(books: np.ndarray, scale: int):
    """Sums and counts of what is nearest to each entry, one row per part and entry of a task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = integers(batch.column(0), parts * width, parts, scale)[1]
            for a in range(0, len(x), BLOCK):
                for p in range(parts):
                    own = x[a : a + BLOCK, p * width : (p + 1) * width]
                    at = nearest(own, books[p])[0]
                    order = np.argsort(at, kind="stable")
                    used, heads, size = np.unique(at[order], return_index=True, return_counts=True)
                    sums[p, used] += np.add.reduceat(own[order], heads, axis=0)
                    counts[p, used] += size
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    return run


def train(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, column: str = "embedding", key: str = "vec_id") -> np.ndarray:
    """Codebooks after ``rounds`` of assignment and means rounded down; entries that nothing is nearest to stay.

    A round is one pass: each task adds up its own vectors, and only ``parts * entries`` rows of sums a task are
    shuffled, and that many in all reach the driver.
    """
    books = start(vectors, parts=parts, entries=entries, scale=scale, column=column, key=key)
    width = books.shape[2]
    for _ in range(rounds if books.size else 0):
        sums = vectors.select(column).mapInArrow(_partials(books, scale), "part int, entry int, n bigint, sums array<bigint>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
        books = books.copy()
        for r in total.collect():
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def encode(vectors: DataFrame, books: np.ndarray, *, scale: int = 1024, column: str = "embedding") -> DataFrame:
    """Add code (two hex digits a part) and error (squared distance) to the rows whose vector can be coded.

    Null vectors, those that hold nulls or components that aren't finite, that have another length than the
    codebooks or a component so large that no long holds its squared distance (2^28 and more after scaling, at 16
    components a part) are left out.  Equal vectors get equal codes; of entries at equal distance the first is
    taken.  An empty table stays empty.  Columns named code and error are replaced, all others kept.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape

    @F.arrow_udf("struct<code: string, error: bigint>")
    def coded(column: pa.Array) -> pa.Array:
        books = shared.value
        ok, x = integers(column, parts * width, parts, scale) if books.size else (np.zeros(len(column), bool), np.zeros((0, 0), np.int64))
        codes, errors = np.full(len(ok), None, dtype=object), np.zeros(len(ok), np.int64)
        rows = np.flatnonzero(ok)
        for a in range(0, len(x), BLOCK):
            block, text = x[a : a + BLOCK], ""
            for p in range(parts):
                at, far = nearest(block[:, p * width : (p + 1) * width], books[p])
                text = np.char.add(text, _HEX[at])
                errors[rows[a : a + BLOCK]] += far
            codes[rows[a : a + BLOCK]] = text
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64(), mask=~ok)], ["code", "error"])

    found = vectors.withColumn("__coded", coded(F.col(column))).where("__coded.code IS NOT NULL")
    kept = [F.col(f"`{c}`") for c in vectors.columns if c not in ("code", "error")]
    return found.select(*kept, F.col("__coded.code").alias("code"), F.col("__coded.error").alias("error"))


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add label_error: the errors of all rows of an equal label together, null labels as one.

    ``coded`` is read twice, so it should be written before.  Errors are added up ahead of their shuffle; the
    join's other side has a row per label.
    """
    total = coded.groupBy(F.col(label).alias("__label")).agg(F.try_sum("error").alias("label_error"))
    return coded.drop("label_error").join(total, F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")


def books_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
