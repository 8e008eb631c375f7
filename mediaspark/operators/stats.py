"""Rate estimation, rate control tables, seek indexes and small numerics.

Sums over samples are Spark aggregates; only matrices whose size the caller sets
(regressors, vector length, codebook) are solved with numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mediaspark.functions.timebase import gcd
from mediaspark.operators.packets import STREAM
from mediaspark.operators.scan import CHUNK_ROWS, chunk_id, cut_lineage, neighbours, running

# ---------------------------------------------------------- frame rates


def rate_units() -> list[int]:
    """Standard frame rates in units of 1/(12*1001) Hz.

    Multiples of 1/12 Hz up to 60 Hz, and the five whole rates 24, 30, 60, 12 and
    15 Hz, in that order.
    """
    return [i * 1001 for i in range(60 * 12)] + [r * 12000 for r in (24, 30, 60, 12, 15)]


def dts_gaps(df: DataFrame, *, keys: Sequence[str] = STREAM, order: str = "seq") -> DataFrame:
    """Distance of each packet's decode time from the stream's second one.

    The second packet counts from the first.  ``gap_no`` 1 is the second packet;
    gaps that are not positive are left out.
    """
    keys = list(keys)
    known = df.filter(F.col("dts").isNotNull())
    # The first two packets per stream: tasks keep two a stream before the shuffle.
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    two = known.select(*keys, order, "dts").withColumn("__i", nth).filter("__i <= 2")
    start = two.groupBy(*keys).agg(
        F.max(F.when(F.col("__i") == 1, F.col("dts"))).alias("__t0"), F.max(F.when(F.col("__i") == 2, F.col("dts"))).alias("__t1"),
        F.max(F.when(F.col("__i") == 2, F.col(order))).alias("__o1"),
    )
    j = known.join(start, keys).filter(F.col(order) >= F.col("__o1"))
    base = F.when(F.col(order) == F.col("__o1"), F.col("__t0")).otherwise(F.col("__t1"))
    return j.withColumn("gap", F.col("dts") - base).filter("gap > 0").drop("__t0", "__t1", "__o1")


def estimate_frame_rate(
    df: DataFrame, *, num: int = 1, den: int = 1_000_000, keys: Sequence[str] = STREAM, order: str = "seq"
) -> DataFrame:
    """Average rate, and the standard rate that decode times fit best.

    Each standard rate sums the squared distance of every gap from a whole number
    of its frames; the least sum times rate wins if it stays under the threshold.
    Equal gaps are counted before they meet the rates, and come sorted by ranges of (stream, gap): a task holds the
    sums of one stream at a time.  Streams that lie within a range leave it as one row; only the first and the last of
    a range, which others may share, hand on a row per rate.
    """
    units = np.array(rate_units()[1:], dtype=np.float64)
    keys = list(keys)
    gaps = dts_gaps(df, keys=keys, order=order)
    counts = gaps.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    heads = [f for f in counts.schema.fields if f.name in keys]
    sums_schema = T.StructType([*heads, *T._parse_datatype_string("unit double, sum double, n double").fields])
    shape = to_arrow_schema(sums_schema)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the rows that come together: all rates of a task's first and last stream, the best of the others."""
        period, key, total, first = 1001 * 12.0 / units, None, None, True

        def put(done: list[tuple[tuple, np.ndarray, bool]]) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in shape]
            for k, sums, shared in done:
                # Of equal fits the lowest rate, as below.
                fit = sums[:-1] * units
                at = np.arange(len(units)) if shared else [min(np.flatnonzero(fit == fit.min()), key=lambda i: units[i])]
                for column, v in zip(columns, k):
                    column.extend([v] * len(at))
                for column, v in zip(columns[len(k):], (units[at], sums[at], np.full(len(at), sums[-1]))):
                    column.extend(v.tolist())
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, shape)], schema=shape)

        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch, done = whole.slice(start, 1024), []
                # NaN as a key is one stream, as it is to Spark: the same object is equal in a tuple.
                names = list(zip(*[[math.nan if v != v else v for v in batch[k].to_pylist()] for k in keys]))
                secs, n = batch["gap"].to_numpy().astype(np.float64) * (num / den), batch["n"].to_numpy().astype(np.float64)
                cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]]]
                off = secs[:, None] - np.rint(secs[:, None] / period) * period
                sums = np.add.reduceat(np.column_stack((off * off * n[:, None], n)), cuts, axis=0)
                for i, row in zip(cuts, sums):
                    if names[i] == key:
                        total = total + row
                        continue
                    if key is not None:
                        done.append((key, total, first))
                        first = False
                    key, total = names[i], row
                if done:
                    yield put(done)
        if key is not None:
            yield put([(key, total, True)])

    ranged = counts.repartitionByRange(*keys, "gap").sortWithinPartitions(*keys, "gap")
    sums = ranged.mapInArrow(add_up, sums_schema).groupBy(*keys, "unit").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    sums = sums.withColumn("fit", F.col("sum") * F.col("unit"))
    least = F.min_by(F.struct("unit", "fit", "n"), F.struct("fit", "unit"))
    best = sums.groupBy(*keys).agg(least.alias("__b")).select(*keys, "__b.unit", "__b.fit", "__b.n")
    limit = (2.0 * num / den) ** 2 * 1000 * 12 * 30
    out = best.withColumn("r_num", F.when(F.col("fit") < F.lit(limit) * F.col("n"), F.col("unit").cast("bigint")))
    span = df.groupBy(*keys).agg(
        F.count("dts").alias("frames"), F.sum("duration").alias("__d")
    )
    avg = F.try_divide((F.col("frames") - 2) * F.lit(float(den)), F.col("__d") * F.lit(float(num)))
    out = span.withColumn("avg_rate", F.when(F.col("frames") > 2, avg)).drop("__d").join(out, list(keys), "left")
    return out.select(*keys, "frames", "avg_rate", "r_num", F.when(F.col("r_num").isNotNull(), F.lit(12 * 1001)).alias("r_den"))


def delta_gcd(df: DataFrame, *, keys: Sequence[str] = STREAM, order: str = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    """Greatest common divisor of decode time gaps from the fourth on.

    A chunk hands on five numbers: how many gaps it has, and their divisor without its
    first 0 to 3.  Which of these counts follows from the gaps in earlier chunks.
    """
    keys = list(keys)
    gaps = dts_gaps(df, keys=keys, order=order).select(*keys, chunk_id(order, rows).alias("__c"), F.col(order).alias("__o"), "gap")

    def divisors(table: pa.Table) -> pa.Table:
        gap = table["gap"].to_numpy()[np.argsort(table["__o"].to_numpy(), kind="stable")]
        head = table.select([*keys, "__c"]).slice(0, 1).append_column("__n", pa.array([len(gap)], pa.int64()))
        return head.append_column("__g", pa.array([[int(np.gcd.reduce(gap[k:])) for k in range(4)]], pa.list_(pa.int64())))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in gaps.schema if f.name in [*keys, "__c"])
    part = gaps.groupBy(*keys, "__c").applyInArrow(divisors, f"{names}, __n bigint, __g array<bigint>")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    skip = F.greatest(F.lit(3) - before, F.lit(0)).cast("int")
    part = part.withColumn("__s", skip).filter(F.col("__n") > F.col("__s")).withColumn("__g", F.get("__g", F.col("__s")))
    # Divisors of the chunks; few distinct ones are left.
    zero = F.lit(0).cast("bigint")
    return part.groupBy(*keys).agg(F.aggregate(F.collect_set("__g"), zero, gcd).alias("gap_gcd"))


# ------------------------------------------------------------ rate control


def bit_budget(df: DataFrame, *, bit_rate: float, fps: float) -> DataFrame:
    """First-pass sums per picture type and whether the fixed bits fit the rate."""
    t = F.col("pict_type")
    g = df.groupBy("stream_id", t).agg(
        F.sum(F.col("tex_bits") * F.col("q")).alias("complexity"),
        F.sum("misc_bits").alias("const_bits"),
        F.count(F.lit(1)).alias("frames"),
    )
    # One row per type: a handful per stream.
    w = Window.partitionBy("stream_id")
    available = F.floor(F.lit(bit_rate) * F.sum("frames").over(w) / F.lit(fps))
    return g.withColumn("feasible", available >= F.sum("const_bits").over(w))


def bit_budget_wide(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """Frame counts and complexity with one column per picture type."""
    return df.groupBy("stream_id").pivot("pict_type", list(types)).agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.col("tex_bits") * F.col("q")).alias("complexity")
    )


def size_predictor(
    df: DataFrame, *, decay: float = 0.4, coeff: float = 118 * 7.0, keys: Sequence[str] = ("stream_id",), order: str = "frame_no",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Size model ``coeff * var / (q * count)`` with forgetting.

    A row's weight is ``decay`` to the number of used rows after it, so the
    recursion is one weighted sum.  Rows with variance under 10 are not used.
    """
    used = df.filter(F.col("variance") >= 10)
    ranked = running(used, keys, order, {"__k": ("count", F.lit(1))}, reverse=True, include_current=False, rows=rows)
    weight = F.pow(F.lit(decay), F.coalesce("__k", F.lit(0)).cast("double"))
    new = F.col("size") * F.col("q") / (F.col("variance") + 1)
    g = ranked.groupBy(*keys).agg(F.sum(weight * new).alias("__c"), F.sum(weight).alias("__w"), F.count(F.lit(1)).alias("__n"))
    rest = F.pow(F.lit(decay), F.col("__n").cast("double"))
    return g.select(*keys, (F.col("__c") + rest * coeff).alias("coeff"), (F.col("__w") + rest).alias("count"))


def predict_size(df: DataFrame, model: DataFrame, *, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    m = model.withColumnsRenamed({"coeff": "__c", "count": "__n"})
    return df.join(m, list(keys), "left").withColumn(
        "predicted", F.col("__c") * F.col("variance") / (F.col("q") * F.col("__n"))
    ).drop("__c", "__n")


def smooth_same_type(
    df: DataFrame, *, blur: float = 0.5, half: int | None = None, value: str = "q", keys: Sequence[str] = ("stream_id",),
    order: str = "frame_no", rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Gaussian average over nearby rows of the same picture type.

    Weights are renormalised, also at the ends.  Needs consecutive numbers.
    """
    k = (int(blur * 4) | 1) // 2 if half is None else half
    part = F.struct(F.col("pict_type").alias("t"), F.col(value).cast("double").alias("v"), F.col(order).alias("n"))
    cols = {"__near": lambda w: F.collect_list(part).over(w.rowsBetween(-k, k))}
    out = neighbours(df, keys, order, k, k, cols, rows=rows)
    same = F.filter("__near", lambda e: e["t"] == F.col("pict_type"))

    def weight(e: Column) -> Column:
        d = (e["n"] - F.col(order)).cast("double")
        return F.lit(1.0) if blur == 0 else F.exp(-d * d / F.lit(blur * blur))

    zero = F.lit(0.0)
    top = F.aggregate(F.transform(same, lambda e: e["v"] * weight(e)), zero, lambda a, x: a + x)
    bottom = F.aggregate(F.transform(same, weight), zero, lambda a, x: a + x)
    return out.withColumn("blurred", top / bottom).drop("__near")


# ------------------------------------------------------------ seek indexes


def build_seek_index(packets: DataFrame, *, keys: Sequence[str] = STREAM) -> DataFrame:
    """One entry per time: the last arrival, keeping the larger key distance.

    Entries of one time and position keep the larger ``min_distance`` while they
    follow each other; another position starts afresh, also where an earlier one
    comes back.  So the last run of equal positions counts: what arrived after the
    last entry with another position.  All steps are aggregates.
    """
    at = [*keys, "ts"]
    last = packets.groupBy(*at).agg(F.max_by(F.struct("pos", "size", "is_key"), "seq").alias("__e"))
    known = packets.join(last, at)
    same = F.col("pos").eqNullSafe(F.col("__e.pos"))
    broken = known.groupBy(*at).agg(F.max(F.when(~same, F.col("seq"))).alias("__broken"))
    run = known.join(broken, at).where(same & (F.col("__broken").isNull() | (F.col("seq") > F.col("__broken"))))
    return run.groupBy(*at).agg(
        F.first("__e.pos").alias("pos"), F.max("min_distance").alias("min_distance"),
        F.first("__e.size").alias("size"), F.first("__e.is_key").alias("is_key"),
    )


def thin_index(index: DataFrame, max_entries: int, *, keys: Sequence[str] = STREAM, order: str = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    """Keep every second entry while a stream's index is full."""
    n = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    ranked = running(index, keys, order, {"__rn": ("count", F.lit(1))}, rows=rows).join(n, list(keys))
    # Halving until it fits is keeping every 2^k-th entry.
    rounds = F.greatest(F.lit(0), F.ceil(F.log2(F.col("__total") / F.lit(max_entries - 0.5)))) if max_entries > 1 else F.lit(62)
    full = F.when(F.col("__total") >= max_entries, F.greatest(rounds, F.lit(1))).otherwise(0)
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), full.cast("int"))
    return ranked.filter((F.col("__rn") - 1) % step == 0).drop("__rn", "__total")


def halve_index(index: DataFrame, max_entries: int, *, keys: Sequence[str] = STREAM, order: str = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    """One thinning step: full indexes lose every second entry."""
    n = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    ranked = running(index, keys, order, {"__rn": ("count", F.lit(1))}, rows=rows).join(n, list(keys))
    keep = (F.col("__total") < max_entries) | ((F.col("__rn") - 1) % 2 == 0)
    return ranked.filter(keep).drop("__rn", "__total")


def split_index(index: DataFrame, *, least: int = 1024) -> DataFrame:
    """Cut a stream's single huge entry into equal blocks, all of them key entries.

    The block is the sample size doubled until it reaches ``least``.
    """
    s = F.col("sample_size")
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.lit(float(least)) / s)))
    block = (s * F.pow(F.lit(2.0), doublings)).cast("bigint")
    offs = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.col("__b"))
    out = index.withColumn("__b", block).filter("size > 0").withColumn("__off", F.explode(offs))
    return (
        out.withColumn("pos", F.col("pos") + F.col("__off"))
        .withColumn("ts", F.col("ts") + F.col("__off"))
        .withColumn("size", F.least("__b", F.col("size") - F.col("__off")))
        .withColumn("is_key", F.lit(True))
        .drop("__b", "__off")
    )


def is_interleaved(index: DataFrame) -> DataFrame:
    """False where some stream starts after another one has ended in the file."""
    lo, hi = F.min("pos"), F.max("pos")
    per = index.groupBy(*STREAM).agg(
        lo.alias("__first"), hi.alias("__last"), F.min_by("size", "pos").alias("__size"), F.count(F.lit(1)).alias("__n"),
    )
    second = index.join(per.select(*STREAM, F.col("__first")), list(STREAM)).filter(F.col("pos") > F.col("__first"))
    second = second.groupBy(*STREAM).agg(F.min("pos").alias("__second"))
    per = per.join(second, list(STREAM), "left")
    overlap = (F.col("__n") >= 2) & (F.col("__first") + F.col("__size") > F.col("__second"))
    g = per.groupBy("stream_id").agg(
        F.max("__first").alias("last_start"), F.min("__last").alias("first_end"), F.max(F.coalesce(overlap, F.lit(False))).alias("overlap")
    )
    return g.withColumn("interleaved", ~(F.col("overlap") | (F.col("last_start") > F.col("first_end"))))


# -------------------------------------------------------------- numerics


def least_squares(
    df: DataFrame, y: str, xs: Sequence[str], *, decay: float = 1.0, threshold: float = 0.0, keys: Sequence[str] = ("stream_id",),
    order: str = "seq",
) -> DataFrame:
    """Coefficients and residual variance for every number of regressors.

    Moments are one weighted aggregate (a row weighs ``decay`` to its distance from
    the newest row, by consecutive ``order``); the solve is of size len(xs).
    """
    names = [y, *xs]
    n = len(xs)
    rows = df
    weight = F.lit(1.0)
    if decay != 1.0:
        top = df.groupBy(*keys).agg(F.max(order).alias("__top"))
        rows = df.join(top, list(keys))
        weight = F.pow(F.lit(decay), (F.col("__top") - F.col(order)).cast("double"))
    pairs = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
    aggs = [F.sum(F.col(names[i]) * F.col(names[j]) * weight).alias(f"__m{i}_{j}") for i, j in pairs]
    moments = rows.groupBy(*keys).agg(*aggs)
    moments = moments.select(*keys, F.array(*[F.col(f"__m{i}_{j}") for i, j in pairs]).alias("__m"))

    @F.pandas_udf("array<struct<order:int,coeff:array<double>,variance:double>>")
    def solve(m: pd.Series) -> pd.Series:
        out = []
        for v in m:
            full = np.zeros((n + 1, n + 1))
            for (i, j), x in zip(pairs, v):
                full[i, j] = full[j, i] = x
            cov, cy = full[1:, 1:], full[0, 1:]
            res = []
            for k in range(1, n + 1):
                c = np.linalg.lstsq(cov[:k, :k] + np.eye(k) * threshold, cy[:k], rcond=None)[0]
                var = full[0, 0] - 2 * c @ cy[:k] + c @ cov[:k, :k] @ c
                res.append({"order": k, "coeff": c.tolist(), "variance": float(var)})
            out.append(res)
        return pd.Series(out)

    return moments.select(*keys, F.inline(solve("__m")))


def _partial_moments(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """Sum, cross products and count of vectors, one row per partition."""
    schema = "n bigint, s array<double>, q array<double>"

    def add(batches):
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if len(b):
                x = np.stack(b[column].to_numpy()).astype(np.float64)
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    return vectors.select(column).mapInPandas(add, schema)


def pca(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """Eigenvalues and vectors of the covariance, largest first.

    Partitions add up their cross products; the matrix to solve is dim x dim.
    """
    parts = _partial_moments(vectors, column, dim)
    cells = parts.select("n", "s", F.posexplode("q").alias("i", "v"))
    q = cells.groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    means = parts.select("n", F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    m = means.select("i", (F.col("v") / F.col("n")).alias("m"))
    cov = (
        q.withColumn("r", F.expr(f"i div {dim}").cast("int")).withColumn("c", (F.col("i") % dim).cast("int"))
        .join(m.withColumnsRenamed({"i": "r", "m": "mr"}), "r").join(m.withColumnsRenamed({"i": "c", "m": "mc"}), "c")
        .select("r", "c", (F.col("v") / F.col("n") - F.col("mr") * F.col("mc")).alias("v"))
    )
    # dim * dim cells in one row.
    one = cov.groupBy().agg(F.collect_list(F.struct("r", "c", "v")).alias("cells"))

    @F.pandas_udf("array<struct<rank:int,eigenvalue:double,vector:array<double>>>")
    def solve(cells: pd.Series) -> pd.Series:
        out = []
        for cs in cells:
            a = np.zeros((dim, dim))
            for c in cs:
                a[c["r"], c["c"]] = c["v"]
            val, vec = np.linalg.eigh((a + a.T) / 2)
            res = []
            for k, i in enumerate(np.argsort(-val, kind="stable")):
                v = vec[:, i] * (1 if vec[np.argmax(np.abs(vec[:, i])), i] >= 0 else -1)
                res.append({"rank": k, "eigenvalue": float(val[i]), "vector": v.tolist()})
            out.append(res)
        return pd.Series(out)

    return one.select(F.inline(solve("cells")))


def vq_assign(points: DataFrame, codebook: np.ndarray, column: str = "v") -> DataFrame:
    """Nearest code of each point (the first of equals) and its squared error."""
    codes = np.asarray(codebook, dtype=np.float64)

    @F.pandas_udf("cell int, error double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(np.float64)
        d = ((x[:, None, :] - codes[None, :, :]) ** 2).sum(axis=2)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "error": d[np.arange(len(x)), cell]})

    return points.select("*", nearest(column).alias("__q")).select(*points.columns, "__q.cell", "__q.error")


class _Sums:
    """Per slot: count, error, sum and bounds of vectors."""

    def __init__(self, slots: int, dim: int):
        self.n, self.e = np.zeros(slots), np.zeros(slots)
        self.s = np.zeros((slots, dim))
        self.lo, self.hi = np.full((slots, dim), np.inf), np.full((slots, dim), -np.inf)

    def means(self, fallback: np.ndarray) -> np.ndarray:
        return np.where(self.n[:, None] > 0, self.s / np.maximum(self.n, 1)[:, None], fallback)


def _accumulate(points: DataFrame, column: str, slots: int, dim: int, pick) -> _Sums:
    """Add vectors up by slot; ``pick(x)`` gives slot (-1 for none) and error per row.

    Partitions add up first and hand on one row per slot; slots x dimensions rows
    come to the driver.
    """

    def add(batches):
        t = _Sums(slots, dim)
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b[column].to_numpy()).astype(np.float64)
            slot, err = pick(x)
            x, err, slot = x[slot >= 0], err[slot >= 0], slot[slot >= 0]
            t.n += np.bincount(slot, minlength=slots)
            t.e += np.bincount(slot, weights=err, minlength=slots)
            np.add.at(t.s, slot, x)
            np.minimum.at(t.lo, slot, x)
            np.maximum.at(t.hi, slot, x)
        yield pd.DataFrame({
            "slot": np.arange(slots, dtype=np.int32), "n": t.n, "e": t.e, "s": list(t.s), "lo": list(t.lo), "hi": list(t.hi),
        })

    parts = points.select(column).mapInPandas(add, "slot int, n double, e double, s array<double>, lo array<double>, hi array<double>")
    flat = parts.select("slot", "n", "e", F.posexplode(F.arrays_zip("s", "lo", "hi")).alias("i", "z"))
    g = flat.groupBy("slot", "i").agg(
        F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("z.s").alias("s"), F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi")
    )
    out = _Sums(slots, dim)
    for r in g.toPandas().itertuples():
        out.n[r.slot], out.e[r.slot] = r.n, r.e
        out.s[r.slot, r.i], out.lo[r.slot, r.i], out.hi[r.slot, r.i] = r.s, r.lo, r.hi
    return out


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - codes[None, :, :]) ** 2).sum(axis=2)


def _nearest(codes: np.ndarray):
    def pick(x):
        d = _distances(x, codes)
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(x)), cell]

    return pick


def _plan_moves(codes: np.ndarray, e: np.ndarray) -> list[tuple[int, int, int]]:
    """(poor, rich, neighbour) cells of one round; a cell takes part once.

    Poor cells carry less than the average error.  Each gets the richest cell still
    free and the code closest to its own, which takes over its vectors.
    """
    k, total = len(codes), e.sum()
    rich = [i for i in np.argsort(-e, kind="stable") if k * e[i] > total]
    moves, used = [], set()
    for p in range(k):
        if k * e[p] >= total or p in used:
            continue
        d = _distances(codes[p : p + 1], codes)[0]
        d[p] = np.inf
        near = int(np.argmin(d))
        r = next((int(i) for i in rich if i not in used and i not in (p, near)), None)
        if r is None or near in used:
            continue
        moves.append((p, r, near))
        used |= {p, r, near}
    return moves


def _move_cells(points: DataFrame, column: str, codes: np.ndarray, cells: _Sums, means: np.ndarray) -> np.ndarray:
    """Give codes of poor cells to rich ones where that lowers the error."""
    moves = _plan_moves(codes, cells.e)
    if not moves:
        return means
    dim, nearest = codes.shape[1], _nearest(codes)
    merged = np.array([(cells.s[p] + cells.s[c]) / max(cells.n[p] + cells.n[c], 1) for p, _, c in moves])
    # A rich cell is split at one and two thirds of its box, then averaged once.
    thirds = np.array([[cells.lo[r] + (cells.hi[r] - cells.lo[r]) * t / 3 for t in (1, 2)] for _, r, _ in moves])
    role = np.full(len(codes), -1)
    for i, (_, r, _) in enumerate(moves):
        role[r] = i

    def split(x):
        m = role[nearest(x)[0]]
        pair = thirds[np.maximum(m, 0)]
        d = ((x[:, None, :] - pair) ** 2).sum(axis=2)
        side = (d[:, 0] >= d[:, 1]).astype(int)
        return np.where(m >= 0, m * 2 + side, -1), d.min(axis=1)

    halves = _accumulate(points, column, 2 * len(moves), dim, split).means(thirds.reshape(-1, dim)).reshape(-1, 2, dim)
    owner = np.full(len(codes), -1)
    for i, m in enumerate(moves):
        owner[list(m)] = i

    def judge(x):
        cell = nearest(x)[0]
        m = owner[cell]
        at = np.maximum(m, 0)
        split_err = ((x[:, None, :] - halves[at]) ** 2).sum(axis=2).min(axis=1)
        joined_err = ((x - merged[at]) ** 2).sum(axis=1)
        return m, np.where(role[cell] >= 0, split_err, joined_err)

    after = _accumulate(points, column, len(moves), dim, judge).e
    out = means.copy()
    for i, (p, r, c) in enumerate(moves):
        if after[i] < cells.e[p] + cells.e[r] + cells.e[c]:
            out[p], out[r], out[c] = halves[i, 0], halves[i, 1], merged[i]
    return out


def vq_codebook(
    points: DataFrame, k: int, *, column: str = "v", steps: int = 20, gain: float = 0.1, seed: Sequence[Sequence[float]] | None = None
) -> tuple[np.ndarray, float]:
    """Codebook of ``k`` vectors by repeated assignment, moving of codes and averaging.

    In each round cells with less than the average error hand their vectors to
    their neighbour and their code to a cell with more, where the error falls by
    it.  Stops when a round gains at most ``gain`` of the error or after ``steps``
    rounds.  Only the codebook and per-cell sums come to the driver.
    """
    if seed is None:
        first = points.select(column).distinct().orderBy(F.xxhash64(column), column).limit(k).collect()
        seed = [list(r[0]) for r in first]
    codes = np.asarray(seed, dtype=np.float64)
    points = cut_lineage(points.select(column))
    last = math.inf
    for _ in range(steps):
        cells = _accumulate(points, column, len(codes), codes.shape[1], _nearest(codes))
        error = cells.e.sum()
        if last - error <= gain * error:
            break
        last = error
        codes = _move_cells(points, column, codes, cells, cells.means(codes))
    cells = _accumulate(points, column, len(codes), codes.shape[1], _nearest(codes))
    return codes, float(cells.e.sum())


def autocorr(df: DataFrame, lag: int, *, column: str = "x", start: float = 1.0, window: bool = True) -> DataFrame:
    """Autocorrelation of blocks of even length up to ``lag``; sums begin at ``start``.

    The window weighs a sample i steps from the middle by
    ``1 - (2/(len-1) - len/2 + i)^2``.
    """
    n = F.size(column)
    half = F.floor(n / 2)
    c = F.lit(2.0) / (n - 1)

    def weighted(v: Column, i: Column) -> Column:
        step = F.when(i >= half, i - half).otherwise(half - 1 - i)
        w = c - half + step
        return v.cast("double") * (F.lit(1.0) - w * w) if window else v.cast("double")

    d = df.withColumn("__d", F.transform(F.col(column), weighted))
    sums = [
        F.aggregate(
            F.zip_with(F.slice("__d", j + 1, 1 << 30), "__d", lambda a, b: a * b), F.lit(start),
            lambda s, v: s + F.coalesce(v, F.lit(0.0)),
        )
        for j in range(lag + 1)
    ]
    return d.withColumn("autoc", F.array(*sums)).drop("__d")


def lpc_order(df: DataFrame, *, min_order: int = 1, max_order: int | None = None, limit: float = 0.10) -> DataFrame:
    """Prediction order: the highest reflection coefficient above ``limit``."""

    @F.pandas_udf("int")
    def order(autoc: pd.Series) -> pd.Series:
        a = np.stack(autoc.to_numpy()).astype(np.float64)
        top = (max_order or a.shape[1] - 1)
        err, lpc = a[:, 0].copy(), np.zeros((len(a), top + 1))
        lpc[:, 0] = 1.0
        est = np.full(len(a), min_order, dtype=np.int32)
        for i in range(1, top + 1):
            acc = sum(lpc[:, j] * a[:, i - j] for j in range(i))
            k = np.where(err != 0, -acc / np.where(err != 0, err, 1), 0.0)
            old = lpc.copy()
            for j in range(1, i + 1):
                lpc[:, j] = old[:, j] + k * old[:, i - j]
            err = err * (1 - k * k)
            if i >= min_order:
                est = np.where(np.abs(k) > limit, i, est).astype(np.int32)
        return pd.Series(est)

    return df.withColumn("lpc_order", order("autoc"))


# --------------------------------------------------------------- delivery


def reception_report(received: DataFrame, *, interval: str = "interval") -> DataFrame:
    """Loss per source and report interval, from unwrapped sequence numbers."""
    w = Window.partitionBy("ssrc").orderBy(interval)
    g = received.filter("valid").groupBy("ssrc", interval).agg(
        F.max_by(F.struct("ext_seq", "base", "received"), "arrival_no").alias("s")
    )
    expected = F.col("s.ext_seq") - F.col("s.base") + 1
    r = g.select("ssrc", interval, F.col("s.ext_seq").alias("ext_max"), expected.alias("expected"), F.col("s.received").alias("received"))
    # Intervals per source are few against packets.
    pe, pr = F.coalesce(F.lag("expected").over(w), F.lit(0)), F.coalesce(F.lag("received").over(w), F.lit(0))
    de, dr = F.col("expected") - pe, F.col("received") - pr
    r = r.withColumn("__de", de).withColumn("__lost", de - dr)
    frac = F.when((F.col("__de") == 0) | (F.col("__lost") <= 0), 0).otherwise(
        F.call_function("div", F.col("__lost") * 256, F.when(F.col("__de") != 0, F.col("__de")))
    )
    return r.withColumn("lost", F.least(F.col("expected") - F.col("received"), F.lit(0xFFFFFF))).withColumn("fraction", frac).drop("__de", "__lost")


def bandwidth_in_use(conns: DataFrame, maximum: int, *, cell: int | None = None) -> DataFrame:
    """Bandwidth in use after each moment at which connections open or close.

    ``conns`` has ``opened, closed, bandwidth``.  ``over`` says a connection
    arriving then is refused.  Changes are added up per moment before the running sum.
    """
    change = F.explode(
        F.array(
            F.struct(F.col("opened").alias("t"), F.col("bandwidth").alias("d")),
            F.struct(F.col("closed").alias("t"), (-F.col("bandwidth")).alias("d")),
        )
    )
    per = conns.select(change.alias("c")).filter("c.t IS NOT NULL").groupBy(F.col("c.t").alias("t")).agg(F.sum("c.d").alias("d"))
    run = running(per, [], "t", {"in_use": ("sum", F.col("d"))}, rows=cell)
    return run.withColumn("over", F.col("in_use") > maximum).drop("d")


def connection_status(conns: DataFrame, streams: DataFrame) -> DataFrame:
    """Per connection: target and actual bit rate and bytes."""
    j = conns.join(streams.select("stream_id", F.col("bit_rate").alias("target_rate")), "stream_id", "left")
    secs = (F.col("closed") - F.col("opened")) / F.lit(1e6)
    return j.withColumn("actual_rate", F.try_divide(F.col("bytes") * 8.0, secs))
