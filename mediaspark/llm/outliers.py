"""Quality rules: base counts, then robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaspark.llm.common import BLANKS, written

_SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_ARROW = pa.struct([(x, pa.int64()) for x in _COUNTS])

#: The vector of a text, and the deviation per statistic that never counts as odd (added to the covariance).
STATISTICS: dict[str, tuple[str, float]] = {
    "length": ("ln(1 + n_words)", 0.5),
    "word": ("ln((1 + word_chars) / (1 + n_words))", 0.08),
    "symbols": ("ln(1 + 100 * n_symbols / (1 + word_chars))", 0.3),
    "upper": ("ln(1 + 20 * n_upper / (1 + word_chars))", 0.2),
    "marks": ("ln(1 + 20 * n_marks / (1 + word_chars))", 0.2),
    "lines": ("ln(1 + 5 * n_dup_lines / (1 + n_lines))", 0.2),
    "repeats": ("ln(1 + 5 * n_repeat_words / (1 + n_words))", 0.2),
}
#: Bins of a squared distance per octave, and the bin of distance 0.
BINS, LOWEST = 6, -20
#: Starts of a group: its moments, those of tanh and of signs about the median, median and MAD, and so many small subsets.
MOMENTS, TANH, SIGNS, MEDIAN, SUBSETS = 0, 1, 2, 3, 10
#: A start stands still once a step lowers its log-determinant by less than this.
STILL = 1e-4
#: The largest share of normal rows that the cut rejects, however small the group.
LARGEST_TAIL = 1e-3
#: Parts that the rows of a group are dealt to where they meet the group's estimates.
SALTS = 32


def _repeated(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of ``size`` (a power of two) words that occur twice or more, exactly."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    step = 1
    while step < size:  # numbers of windows of 1, 2, 4 and 8 words
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if counts.max() < 2:
            return 0
        step *= 2
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(counts[ids] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def _count(text: str | None) -> dict[str, int]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": _repeated(words),
        "n_lines": len(lines),
        "n_upper": len(raw) - len(raw.translate(None, _UPPER)),
        "n_marks": len(raw) - len(raw.translate(None, _MARKS)),
    }


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in _COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    """The base counts of each text."""
    return pa.array([_count(x) for x in texts.to_pylist()], _ARROW)


def _distance(x: list[Column], centre: str, weight: str) -> Column:
    """Squared Mahalanobis distance; ``weight`` holds the inverse covariance row by row."""
    d = [x[i] - F.col(centre)[i] for i in range(len(x))]
    total = F.lit(0.0)
    for i in range(len(x)):
        inner = F.lit(0.0)
        for j in range(len(x)):
            inner = inner + F.col(weight)[i * len(x) + j] * d[j]
        total = total + d[i] * inner
    return total


def _moments(x: list[Column]) -> list[Column]:
    pairs = [x[i] * x[j] for i in range(len(x)) for j in range(i + 1)]
    return [F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(c) for c in pairs]).alias("q")]


def _spread(mean: np.ndarray, sums: np.ndarray, total: float) -> np.ndarray:
    """The covariance, from the sums of products of the lower triangle."""
    square = np.zeros((len(mean), len(mean)))
    square[np.tril_indices(len(mean))] = sums / total
    return square + np.tril(square, -1).T - np.outer(mean, mean)


def _fit(rows: pd.DataFrame, share: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, covariance and its log-determinant of the nearest ``share`` of the rows; the last bin counts in part."""
    rows = rows.sort_values("bin")
    n = rows["n"].to_numpy().astype(float)
    held = np.clip((share * n.sum() - (np.cumsum(n) - n)) / n, 0.0, 1.0)
    total = float(held @ n)
    mean = held @ np.stack(rows["s"].to_numpy()) / total
    cov = _spread(mean, held @ np.stack(rows["q"].to_numpy()), total) + np.diag(floor**2)
    return mean, cov, float(np.linalg.slogdet(cov)[1])


def _begin(floors: list[float]):
    """The first estimate of a start, from the moments of its vectors and the group's medians and MADs."""
    floor = np.array(floors)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        start, row, found = key[2], rows.iloc[0], []
        mean = np.array(row["s"]) / row["n"]
        middle, wide = np.array(row["middle"]), np.hypot(1.4826 * np.array(row["mad"]), floor)
        if start == TANH:
            found.append((MEDIAN, middle, np.diag(wide**2)))
            found.append((TANH, middle, _spread(mean, row["q"], row["n"]) * np.outer(wide, wide)))
        elif start == SIGNS:
            found.append((SIGNS, middle, len(floor) * _spread(0 * mean, row["q"], row["n"]) * np.outer(wide, wide)))
        else:
            found.append((start, mean, _spread(mean, row["q"], row["n"])))
        weights = [np.linalg.inv(cov + np.diag(floor**2)).ravel().tolist() for _, _, cov in found]
        return pd.DataFrame({"g1": key[0], "g2": key[1], "start": [x[0] for x in found], "centre": [x[1].tolist() for x in found], "weight": weights, "det": math.inf})

    return run


def _beside(fit: DataFrame, per_group: DataFrame) -> DataFrame:
    """Rows with what their group has.  Groups are dealt out, or the aggregate that follows took each in one task."""
    many = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = fit.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(many, ["g1", "g2", "salt"]).drop("salt")


def _starts(fit: DataFrame, x: list[Column], floors: list[float]) -> DataFrame:
    """Several starts per group: ``(g1, g2, start, centre, weight, det)``, with a determinant still without end."""
    k = len(x)
    half = lambda c: F.percentile_approx(c, 0.5)
    middles = fit.groupBy("g1", "g2").agg(F.array(*[half(c) for c in x]).alias("middle"))
    mads = _beside(fit, middles).groupBy("g1", "g2", "middle").agg(F.array(*[half(F.abs(x[i] - F.col("middle")[i])) for i in range(k)]).alias("mad"))
    scales = written(mads, "scales")
    z = [(x[i] - F.col("middle")[i]) / F.sqrt(F.pow(1.4826 * F.col("mad")[i], 2) + floors[i] ** 2) for i in range(k)]
    length = F.sqrt(F.greatest(sum((c * c for c in z), F.lit(0.0)), F.lit(1e-12)))
    forms = [(MOMENTS, F.col("x")), (TANH, F.array(*[F.tanh(c) for c in z])), (SIGNS, F.array(*[c / length for c in z]))]
    forms = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), v.alias("x")) for i, v in forms]))
    whole = _beside(fit, scales).select("g1", "g2", forms.alias("v")).select("g1", "g2", "v.*")
    # A subset is one row more than statistics, each with the smallest hash of its slot; equal vectors count once.
    named = fit.select("g1", "g2", "x", F.xxhash64("x").alias("h"))
    drawn = named.groupBy("g1", "g2", F.pmod("h", F.lit(SUBSETS * (k + 1))).alias("slot")).agg(F.min("h").alias("h"))
    few = named.join(drawn, ["g1", "g2", "h"]).dropDuplicates(["g1", "g2", "h"])
    few = few.select("g1", "g2", (MEDIAN + 1 + F.floor(F.col("slot") / (k + 1))).cast("int").alias("start"), "x")
    sums = whole.unionByName(few).groupBy("g1", "g2", "start").agg(*_moments(x)).join(scales, ["g1", "g2"])
    schema = "g1 string, g2 string, start int, centre array<double>, weight array<double>, det double"
    return written(sums.groupBy("g1", "g2", "start").applyInPandas(_begin(floors), schema), "starts")


def _step(share: float, floors: list[float], minimum: int, limit_of: Callable[[int], float]):
    """One concentration step of a start: from moments per distance bin to a new estimate."""
    floor = np.array(floors)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mean, cov, det = _fit(rows, share, floor)
        few, moved = int(rows["n"].sum()) < minimum, det < rows["old"].iloc[0] - STILL
        return pd.DataFrame({"g1": [key[0]], "g2": [key[1]], "start": [key[2]], "centre": [mean.tolist()], "weight": [np.linalg.inv(cov).ravel().tolist()], "det": [det], "few": [few], "moved": [moved], "limit": [limit_of(int(rows["n"].sum()))]})

    return run


def _concentrate(fit: DataFrame, x: list[Column], floors: list[float], share: float, minimum: int, steps: int | None, limit_of: Callable[[int], float]) -> DataFrame:
    """Per group the estimate of smallest determinant that its starts come to: ``(g1, g2, centre, weight, few, limit)``."""
    schema = "g1 string, g2 string, start int, centre array<double>, weight array<double>, det double, few boolean, moved boolean, limit double"
    active, found = _starts(fit, x, floors), None
    while steps is None or steps > 0:
        bins = F.floor(F.log2(F.greatest(_distance(x, "centre", "weight"), F.lit(2.0**LOWEST))) * BINS)
        binned = _beside(fit, active).withColumn("bin", bins).groupBy("g1", "g2", "start", "bin").agg(*_moments(x), F.first("det").alias("old"))
        estimate = written(binned.groupBy("g1", "g2", "start").applyInPandas(_step(share, floors, minimum, limit_of), schema), "estimate")
        found = estimate if found is None else found.unionByName(estimate)
        active, steps = estimate.where("moved"), steps and steps - 1
        if active.isEmpty():
            break
    best = found.groupBy("g1", "g2").agg(F.min_by(F.struct("centre", "weight", "few", "limit"), F.struct("det", "start")).alias("best"))
    return written(best.select("g1", "g2", "best.*"), "best")


def _chi2_point(k: int, upper_tail: float) -> float:
    """The point of a chi-square law with ``k`` degrees that ``upper_tail`` lies beyond (Wilson and Hilferty)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - upper_tail)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def reject_outliers(
    docs: DataFrame,
    *,
    text: str = "text",
    groups: tuple[str, str] = ("lang", "source"),
    share: float = 0.75,
    steps: int | None = None,
    tail: float | None = None,
    lost: float = 1.0,
    minimum: int = 40,
) -> DataFrame:
    """Every row of ``docs`` but its text, with the base counts, base_failed, distance and kept.

    Rows that pass the base rules give their group (language and source) a minimum-covariance-determinant
    estimate.  Several starts per group (moments, median and MAD, covariances of tanh and of signs about the
    median, ``SUBSETS`` small subsets drawn by hash) each take concentration steps until the determinant stands
    still (``steps`` bounds them, if given): a step finds the distance within which ``share`` of the rows lie and
    estimates anew from those.  The estimate of smallest determinant is the group's.  A step is one aggregation of
    moments per group, start and distance bin, combined before its shuffle, so a group that holds a third of all
    rows costs what its rows cost and none is gathered in a task; the matrix work sees a few hundred bins a start.  Groups of
    fewer than ``minimum`` rows share one estimate; if those are still too few, their rows are kept.  Rows
    beyond a point of a chi-square law are rejected: the one that ``lost`` normal rows of the group are expected
    beyond, a share of ``LARGEST_TAIL`` at most, or the ``tail`` point if given; the covariance is scaled by its consistency
    factor and widened by the floors of ``STATISTICS``, so a statistic that hardly varies rejects nothing by
    rounding.  Counts and estimates cover all rows.

    Null and empty texts have counts of 0 and fail the base rules, as all texts under 20 words do.  Null group
    values form groups of their own.  Repeated rows count as often as they occur.  Very long texts are counted
    whole.  Of starts that come to the same determinant the one with the smallest number is taken; rows at the cut
    itself are kept.  ``steps``, if given, is 1 or more.  An empty table gives an empty result.  Result columns replace columns of their names, the others are kept.
    """
    k = len(STATISTICS)
    floors = [f for _, f in STATISTICS.values()]
    row = [c for c in docs.columns if c.lower() != text.lower() and c.lower() not in (*_COUNTS, "base_failed", "distance", "kept")]
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"), text_counts(F.col(text)).alias("c"), *[F.col(g).cast("string").alias(f"k{i}") for i, g in enumerate(groups, 1)])
    failed = F.expr("c.n_words < 20 or 100 * c.n_repeat_words > 30 * c.n_words")
    vector = F.array(*[F.expr(_in_struct(e)) for e, _ in STATISTICS.values()])
    rows = written(counted.withColumns({"base_failed": failed, "x": vector}), "counts")

    sizes = rows.where("not base_failed").groupBy("k1", "k2").agg(F.count("*").alias("size"))
    sizes = sizes.select(F.col("k1").alias("z1"), F.col("k2").alias("z2"), (F.col("size") >= minimum).alias("own"))
    named = rows.join(sizes, F.col("k1").eqNullSafe(F.col("z1")) & F.col("k2").eqNullSafe(F.col("z2")), "left")
    # Small groups go to one common group, marked by an empty array; null values keep their own name.
    name = lambda c: F.when(F.col("own"), F.coalesce(F.concat(F.lit("="), c), F.lit("null"))).otherwise(F.lit("rest"))
    named = written(named.select("row", "c", "base_failed", "x", name(F.col("k1")).alias("g1"), name(F.col("k2")).alias("g2")), "groups")

    x = [F.col("x")[i] for i in range(k)]
    fit = named.where("not base_failed")
    # Among normal rows, those within the share's distance have a covariance smaller by this factor.
    factor = share / _below(k + 2, _chi2_point(k, 1 - share))
    limit_of = lambda size: factor * _chi2_point(k, min(LARGEST_TAIL, lost / size) if tail is None else tail)
    estimate = _concentrate(fit, x, floors, share, minimum, steps, limit_of)
    judged = named.join(estimate, ["g1", "g2"], "left").withColumn("distance", _distance(x, "centre", "weight"))
    ok = ~F.col("base_failed") & (F.coalesce(F.col("few"), F.lit(True)) | (F.coalesce("distance", F.lit(0.0)) <= F.col("limit")))
    return judged.select("row.*", *[F.col(f"c.{c}") for c in _COUNTS], "base_failed", "distance", ok.alias("kept"))


def _below(k: int, point: float) -> float:
    """The share of a chi-square law with ``k`` degrees below ``point`` (Wilson and Hilferty)."""
    from statistics import NormalDist

    return NormalDist().cdf(((point / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def _in_struct(expression: str) -> str:
    for c in _COUNTS:
        expression = expression.replace(c, f"c.{c}")
    return expression
