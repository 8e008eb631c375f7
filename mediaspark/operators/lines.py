"""Picture lines: deinterlacing filters, motion, statistics and geometry.

A table of lines has ``stream_id, frame_no, plane, line_no, px``.  Vertical filters
window over the lines of one picture, which a picture's height bounds; temporal
ones over one line of the pictures next to each other, cut into chunks.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaspark.operators.fold import Fold, fold_stream
from mediaspark.operators.scan import CHUNK_ROWS, neighbours, with_halo

PICTURE = ("stream_id", "frame_no", "plane")
LINE = ("stream_id", "plane", "line_no")


def _clip(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), v)).cast("int")


def _avg(a: Column, b: Column) -> Column:
    """Byte average, rounded up."""
    return F.shiftright(a + b + 1, 1)


def _vertical(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("line_no")


def _taps(df: DataFrame, keys: Sequence[str], offsets: Sequence[int]) -> DataFrame:
    """Add ``t{k}``: the line k below (negative: above), null outside the picture."""
    w = _vertical(keys)
    for k in offsets:
        c = F.col("px") if k == 0 else (F.lag("px", -k).over(w) if k < 0 else F.lead("px", k).over(w))
        df = df.withColumn(f"t{k}", c)
    return df


def _drop_taps(df: DataFrame, offsets: Sequence[int]) -> DataFrame:
    return df.drop(*[f"t{k}" for k in offsets])


def _each(fn, *cols: Column) -> Column:
    """Apply ``fn`` pixel by pixel to several lines."""
    names = [chr(ord("a") + i) for i in range(len(cols))]
    zipped = F.arrays_zip(*[c.alias(n) for n, c in zip(names, cols)])
    return F.transform(zipped, lambda z: fn(*[z[n] for n in names]))


def _filter(df, offsets, pixel, *, parity, keys, edges=None) -> DataFrame:
    """Replace lines of a parity (or all) by a vertical filter.

    ``edges`` gives, per offset, the offsets to use where a line is missing; without
    a replacement the line keeps its pixels.
    """
    out = _taps(df, keys, offsets)
    cols = []
    for k in offsets:
        alternatives = [F.col(f"t{a}") for a in (edges or {}).get(k, ())]
        cols.append(F.coalesce(F.col(f"t{k}"), *alternatives))
    for i, c in enumerate(cols):
        out = out.withColumn(f"__f{i}", c)
    ready = F.lit(True)
    for i in range(len(cols)):
        ready = ready & F.col(f"__f{i}").isNotNull()
    if parity is not None:
        ready = ready & (F.col("line_no") % 2 == parity)
    value = _each(pixel, *[F.col(f"__f{i}") for i in range(len(cols))])
    out = out.withColumn("px", F.when(ready, value).otherwise(F.col("px")))
    return _drop_taps(out, offsets).drop(*[f"__f{i}" for i in range(len(cols))])


def deint_linear(df: DataFrame, *, parity: int = 1, keys: Sequence[str] = PICTURE) -> DataFrame:
    """Lines of one parity become the average of their neighbours."""
    return _filter(df, (-1, 1), _avg, parity=parity, keys=keys, edges={-1: (1,), 1: (-1,)})


def deint_cubic(df: DataFrame, *, parity: int = 1, keys: Sequence[str] = PICTURE) -> DataFrame:
    """Cubic interpolation ``(-a + 9b + 9c - d) >> 4`` from lines at -3, -1, 1, 3."""
    f = lambda a, b, c, d: _clip(F.shiftright(b * 9 + c * 9 - a - d, 4))
    return _filter(df, (-3, -1, 1, 3), f, parity=parity, keys=keys, edges={-3: (-1, 1), -1: (1,), 1: (-1,), 3: (1, -1)})


def deint_ff(df: DataFrame, *, parity: int = 1, keys: Sequence[str] = PICTURE) -> DataFrame:
    """Five taps ``(-1 4 2 4 -1) / 8`` over the lines of one parity."""
    f = lambda a, b, c, d, e: _clip(F.shiftright(b * 4 + c * 2 + d * 4 - a - e + 4, 3))
    edges = {-2: (-1,), -1: (0,), 1: (0,), 2: (0,)}
    return _filter(df, (-2, -1, 0, 1, 2), f, parity=parity, keys=keys, edges=edges)


def deint_lowpass5(df: DataFrame, *, keys: Sequence[str] = PICTURE) -> DataFrame:
    """Low pass ``(-1 2 6 2 -1) / 8`` over all lines."""
    f = lambda a, b, c, d, e: _clip(F.shiftright(b * 2 + d * 2 + c * 6 - a - e + 4, 3))
    edges = {-2: (-1, 0), -1: (0,), 1: (0,), 2: (1, 0)}
    return _filter(df, (-2, -1, 0, 1, 2), f, parity=None, keys=keys, edges=edges)


def deint_blend(df: DataFrame, *, keys: Sequence[str] = PICTURE) -> DataFrame:
    """``(1 2 1) / 4`` over all lines: outer average rounds down, the last one up."""
    f = lambda a, b, c: _avg(b, F.shiftright(a + c, 1))
    return _filter(df, (-1, 0, 1), f, parity=None, keys=keys, edges={-1: (0,), 1: (0,)})


def deint_median(df: DataFrame, *, parity: int = 1, keys: Sequence[str] = PICTURE) -> DataFrame:
    """Median of a line and its neighbours."""
    f = lambda a, b, c: a + b + c - F.greatest(a, b, c) - F.least(a, b, c)
    return _filter(df, (-1, 0, 1), f, parity=parity, keys=keys, edges={-1: (0,), 1: (0,)})


def bob(df: DataFrame, *, number: str = "line_no") -> DataFrame:
    """Each field line fills both picture lines it stands for."""
    n = F.col(number)
    return df.withColumn(number, F.explode(F.array(n * 2, n * 2 + 1)))


def weave(lines: DataFrame, *, keys: Sequence[str] = ("stream_id", "plane", "line_no"), order: str = "field_no", rows: int = CHUNK_ROWS) -> DataFrame:
    """Interleave each field with the one before it.

    ``lines`` are field lines with ``is_top``.  The newer field takes the lines of
    its own parity, the older one the others.  Each line is sent twice, to its own
    picture and to the next; the first field has no picture.
    """
    nb = neighbours(
        lines, keys, order, 1, 1,
        {"__next": lambda w: F.lead("is_top").over(w), "__prev": lambda w: F.lag(order).over(w)}, rows=rows,
    )
    own = F.struct(F.col(order).alias("n"), F.when(F.col("is_top"), 0).otherwise(1).alias("o"), F.col("__prev").isNotNull().alias("ok"))
    older = F.struct(
        (F.col(order) + 1).alias("n"), F.when(F.col("__next"), 1).otherwise(0).alias("o"), F.col("__next").isNotNull().alias("ok")
    )
    out = nb.withColumn("__w", F.explode(F.array(own, older))).filter("__w.ok")
    return out.withColumn("line_no", F.col("line_no") * 2 + F.col("__w")["o"]).withColumn(order, F.col("__w")["n"]).drop(
        "__w", "__next", "__prev", "is_top"
    )


def diag_deinterlace(
    df: DataFrame, *, parity: int = 1, move: int = 15, still: int = 1, edge: int = 4, keys: Sequence[str] = PICTURE
) -> DataFrame:
    """Rebuild lines of one parity along the smoothest direction.

    The vertical and two diagonal averages of the lines around compete by their
    difference; the vertical one passes whenever its difference is at most
    ``move``.  Diagonals count for luma only and not within ``edge`` pixels of a
    side.  Pixels whose ``still`` counter (and that of a neighbour line) is above
    the limit keep their own value.
    """
    w = _vertical(keys)
    x = df
    for n, c in (("t", "px"), ("s", "still")):
        x = x.withColumn(f"__{n}1", F.lag(c).over(w)).withColumn(f"__{n}2", F.lead(c).over(w))
    x = x.withColumn("__a", F.coalesce("__t1", "__t2")).withColumn("__b", F.coalesce("__t2", "__t1"))
    x = x.withColumn("__sa", F.coalesce("__s1", "__s2")).withColumn("__sb", F.coalesce("__s2", "__s1"))
    size = F.size("px")

    def at(c: str, i: Column) -> Column:
        return F.get(c, i)

    def pixel(i: Column) -> Column:
        a, b, c = at("__a", i - 1), at("__a", i), at("__a", i + 1)
        d, e, f = at("__b", i - 1), at("__b", i), at("__b", i + 1)
        vert, dv = _avg(b, e), F.abs(b - e)
        rise, fall = F.abs(a - f), F.abs(c - d)
        # How well each diagonal agrees with the pixels beside it.
        side_rise = _avg(F.abs(a - e), F.abs(b - f))
        side_fall = _avg(F.abs(b - d), F.abs(c - e))
        rise = F.when(side_fall <= side_rise, F.lit(255)).otherwise(rise)
        fall = F.when(side_fall > side_rise, F.lit(255)).otherwise(fall)
        best = F.least(rise, fall)
        diag = F.when(rise <= fall, _avg(a, f)).otherwise(_avg(c, d))
        straight = (i < edge) | (i >= size - edge) | (F.col("plane") != "Y") | (dv <= best) | (dv <= move)
        calm = (at("still", i) > still) & ((at("__sa", i) > still) | (at("__sb", i) > still))
        return F.when(calm, at("px", i)).when(straight, vert).otherwise(diag).cast("int")

    done = F.transform(F.sequence(F.lit(0), size - 1), pixel)
    ok = (F.col("line_no") % 2 == parity) & F.col("__a").isNotNull()
    return x.withColumn("px", F.when(ok, done).otherwise(F.col("px"))).drop(
        "__t1", "__t2", "__s1", "__s2", "__a", "__b", "__sa", "__sb"
    )


def movement_map(
    df: DataFrame, *, keys: Sequence[str] = LINE, order: str = "frame_no", back: int = 1, limit: int = 8, top: int = 127,
    rows: int = 4096,
) -> DataFrame:
    """Per pixel: for how many pictures it has moved less than ``limit``.

    The counter ends at ``top``, so it depends on that many earlier lines only;
    these are copied into a chunk and the rest needs no other chunk.
    """
    own = with_halo(df.select(*keys, order, "px"), order, top + back, 0, rows=rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in (*keys, order))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        px = np.stack(pdf["px"].to_numpy()).astype(np.int32)
        still = np.zeros(px.shape, dtype=np.int32)
        for i in range(back, len(px)):
            calm = np.abs(px[i] - px[i - back]) < limit
            still[i] = np.where(calm, np.minimum(still[i - 1] + 1, top), 0)
        out = pdf[[*keys, order]].copy()
        out["still"] = list(still)
        return out[pdf["__own"].to_numpy()]

    return own.groupBy(*keys, "__chunk").applyInPandas(count, f"{schema}, still array<int>")


# ---------------------------------------------------------------- statistics


def psnr(pairs: DataFrame, keys: Sequence[str], *, elem_size: int = 1) -> DataFrame:
    """Squared error, deviation and PSNR of paired values ``a`` and ``b``."""
    top = (1 << (8 * elem_size)) - 1
    g = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("sse")
    )
    value = F.when(F.col("sse") == 0, 999.99).otherwise(
        F.lit(10.0) * F.log10(F.lit(float(top * top)) * F.col("n") / F.when(F.col("sse") != 0, F.col("sse")))
    )
    return g.withColumn("stddev", F.sqrt(F.col("sse") / F.col("n"))).withColumn("psnr", value)


def line_sse(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Squared error per pair of lines, before any shuffle of pixels."""
    right = b.select(*keys, F.col("px").alias("__q"))
    sse = F.aggregate(
        F.zip_with("px", "__q", lambda p, q: ((p - q) * (p - q)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v
    )
    return a.join(right, list(keys)).withColumn("sse", sse).withColumn("n", F.size("px").cast("bigint")).drop("px", "__q")


def psnr_planes(errors: DataFrame, *, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """PSNR per plane and, as plane ``*``, of all planes together."""
    g = errors.groupBy(*keys, "plane").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    both = g.withColumn("plane", F.explode(F.array(F.col("plane"), F.lit("*"))))
    g = both.groupBy(*keys, "plane").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    value = F.when(
        F.col("sse") > 0, F.lit(-10.0) * F.log10(F.when(F.col("sse") > 0, F.col("sse")) / (F.col("n") * 255.0 * 255.0))
    )
    return g.withColumn("psnr", value)


def luma_histogram(df: DataFrame, *, keys: Sequence[str] = ("stream_id", "frame_no")) -> DataFrame:
    """Pixels per luma value; counted within each line's partition first."""
    luma = df.filter("plane = 'Y'").select(*keys, F.explode("px").alias("v"))
    return luma.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def auto_levels(
    hist: DataFrame, *, keys: Sequence[str] = ("stream_id", "frame_no"), clipped: float = 0.01, low: int = 16, high: int = 234
) -> DataFrame:
    """Black and white point with a share of pixels clipped, and the stretch factor."""
    # At most 256 rows per key.
    w = Window.partitionBy(*keys)
    up = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    down = w.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("__t", F.sum("n").over(w)).withColumn("__u", F.sum("n").over(up)).withColumn("__d", F.sum("n").over(down))
    h = h.withColumn("__m", F.floor(F.col("__t") * F.lit(clipped)))
    g = h.groupBy(*keys).agg(
        F.max("__m").alias("__m"),
        F.min(F.when(F.col("__u") >= F.col("__m"), F.col("v"))).alias("__b"),
        F.max(F.when(F.col("__d") >= F.col("__m"), F.col("v"))).alias("__w"),
    )
    some = F.col("__m") > 0
    g = g.withColumn("black", F.when(some, F.greatest(F.col("__b") - 1, F.lit(0))).otherwise(0).cast("int"))
    g = g.withColumn("white", F.when(some, F.col("__w") + 1).otherwise(256).cast("int"))
    return g.withColumn("scale", F.lit(float(high - low)) / (F.col("white") - F.col("black"))).drop("__m", "__b", "__w")


def apply_levels(df: DataFrame, levels: DataFrame, *, keys: Sequence[str] = ("stream_id", "frame_no"), low: int = 16) -> DataFrame:
    """Stretch luma lines so that black meets ``low``."""
    j = df.join(levels.select(*keys, "black", "scale"), list(keys))
    v = F.transform("px", lambda p: _clip(F.floor((p - F.col("black")) * F.col("scale") + low)))
    return j.withColumn("px", F.when(F.col("plane") == "Y", v).otherwise(F.col("px"))).drop("black", "scale")


def _block_sums(df: DataFrame, px: str, fn, block: int) -> Column:
    """Per line: one sum per block of columns, as an array."""
    cols = F.sequence(F.lit(0), F.call_function("div", F.size(px), F.lit(block)) - 1)
    return F.transform(
        cols,
        lambda b: F.aggregate(
            F.transform(F.slice(F.col(px), b * block + 1, F.lit(block)), fn), F.lit(0).cast("bigint"), lambda s, v: s + v
        ),
    )


def block_stats(df: DataFrame, *, block: int = 16, keys: Sequence[str] = PICTURE) -> DataFrame:
    """Mean and variance of whole blocks, in the integer form of a motion search."""
    shift = (block * block).bit_length() - 1
    half = 1 << (shift - 1)
    y = F.call_function("div", F.col("line_no"), F.lit(block)).alias("by")
    lines = df.filter(F.size("px") >= block).select(
        *keys, y, _block_sums(df, "px", lambda p: p.cast("bigint"), block).alias("__s"),
        _block_sums(df, "px", lambda p: (p * p).cast("bigint"), block).alias("__q"),
    )
    cells = lines.select(*keys, "by", F.posexplode(F.arrays_zip("__s", "__q")).alias("bx", "__z"))
    g = cells.groupBy(*keys, "by", "bx").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col("__z")["__s"]).alias("__s"), F.sum(F.col("__z")["__q"]).alias("__q")
    ).filter(F.col("__n") == block)
    mean = F.shiftright(F.col("__s") + half, shift)
    var = F.shiftright(F.col("__q") - F.shiftright(F.col("__s") * F.col("__s"), shift) + 500 + half, shift)
    return g.select(*keys, "bx", "by", mean.alias("mean"), var.alias("variance"))


def scene_score(df: DataFrame, *, block: int = 16, bias: int = 500, plane: str = "Y", rows: int = CHUNK_ROWS) -> DataFrame:
    """Blocks per picture that are cheaper to code alone than from the picture before."""
    luma = df.filter(F.col("plane") == plane)
    prev = neighbours(luma, LINE, "frame_no", 1, 0, {"__q": lambda w: F.lag("px").over(w)}, rows=rows)
    prev = prev.filter(F.col("__q").isNotNull())
    prev = prev.withColumn("__d", F.zip_with("px", "__q", lambda p, q: F.abs(p - q).cast("bigint")))
    y = F.call_function("div", F.col("line_no"), F.lit(block)).alias("by")
    # Pixels of a block travel as one slice per line, so the mean can be taken first.
    cols = F.sequence(F.lit(0), F.call_function("div", F.size("px"), F.lit(block)) - 1)
    cut = F.transform(
        cols,
        lambda b: F.struct(
            F.slice("px", b * block + 1, F.lit(block)).alias("p"),
            F.aggregate(F.slice("__d", b * block + 1, F.lit(block)), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("d"),
        ),
    )
    cells = prev.filter(F.size("px") >= block).select("stream_id", "frame_no", y, F.posexplode(cut).alias("bx", "z"))
    g = cells.groupBy("stream_id", "frame_no", "by", "bx").agg(
        # A block has at most ``block`` lines.
        F.flatten(F.collect_list(F.col("z")["p"])).alias("p"), F.sum(F.col("z")["d"]).alias("sad"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") == block)
    shift = (block * block).bit_length() - 1
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda s, v: s + v)
    mean = F.shiftright(total + (1 << (shift - 1)), shift)
    # The one-element array makes the mean a lambda variable, computed once per block.
    g = g.withColumn(
        "sae",
        F.transform(F.array(mean), lambda m: F.aggregate("p", F.lit(0).cast("bigint"), lambda s, v: s + F.abs(v - m)))[0],
    )
    return g.groupBy("stream_id", "frame_no").agg(F.count_if(F.col("sae") + bias < F.col("sad")).alias("score"))


def same_field_test(
    df: DataFrame, *, height: int, width: int, x_step: int = 1, y_step: int = 2, v_margin: float = 0.1, h_margin: float = 0.1,
    max_peaks: int = 250, peak: int = 30, searching: bool = True, back: int = 1, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Is a field a repeat of the one ``back`` pictures ago: 0 same, 1 nearly, 2 not.

    Only the middle of the picture counts.  More than ``max_peaks`` large errors or
    a mean error over 10 say no; large errors that are rare but strong say nearly
    while no rhythm is known (``searching``).
    """
    top = (2 + int(height * v_margin) // 2) & ~1
    left = (int(width * h_margin) // 2) & ~15
    prev = neighbours(df, LINE, "frame_no", back, 0, {"__q": lambda w: F.lag("px", back).over(w)}, rows=rows)
    rel = F.col("line_no") - F.lit(top)
    prev = prev.filter(
        F.col("__q").isNotNull() & (F.col("line_no") >= top) & (F.col("line_no") < height - top) & (rel % y_step == 0)
    )
    err = F.filter(
        F.transform(
            F.sequence(F.lit(left), F.lit(max(width - left - 1, left)), F.lit(x_step)),
            lambda i: F.abs(F.get("px", i) - F.get("__q", i)),
        ),
        lambda e: e.isNotNull(),
    )
    big = F.filter("__e", lambda e: e > peak)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: s + v)
    p = prev.withColumn("__e", err).withColumn("__s", total(F.col("__e"))).withColumn("__b", F.size(big)).withColumn("__bs", total(big))
    g = p.groupBy("stream_id", "frame_no").agg(
        F.sum("__s").alias("errors"), F.sum("__b").alias("peaks"), F.sum("__bs").alias("peak_sum"), F.count(F.lit(1)).alias("lines")
    )
    strong = (F.col("peaks") > 10) & (F.expr("peak_sum div nullif(peaks, 0)") > peak + 15)
    mean = F.col("errors") / (F.col("lines") * F.lit(float(width)) / x_step)
    verdict = F.when(F.col("peaks") > max_peaks, 2).when(F.lit(searching) & strong, 1).when(mean > 10, 2).otherwise(0)
    return g.withColumn("verdict", verdict)


# ------------------------------------------------------------------ geometry


def crop(df: DataFrame, x: int, y: int, w: int, h: int, *, height: int, width: int, chroma_shift: int = 1) -> DataFrame:
    """Cut a rectangle; 0 means up to the edge, chroma is cut to match.

    The corner is aligned down to the chroma grid and a rectangle that leaves the
    picture is refused.
    """
    mask = ~((1 << chroma_shift) - 1)
    x, y = x & mask, y & mask
    w, h = w or width - x, h or height - y
    if min(x, y) < 0 or w <= 0 or h <= 0 or x + w > width or y + h > height:
        raise ValueError("crop rectangle lies outside the picture")
    sh = F.when(F.col("plane") == "Y", 0).otherwise(chroma_shift)

    def scaled(v):
        return F.call_function("shiftright", F.lit(v), sh)

    up = lambda v: -F.call_function("shiftright", F.lit(-v), sh)
    inside = df.filter((F.col("line_no") >= scaled(y)) & (F.col("line_no") < scaled(y) + up(h)))
    return inside.withColumn("px", F.slice("px", scaled(x) + 1, up(w))).withColumn("line_no", F.col("line_no") - scaled(y))


def pad(
    df: DataFrame, top: int, bottom: int, left: int, right: int, *, color: dict[str, int], keys: Sequence[str] = PICTURE
) -> DataFrame:
    """Add a border in a colour per plane; chroma planes get half of it."""
    fill = F.element_at(F.create_map(*[F.lit(v) for kv in color.items() for v in kv]), F.col("plane"))
    half = F.when(F.col("plane") == "Y", 0).otherwise(1)
    n = lambda v: F.call_function("shiftright", F.lit(v), half)
    body = df.withColumn("px", F.concat(F.array_repeat(fill, n(left)), F.col("px"), F.array_repeat(fill, n(right))))
    body = body.withColumn("line_no", F.col("line_no") + n(top))
    dims = df.groupBy(*keys).agg((F.max("line_no") + 1).alias("__h"), F.max(F.size("px")).alias("__w"))
    above = F.when(n(top) > 0, F.sequence(F.lit(0).cast("bigint"), (n(top) - 1).cast("bigint")))
    below_at = F.col("__h") + n(top)
    below = F.when(n(bottom) > 0, F.sequence(below_at.cast("bigint"), (below_at + n(bottom) - 1).cast("bigint")))
    none = F.array().cast("array<bigint>")
    border = dims.withColumn("line_no", F.explode(F.concat(F.coalesce(above, none), F.coalesce(below, none))))
    border = border.withColumn("px", F.array_repeat(fill, (F.col("__w") + n(left) + n(right)).cast("int")))
    return body.select(*keys, "line_no", "px").unionByName(border.select(*keys, "line_no", "px"))


def vflip(df: DataFrame, *, keys: Sequence[str] = PICTURE) -> DataFrame:
    """Turn pictures upside down."""
    h = F.max("line_no").over(Window.partitionBy(*keys))
    return df.withColumn("line_no", h - F.col("line_no"))


def shrink(df: DataFrame, by: int, *, keys: Sequence[str] = PICTURE) -> DataFrame:
    """Box down-sample by 2, 4 or 8: rounded mean of whole boxes."""
    if by not in (2, 4, 8):
        raise ValueError("by must be 2, 4 or 8")
    shift = 2 * (by.bit_length() - 1)
    sums = df.select(
        *keys, F.call_function("div", F.col("line_no"), F.lit(by)).alias("line_no"),
        F.posexplode(_block_sums(df, "px", lambda p: p.cast("bigint"), by)).alias("__x", "__s"),
    )
    g = sums.groupBy(*keys, "line_no", "__x").agg(F.sum("__s").alias("__s"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == by)
    g = g.withColumn("__v", F.shiftright(F.col("__s") + (1 << (shift - 1)), shift).cast("int"))
    # One line of the smaller picture: bounded by its width.
    line = F.transform(F.array_sort(F.collect_list(F.struct("__x", "__v"))), lambda z: z["__v"])
    return g.groupBy(*keys, "line_no").agg(line.alias("px"))


def axis_weights(source: int, target: int, bits: int = 14) -> list[tuple[int, int, int]]:
    """(target, source, weight) of a bilinear scaler along one axis.

    Weights are fixed point and add up to ``2**bits`` per target.  Shrinking widens
    the triangle, so that every source position counts.
    """
    ratio = source / target
    reach = max(ratio, 1.0)
    out = []
    for t in range(target):
        centre = (t + 0.5) * ratio - 0.5
        low, high = math.floor(centre - reach) + 1, math.ceil(centre + reach) - 1
        merged: dict[int, float] = {}
        for i in range(low, high + 1):
            at = min(max(i, 0), source - 1)
            merged[at] = merged.get(at, 0.0) + 1.0 - abs(i - centre) / reach
        total = sum(merged.values())
        fixed = {i: round(w / total * (1 << bits)) for i, w in sorted(merged.items())}
        heaviest = max(fixed, key=lambda i: (fixed[i], -i))
        fixed[heaviest] += (1 << bits) - sum(fixed.values())
        out += [(t, i, w) for i, w in fixed.items()]
    return out


def scale(df: DataFrame, width: int, height: int, new_width: int, new_height: int, *, keys: Sequence[str] = PICTURE) -> DataFrame:
    """Bilinear scaling of planes of one size; rows are widened first, then mixed.

    Weights are constants of the plan, as many as the picture has columns and rows.
    """
    taps: list[list[tuple[int, int]]] = [[] for _ in range(new_width)]
    for t, i, w in axis_weights(width, new_width):
        taps[t].append((i, w))
    pair = lambda a, b, i, w: F.struct(F.lit(i).alias(a), F.lit(w).alias(b))
    table = F.array(*[F.array(*[pair("i", "w", i, w) for i, w in c]) for c in taps])
    zero = F.lit(0).cast("bigint")
    wide = F.transform(table, lambda c: F.aggregate(c, zero, lambda s, t: s + (F.get("px", t["i"]) * t["w"]).cast("bigint")))
    uses: list[list[tuple[int, int]]] = [[] for _ in range(height)]
    for t, i, w in axis_weights(height, new_height):
        uses[i].append((t, w))
    target = F.get(F.array(*[F.array(*[pair("t", "w", t, w) for t, w in u]) for u in uses]), F.col("line_no").cast("int"))
    sent = df.select(*keys, wide.alias("__v"), F.explode(target).alias("__t"))
    sent = sent.select(*keys, F.col("__t.t").cast("bigint").alias("line_no"), F.transform("__v", lambda v: v * F.col("__t.w")).alias("__v"))
    return _mixed_lines(sent, new_width, keys)


def _mixed_lines(sent: DataFrame, width: int, keys: Sequence[str]) -> DataFrame:
    """Sum the weighted lines ``__v`` that a target line gets; their number is bounded."""
    g = sent.groupBy(*keys, "line_no").agg(F.collect_list("__v").alias("__vs"))
    total = F.aggregate("__vs", F.array_repeat(F.lit(0).cast("bigint"), width), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return g.select(*keys, "line_no", F.transform(total, lambda v: _clip(F.shiftright(v + (1 << 27), 28))).alias("px"))


def kernel_weights(
    spark: SparkSession, source: int, target: int, kernel: Callable[[Column], Column], reach: float, *, bits: int = 14
) -> DataFrame:
    """``(t, i, w)``: the weight of each source position in each target position, along one axis.

    ``kernel`` gives the weight at a distance from 0 to ``reach``, counted in source positions, or in target
    positions when the axis shrinks.  Positions outside count for the nearest one inside.  Weights are fixed
    point from the start, so that sums don't depend on their order, and add up to ``2**bits`` per target; what
    rounding leaves goes to the heaviest, the first one of a tie.  A kernel whose weights around a target add up
    to 0 or less is refused.
    """
    ratio = source / target
    wide = max(ratio, 1.0)
    centre = (F.col("t") + 0.5) * ratio - 0.5
    positions = F.sequence(F.floor(centre - reach * wide), F.ceil(centre + reach * wide))
    taps = spark.range(target).withColumnRenamed("id", "t").select("t", F.explode(positions).alias("p"))
    taps = taps.withColumn("d", F.abs(F.col("p") - centre) / wide).where(F.col("d") < reach)
    inside = F.greatest(F.lit(0), F.least(F.lit(source - 1), F.col("p"))).cast("int")
    taps = taps.groupBy("t", inside.alias("i")).agg(F.sum(F.round(kernel(F.col("d")) * (1 << 20)).cast("bigint")).alias("k"))
    of_target = Window.partitionBy("t")
    total = F.sum("k").over(of_target)
    refused = F.raise_error(F.lit("the kernel's weights must add up to more than 0")).cast("bigint")
    taps = taps.withColumn("total", F.when(total > 0, total).otherwise(refused))
    twice = F.col("k") * (2 << bits) + F.col("total")
    taps = taps.withColumn("f", F.call_function("div", twice - F.pmod(twice, F.col("total") * 2), F.col("total") * 2))
    first = F.row_number().over(of_target.orderBy(F.desc("f"), "i")) == 1
    left = F.when(first, F.lit(1 << bits) - F.sum("f").over(of_target)).otherwise(0)
    return taps.select("t", "i", (F.col("f") + left).alias("w"))


def scale_by_kernel(
    df: DataFrame, width: int, height: int, new_width: int, new_height: int, kernel: Callable[[Column], Column], reach: float,
    *, keys: Sequence[str] = PICTURE,
) -> DataFrame:
    """Scaling of planes of one size by the caller's ``kernel`` (see ``kernel_weights``).

    The weights of a line are one array, as large as a line has taps; those of the rows are joined by line number.
    """
    spark = df.sparkSession
    taps = kernel_weights(spark, width, new_width, kernel, reach).groupBy("t").agg(F.collect_list(F.struct("i", "w")).alias("c"))
    table = taps.agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "c"))), lambda z: z["c"]).alias("c")).scalar()
    zero = F.lit(0).cast("bigint")
    wide = F.transform("__table", lambda c: F.aggregate(c, zero, lambda s, t: s + F.get("px", t["i"]) * t["w"]))
    lines = df.withColumn("__table", table).select(*keys, "line_no", wide.alias("__v"))
    down = kernel_weights(spark, height, new_height, kernel, reach).select("t", F.col("i").cast("bigint").alias("line_no"), "w")
    sent = lines.join(down, "line_no").select(*keys, F.col("t").alias("line_no"), F.transform("__v", lambda v: v * F.col("w")).alias("__v"))
    return _mixed_lines(sent, new_width, keys)


def denoise_fold(limits: tuple[int, int, int]) -> Fold:
    """Blend pictures with their running average, block by block (see ``temporal_denoise``)."""

    def fold(state, cols):
        mean = past = None
        if state:
            shape = tuple(state[0])
            mean = np.frombuffer(base64.b64decode(state[1]), np.uint8).reshape(shape).astype(np.int64)
            past = np.asarray(state[2], dtype=np.int64)
        out = []
        for rows in cols["lines"]:
            cur = np.stack([np.asarray(r) for r in rows]).astype(np.int64)
            h, w = cur.shape[0] // 8, cur.shape[1] // 8
            if mean is None or mean.shape != cur.shape:
                mean, past = np.zeros_like(cur), np.zeros((h, w), dtype=np.int64)
            body = cur[: h * 8, : w * 8]
            ref = mean[: h * 8, : w * 8]
            sse = ((ref - body) ** 2).reshape(h, 8, w, 8).sum(axis=(1, 3))
            up = np.pad(sse, ((1, 0), (0, 0)))[:-1]
            left = np.pad(sse, ((0, 0), (1, 0)))[:, :-1]
            down = np.pad(past, ((0, 1), (0, 0)))[1:]
            right = np.pad(past, ((0, 0), (0, 1)))[:, 1:]
            d = (4 * sse + up + left + right + down + 4) >> 3
            past = sse
            grid = np.kron(d, np.ones((8, 8), dtype=np.int64))
            low, mid, high = limits
            mixed = np.where(
                grid > mid,
                np.where(grid < high, (ref + body + 1) >> 1, body),
                np.where(grid < low, (ref * 7 + body + 4) >> 3, (ref * 3 + body + 2) >> 2),
            )
            res = cur.copy()
            res[: h * 8, : w * 8] = mixed
            mean = mean.copy()
            mean[: h * 8, : w * 8] = mixed
            out.append([r.tolist() for r in res])
        return [list(mean.shape), base64.b64encode(mean.astype(np.uint8).tobytes()).decode(), past.tolist()], {"done": out}

    return fold


def temporal_denoise(
    df: DataFrame, *, limits: tuple[int, int, int] = (700, 1500, 3000), keys: Sequence[str] = ("stream_id", "plane"), order: str = "frame_no",
    rows: int = 256,
) -> DataFrame:
    """Average each 8x8 block with its past, the less it changes the more.

    A block's change is its squared difference to the running average, eased by
    its neighbours: those above and left of this picture, those right and below of
    the last one.  Another picture size starts over.
    """
    # A picture's lines: bounded by its height.
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "px"))), lambda s: s["px"])
    pictures = df.groupBy(*keys, order).agg(lines.alias("lines"))
    folded = fold_stream(pictures, keys, order, ["lines"], denoise_fold(limits), "done array<array<int>>", rows=rows)
    return folded.select(*keys, order, F.posexplode("done").alias("line_no", "px")).withColumn("line_no", F.col("line_no").cast("bigint"))


def rgb_to_yuv(df: DataFrame) -> DataFrame:
    """Full-resolution planes of ``r, g, b`` lines, 16-bit fixed point."""
    def fixed(v: float) -> int:
        return int(v * 65536 + 0.5)

    z = F.arrays_zip("r", "g", "b")
    y = F.transform(z, lambda p: F.shiftright(p["r"] * fixed(0.29900) + p["g"] * fixed(0.58700) + p["b"] * fixed(0.11400) + 32768, 16))
    cb = F.transform(
        z, lambda p: F.shiftright(p["b"] * fixed(0.50000) - p["r"] * fixed(0.16874) - p["g"] * fixed(0.33126) + 32767, 16) + 128
    )
    cr = F.transform(
        z, lambda p: F.shiftright(p["r"] * fixed(0.50000) - p["g"] * fixed(0.41869) - p["b"] * fixed(0.08131) + 32767, 16) + 128
    )
    planes = F.array(*[F.struct(F.lit(n).alias("plane"), c.alias("px")) for n, c in (("Y", y), ("U", cb), ("V", cr))])
    keep = [c for c in df.columns if c not in ("r", "g", "b", "plane")]
    return df.select(*keep, F.inline(planes))


def chroma_420(df: DataFrame, *, keys: Sequence[str] = PICTURE) -> DataFrame:
    """Halve the chroma planes both ways (rounded mean of four); luma passes."""
    return df.filter("plane = 'Y'").select(*keys, "line_no", "px").unionByName(
        shrink(df.filter("plane <> 'Y'"), 2, keys=keys).select(*keys, "line_no", "px")
    )


def expand_chroma(df: DataFrame, *, wide: bool = True, tall: bool = True) -> DataFrame:
    """Repeat chroma pixels and lines: 4:2:0 to 4:2:2 (tall) or 4:4:4 (both)."""
    c = df.filter("plane <> 'Y'")
    if wide:
        c = c.withColumn("px", F.flatten(F.transform("px", lambda p: F.array(p, p))))
    if tall:
        c = c.withColumn("line_no", F.explode(F.array(F.col("line_no") * 2, F.col("line_no") * 2 + 1)))
    return df.filter("plane = 'Y'").unionByName(c.select(df.columns))


def yuv_to_rgb(df: DataFrame, *, keys: Sequence[str] = ("stream_id", "frame_no", "line_no")) -> DataFrame:
    """RGB lines from full-resolution planes of studio range, 16-bit fixed point."""
    plane = lambda n: F.first(F.when(F.col("plane") == n, F.col("px")), ignorenulls=True).alias(n)
    j = df.groupBy(*keys).agg(plane("Y"), plane("U"), plane("V"))
    z = F.arrays_zip("Y", "U", "V")
    luma = lambda p: (p["Y"] - 16) * 76309
    mix = lambda f: F.transform(z, lambda p: _clip(F.shiftright(f(p) + 32768, 16)))
    return j.select(
        *keys,
        mix(lambda p: luma(p) + (p["V"] - 128) * 104597).alias("r"),
        mix(lambda p: luma(p) - (p["U"] - 128) * 25675 - (p["V"] - 128) * 53279).alias("g"),
        mix(lambda p: luma(p) + (p["U"] - 128) * 132201).alias("b"),
    )


def map_lines(df: DataFrame, fn, *, planes: Sequence[str] | None = None) -> DataFrame:
    """Run a numpy function over each line of the chosen planes (Arrow batches)."""

    @F.pandas_udf("array<int>")
    def call(px: pd.Series) -> pd.Series:
        return px.map(lambda v: np.asarray(fn(np.asarray(v)), dtype=np.int32))

    done = call("px")
    if planes is None:
        return df.withColumn("px", done)
    chosen = df.filter(F.col("plane").isin(list(planes))).withColumn("px", done)
    return chosen.unionByName(df.filter(~F.col("plane").isin(list(planes))))


def map_fields(
    df: DataFrame, fn, *, buffered: int, delay: int = 0, keys: Sequence[str] = LINE, order: str = "field_no", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Run a numpy function over a line of ``buffered`` fields in a row.

    ``fn`` gets an array (fields, pixels), newest first; the newest is ``delay``
    fields ahead of the row.  Rows without a full buffer keep their own pixels.
    """
    def stack(w):
        parts = [F.lead("px", delay - k).over(w) if delay > k else F.lag("px", k - delay).over(w) if k > delay else F.col("px") for k in range(buffered)]
        return F.array(*parts)

    out = neighbours(df, keys, order, max(buffered - 1 - delay, 0), delay, {"__st": stack}, rows=rows)

    @F.pandas_udf("array<int>")
    def call(st: pd.Series) -> pd.Series:
        return st.map(lambda v: np.asarray(fn(np.stack(list(v))), dtype=np.int32))

    full = F.forall("__st", lambda p: p.isNotNull())
    ready = out.filter(full).withColumn("px", call("__st"))
    return ready.unionByName(out.filter(~full)).drop("__st")
