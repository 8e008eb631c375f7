"""Picture geometry, pixel formats and format choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.functions.timebase import gcd

# Pixel formats (fixed values): name, channels, depth, colour, alpha, layout,
# log2 of chroma width and height, bits per pixel where packed unevenly.
PIXEL_FORMATS = (
    ("yuv420p", 3, 8, "yuv", False, "planar", 1, 1, None),
    ("yuyv422", 1, 8, "yuv", False, "packed", 1, 0, 16),
    ("rgb24", 3, 8, "rgb", False, "packed", 0, 0, None),
    ("bgr24", 3, 8, "rgb", False, "packed", 0, 0, None),
    ("yuv422p", 3, 8, "yuv", False, "planar", 1, 0, None),
    ("yuv444p", 3, 8, "yuv", False, "planar", 0, 0, None),
    ("yuv410p", 3, 8, "yuv", False, "planar", 2, 2, None),
    ("yuv411p", 3, 8, "yuv", False, "planar", 2, 0, None),
    ("gray", 1, 8, "gray", False, "planar", 0, 0, None),
    ("pal8", 4, 8, "rgb", True, "palette", 0, 0, None),
    ("yuvj420p", 3, 8, "yuvj", False, "planar", 1, 1, None),
    ("yuva420p", 4, 8, "yuv", True, "planar", 1, 1, None),
    ("rgba", 4, 8, "rgb", True, "packed", 0, 0, None),
    ("rgb565le", 3, 5, "rgb", False, "packed", 0, 0, 16),
    ("rgb555le", 3, 5, "rgb", False, "packed", 0, 0, 16),
)


def _bits(f) -> int:
    name, channels, depth, _, _, layout, cw, ch, packed = f
    if layout == "palette":
        return 8
    if packed:
        return packed
    if layout == "planar" and (cw or ch):
        return depth + ((2 * depth) >> (cw + ch))
    return depth * channels


#: Colour families that a family can hold without loss of colour (fixed values).
_HOLDS = {"rgb": ("rgb", "gray"), "gray": ("gray",), "yuv": ("yuv",), "yuvj": ("yuvj", "yuv", "gray")}
#: Bits of the finest channel where channels differ in depth (fixed values).
_FINEST = {"rgb565le": 6}


def _properties(f) -> dict[str, object]:
    name, _, depth, family, alpha, layout, cw, ch, _ = f
    return {
        "depth": (depth, _FINEST.get(name, depth)), "resolution": (-cw, -ch), "colorspace": family, "chroma": family != "gray",
        "alpha": alpha, "colorquant": layout != "palette" and family != "gray",
    }


def _loss(dst, src, alpha: bool) -> set[str]:
    """The properties of the source that the candidate doesn't keep: each compared by its own kind."""
    have, want = _properties(dst), _properties(src)
    if not alpha:
        want["alpha"] = False
    if dst[5] != "palette":
        want["colorquant"] = False
    kept = {
        tuple: lambda h, w: all(x >= y for x, y in zip(h, w, strict=True)),
        bool: lambda h, w: h or not w,
        str: lambda h, w: w in _HOLDS[h],
    }
    return {p for p, w in want.items() if not kept[type(w)](have[p], w)}


# What may be lost, in the order it is tried (fixed values).
_FORGIVEN = (
    set(), {"alpha"}, {"resolution"}, {"colorspace", "resolution"}, {"colorquant"}, {"depth"},
    {"alpha", "resolution", "colorspace", "colorquant", "depth", "chroma"},
)


def loss_table(alpha: bool = False) -> list[tuple[str, str, int, int]]:
    """(source, candidate, rank of the loss, bits per pixel) for all pairs."""
    rows = []
    for src in PIXEL_FORMATS:
        for dst in PIXEL_FORMATS:
            lost = _loss(dst, src, alpha)
            rank = next(i for i, ok in enumerate(_FORGIVEN) if lost <= ok)
            rows.append((src[0], dst[0], rank, _bits(dst)))
    return rows


def best_format(candidates: Column, source: Column, *, alpha: bool = False) -> Column:
    """The candidate that loses least, then the one with fewest bits per pixel.

    The pairs make a constant map; nothing is joined.
    """
    order = {f[0]: i for i, f in enumerate(PIXEL_FORMATS)}
    pairs = [F.lit(x) for s, d, rank, bits in loss_table(alpha) for x in (f"{s}>{d}", rank * 10_000 + bits * 100 + order[d])]
    table = F.create_map(*pairs)
    scored = F.transform(
        candidates, lambda c: F.struct(F.try_element_at(table, F.concat(source, F.lit(">"), c)).alias("s"), c.alias("c"))
    )
    return F.array_min(F.filter(scored, lambda x: x["s"].isNotNull()))["c"]


def common_formats(a: Column, b: Column) -> Column:
    """Formats both sides support, in the left side's order; null when there are none."""
    both = F.array_intersect(a, b)
    return F.when(F.size(both) > 0, both)


def picture_size(fmt: Column, width: Column, height: Column) -> Column:
    """Bytes of a picture; chroma planes are rounded up."""
    out = F.lit(None).cast("bigint")
    for f in reversed(PIXEL_FORMATS):
        name, channels, depth, colour, alpha, layout, cw, ch, packed = f
        w, h = width.cast("bigint"), height.cast("bigint")
        if layout == "palette":
            size = w * h + 256 * 4
        elif layout == "planar":
            size = w * h
            if colour != "gray":
                part = lambda v, s: F.call_function("div", v + F.lit((1 << s) - 1), F.lit(1 << s))
                size = size + part(w, cw) * part(h, ch) * 2
            if alpha:
                size = size + w * h
        else:
            size = w * h * (_bits(f) // 8)
        out = F.when(fmt == name, size).otherwise(out)
    return out


# ---------------------------------------------------------- display geometry

# Crops by coded shape, active format and display preference (fixed values):
# (shape, code, preference) -> list of (box, coded share, kept share, from the top).
AFD_RULES = {
    ("4:3", 2, "16:9"): [("letter", 4, 3, True)],
    ("4:3", 3, "16:9"): [("letter", 7, 6, True)],
    ("4:3", 4, "16:9"): [("letter", 4, 3, False)],
    ("4:3", 10, "16:9"): [("letter", 4, 3, False)],
    ("4:3", 11, "16:9"): [("letter", 7, 6, False)],
    ("4:3", 13, "16:9"): [("letter", 7, 6, False)],
    ("4:3", 14, "16:9"): [("letter", 4, 3, False)],
    ("4:3", 15, "16:9"): [("letter", 4, 3, False)],
    ("16:9", 2, "cut"): [("pillar", 4, 3, False)],
    ("16:9", 3, "cut"): [("pillar", 4, 3, False)],
    ("16:9", 3, "letterbox"): [("pillar", 7, 6, False)],
    ("16:9", 4, "cut"): [("pillar", 4, 3, False)],
    ("16:9", 8, "cut"): [("pillar", 4, 3, False)],
    ("16:9", 9, "cut"): [("pillar", 4, 3, False)],
    ("16:9", 9, "letterbox"): [("pillar", 4, 3, False)],
    ("16:9", 10, "cut"): [("pillar", 4, 3, False)],
    ("16:9", 11, "cut"): [("pillar", 7, 6, False)],
    ("16:9", 11, "letterbox"): [("pillar", 7, 6, False)],
    ("16:9", 13, "cut"): [("pillar", 4, 3, False)],
    ("16:9", 13, "letterbox"): [("pillar", 4, 3, False)],
    ("16:9", 13, "16:9"): [("pillar", 4, 3, False), ("letter", 7, 6, False)],
    ("16:9", 14, "cut"): [("pillar", 4, 3, False)],
    ("16:9", 14, "letterbox"): [("pillar", 7, 6, False)],
    ("16:9", 15, "cut"): [("pillar", 4, 3, False)],
    ("16:9", 15, "letterbox"): [("pillar", 4, 3, False)],
}
PREFERENCES = ("16:9", "cut", "letterbox")


def display_geometry(df: DataFrame, preference: str, *, analog_blanking: bool = False) -> DataFrame:
    """Crop and aspect of pictures: ``width, height, pixel_x, pixel_y, afd`` in.

    Out come ``out_width, out_height, offset_x, offset_y, aspect_x, aspect_y``.
    Crops are aligned down to 4.
    """
    if preference not in PREFERENCES:
        raise ValueError(f"preference must be one of {PREFERENCES}")
    div = lambda a, b: F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))
    down4 = lambda v: div(v, 4) * 4
    w, h = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    blank = {720: (704, 8), 544: (532, 6)} if analog_blanking else {}
    ow, ox = w, F.lit(0).cast("bigint")
    for full, (kept, off) in blank.items():
        ow = F.when(w == full, kept).otherwise(ow)
        ox = F.when(w == full, off).otherwise(ox)
    out = df.withColumn("__h", F.when(h == 1088, 1080).otherwise(h)).withColumn("__w", ow).withColumn("__x", ox)
    out = out.withColumn("__g", gcd(F.col("pixel_x").cast("bigint"), F.col("pixel_y").cast("bigint")))
    ax = div(F.col("pixel_x").cast("bigint"), F.col("__g")) * F.col("__w")
    ay = div(F.col("pixel_y").cast("bigint"), F.col("__g")) * F.least(F.col("__h"), F.lit(1080))
    out = out.withColumn("__ax", ax).withColumn("__ay", ay).withColumn("__g", gcd(F.col("__ax"), F.col("__ay")))
    out = out.withColumn("__ax", div(F.col("__ax"), F.col("__g"))).withColumn("__ay", div(F.col("__ay"), F.col("__g")))
    out = out.withColumn("__shape", F.when(div(F.col("__ax") * 100, F.col("__ay")) < 144, "4:3").otherwise("16:9"))

    names = ("out_width", "out_height", "offset_x", "offset_y", "adjust_x", "adjust_y")
    plain = (F.col("__w"), F.col("__h"), F.col("__x"), F.lit(0), F.lit(1), F.lit(1))
    cols = dict(zip(names, plain))
    for (shape, code, pref), boxes in AFD_RULES.items():
        if pref != preference:
            continue
        v = dict(zip(names, plain))
        for box, coded, kept, top in boxes:
            if box == "letter":
                cut = down4(div(v["out_height"] * kept, coded))
                if not top:
                    v["offset_y"] = v["offset_y"] + div(v["out_height"] - cut, 2)
                v["out_height"], v["adjust_x"], v["adjust_y"] = cut, F.lit(coded), F.lit(kept)
            else:
                cut = down4(div(v["out_width"] * kept, coded))
                v["offset_x"] = v["offset_x"] + div(v["out_width"] - cut, 2)
                v["out_width"], v["adjust_x"], v["adjust_y"] = cut, F.lit(kept), F.lit(coded)
        hit = (F.col("__shape") == shape) & (F.col("afd") == code)
        for n in names:
            cols[n] = F.when(hit, v[n]).otherwise(cols[n])
    out = out.select("*", *[cols[n].cast("bigint").alias(n) for n in names])
    return (
        out.withColumn("aspect_x", F.col("__ax") * F.col("adjust_x")).withColumn("aspect_y", F.col("__ay") * F.col("adjust_y"))
        .drop("__h", "__w", "__x", "__g", "__ax", "__ay", "__shape", "adjust_x", "adjust_y")
    )


def scaled_size(width: Column, height: Column, w: int, h: int) -> tuple[Column, Column]:
    """Target size of a scaler: 0 keeps a side, -1 keeps the aspect."""
    if w == -1 and h == -1:
        w = h = 0
    ww = F.lit(w) if w else width
    hh = F.lit(h) if h else height
    near = lambda a, b, c: F.floor((a * b + F.floor(c / 2)) / c)
    if w == -1:
        ww = near(hh, width, height)
    if h == -1:
        hh = near(ww, height, width)
    return ww.cast("int"), hh.cast("int")
