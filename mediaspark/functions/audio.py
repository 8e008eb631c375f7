"""Sample conversion, quantising, channel layouts and mixing (column expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("u8", "s16", "s32", "flt", "dbl")
_BITS = {"u8": 8, "s16": 16, "s32": 32}


def convert_sample(x: Column, source: str, target: str) -> Column:
    """One sample between 8/16/32-bit integers and floats.

    Values are not clipped; a float outside [-1, 1) therefore leaves the range.
    """
    if source not in FORMATS or target not in FORMATS:
        raise ValueError(f"formats are {FORMATS}")
    if source in ("flt", "dbl"):
        if target in ("flt", "dbl"):
            return x.cast("float" if target == "flt" else "double")
        scaled = F.rint(x.cast("double") * float(1 << (_BITS[target] - 1))).cast("bigint")
        return scaled + 128 if target == "u8" else scaled
    signed = x.cast("bigint") - 128 if source == "u8" else x.cast("bigint")
    if target in ("flt", "dbl"):
        return (signed * F.lit(1.0 / (1 << (_BITS[source] - 1)))).cast("float" if target == "flt" else "double")
    shift = _BITS[target] - _BITS[source]
    moved = F.shiftleft(signed, shift) if shift >= 0 else F.shiftright(signed, -shift)
    return moved + 128 if target == "u8" else moved


def clip_bits(x: Column, bits: int) -> Column:
    top = 1 << (bits - 1)
    return F.least(F.lit(top - 1), F.greatest(F.lit(-top), x))


def quantise(x: Column, source_bits: int, target: str, noise: Column | None = None) -> Column:
    """Clip an integer sample and bring it to 16, 24, 32 bits or a float.

    ``noise`` (dither, scaled to 32 bits) is added before a 16-bit result is clipped.
    """
    x = x.cast("bigint")
    if target == "16":
        if noise is not None:
            x = x + F.shiftright(noise.cast("bigint"), 32 - source_bits)
        return F.shiftright(clip_bits(x, source_bits), source_bits - 16)
    if target == "24":
        return F.shiftright(clip_bits(x, source_bits), source_bits - 24) if source_bits >= 24 else F.shiftleft(clip_bits(x, source_bits), 24 - source_bits)
    if target == "32":
        return F.shiftleft(clip_bits(x, source_bits), 32 - source_bits)
    if target == "float":
        return clip_bits(x, source_bits) / F.lit(float(1 << (source_bits - 1)))
    raise ValueError("target must be 16, 24, 32 or float")


def dithered(df: DataFrame, dither: DataFrame, slots: int, *, order: str = "sample_no") -> DataFrame:
    """Add ``noise`` from a table ``(slot, noise)`` used round and round."""
    j = df.withColumn("slot", F.pmod(F.col(order), F.lit(slots)))
    return j.join(dither, "slot", "left").drop("slot")


# Speaker bits in mask order (fixed values).
CHANNELS = (
    "FL", "FR", "FC", "LFE", "BL", "BR", "FLC", "FRC", "BC", "SL", "SR", "TC", "TFL", "TFC", "TFR", "TBL", "TBC", "TBR",
)
_DL = (1 << 29) | (1 << 30)


def _mask(*names: str) -> int:
    return sum(1 << CHANNELS.index(n) for n in names)


_SURROUND = _mask("FL", "FR", "FC")
_FIVE = _SURROUND | _mask("SL", "SR")
_FIVE_ONE = _FIVE | _mask("LFE")
_SEVEN_ONE = _FIVE_ONE | _mask("BL", "BR")
# Layout names with channel counts and masks (fixed values).
LAYOUTS = (
    ("mono", 1, _mask("FC")),
    ("stereo", 2, _mask("FL", "FR")),
    ("4.0", 4, _SURROUND | _mask("BC")),
    ("quad", 4, _mask("FL", "FR", "BL", "BR")),
    ("5.0", 5, _FIVE),
    ("5.0", 5, _SURROUND | _mask("BL", "BR")),
    ("5.1", 6, _FIVE_ONE),
    ("5.1", 6, _SURROUND | _mask("BL", "BR", "LFE")),
    ("5.1+downmix", 8, _FIVE_ONE | _DL),
    ("7.1", 8, _SEVEN_ONE),
    ("7.1(wide)", 8, _FIVE_ONE | _mask("FLC", "FRC")),
    ("7.1+downmix", 10, _SEVEN_ONE | _DL),
)
_GUESS = {1: _mask("FC"), 2: _mask("FL", "FR"), 3: _SURROUND, 4: _mask("FL", "FR", "BL", "BR"), 5: _FIVE, 6: _FIVE_ONE, 8: _SEVEN_ONE}


def layout_channels(mask: Column) -> Column:
    return F.bit_count(mask)


def default_layout(channels: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for n, m in _GUESS.items():
        out = F.when(channels == n, F.lit(m).cast("bigint")).otherwise(out)
    return out


def layout_name(channels: Column, mask: Column) -> Column:
    """Known layout name, else the channel count and the speakers."""
    known = F.lit(None).cast("string")
    for name, n, m in reversed(LAYOUTS):
        known = F.when((channels == n) & (mask == m), F.lit(name)).otherwise(known)
    names = [*CHANNELS, *[None] * (29 - len(CHANNELS)), "DL", "DR"]
    parts = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names) if n]
    speakers = F.concat_ws("|", *parts)
    other = F.concat(channels.cast("string"), F.lit(" channels"), F.when(mask != 0, F.concat(F.lit(" ("), speakers, F.lit(")"))).otherwise(""))
    return F.coalesce(known, other)


def mix(ch: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """Output channels as weighted sums of the input channels."""
    outs = []
    for row in matrix:
        weights = F.array(*[F.lit(float(w)) for w in row])
        terms = F.zip_with(ch, weights, lambda a, w: a * w)
        outs.append(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))
    return F.array(*outs)


def reorder(ch: Column, order: Sequence[int]) -> Column:
    return F.array(*[F.get(ch, i) for i in order])


def stereo_to_mono(ch: Column) -> Column:
    return F.array(F.shiftright(F.get(ch, 0) + F.get(ch, 1), 1))


def mono_to_stereo(ch: Column) -> Column:
    return F.array(F.get(ch, 0), F.get(ch, 0))


def stereo_to_51(ch: Column) -> Column:
    """Left, centre (half of each), right; the other three are silent."""
    half = lambda c: F.call_function("div", c, F.lit(2)).cast("int")
    l, r = F.get(ch, 0), F.get(ch, 1)
    zero = F.lit(0)
    return F.array(l, half(l) + half(r), r, zero, zero, zero)


def downmix_matrix(mode: str, *, centre: float = 2**-0.5, surround: float = 0.5) -> list[list[float]]:
    """Levels for L, C, R, SL, SR brought to fewer channels."""
    half = 2**-0.5
    rows = {
        "mono": [[half, 2 * half * centre, half, half * surround, half * surround]],
        "stereo": [[1.0, centre, 0.0, surround, 0.0], [0.0, centre, 1.0, 0.0, surround]],
        "dolby": [[1.0, half, 0.0, -half, -half], [0.0, half, 1.0, half, half]],
        "3/0": [[1.0, 0.0, 0.0, surround, 0.0], [0.0, 1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0, surround]],
        "2/2": [
            [1.0, centre, 0.0, 0.0, 0.0], [0.0, centre, 1.0, 0.0, 0.0],
            [0.0, 0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 0.0, 1.0],
        ],
    }
    if mode not in rows:
        raise ValueError(f"mode must be one of {sorted(rows)}")
    return rows[mode]
