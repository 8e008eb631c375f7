"""Filters over long sample streams, cut into blocks with copied edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.operators.scan import CHUNK_ROWS, neighbours, with_halo


def decimate2(df: DataFrame, *, keys: Sequence[str] = ("stream_id",), order: str = "sample_no", value: str = "x", rows: int = CHUNK_ROWS) -> DataFrame:
    """Half the rate after a (1 2 1)/4 low pass; the sample before the first is 0."""
    cols = {"__a": lambda w: F.coalesce(F.lag(value).over(w), F.lit(0)), "__b": lambda w: F.lead(value).over(w)}
    out = neighbours(df, keys, order, 1, 1, cols, rows=rows)
    out = out.filter((F.pmod(F.col(order), F.lit(2)) == 0) & F.col("__b").isNotNull())
    y = F.shiftright(F.col("__a") + F.col(value) * 2 + F.col("__b"), 2)
    return out.select(*keys, F.expr(f"`{order}` div 2").alias(order), y.alias(value))


def filter_bank(factor: float, taps: int, phases: int, scale: int, kind: int) -> np.ndarray:
    """Windowed-sinc (or cubic) coefficients, one row per phase and one to spare.

    ``kind`` 0 is cubic, 1 Blackman-Nuttall, from 2 a Kaiser window of that beta.
    The spare row is phase 0 one sample on, for blending two phases.
    """
    factor = min(factor, 1.0)
    centre = (taps - 1) // 2
    ph = np.arange(phases)[:, None] / phases
    at = (np.arange(taps)[None, :] - centre - ph) * factor
    if kind == 0:
        a = np.abs(at)
        d = -0.5
        inner = 1 - 3 * a**2 + 2 * a**3 + d * (a**3 - a**2)
        outer = d * (-4 + 8 * a - 5 * a**2 + a**3)
        tab = np.where(a < 1.0, inner, outer)
    else:
        tab = np.sinc(at)
        if kind == 1:
            w = 2.0 * math.pi * at / (factor * taps) + math.pi
            # Blackman-Nuttall terms (fixed values).
            tab = tab * (0.3635819 - 0.4891775 * np.cos(w) + 0.1365995 * np.cos(2 * w) - 0.0106411 * np.cos(3 * w))
        else:
            w = 2.0 * at / (factor * taps)
            tab = tab * np.i0(kind * np.sqrt(np.maximum(1 - w * w, 0)))
    tab = tab / tab.sum(axis=1, keepdims=True)
    bank = np.clip(np.rint(tab * scale), -32768, 32767).astype(np.int64)
    spare = np.concatenate([[bank[0, -1]], bank[0, :-1]])
    return np.vstack([bank, spare])


def resample(
    df: DataFrame, in_rate: int, out_rate: int, *, taps: int = 16, phase_shift: int = 10, kind: int = 9, linear: bool = False,
    cutoff: float = 0.8, keys: Sequence[str] = ("stream_id",), order: str = "sample_no", value: str = "x", rows: int = 1 << 16,
) -> DataFrame:
    """16-bit samples at another rate through a polyphase filter.

    An output belongs to the block in which its first tap lies; the taps beyond a
    block's end are copied in.  Ahead of the first sample the input is mirrored,
    and outputs end when a tap would lie behind the last sample.
    """
    factor = min(out_rate * cutoff / in_rate, 1.0)
    length = max(math.ceil(taps / factor), 1)
    phases = 1 << phase_shift
    bank = filter_bank(factor, length, phases, 1 << 15, kind)
    first = -phases * ((length - 1) // 2)
    step = in_rate * phases
    rows = max(rows, length + 1)

    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    cut = with_halo(df.select(*keys, order, F.col(value).alias("__x")), order, 0, length - 1, rows=rows).join(size, list(keys))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf["__x"].to_numpy().astype(np.int64)
        base = int(pdf[order].iloc[0])
        total = int(pdf["__n"].iloc[0])
        chunk = int(pdf["__chunk"].iloc[0])
        low, high = chunk * rows, (chunk + 1) * rows
        # Outputs whose position starts in [low, high); negative ones go to block 0.
        at = lambda j: first + (j * step) // out_rate
        j0 = 0 if chunk == 0 else max(0, ((low * phases - first) * out_rate) // step - 2)
        j1 = max(0, ((high * phases - first) * out_rate) // step + 2)
        j = np.arange(j0, j1 + 1, dtype=np.int64)
        pos = at(j)
        idx = pos >> phase_shift
        mine = (idx < high) & ((idx >= low) | (chunk == 0)) & ((idx < 0) | (idx + length <= total))
        j, pos, idx = j[mine], pos[mine], idx[mine]
        taps_at = idx[:, None] + np.arange(length)[None, :]
        taps_at = np.where(idx[:, None] < 0, np.abs(taps_at) % total, taps_at) - base
        got = x[taps_at] if len(j) else np.zeros((0, length), dtype=np.int64)
        ph = pos & (phases - 1)
        val = (got * bank[ph]).sum(axis=1)
        if linear:
            v2 = (got * bank[ph + 1]).sum(axis=1)
            frac = (j * step) % out_rate
            blend = np.trunc((v2 - val) * frac / out_rate).astype(np.int64)
            val = np.where(idx < 0, val, val + blend)
        val = np.clip((val + (1 << 14)) >> 15, -32768, 32767)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(j) for k in keys})
        out[order] = j
        out[value] = val.astype(np.int32)
        return out

    return cut.groupBy(*keys, "__chunk").applyInPandas(run, f"{schema}, `{order}` bigint, `{value}` int")


def convolve(
    df: DataFrame, impulse: Sequence[float], *, wet: float = 1.0, attenuation_db: float = 0.0, keys: Sequence[str] = ("stream_id",),
    order: str = "sample_no", value: str = "x", rows: int = 1 << 16,
) -> DataFrame:
    """FIR convolution, mixed with the dry signal and attenuated."""
    h = np.asarray(impulse, dtype=np.float64)
    gain = 10.0 ** (-attenuation_db / 20.0)
    cut = with_halo(df.select(*keys, order, F.col(value).alias("__x")), order, len(h) - 1, 0, rows=rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in (*keys, order))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf["__x"].to_numpy().astype(np.float64)
        y = np.convolve(x, h)[: len(x)]
        out = pdf[[*keys, order]].copy()
        out[value] = gain * (wet * y + (1.0 - wet) * x)
        return out[pdf["__own"].to_numpy()]

    return cut.groupBy(*keys, "__chunk").applyInPandas(run, f"{schema}, `{value}` double")


# Sync words of coded audio, as bytes in stream order (fixed values).
DTS_SYNCS = (b"\xff\x1f\x00\xe8", b"\x1f\xff\xe8\x00", b"\xfe\x7f\x01\x80", b"\x7f\xfe\x80\x01")
BURST = b"\x72\xf8\x1f\x4e"


def classify_block(data: bytes) -> str:
    """Type of one audio block: DTS, AC3, SILENCE or PCM."""
    for sync in DTS_SYNCS:
        at = data.find(sync)
        while at >= 0:
            if at % 4 == 0:
                return "DTS"
            at = data.find(sync, at + 1)
    at = data.find(BURST)
    while at >= 0:
        if at % 2 == 0 and len(data) >= at + 6:
            kind = int.from_bytes(data[at + 4 : at + 6], "little")
            return {1: "AC3", 11: "DTS"}.get(kind, "SILENCE")
        at = data.find(BURST, at + 1)
    return "PCM"


def classify_audio(df: DataFrame, *, data: str = "data") -> DataFrame:
    """Type of each audio block by its sync patterns."""

    @F.pandas_udf("string")
    def classify(s: pd.Series) -> pd.Series:
        return s.map(lambda b: classify_block(bytes(b)) if b is not None else None)

    return df.withColumn("audio_type", classify(data))


def stream_audio_type(blocks: DataFrame, *, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Most frequent block type per stream (alphabetical on a tie)."""
    n = blocks.groupBy(*keys, "audio_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min_by("audio_type", F.struct((-F.col("n")).alias("c"), F.col("audio_type").alias("t"))).alias("audio_type"))


def map_blocks(df: DataFrame, fn, schema: str) -> DataFrame:
    """Run a pandas function over batches of audio blocks."""

    def run(batches):
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)
