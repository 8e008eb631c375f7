"""Deterministic test signals, made in parallel from row numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.operators.scan import CHUNK_ROWS, running

FRAC = 16
ONE = 1 << FRAC
_TABLE_BITS = 7
_SHIFT = FRAC - _TABLE_BITS - 2
#: A quarter wave in steps of pi/256, 15 bits, with one step to spare.
_COS = [round(32768 * math.cos(i * math.pi / 256)) if i <= 128 else 0 for i in range(130)]


def int_cos(a: Column) -> Column:
    """Cosine of a phase in 1/65536 turns, 16-bit fixed point, from a table."""
    a = a.bitwiseAND(F.lit(ONE - 1))
    a = F.when(a >= ONE // 2, ONE - a).otherwise(a)
    far = a > ONE // 4
    a = F.when(far, ONE // 2 - a).otherwise(a).cast("int")
    table = F.array(*[F.lit(v) for v in _COS])
    i = F.shiftright(a, _SHIFT)
    low, high = F.get(table, i), F.get(table, i + 1)
    part = a.bitwiseAND(F.lit((1 << _SHIFT) - 1))
    v = low + F.shiftright((high - low) * part + (1 << (_SHIFT - 1)), _SHIFT)
    return F.when(far, -v).otherwise(v) * (1 << (FRAC - 15))


def _samples(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "sample_no")


def gen_tone(spark: SparkSession, n: int, *, freq: int = 1000, rate: int = 44100, amp: int = 10000) -> DataFrame:
    step = freq * ONE // rate
    return _samples(spark, n).withColumn("x", F.shiftright(int_cos(F.col("sample_no") * step) * amp, FRAC).cast("int"))


def gen_chirp(
    spark: SparkSession, n: int, *, low: int = 100, high: int = 10000, rate: int = 44100, amp: int = 10000, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Rising tone; the phase is a running sum of the frequency."""
    f = F.lit(low) + F.expr(f"(sample_no * {high - low}) div {rate}")
    step = F.call_function("div", f * ONE, F.lit(rate))
    out = running(_samples(spark, n).withColumn("__d", step), [], "sample_no", {"__a": ("sum", F.col("__d"))}, include_current=False, rows=rows)
    return out.select("sample_no", F.shiftright(int_cos(F.coalesce("__a", F.lit(0))) * amp, FRAC).cast("int").alias("x"))


def gen_ramp(spark: SparkSession, n: int, start_freq: int, end_freq: int, **kw) -> DataFrame:
    """A tone that glides between two frequencies."""
    return gen_chirp(spark, n, low=start_freq, high=end_freq, **kw)


def gen_am(spark: SparkSession, n: int, *, channel: int = 0, freq: int = 500, mod: int = 2, rate: int = 44100) -> DataFrame:
    """Tone of changing volume; odd channels get the opposite volume.

    Both phases advance once per channel of a stereo sample.
    """
    i = F.col("sample_no") * 2 + channel
    amp = F.shiftright((int_cos(i * (mod * ONE // rate)) + ONE) * 5000, FRAC)
    amp = F.lit(10000) - amp if channel % 2 else amp
    return _samples(spark, n).withColumn("x", F.shiftright(int_cos(i * (freq * ONE // rate)) * amp, FRAC).cast("int"))


_MUL, _MOD = 314159, 1 << 32


def _jump(seed: int, k: int) -> int:
    """State of the generator after ``k`` steps of ``s * 314159 + 1``."""
    mul, add, m, c = 1, 0, _MUL, 1
    while k:
        if k & 1:
            mul, add = mul * m % _MOD, (add * m + c) % _MOD
        m, c = m * m % _MOD, (c * m + c) % _MOD
        k >>= 1
    return (seed * mul + add) % _MOD


def gen_noise(spark: SparkSession, n: int, *, span: int = 20000, seed: int = 1) -> DataFrame:
    """White noise of a linear congruential generator; each batch jumps to its place."""

    def run(batches):
        for b in batches:
            ids = b["id"].to_numpy()
            out = np.empty(len(ids), dtype=np.int64)
            s, at = 0, -2
            for j, i in enumerate(ids):
                s = (s * _MUL + 1) % _MOD if i == at + 1 else _jump(seed, int(i) + 1)
                at = i
                out[j] = (s >> 24 if span == 256 else s % span) - span // 2
            yield pd.DataFrame({"sample_no": ids, "x": out.astype(np.int32)})

    return spark.range(n).mapInPandas(run, "sample_no bigint, x int")


def gen_pattern(spark: SparkSession, frames: int, width: int, height: int) -> DataFrame:
    """Luma ramps that move one pixel per frame."""
    f = spark.range(frames * height).select(
        F.expr(f"id div {height}").alias("frame_no"), F.lit("Y").alias("plane"), (F.col("id") % height).alias("line_no")
    )
    px = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: ((x + F.col("line_no") + F.col("frame_no")) % 256).cast("int"))
    return f.withColumn("px", px)


def gen_cadence(spark: SparkSession, streams: int, fields: int, *, kind: str = "32") -> DataFrame:
    """Fields of clean film: 3:2 or 2:2 hints in order, phase by stream."""
    cycle = ["AFTERNEXT_32", "NEXT_32", "PREV_32", "NEXT_22", "PREV_22"] if kind == "32" else ["NEXT_22", "PREV_22"]
    r = spark.range(streams * fields).select(F.expr(f"id div {fields}").alias("stream_id"), (F.col("id") % fields).alias("field_no"))
    at = ((F.col("stream_id") + F.col("field_no")) % len(cycle) + 1).cast("int")
    return r.withColumn("is_top", F.col("field_no") % 2 == 0).withColumn("hint", F.element_at(F.array(*[F.lit(c) for c in cycle]), at))


def gen_null(spark: SparkSession, schema: str) -> DataFrame:
    """A source without rows."""
    return spark.createDataFrame([], schema)
