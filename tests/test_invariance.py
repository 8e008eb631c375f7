"""Chunk size and partitioning never change a result; one stream holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from mediaspark.operators import audio as A
from mediaspark.operators import cues as C
from mediaspark.operators import fields as E
from mediaspark.operators import lines as L
from mediaspark.operators import packets as P
from mediaspark.operators import stats as S
from mediaspark.operators import transport as T


@pytest.fixture(scope="module")
def packets(spark):
    rng = random.Random(9)
    rows, t = [], 0
    for i in range(180):
        t += rng.randint(-20, 90)
        rows.append((
            0 if rng.random() < 0.7 else rng.randint(1, 4), rng.randint(0, 1), i + 1, rng.choice([None, t]), rng.choice([None, t + rng.randint(-5, 60)]),
            rng.randint(0, 900), rng.random() < 0.2, rng.random() < 0.1, rng.choice([20, 40]), rng.randint(1, 31), rng.randint(0, 60), rng.choice("IPB"),
        ))
    cols = "stream_id bigint, stream_index int, seq bigint, dts bigint, pts bigint, size bigint, is_key boolean, disc boolean, duration bigint, q int, variance bigint, pict_type string"
    return spark.createDataFrame(rows, cols).repartition(7).cache()


@pytest.fixture(scope="module")
def dense(spark):
    rng = random.Random(10)
    rows, at = [], {0: 0, 1: 0}
    for _ in range(150):
        k = 0 if rng.random() < 0.8 else 1
        rows.append((k, at[k], rng.choice([2, 3]), rng.random() < 0.7, rng.random() < 0.5, rng.choice([None, at[k] * 1000]), rng.choice("IPB"), rng.randint(1, 31), rng.randint(-900, 900)))
        at[k] += 1
    cols = "stream_id bigint, frame_no bigint, nb_fields int, progressive boolean, tff boolean, rt_start bigint, pict_type string, q int, x int"
    return spark.createDataFrame(rows, cols).repartition(5).cache()


PACKETS = {
    "time_slice": lambda p, r: P.time_slice(p, 300, 3000, rows=r),
    "wait_for_key": lambda p, r: P.wait_for_key(p, rows=r),
    "cap": lambda p, r: P.cap(p.filter("dts IS NOT NULL"), max_frames=40, max_bytes=30000, shortest=True, rows=r),
    "repair": lambda p, r: P.repair_timestamps(p, rows=r),
    "backfill": lambda p, r: P.backfill_initial(p, rows=r),
    "validate": lambda p, r: P.validate_mux(p, rows=r),
    "discontinuity": lambda p, r: P.fix_discontinuity(p.filter("dts IS NOT NULL"), 60, duration=F.col("duration"), rows=r),
    "frame_stats": lambda p, r: P.frame_stats(p.filter("dts IS NOT NULL").withColumn("o", F.lit(0)), fps=25.0, origin="o", rows=r),
    "interleave": lambda p, r: P.interleave(p),
    "delta_gcd": lambda p, r: S.delta_gcd(p, rows=r),
    "halve_index": lambda p, r: S.halve_index(p, 20, rows=r),
    "thin_index": lambda p, r: S.thin_index(p, 20, rows=r),
    "continuity": lambda p, r: T.ts_continuity(p.withColumn("cc", F.col("size") % 16), keys=["stream_id"], order="seq", rows=r),
    "cues": lambda p, r: C.close_open_cues(p.select("stream_id", "seq", F.col("dts").alias("start"), F.col("size").cast("string").alias("payload")), rows=r),
}
DENSE = {
    "split": lambda f, r: E.field_split(f.withColumns({"rt_start": F.col("frame_no") * 900, "rt_stop": F.col("frame_no") * 900 + 700}), rows=r),
    "split_by_function": lambda f, r: E.split_fields(f.withColumns({"rt_start": F.col("frame_no") * -900, "rt_stop": F.col("frame_no") * 700}), rows=r),
    "cadence": lambda f, r: E.cadence_flag(f, rows=r),
    "times": lambda f, r: E.fill_frame_times(f, avg_time=400, rows=r),
    "smooth": lambda f, r: S.smooth_same_type(f, blur=1.0, half=2, rows=r).withColumn("blurred", F.round("blurred", 9)),
    "decimate": lambda f, r: A.decimate2(f, order="frame_no", rows=r),
}


@pytest.mark.parametrize("name", sorted(PACKETS))
def test_packet_operators(packets, name):
    whole = sorted(map(str, PACKETS[name](packets, 100_000).collect()))
    assert whole
    assert sorted(map(str, PACKETS[name](packets.repartition(2), 6).collect())) == whole


@pytest.mark.parametrize("name", sorted(DENSE))
def test_frame_operators(dense, name):
    whole = sorted(map(str, DENSE[name](dense, 100_000).collect()))
    assert whole
    assert sorted(map(str, DENSE[name](dense.repartition(2), 7).collect())) == whole


def test_thinning_ends_below_the_limit(packets):
    n = S.thin_index(packets, 20).groupBy("stream_id", "stream_index").count().agg(F.max("count").alias("m")).collect()[0].m
    assert n < 20


def test_weave_and_scene_chunks(spark):
    rng = random.Random(4)
    rows = [(0, f, "Y", y, [rng.randint(0, 255) for _ in range(32)]) for f in range(9) for y in range(16)]
    df = spark.createDataFrame(rows, "stream_id bigint, frame_no bigint, plane string, line_no bigint, px array<int>")
    for op in (
        lambda d, r: L.scene_score(d, rows=r), lambda d, r: L.same_field_test(d, height=16, width=32, rows=r),
        lambda d, r: L.weave(d.withColumnRenamed("frame_no", "field_no").withColumn("is_top", F.col("field_no") % 2 == 0), rows=r),
    ):
        assert sorted(map(str, op(df, 2).collect())) == sorted(map(str, op(df, 1000).collect()))
