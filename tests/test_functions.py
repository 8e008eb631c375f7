"""Scalar functions against plain Python."""

import math
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediaspark.functions import audio as A
from mediaspark.functions import picture as Pic
from mediaspark.functions import text as Tx
from mediaspark.functions import timebase as Tb
from mediaspark.plans.pipeline import Param, Pipeline, Stage, observed


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return df.select(col.alias("r")).collect()[0].r


def python_rescale(a, b, c, mode):
    f = Fraction(a * b, c)
    low = math.floor(f)
    if mode == "down":
        return low
    if mode == "up":
        return math.ceil(f)
    if mode == "zero":
        return math.trunc(f)
    if mode == "inf":
        return math.ceil(f) if f > 0 else math.floor(f)
    mag = (abs(a * b) + c // 2) // c
    return mag if a * b >= 0 else -mag


def test_rescale_equals_big_integers(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.randint(-(2**40), 2**40), rng.randint(0, 2**20), rng.randint(1, 2**22)) for _ in range(300)]
    rows += [(2**62, 2**40, 2**41), (-(2**62), 3, 5), (0, 5, 7), (7, 1, 2), (-7, 1, 2)]
    rows = [r for r in rows if abs(r[0] * r[1] // r[2]) < 2**62]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    for mode in Tb.ROUNDINGS:
        out = df.select("a", "b", "c", Tb.rescale(F.col("a"), F.col("b"), F.col("c"), mode).alias("r")).collect()
        for r in out:
            assert r.r == python_rescale(r.a, r.b, r.c, mode), (mode, r)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**6), 10**6), st.integers(1, 10**6), st.integers(1, 10**6), st.integers(1, 10**6)), min_size=1, max_size=20))
def test_rationals(spark, rows):
    df = spark.createDataFrame(rows, "n bigint, d bigint, m bigint, e bigint")
    a, b = Tb.rational(F.col("n"), F.col("d")), Tb.rational(F.col("m"), F.col("e"))
    out = df.select("*", Tb.add_q(a, b).alias("s"), Tb.mul_q(a, b).alias("p"), Tb.div_q(a, b).alias("q"), Tb.sub_q(a, b).alias("t")).collect()
    for r in out:
        x, y = Fraction(r.n, r.d), Fraction(r.m, r.e)
        for got, want in ((r.s, x + y), (r.p, x * y), (r.q, x / y), (r.t, x - y)):
            assert (got.num, got.den) == (want.numerator, want.denominator)


def test_compare_and_double_to_rational(spark):
    assert one(spark, Tb.compare_ts(F.lit(1001), 1, 30000, F.lit(1000), 1, 30000)) == 1
    assert one(spark, Tb.compare_ts(F.lit(1), 1, 25, F.lit(3600), 1, 90000)) == 0
    r = one(spark, Tb.double_to_q(F.lit(29.97002997), 2000))
    assert (r.num, r.den) == (30000, 1001)
    assert one(spark, Tb.rescale_q(F.lit(90000), 1, 90000, 1, 1000)) == 1000


def test_report_text(spark):
    assert one(spark, Tx.sexagesimal(F.lit(3725.5))) == "1:02:05.500000"
    assert one(spark, Tx.sexagesimal(F.lit(None).cast("double"))) == "N/A"
    assert one(spark, Tx.format_value(F.lit(1536000), "bit/s", prefix=True)) == "1.536 Mbit/s"
    assert one(spark, Tx.format_value(F.lit(3 * 1024 * 1024), "byte", prefix=True, binary=True)) == "3.000 Mibyte"
    assert one(spark, Tx.format_value(F.lit(0), "Hz", prefix=True)) == "0.000 Hz"
    assert one(spark, Tx.format_bytecount(F.lit(99999))) == "99999 "
    assert one(spark, Tx.format_bytecount(F.lit(100000))) == "100k"
    assert one(spark, Tx.fourcc(F.lit(0x34363248))) == "H264"
    assert one(spark, Tx.fourcc(F.lit(0x00000001))) == "[1][0][0][0]"


@pytest.mark.parametrize("text, want", [("25", 25.0), ("1.5k", 1500.0), ("2Ki", 2048.0), ("1MB", 8e6), ("-3m", -0.003), ("x", None), ("1e3", 1000.0)])
def test_numbers(spark, text, want):
    got = one(spark, Tx.parse_number(F.lit(text)))
    assert got is None if want is None else math.isclose(got, want)


def test_names_and_tags(spark):
    assert one(spark, Tx.frame_filename("img%03d.pgm", F.lit(7))) == "img007.pgm"
    u = one(spark, Tx.split_url(F.lit("rtsp://me:pw@host.tv:554/a/b?x=1")))
    assert (u.proto, u["auth"], u.host, u.port, u.path) == ("rtsp", "me:pw", "host.tv", 554, "/a/b?x=1")
    assert one(spark, Tx.join_url(F.lit("http"), F.lit("h"), F.lit(-1), F.lit("/p"))) == "http://h/p"
    tags = F.create_map(F.lit("Title"), F.lit("a"), F.lit("tIT2"), F.lit("b"))
    assert one(spark, Tx.tag_get(tags, "TITLE")) == "a"
    assert one(spark, Tx.translate_keys(tags, {"TIT2": "title"}, {"title": "NAME"})) == {"NAME": "b"}
    assert one(spark, Tx.tag_set(tags, "Title", None)) == {"tIT2": "b"}
    assert one(spark, Tx.genre_name(F.lit(1), ["Blues", "Classic Rock"])) == "Classic Rock"
    assert one(spark, Tx.match_extension(F.lit("a.b.MP3"), ["wav", "mp3"])) is True
    assert math.isclose(one(spark, Tx.floored_mod(F.lit(-7.0), F.lit(3.0))), 2.0)


def test_samples(spark):
    assert one(spark, A.convert_sample(F.lit(0), "u8", "s16")) == -32768
    assert one(spark, A.convert_sample(F.lit(-1), "s32", "u8")) == 127
    assert one(spark, A.convert_sample(F.lit(0.5), "dbl", "s16")) == 16384
    assert one(spark, A.quantise(F.lit(1 << 30), 24, "float")) == (2**23 - 1) / 2**23
    assert one(spark, A.stereo_to_mono(F.array(F.lit(-3), F.lit(2)))) == [-1]
    assert one(spark, A.stereo_to_51(F.array(F.lit(-3), F.lit(5)))) == [-3, 1, 5, 0, 0, 0]
    assert one(spark, A.reorder(F.array(F.lit(10), F.lit(20), F.lit(30)), [2, 0, 1])) == [30, 10, 20]
    assert one(spark, A.layout_name(F.lit(6), F.lit(0x60F))) == "5.1"
    assert one(spark, A.layout_name(F.lit(2), F.lit(0x30))) == "2 channels (BL|BR)"
    assert one(spark, A.default_layout(F.lit(2))) == 3


def test_format_choice(spark):
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    assert one(spark, Pic.best_format(names("gray", "rgb24", "yuv444p"), F.lit("yuv420p"))) == "yuv444p"
    assert one(spark, Pic.best_format(names("gray", "pal8", "rgb24"), F.lit("rgba"))) == "rgb24"
    assert one(spark, Pic.best_format(names("gray"), F.lit("rgb24"))) == "gray"
    assert one(spark, Pic.common_formats(names("a", "b"), names("c"))) is None
    assert one(spark, Pic.picture_size(F.lit("yuv420p"), F.lit(5), F.lit(3))) == 15 + 2 * 3 * 2


def test_pipeline_orders_and_checks(spark):
    p = Param("by", "int", 1, 0, 10)
    add = lambda df, by: df.withColumn("v", F.col("v") + by)
    twice = lambda df: df.withColumn("v", F.col("v") * 2)
    chain = Pipeline([Stage("deint", twice), Stage("pre_detect_1", add, (p,), {"by": 3})])
    df = spark.range(1).withColumn("v", F.lit(1))
    out, seen = observed(chain.run(df), "stats", top=F.max("v"))
    assert out.collect()[0].v == 8 and seen.get["top"] == 8
    with pytest.raises(ValueError):
        Pipeline([Stage("deint", add, (p,), {"by": 99})]).run(df)
    with pytest.raises(ValueError):
        Pipeline([Stage("nowhere", twice)])


def test_counts_beyond_64_bits(spark, tmp_path):
    """Cubes of order keys from 2,097,152 on overflowed; every count is held against repeated division."""
    from decimal import Decimal

    from mediaspark.plans.catalog import QUERIES

    def by_hand(n):
        suffix = 0
        while n >= 100000 and suffix < 5:
            n, suffix = n // 1000, suffix + 1
        return f"{n}{' kMGTP'[suffix]}"

    keys = [0, 1, -70, 46, 47, 464, 465, 4641, 4642, 464158, 464159, 2097151, 2097152, 9_000_000, 54_000_000, 4 * 10**12, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r["size"] for r in QUERIES["format_bytecount"](spark, str(tmp_path)).collect()}
    assert got == {k: None if k is None else by_hand(k**3) for k in keys}
    counts = [10**e + d for e in range(19) for d in (-1, 0)] + [-100000, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(n,) for n in counts], "n bigint").select("n", Tx.format_bytecount(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == {n: by_hand(n) for n in counts}
    part = spark.createDataFrame([(Decimal("99999.99"),), (Decimal("-0.50"),)], "n decimal(10, 2)").select(Tx.format_bytecount(F.col("n")).alias("t"))
    assert [r.t for r in part.collect()] == ["99999 ", "0 "]
