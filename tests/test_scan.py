"""Chunked scans give what one pass over the whole stream gives."""

import random

import pytest
from pyspark.sql import functions as F

from mediaspark.operators import packets as P
from mediaspark.operators import scan
from mediaspark.operators.cues import caption_events
from mediaspark.operators.stats import build_seek_index


def table(spark, n=200, gaps=True, seed=1):
    rng = random.Random(seed)
    rows, at = [], {0: 0, 1: 0}
    for _ in range(n):
        k = 0 if rng.random() < 0.8 else 1
        at[k] += rng.randint(1, 4) if gaps else 1
        rows.append((k, at[k], rng.choice([None, rng.randint(-50, 50)])))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k bigint, o bigint, v bigint").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("rows_per_chunk", [3, 17, 10_000])
@pytest.mark.parametrize("include", [True, False])
def test_running(spark, rows_per_chunk, include):
    rows, df = table(spark)
    out = scan.running(
        df, ["k"], "o",
        {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v")), "l": ("last", F.col("v"))},
        include_current=include, rows=rows_per_chunk,
    )
    got = {(r.k, r.o): (r.s, r.c, r.m, r.n, r.l) for r in out.collect()}
    for k, seq in by_key(rows).items():
        for i, r in enumerate(seq):
            vals = [x[2] for x in seq[: i + include] if x[2] is not None]
            want = (sum(vals), len(vals), max(vals), min(vals), vals[-1]) if vals else (None, 0, None, None, None)
            assert got[(k, r[1])] == want


@pytest.mark.parametrize("rows_per_chunk", [3, 10_000])
def test_reverse_and_neighbour_rows(spark, rows_per_chunk):
    rows, df = table(spark)
    ahead = {(r.k, r.o): r.f for r in scan.running(df, ["k"], "o", {"f": ("first", F.col("v"))}, reverse=True, rows=rows_per_chunk).collect()}
    prev = {(r.k, r.o): r.p for r in scan.previous(df, ["k"], "o", {"p": F.col("v")}, rows=rows_per_chunk).collect()}
    nxt = {(r.k, r.o): r.p for r in scan.following(df, ["k"], "o", {"p": F.col("v")}, rows=rows_per_chunk).collect()}
    for k, seq in by_key(rows).items():
        for i, r in enumerate(seq):
            rest = [x[2] for x in seq[i:] if x[2] is not None]
            assert ahead[(k, r[1])] == (rest[0] if rest else None)
            assert prev[(k, r[1])] == (seq[i - 1][2] if i else None)
            assert nxt[(k, r[1])] == (seq[i + 1][2] if i + 1 < len(seq) else None)


@pytest.mark.parametrize("rows_per_chunk", [4, 13, 10_000])
def test_neighbours(spark, rows_per_chunk):
    rows, df = table(spark, gaps=False)
    cols = {"a": lambda w: F.lag("v", 3).over(w), "b": lambda w: F.lead("v", 2).over(w), "n": lambda w: F.count("v").over(w.rowsBetween(-3, 2))}
    got = {(r.k, r.o): (r.a, r.b, r.n) for r in scan.neighbours(df, ["k"], "o", 3, 2, cols, rows=rows_per_chunk).collect()}
    assert len(got) == len(rows)
    for k, seq in by_key(rows).items():
        for i, r in enumerate(seq):
            near = [x[2] for x in seq[max(0, i - 3) : i + 3] if x[2] is not None]
            want = (seq[i - 3][2] if i >= 3 else None, seq[i + 2][2] if i + 2 < len(seq) else None, len(near))
            assert got[(k, r[1])] == want


@pytest.mark.parametrize("rows_per_chunk", [3, 10_000])
def test_anchored_sum(spark, rows_per_chunk):
    rows, df = table(spark)
    out = scan.anchored_sum(df, ["k"], "o", "t", F.col("v"), F.col("o") % 7, rows=rows_per_chunk)
    got = {(r.k, r.o): r.t for r in out.collect()}
    for k, seq in by_key(rows).items():
        cur = 0
        for r in seq:
            cur = r[2] if r[2] is not None else cur
            assert got[(k, r[1])] == cur
            cur += r[1] % 7


def test_number_rows_levels(spark):
    rows, df = table(spark)
    out = scan.number_rows(df, ["k"], ["o"], [F.expr("o div 50"), F.expr("o div 7")], "rn", start=0)
    got = {(r.k, r.o): r.rn for r in out.collect()}
    for k, seq in by_key(rows).items():
        assert [got[(k, r[1])] for r in seq] == list(range(len(seq)))


def test_plan_has_no_whole_stream_window(spark):
    """Rows are partitioned by stream and chunk; only chunk summaries by stream alone."""
    _, df = table(spark)
    out = scan.running(df, ["k"], "o", {"s": ("sum", F.col("v"))}, rows=10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__chunk" in plan and "Window" in plan
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 2
    assert any("[k#" in w and "__chunk" in w.split("],")[1] for w in windows)


def test_number_sorted_in_any_order(spark):
    rng = random.Random(17)
    # A third of the rows are one stream's, times are sparse, out of order, tied and missing.
    rows = [(0 if i % 3 == 0 else i % 7, rng.choice([None, rng.randint(0, 10**15), rng.randint(0, 5)]), i % 2, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "stream_id bigint, dts bigint, stream_index int, seq bigint").repartition(7)
    got = {(r.stream_id, r.seq): r.pos for r in P.interleave(df).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2], r[3])):
        by.setdefault(r[0], []).append(r[3])
    assert got == {(k, seq): n for k, seqs in by.items() for n, seq in enumerate(seqs, 1)}


def test_later_packets_come_later_whatever_their_numbers(spark):
    df = spark.createDataFrame([(0, 100, 0, 262143), (0, 90, 0, 262144), (0, None, 0, 1)], "stream_id bigint, dts bigint, stream_index int, seq bigint")
    assert {r.seq: r.pos for r in P.interleave(df).collect()} == {262144: 1, 262143: 2, 1: 3}


def test_captions_are_numbered_by_time_over_chunks(spark):
    say = lambda at: f"Dialogue: 0, 0:00:{at:02d}.00,x"
    lines = [(0, "[Events]"), (1, "Format: x"), (262143, say(10)), (262145, say(5))]
    df = spark.createDataFrame([(1, n, x) for n, x in lines], "file_id bigint, line_no bigint, line string")
    assert {r.line_no: r.event_no for r in caption_events(df).collect()} == {262145: 1, 262143: 2}


def test_an_index_entry_starts_afresh_when_its_position_returns(spark):
    rows = [(100, 9, 1), (200, 3, 2), (100, 1, 3), (100, 0, 4)]
    df = spark.createDataFrame([(0, 0, 7, p, s, 10 * s, s == 3, d) for p, d, s in rows], "stream_id int, stream_index int, ts bigint, pos bigint, seq bigint, size bigint, is_key boolean, min_distance int")
    r = build_seek_index(df).collect()
    assert [(x.pos, x.min_distance, x.size, x.is_key) for x in r] == [(100, 1, 40, False)]


def test_counting_up_in_blocks(spark):
    from mediaspark.operators.scan import count_up

    df = spark.createDataFrame([(0, 0), (1, 1), (2, 7), (3, 8), (4, 9), (5, None), (6, 1000)], "k bigint, n bigint")
    for block in (4, 1 << 16):
        got = sorted((r["k"], r["x"]) for r in count_up(df, ["k"], F.col("n"), "x", block=block).collect())
        assert got == [(k, x) for k, n in ((1, 1), (2, 7), (3, 8), (4, 9), (6, 1000)) for x in range(n)]
