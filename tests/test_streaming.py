"""Streaming runs give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from mediaspark.operators import fold as G
from mediaspark.streaming import ordered as O
from mediaspark.streaming import twins as S


def feed(spark, tmp_path, rows, schema, parts=4):
    """Write rows as several files, in order, and read them one per micro-batch."""
    per = (len(rows) + parts - 1) // parts
    for i in range(parts):
        spark.createDataFrame(rows[i * per : (i + 1) * per], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, tmp_path):
    S.drain(df, str(tmp_path / "out"), str(tmp_path / "progress"))
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


FOLDS = {
    "rtp": (["seq"], G.rtp_fold(), G.RTP_OUT),
    "video": (["pts"], G.video_sync_fold(25.0, "cfr"), "nb_frames int, out_no bigint"),
    "reorder": (["pts", "duration"], G.reorder_fold(2), "dts_out bigint"),
    "iir": (["x"], G.iir_fold(4, 0.3), "y int"),
}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_stream_equals_batch(spark, tmp_path, name):
    rng = random.Random(6)
    schema = "k bigint, o bigint, seq int, pts bigint, duration bigint, x int"
    rows = [(i % 3, i, (65520 + i // 3) % 65536, i * 15000 + rng.randint(-20000, 20000), 40000, rng.randint(-9000, 9000)) for i in range(120)]
    inputs, fold, out = FOLDS[name]
    live = run(spark, S.fold_live(feed(spark, tmp_path, rows, schema), ["k"], "o", inputs, fold, out), tmp_path)
    batch = G.fold_stream(spark.createDataFrame(rows, schema), ["k"], "o", inputs, fold, out)
    cols = ["k", "o", *[c.split()[0] for c in out.split(", ")]]
    assert sorted(map(str, live.select(cols).collect())) == sorted(map(str, batch.select(cols).collect()))


def test_reset_clears_state():
    fold = S.with_reset(G.clock_fold(10.0, 0.5, 0.1))
    cols = {"time": [0.0, 10.0, 500.0, 511.0], "step": [1.0] * 4, "disc": [False, False, True, False]}
    _, out = fold(None, cols)
    assert out["smooth_time"][2] == 500.0
    _, fresh = G.clock_fold(10.0, 0.5, 0.1)(None, {"time": [500.0, 511.0], "step": [1.0] * 2})
    assert out["smooth_time"][2:] == fresh["smooth_time"]


def test_live_cues_join(spark, tmp_path):
    t0 = 1_700_000_000
    frames = spark.createDataFrame([(0, t0 + i) for i in range(0, 40, 5)], "stream_id bigint, s bigint")
    cues = spark.createDataFrame([(0, t0 + 4, t0 + 12), (0, t0 + 20, t0 + 21)], "stream_id bigint, a bigint, b bigint")
    frames.select("stream_id", F.timestamp_seconds("s").alias("t")).write.parquet(str(tmp_path / "f"))
    cues.select("stream_id", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("stop")).write.parquet(str(tmp_path / "c"))
    f = spark.readStream.schema("stream_id bigint, t timestamp").parquet(str(tmp_path / "f"))
    c = spark.readStream.schema("stream_id bigint, start timestamp, stop timestamp").parquet(str(tmp_path / "c"))
    got = run(spark, S.live_cues(f, c), tmp_path)
    assert sorted(r.s - t0 for r in got.select(F.unix_seconds("t").alias("s")).collect()) == [5, 10, 20]


def test_preroll_and_warm_up(spark):
    df = spark.createDataFrame([(5, False), (0, False), (9, True)], "rt_stop bigint, preroll boolean")
    assert [r.rt_stop for r in S.skip_preroll(df).collect()] == [5]
    x = spark.createDataFrame([(None, 1), (2, 3)], "a int, b int").select(S.warm_up(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in x.collect()] == [1, 2]


def test_merged_inputs(spark, tmp_path):
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    for n in ("a", "b"):
        spark.range(10).select(t.alias("ts"), F.lit(n).alias("src"), F.lit(100).cast("bigint").alias("size")).write.parquet(str(tmp_path / n))
    parts = [spark.readStream.schema("ts timestamp, src string, size bigint").parquet(str(tmp_path / n)) for n in ("a", "b")]
    got = run(spark, S.merge_inputs(parts, "ts"), tmp_path)
    assert got.count() == 20


# ------------------------------------------------------------- rows in order


def shuffled(spark, tmp_path, rows, schema, rng, parts=6):
    """The rows of a feed in files that come in any order, one per micro-batch."""
    per = (len(rows) + parts - 1) // parts
    files = [rows[i * per : (i + 1) * per] for i in range(parts)]
    rng.shuffle(files)
    for f in files:
        rng.shuffle(f)
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


TYPED = {
    "reorder": (["pts", "duration"], lambda: G.reorder_fold(2), "dts_out bigint", "array<bigint>"),
    "video": (["pts"], lambda: G.video_sync_fold(25.0, "cfr"), "nb_frames int, out_no bigint", "count bigint"),
    "audio": (["pts", "size"], lambda: (lambda run: lambda s, c: run(s, {"pts": c["pts"], "samples": c["size"]}))(G.audio_sync_fold(48000, 0.1, 2)),
              "dropped bigint, silence bigint, compensation int, out_samples bigint", "count bigint, starting boolean"),
    "rate": (["pts", "size"], lambda: (lambda run: lambda s, c: run(s, {"t_ms": c["pts"], "bytes_total": c["size"]}))(G.data_rate_fold()), "rate bigint", "array<struct<t:bigint,n:bigint>>"),
    "iir": (["x"], lambda: G.iir_fold(4, 0.3), "y int", "array<double>"),
    "rtp": (["seq"], lambda: G.rtp_fold(), G.RTP_OUT, None),
}


@pytest.mark.parametrize("name", sorted(TYPED))
def test_order_across_batches(spark, tmp_path, name):
    """Files in any order give what one pass in order gives; nothing is late."""
    rng = random.Random(8)
    inputs, make, out, state = TYPED[name]
    schema = "k bigint, o bigint, seq int, pts bigint, duration bigint, x int, size bigint"
    rows = [(k, i, (65500 + i) % 65536, None if i % 17 == 5 and name != "rate" else i * 15000 + rng.randint(-20000, 20000) + (1 << 60 if name == "reorder" else 0), 40000, rng.randint(-9000, 9000), rng.randint(100, 900)) for i in range(60) for k in (0, 1)]
    whole = {}
    for k in (0, 1):
        mine = [dict(zip([c.split()[0] for c in schema.split(", ")], r)) for r in rows if r[0] == k]
        _, got = make()(None, {c: [m[c] for m in mine] for c in inputs})
        whole |= {(k, i): v for i, v in enumerate(zip(*[got[c.split()[0]] for c in out.split(", ")]))}
    df = S.fold_live(shuffled(spark, tmp_path, list(rows), schema, rng), ["k"], "o", inputs, make(), out, first=0, state=state)
    live = run(spark, df, tmp_path).collect()
    assert {(r["k"], r["o"]): tuple(r)[2:-1] for r in live} == whole and not any(r["late"] for r in live) and len(live) == len(rows)


def counting():
    """How many rows came before."""

    def fold(state, cols):
        n = state[0] if state else 0
        return [n + len(cols["o"])], {"place": list(range(n, n + len(cols["o"])))}

    return fold


def test_late_rows_come_out_marked(spark, tmp_path):
    """A number that is missing is waited for, given up for by depth, and late when it comes after all."""
    schema = "k bigint, o bigint"
    for part in ([0, 1, 3, 2, 5, 6], [7, 8, 9], [4, 10, 10], [11]):
        spark.createDataFrame([(0, o) for o in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, S.fold_live(feed, ["k"], "o", ["o"], counting(), "place bigint", first=0, depth=3, state="n bigint"), tmp_path).collect()
    ok = {r["o"]: r["place"] for r in got if not r["late"]}
    assert [r["o"] for r in got if r["late"]] in ([4], [4, 10]) and all(r["place"] is None for r in got if r["late"])
    assert [ok[o] for o in (0, 1, 2, 3, 5, 6, 7, 8, 9)] == list(range(9)) and 11 in ok and len(got) == 13


def ended(spark, tmp_path, feed, make):
    """A feed run to its end, then the mark that ends it."""
    df = make(S.with_end(feed, str(tmp_path / "marks")))
    S.drain(df, str(tmp_path / "out"), str(tmp_path / "progress"))
    before = spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()
    S.end_feed(feed, str(tmp_path / "marks"), "ts")
    S.drain(df, str(tmp_path / "out"), str(tmp_path / "progress"))
    return before, spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()


def test_warm_up_and_drain(spark, tmp_path):
    """The first and the last fields come out by the one-field method, the last ones when the feed has ended."""
    rng = random.Random(2)
    from datetime import datetime, timedelta

    rows = [(k, n, 100 * k + n * n, datetime(2024, 1, 1) + timedelta(seconds=n)) for n in range(20) for k in (0, 1)] + [(2, 0, 7, datetime(2024, 1, 1))]
    feed = shuffled(spark, tmp_path, rows, "k bigint, n bigint, v bigint, ts timestamp", rng)
    look = lambda f: O.look_around(f.withWatermark("ts", "1 hour"), ["k"], "n", "v", "ts", before=2, after=1, full=lambda w: sum(w), single=lambda v: -v, output="r bigint", first=0)
    before, got = ended(spark, tmp_path, feed, look)
    want = {(k, n): 100 * k * 4 + sum(m * m for m in range(n - 2, n + 2)) if 2 <= n < 19 else -(100 * k + n * n) for k in (0, 1) for n in range(20)} | {(2, 0): -7}
    assert {(r["k"], r["n"]): r["r"] for r in got} == want and len(got) == len(want) and len(before) == len(want) - 3, [r for r in want if r not in {(b["k"], b["n"]) for b in before}]


def test_captions_leave_the_state(spark, tmp_path):
    """Open cues end with the next one, cues that are over are forgotten, and the live run says the same."""
    fold, state, longest, shown = O.captions_fold(), None, 0, {}
    feed, cues = [], {}
    for i in range(3000):
        if i % 7 == 0:
            cues[i] = (i * 10, None if i % 2 else i * 10 + 95)
            feed.append((i * 10, i, cues[i][1], None))
        feed.append((i * 10 + 1, None, None, i))
    for a in range(0, len(feed), 50):
        part = feed[a : a + 50]
        state, out = fold(state, {"t": [r[0] for r in part], "cue": [r[1] for r in part], "stop": [r[2] for r in part]})
        longest = max(longest, len(state[0]))
        shown |= {r[3]: o for r, o in zip(part, out["shown"]) if r[3] is not None}
    starts = sorted(cues)
    closed = {c: cues[c][1] or cues.get(starts[i + 1] if i + 1 < len(starts) else None, (10**9,))[0] for i, c in enumerate(starts)}
    assert longest <= 3 and shown == {n: [c for c in starts if cues[c][0] <= n * 10 + 1 < closed[c]] for n in range(3000)}


def test_late_column_and_null_keys_do_not_disturb_batches(spark, tmp_path):
    """Without numbers or times a batch is folded in order and nothing waits."""
    schema = "k bigint, o bigint"
    spark.createDataFrame([(0, 5), (0, 1), (0, 3), (None, 2), (0, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run(spark, S.fold_live(feed, ["k"], "o", ["o"], counting(), "place bigint"), tmp_path).collect()
    assert sorted((r["o"], r["place"]) for r in got) == [(1, 0), (3, 1), (5, 2)]
