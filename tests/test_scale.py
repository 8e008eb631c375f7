"""Steps whose cost must follow the rows, not the number of streams, chunks or files."""

import random

from pyspark.sql import functions as F

from mediaspark.operators import fold as G


def summing():
    """A running sum that a value of 0 starts afresh."""

    def fold(state, cols):
        n, out = state[0] if state else 0, []
        for x in cols["x"]:
            n = x if x == 0 else n + x
            out.append(n)
        return [n], {"total": out}

    return fold


def test_short_streams_share_a_batch_and_long_ones_take_several(spark):
    """No Python group per stream and chunk: sorted rows, whatever the batches are cut like."""
    rng = random.Random(3)
    rows = [(k, o, rng.randint(0, 4)) for k in range(60) for o in range(3 + 40 * (k % 20 == 0))]
    want = {}
    for k in range(60):
        mine = [r for r in rows if r[0] == k]
        want |= {(k, r[1]): v for r, v in zip(mine, summing()(None, {"x": [r[2] for r in mine]})[1]["total"])}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k bigint, o bigint, x int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for chunk in (5, 16, 1000):
            out = G.fold_stream(df, ["k"], "o", ["x"], summing(), "total bigint", rows=chunk)
            assert {(r.k, r.o): r.total for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_a_buffer_that_runs_dry_keeps_a_level_of_its_type(spark):
    """An underflow leaves a whole number, which a state typed as double dropped."""
    fold = G.vbv_fold(200000, 0, 80000, 0, 150000.0)
    state, _ = fold(None, {"bits": [10**6]})
    assert [type(v) for v in state] == [float]


def test_streams_of_a_bucket_keep_apart(spark, tmp_path):
    """Many streams, two buckets, files in any order: each stream is put in order by itself, its long key whole."""
    from mediaspark.streaming import twins as S

    rng, schema = random.Random(5), "k bigint, o bigint, x int"
    rows = [((1 << 60) + k, o, rng.randint(0, 4)) for k in range(40) for o in range(1 + k % 9)]
    want = set()
    for k in range(40):
        mine = [r for r in rows if r[0] == (1 << 60) + k]
        want |= {(*r[:2], v) for r, v in zip(mine, summing()(None, {"x": [r[2] for r in mine]})[1]["total"])}
    mixed = [*rows, (None, 3, 1)]
    rng.shuffle(mixed)
    for part in (mixed[::2], mixed[1::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # A sum that is whole is a double to the state.
    out = S.fold_live(feed, ["k"], "o", ["x"], summing(), "total bigint", first=0, state="n double", buckets=2)
    S.drain(out, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(rows) and {(r.k, r.o, r.total) for r in got} == want and not any(r.late for r in got)


def test_feed_by_days_has_as_many_files_at_any_width(spark, tmp_path, monkeypatch):
    from mediaspark.plans import live_queries as Q

    monkeypatch.setattr(Q, "folder", lambda spark, name: str(tmp_path / name))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)
    Q.by_days(spark, spark.range(0, 700, 1, 40).select("id", at.alias("ts")))
    files = spark.read.parquet(str(tmp_path / "feed"))
    assert files.count() == 700 and 0 < len(files.inputFiles()) <= 24


def test_media_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from mediaspark.plans import source_queries as Q

    monkeypatch.setattr(Q, "folder", lambda spark, name: str(tmp_path / name))
    spark.range(0, 400).selectExpr("id % 100 AS user_id", "repeat('x', 5) AS props").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.stream_id: r.file_size for r in Q.scan_media(spark, str(tmp_path)).collect()}
    tasks = {f.name.split("-")[1] for f in (tmp_path / "media").glob("*/part-*.txt")}
    assert got == {u: 24 for u in range(100)} and len(tasks) > 4


def test_numbers_are_counted_up_by_many_tasks(spark):
    """Blocks are a few bytes each, which adaptive execution gave to one task, with all the numbers in them."""
    from mediaspark.operators.scan import count_up

    few = spark.range(40).groupBy("id").agg(F.lit(9).alias("n"))
    got = count_up(few, ["id"], F.col("n"), "no", block=2).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.id, r.no) for r in got) == [(k, i) for k in range(40) for i in range(9)]
    assert len({r.task for r in got}) > 4


def totals(rows):
    """``summing`` over each stream by a loop."""
    want = set()
    for k in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == k)
        want |= {(*r[:2], v) for r, v in zip(mine, summing()(None, {"x": [r[2] for r in mine]})[1]["total"])}
    return want


def test_short_streams_with_far_apart_rows_are_not_cut(spark, tmp_path, monkeypatch):
    """A chunk per row and a state per chunk were written, again in each round, where numbers run over all streams."""
    rng = random.Random(11)
    rows = [(rng.randrange(40), o << 20, rng.randint(0, 4)) for o in range(400)]
    spark.createDataFrame([*rows, (None, 1, 1), (5, None, 1)], "k bigint, o bigint, x int").write.parquet(str(tmp_path / "in"))
    written = []
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(df) or df)
    out = G.fold_stream(spark.read.parquet(str(tmp_path / "in")), ["k"], "o", ["x"], summing(), "total bigint")
    assert {(r.k, r.o, r.total) for r in out.collect()} == totals(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not written and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_long_streams_are_cut_by_their_rows(spark, monkeypatch):
    """By a sample of the rows, in a stream with gaps and one without; short streams beside them stay whole."""
    rng = random.Random(12)
    rows = [(float("nan") if o % 3 else 1.0, o * (1 if o < 900 else 1000), rng.randint(0 if o % 50 else -1, 4)) for o in range(1800)]
    rows += [(2.0 + k, o << 30, rng.randint(0, 4)) for k in range(20) for o in range(5)]
    monkeypatch.setattr(G, "CUT_SAMPLE", 512)
    monkeypatch.setattr(G, "MOST_CUTS", 64)
    df = spark.createDataFrame(rows, "k double, o bigint, x int")
    cuts = {str(r.k): r["__cuts"] for r in G._cuts(df, ["k"], "o", 100).collect()}
    assert set(cuts) == {"nan", "1.0"} and all(4 < len(c) < 20 for c in cuts.values())
    out = G.fold_stream(df, ["k"], "o", ["x"], summing(), "total bigint", rows=100).collect()
    named = [(str(k), o, x) for k, o, x in rows]
    assert len(out) == len(rows) and {(str(r.k), r.o, r.total) for r in out} == totals(named)


def best_rate(times):
    """The standard rate that the times of one stream fit best, by one sum per rate."""
    import numpy as np

    from mediaspark.operators.stats import rate_units

    units = np.array(rate_units()[1:], dtype=np.float64)
    gaps = [b - (times[0] if i == 0 else times[1]) for i, b in enumerate(times[1:])]
    secs = np.array([g for g in gaps if g > 0]) / 1e6
    if not len(secs):
        return None
    period = 12012.0 / units
    fit = ((secs[:, None] - np.rint(secs[:, None] / period) * period) ** 2).sum(0) * units
    return int(units[fit == fit.min()].min()) if fit.min() < 4e-12 * 360000 * len(secs) else None


def test_frame_rates_hold_one_stream_at_a_time(spark, monkeypatch):
    """A task held a vector of sums for each stream it met, and handed them all on."""
    import pyarrow as pa

    from mediaspark.operators import stats as S

    rng = random.Random(13)
    # Rates in Hz; the last one is far off any.
    ticks = lambda hz, n, off=0: [round(i * 1e6 / hz) + rng.randint(-off, off) for i in range(n)]
    times = {float("nan"): ticks(30000 / 1001, 2500), -1.0: ticks(24, 1500), 0.0: ticks(25, 1500, 9000)}
    times |= {float(k): ticks(rng.choice([25, 50, 24000 / 1001, 15]), k % 7) for k in range(1, 90)}
    rows = [(k, i, t, 40000) for k, ts in times.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k double, seq bigint, dts bigint, duration int")
    used, cls = [], type(df)
    real = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda self, f, *a, **b: used.append(f) or real(self, f, *a, **b))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {str(r.k): r.r_num for r in S.estimate_frame_rate(df, keys=["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {str(k): best_rate(ts) for k, ts in times.items() if ts} and len(set(got.values())) > 3
    # A task with 2,000 streams: little goes out, and the first of it early.
    read = []
    batches = (pa.RecordBatch.from_pydict({"k": [float(k)] * 3, "gap": [40000, 80000, 120000], "n": [1, 1, 2]}) for k in range(2000) if not read.append(k))
    out = iter(used[0](batches))
    size = next(out).nbytes
    assert len(read) < 5 and size + sum(b.nbytes for b in out) < 500_000
