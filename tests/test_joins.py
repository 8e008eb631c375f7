"""As-of and interval joins against linear search, at several cell sizes."""

import random

import pytest
from pyspark.sql import functions as F

from mediaspark.operators import joins as J


@pytest.mark.parametrize("cell", [5, 64, None])
@pytest.mark.parametrize("backward", [True, False])
def test_seek_equals_linear_search(spark, cell, backward):
    rng = random.Random(11)
    entries = {(k, rng.randint(0, 500)) for k in (0, 1) for _ in range(60)}
    idx = [(k, 0, t, t * 10, rng.random() < 0.4) for k, t in entries]
    req = [(i, i % 2, 0, rng.randint(-20, 520)) for i in range(150)]
    out = J.seek_join(
        spark.createDataFrame(req, "req bigint, stream_id bigint, stream_index int, ts bigint"),
        spark.createDataFrame(idx, "stream_id bigint, stream_index int, ts bigint, pos bigint, is_key boolean"),
        backward=backward, cell=cell,
    )
    got = {r.req: r.entry_ts for r in out.collect()}
    for i, k, _, t in req:
        keys = [e[2] for e in idx if e[0] == k and e[4] and (e[2] <= t if backward else e[2] >= t)]
        assert got[i] == ((max if backward else min)(keys) if keys else None)


@pytest.mark.parametrize("width", [1, 8, 1000])
def test_interval_join_equals_all_pairs(spark, width):
    rng = random.Random(2)
    spans = []
    for i in range(80):
        a = rng.randint(-300, 900)
        spans.append((i % 2, i, a, None if i % 17 == 0 else a + rng.choice([1, 3, 50, 700, 100000])))
    points = [(i % 2, rng.randint(-400, 1000), i) for i in range(120)]
    out = J.interval_join(
        spark.createDataFrame(points, "k int, t bigint, p int"), spark.createDataFrame(spans, "k int, s int, start bigint, stop bigint"),
        ["k"], "t", "start", "stop", bin_width=width,
    )
    got = sorted((r.p, r.s) for r in out.collect())
    want = sorted((p, s) for k, t, p in points for k2, s, a, b in spans if k == k2 and a <= t and (b is None or t < b))
    assert got == want


def test_semi_join_equals_pairs(spark):
    rng = random.Random(4)
    cues = [(0, a := rng.randint(0, 300), a + rng.randint(1, 30), rng.random() < 0.5) for _ in range(15)]
    c = spark.createDataFrame(cues, "stream_id int, start bigint, stop bigint, forced boolean")
    f = spark.createDataFrame([(0, t) for t in range(0, 340, 3)], "stream_id int, t bigint")
    for on in (False, True):
        got = {r.t for r in J.frames_needing_overlay(f, c, subtitles_on=on).collect()}
        want = {t for t in range(0, 340, 3) if any(a <= t < b and (fo or on) for _, a, b, fo in cues)}
        assert got == want


def test_acl_default_is_opposite_of_last_rule(spark):
    conns = spark.createDataFrame([(1, 5), (2, 15), (3, 99)], "conn_id int, src_addr bigint")
    acl = spark.createDataFrame([(0, 0, 10, False), (1, 0, 20, True)], "rule_no int, first_addr bigint, last_addr bigint, allow boolean")
    assert {r.conn_id: r.allowed for r in J.acl_check(conns, acl).collect()} == {1: False, 2: True, 3: False}
    empty = acl.limit(0)
    assert all(r.allowed for r in J.acl_check(conns, empty).collect())


def test_nearest_rate_tie_keeps_first(spark):
    df = spark.createDataFrame([(3, 2), (100, 1), (1, 1000)], "num bigint, den bigint")
    got = [r.rate_idx for r in J.nearest_rate(df, [(1, 1), (2, 1), (25, 1)]).orderBy("den").collect()]
    assert got == [2, 0, 0]


def test_probe_tie_gives_no_answer(spark):
    df = spark.createDataFrame([("a.mp3", "xy"), ("b.txt", "x"), ("c.txt", "q")], "filename string, head string")
    rules = [("one", 60, F.col("head").contains("x")), ("two", 60, F.col("head").contains("y"))]
    got = {r.filename: r.format for r in J.probe_format(df, rules, extensions={"audio": ["MP3"]}).collect()}
    assert got == {"a.mp3": None, "b.txt": "one", "c.txt": None}


@pytest.mark.parametrize("rows", [7, 10_000])
def test_interpolated_clock(spark, rows):
    pk = [(i, {3: 300, 9: 960, 20: 1840}.get(i)) for i in range(25)]
    out = J.interpolate_pcr(spark.createDataFrame(pk, "packet_no bigint, pcr bigint"), rows=rows)
    got = {r.packet_no: r.clock for r in out.collect()}
    assert got[0] == -30 and got[3] == 300 and got[5] == 520 and got[9] == 960 and got[10] == 1040 and got[24] == 1840 + 4 * 80


def test_diff_golden(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    e = spark.createDataFrame([(1, "x"), (2, "z"), (4, "w"), (3, None)], "k int, v string")
    assert {(r.k, r.status) for r in J.diff_golden(a, e, ["k"], "v").collect()} == {(2, "differs"), (4, "missing")}


def test_first_rule_over_many_overlapping_rules(spark):
    """Against a loop over all rules: open, empty, nested and equal ranges, addresses at every border."""
    rng = random.Random(12)
    rules = []
    for n in range(60):
        a = rng.randrange(0, 5000)
        rules.append((n, a, rng.choice([None, a, a + rng.randrange(0, 40), a + rng.randrange(0, 5000), a - 1]), rng.random() < 0.5))
    rules[40] = (40, 0, None, True)
    addresses = sorted({b + k for _, f, l, _ in rules for b in (f, l or f) for k in (-1, 0, 1)} | set(range(0, 12000, 37)) | {2**32 - 1})
    conns = [(i, a) for i, a in enumerate([*addresses, *addresses[:20], None])]
    acl = spark.createDataFrame(rules, "rule_no bigint, first_addr bigint, last_addr bigint, allow boolean")
    df = spark.createDataFrame([c for c in conns if c[1] is None or c[1] >= 0], "conn_id bigint, src_addr bigint")
    first = lambda x: next((ok for _, f, l, ok in rules if x is not None and f <= x and (l is None or x <= l)), not rules[-1][3])
    for cell in (J.ADDRESSES, 16):
        got = {r["conn_id"]: r["allowed"] for r in J.acl_check(df, acl, cell=cell).collect()}
        assert got == {i: first(a) for i, a in conns if a is None or a >= 0}


def test_an_open_rule_brings_no_addresses_together(spark):
    """No exchange deals addresses by a constant: every address has its own key or its stretch of addresses."""
    acl = spark.createDataFrame([(0, 0, None, True)], "rule_no bigint, first_addr bigint, last_addr bigint, allow boolean")
    spans = J.least_cover(spark.range(50000).withColumnRenamed("id", "at"), acl, "at", "first_addr", "last_addr", F.struct("rule_no", "allow"))
    assert spans.where("__least.allow").count() == 50000
    conns = spark.range(50000).select(F.col("id").alias("conn_id"), F.col("id").alias("src_addr"))
    both = J.acl_check(conns, acl, cell=1000)
    assert both.where("allowed").count() == 50000


def test_open_spans_are_dealt_out(spark):
    frames = spark.range(4000).select(F.lit(0).cast("bigint").alias("k"), F.col("id").alias("t"))
    spans = spark.createDataFrame([(0, 100, None, "a"), (0, 3990, None, "b"), (0, 50, 60, "c")], "k bigint, a bigint, z bigint, n string")
    got = {r["n"]: r["count"] for r in J.interval_join(frames, spans, ["k"], "t", "a", "z").groupBy("n").count().collect()}
    assert got == {"a": 3900, "b": 10, "c": 10}


def _packets(stsz, stts, stsc, stco, stss, ctts):
    """A packet table by loops over expanded runs; the last run of either kind goes on."""
    out = {}
    for k in sorted({r[0] for r in stco}):
        mine = lambda t: sorted(r[1:] for r in t if r[0] == k)
        sizes = dict(mine(stsz))
        times, at = [], 0
        for _, n, step in mine(stts):
            times += [(len(times) + i, None if step is None else at + i * step, step) for i in range(n)]
            at += n * (step or 0)
        shifts = [o for _, n, o in mine(ctts) for _ in range(n)]
        listed = [r[0] for r in mine(stss)]
        keys = {s - (min(listed) == 1) for s in listed} if listed else set(sizes)
        place, no = {}, 0
        for c, off in mine(stco):
            per = [n for first, n in mine(stsc) if first <= c][-1]
            for s in range(no, no + per):
                place[s] = off
                off += sizes.get(s) or 0
            no += per
        last = 0
        for s in sorted(set(sizes) & set(place)):
            first, dts, step = times[min(s, len(times) - 1)]
            dts = None if dts is None else dts + (s - first) * step
            last = s if s in keys else last
            shift = shifts[min(s, len(shifts) - 1)] if shifts else 0
            out[k, s] = (place[s], dts, None if dts is None else dts + (shift or 0), step, sizes[s], s in keys, s - last)
    return out


@pytest.mark.parametrize("rows", [7, 1 << 18])
def test_packet_table_equals_expanded_runs(spark, rows):
    """Streams of one range and of many, empty runs and chunks, no key list, no shifts, unknown values, samples in no chunk."""
    rng = random.Random(8)
    stsz, stts, stsc, stco, stss, ctts = [], [], [], [], [], []
    for k, n in ((1, 150), (2, 5), (3, 40), (4, 33), (6, 90)):
        stsz += [(k, s, rng.choice([None, 10, 33, 1000]) if k == 1 else 10 + s) for s in range(n)]
        stts += [(k, r, rng.randint(0, 9), None if k == 4 and r == 2 else rng.randint(1, 50)) for r in range(n // 5 + 1)]
        stts += [(k, n, 3, 40)]
        chunks = max(2, n // 4)
        stsc += [(k, c, rng.randint(0, 6) if c > 1 else 3) for c in range(1, chunks + 1) if c == 1 or c % 5 == 0]
        stco += [(k, c, 10**6 * c) for c in range(1, chunks + 1)]
        if k != 3:
            stss += [(k, s) for s in range(1 if k % 2 else 2, n, 11)] * 2
        if k != 4:
            ctts += [(k, r, rng.randint(0, 6), rng.choice([None, -20, 0, 80])) for r in range(n // 3)]
    want = _packets(stsz, stts, stsc, stco, stss, ctts)
    stsz += [(5, 0, 7), (None, 0, 7)]
    stts, stsz = rng.sample(stts, len(stts)), rng.sample(stsz, len(stsz))
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in f"stream_id {names}".split()))
    side = [frame(stsz, "sample_no size"), frame(stts, "run_no count duration"), frame(stsc, "first_chunk count"), frame(stco, "chunk_no offset"), frame(stss, "sample")]
    out = J.build_sample_table(*side, frame(ctts, "run_no count offset"), rows=rows)
    got = out.collect()
    assert {tuple(r[:2]): tuple(r[2:]) for r in got} == want and len(got) == len(want) > 200
    plain = J.build_sample_table(*side, rows=rows).collect()
    assert {(r.stream_id, r.sample_no): (r.dts, r.pts) for r in plain} == {at: (v[1], v[1]) for at, v in want.items()}


def test_what_lands_on_samples_is_not_joined_to_them(spark, monkeypatch):
    """Each such join would shuffle all samples once more."""
    monkeypatch.setattr(J, "cut_lineage", lambda df: df)
    frame = lambda names: spark.range(9).selectExpr("id AS stream_id", *[f"id AS {n}" for n in names.split()])
    names = ["sample_no size", "run_no count duration", "first_chunk count", "chunk_no offset", "sample", "run_no count offset"]
    plan = J.build_sample_table(*map(frame, names))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not [x for x in plan.splitlines() if "Join" in x and "sample_no" in x]
