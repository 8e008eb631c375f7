"""Folds over chunks equal one pass; folds equal plain re-statements of the rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mediaspark.operators import fold as G


def packets(spark, n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((
            0 if i % 10 else 1, 0, i, i * 40000 + rng.randint(-90000, 90000) + (400000 if rng.random() < 0.05 else 0),
            rng.choice([None, i * 40000 + rng.randint(-3, 3)]), 40000, rng.randint(100, 3000), rng.random() < 0.1, rng.random() < 0.5,
        ))
    cols = "stream_id bigint, stream_index int, seq bigint, pts bigint, dts bigint, duration bigint, size bigint, disc boolean, is_b boolean"
    return spark.createDataFrame(rows, cols)


CASES = {
    "reorder": lambda p, r: G.dts_from_pts(p, 3, rows=r),
    "video_cfr": lambda p, r: G.video_sync(p, fps=25.0, rows=r),
    "video_vfr": lambda p, r: G.video_sync(p, fps=25.0, method="vfr", rows=r),
    "audio": lambda p, r: G.audio_sync(p.withColumn("samples", F.col("size")), rate=48000, rows=r),
    "monotone": lambda p, r: G.monotone_output(
        p.withColumns({"rt_start": F.col("pts"), "rt_stop": F.col("pts") + 35000}), order="seq", rows=r),
    "clock": lambda p, r: G.clock_filter(
        p.withColumns({"time": F.col("pts").cast("double"), "step": F.lit(1.0)}), period=40000.0, factor2=0.2, factor3=0.02, rows=r),
    "vbv": lambda p, r: G.vbv_audit(p.withColumn("bits", F.col("size") * 8), size=60000, min_rate=0, max_rate=400000, fps=25.0, order="seq", rows=r),
    "rate": lambda p, r: G.data_rate(p.withColumns({"t_ms": F.col("seq") * 900, "bytes_total": F.col("seq") * 1000}), rows=r),
    "blocks": lambda p, r: G.audio_block_times(p.withColumn("rt_start", F.col("dts") * 10), bytes_per_second=192000, rows=r),
    "iir": lambda p, r: G.iir_lowpass(p.withColumn("x", F.col("size").cast("int")), order=4, cutoff=0.4, by="seq", rows=r),
    "repair": lambda p, r: G.repair_delayed(p, rows=r),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_chunks_equal_one_pass(spark, name):
    p = packets(spark).cache()
    whole = sorted(map(str, CASES[name](p, 10_000).collect()))
    if name == "clock":  # sums of products come out in another order
        near = lambda rows: [tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in sorted(rows, key=lambda r: (r["stream_id"], r["seq"]))]
        assert near(CASES[name](p, 25).collect()) == near(CASES[name](p, 10_000).collect())
        return
    assert sorted(map(str, CASES[name](p, 25).collect())) == whole


def test_rtp_chunks(spark):
    rng = random.Random(5)
    rows, seq = [], 65500
    for i in range(200):
        seq = (seq + rng.choice([1, 1, 1, 1, 2, 0, 5000 if rng.random() < 0.1 else 1])) % 65536
        rows.append((7, i, seq))
    df = spark.createDataFrame(rows, "ssrc bigint, arrival_no bigint, seq int")
    a = sorted(map(str, G.rtp_sequence(df, rows=10_000).collect()))
    assert sorted(map(str, G.rtp_sequence(df, rows=20).collect())) == a


def test_rtp_rules():
    fold = G.rtp_fold()
    _, out = fold(None, {"seq": [10, 11, 12, 14, 13, 9000, 9001, 65535, 0]})
    assert out["valid"] == [False, True, True, True, True, False, True, False, True]
    # 9001 follows the suspected restart, so counting begins there.
    assert out["base"][6] == 9000 and out["received"][6] == 1
    _, wrap = fold(None, {"seq": [65533, 65534, 65535, 0, 1]})
    assert wrap["ext_seq"][-1] == 65537


def test_reorder_buffer_equals_sorted_times():
    order = [0, 4, 1, 2, 3, 8, 5, 6, 7]
    _, out = G.reorder_fold(3)(None, {"pts": [x * 10 for x in order], "duration": [10] * 9})
    assert out["dts_out"] == [-30, -20, -10, 0, 10, 20, 30, 40, 50]


def test_video_sync_duplicates_and_drops():
    _, out = G.video_sync_fold(25.0, "cfr")(None, {"pts": [0, 40000, 200000, 210000, 220000, 230000]})
    assert out["nb_frames"] == [1, 1, 3, 1, 1, 0]
    assert out["out_no"] == [0, 1, 2, 5, 6, 7]


def test_butterworth_passes_dc_and_blocks_nyquist():
    fold = G.iir_fold(4, 0.2)
    _, dc = fold(None, {"x": [10000] * 400})
    assert abs(dc["y"][-1] - 10000) <= 1
    _, ny = fold(None, {"x": [10000 * (-1) ** i for i in range(400)]})
    assert abs(ny["y"][-1]) <= 1


def test_clock_filter_follows_line():
    _, out = G.clock_fold(1000.0, 0.1, 0.01)(None, {"time": [i * 1000.0 for i in range(50)], "step": [1.0] * 50})
    assert math.isclose(out["smooth_time"][-1], 49000.0)


def test_vbv_stuffing():
    _, out = G.vbv_fold(1000, 500, 800, 0, 900.0)(None, {"bits": [100, 0, 5000]})
    assert out["stuffing"][0] == math.ceil(300 / 8)
    assert out["underflow"] == [False, False, True]


def test_audio_sync_inserts_and_discards():
    _, out = G.audio_sync_fold(48000, 0.1, 1)(None, {"pts": [1_000_000, 1_020_000, 100_000], "samples": [960, 960, 960]})
    assert out["silence"][0] == 48000 and out["dropped"][1] == 0 and out["dropped"][2] == 960


def test_rounds_of_the_sequence_check_do_not_grow(spark, monkeypatch):
    rng = random.Random(3)
    seqs, at = [], 65000
    for i in range(1600):
        at += 4000 if i == 700 else rng.choice([1, 1, 1, 2])
        seqs.append((0, i, (at - rng.choice([0, 0, 0, 5])) % 65536))
    df = spark.createDataFrame(seqs, "ssrc bigint, arrival_no bigint, seq int")
    written = []
    real = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda d: written.append(1) or real(d))
    results, rounds = [], []
    for rows in (160, 40):
        written.clear()
        results.append(sorted(map(tuple, G.rtp_sequence(df, rows=rows).collect())))
        rounds.append(len(written))
    assert results[0] == results[1] and rounds[0] == rounds[1] <= 5
    _, once = G.rtp_fold()(None, {"seq": [s for _, _, s in seqs]})
    assert [r[3:] for r in results[0]] == list(zip(once["valid"], once["ext_seq"], once["base"], once["received"]))


def video_by_hand(times, fps, method):
    """One picture after the other, by the lead over the count."""
    count, out = 0, []
    for t in times:
        lead = 0.0 if t is None else t / 1e6 * fps - count
        shown, at = 1, count
        if t is not None and method == "passthrough":
            at = round(t / 1e6 * fps)
        elif method == "cfr":
            shown = 1 if abs(lead) <= 1.1 else max(0, round(lead))
        elif t is not None:
            shown, at = (0, count) if lead <= -0.6 else (1, round(t / 1e6 * fps) if lead > 0.6 else count)
        out.append((shown, at))
        count = at + shown
    return out


def audio_by_hand(rows, rate, drift, method):
    count, starting, out = 0, True, []
    for t, n in rows:
        lead = 0.0 if t is None else t / 1e6 * rate - count
        cut = add = pull = 0
        if abs(lead) > 50 and (starting or abs(lead) > drift * rate):
            cut, add = (min(int(-lead), n), 0) if lead < 0 else (0, int(lead))
            starting = starting and n - cut <= 0
        elif abs(lead) > 50 and method > 1:
            pull = int(max(-method, min(method, lead)))
        out.append((cut, add, pull, n - cut + add))
        count += n - cut + add
    return out


def some_times(rng, n):
    """Regular, jittered, missing, half-way, stalled and jumping times, also backwards."""
    t, out = rng.choice([0, -200000, 500000]), []
    for _ in range(n):
        t += rng.choice([40000, 40000, 20000, 60000, 0, rng.randint(-70000, 120000), rng.choice([40000, 900000, -700000])])
        out.append(None if rng.random() < 0.05 else t)
    return out


@pytest.mark.parametrize("method", ["cfr", "vfr", "passthrough"])
def test_video_rules_and_their_maps(method):
    rng = random.Random(8)
    for _ in range(60):
        times = some_times(rng, 60)
        end, out = G.video_sync_fold(25.0, method)(None, {"pts": times})
        assert list(zip(out["nb_frames"], out["out_no"])) == video_by_hand(times, 25.0, method)
        pieces = G.counted_map(G._video_rules(25.0, method), zip(times), [False], 2)
        for start in [0, 1, 2, 7, 8, 9, 30, 31, 1000, -5, *range(10, 30)]:
            state, _ = G.video_sync_fold(25.0, method)([start], {"pts": times})
            assert G.counted_end(pieces, start, False, 2)[0] == state[0], (start, times)
        assert len(pieces) < 60 and end == G.video_sync_fold(25.0, method)([0], {"pts": times})[0]


def test_audio_rules_and_their_maps():
    rng = random.Random(9)
    for _ in range(60):
        rows = [(t, rng.choice([0, 960, 960, 1024, 100])) for t in some_times(rng, 50)]
        cols = {"pts": [t for t, _ in rows], "samples": [n for _, n in rows]}
        for drift, method in ((0.1, 1), (0.1, 3), (0.0005, 2)):
            fold = G.audio_sync_fold(48000, drift, method)
            _, out = fold(None, cols)
            assert list(zip(*out.values())) == audio_by_hand(rows, 48000, drift, method)
            pieces = G.counted_map(G._audio_rules(48000, drift), zip(*cols.values()), [False, True])
            for start in (0, 40, 960, 5000, 20000, 48000, 10**7, -3000, rng.randint(0, 90000)):
                for starting in (False, True):
                    end = fold([start, starting], cols)[0]
                    assert list(G.counted_end(pieces, start, starting)) == end
                    few = G.counted_map(G._audio_rules(48000, drift), zip(*cols.values()), [False, True], top=start)
                    assert list(G.counted_end(few, start, starting)) == end and len(few) <= len(pieces)


def test_regular_times_have_small_maps():
    pieces = G.counted_map(G._video_rules(25.0, "cfr"), (((i * 40000),) for i in range(5000)), [False], 2)
    assert len(pieces) <= 10
    few, pieces = (G.counted_map(G._audio_rules(48000, 0.1), ((i * 20000, 960) for i in range(n)), [False, True], top=20000) for n in (500, 5000))
    assert len(few) == len(pieces) < 100
    # Starts above it that a row catches up with are left out; those that none reaches are there.
    assert G.counted_end(pieces, 1_000_000, False) is None and G.counted_end(pieces, 10**9, False) == (10**9, False)


def test_a_clock_that_catches_up_costs_one_more_pass(spark, monkeypatch):
    """Time jumps back in one chunk, whole chunks are dropped after it, and a later one catches up."""
    from mediaspark.operators import maps

    times = [i * 20000 for i in range(300)] + [i * 20000 for i in range(100, 500)]
    rows = [(0, 0, i, t, 960) for i, t in enumerate(times)]
    p = spark.createDataFrame(rows, "stream_id bigint, stream_index int, seq bigint, pts bigint, samples bigint")
    written = []
    real = maps.cut_lineage
    monkeypatch.setattr(maps, "cut_lineage", lambda d: written.append(1) or real(d))
    got = [tuple(r) for r in G.audio_sync(p, rate=48000, rows=40).orderBy("seq").select("dropped", "silence", "compensation", "out_samples").collect()]
    assert got == audio_by_hand([(t, 960) for t in times], 48000, 0.1, 1) and len(written) == 4


@pytest.mark.parametrize("name", ["video_cfr", "video_vfr", "audio", "clock"])
def test_passes_of_mapped_folds_do_not_grow(spark, monkeypatch, name):
    """The same number of written frames for 10 and 40 chunks, and the result of one pass from the beginning."""
    from mediaspark.operators import maps

    p = packets(spark, n=800, seed=4).filter("stream_id = 0")
    if name == "audio":  # packets of the length their times are apart, off by up to 80 ms
        p = p.withColumns({"pts": F.col("seq") * 40000 + F.col("pts") % 80000, "size": F.lit(1920).cast("bigint")})
    p = p.cache()
    written = []
    real = maps.cut_lineage
    monkeypatch.setattr(maps, "cut_lineage", lambda d: written.append(1) or real(d))
    results, rounds = [], []
    for rows in (80, 20, 10_000):
        written.clear()
        results.append(sorted(map(tuple, CASES[name](p, rows).collect()), key=lambda r: r[2]))
        rounds.append(len(written))
    assert rounds[0] == rounds[1] == 2
    if name != "clock":
        assert results[0] == results[1] == results[2]
    else:
        for a, b, c in zip(*results, strict=True):
            assert a[:-1] == b[:-1] == c[:-1] and math.isclose(a[-1], c[-1], rel_tol=1e-9) and math.isclose(b[-1], c[-1], rel_tol=1e-9)
