"""Picture and field operators against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaspark.operators import fields as E
from mediaspark.operators import lines as L


def pictures(spark, n=6, h=16, w=24, seed=1, step=9):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (n, h, w))
    for i in range(1, n):
        a[i] = np.clip(a[i - 1] + rng.integers(-step, step + 1, (h, w)), 0, 255)
    rows = [(0, f, "Y", y, a[f, y].tolist()) for f in range(n) for y in range(h)]
    return a, spark.createDataFrame(rows, "stream_id bigint, frame_no bigint, plane string, line_no bigint, px array<int>")


def grid(df, a):
    out = np.full(a.shape, -1)
    for r in df.collect():
        out[r.frame_no, r.line_no] = r.px
    return out


def state_machine(hints):
    """Lock on, check the phase of every field, fall back and re-test."""
    kind, idx, out = "FULLRATE", 0, []
    five = ["NEXT_22", "PREV_22", "AFTERNEXT_32", "NEXT_32", "PREV_32"]
    two = ["NEXT_22", "PREV_22"]
    for n, h in enumerate(hints):
        if kind == "PULLDOWN_32" and h != five[(n + idx) % 5]:
            kind, idx = "FULLRATE", 0
        elif kind == "PULLDOWN_22" and h != two[(n + idx) % 2]:
            kind, idx = "FULLRATE", 0
        if kind == "FULLRATE":
            if h == "AFTERNEXT_32":
                kind, idx = "PULLDOWN_32", (7 - n % 5) % 5
            elif h == "NEXT_22":
                kind, idx = "PULLDOWN_22", n % 2
        out.append((kind, idx))
    return out


@pytest.mark.parametrize("rows", [5, 1000])
def test_film_detection_equals_state_machine(spark, rows):
    rng = random.Random(8)
    names = list(E.HINTS) + [None]
    streams = [list(p) for p in itertools.product(names, repeat=4)][::3]
    streams += [[rng.choice(names) if rng.random() < 0.2 else E.HINTS[(i + s) % 5] for i in range(40)] for s in range(30)]
    data = [(s, i, h) for s, hs in enumerate(streams) for i, h in enumerate(hs)]
    out = E.detect_film(spark.createDataFrame(data, "stream_id int, field_no bigint, hint string"), rows=rows)
    got = {(r.stream_id, r.field_no): (r.cadence, r.cadence_index) for r in out.collect()}
    for s, hs in enumerate(streams):
        assert [got[(s, i)] for i in range(len(hs))] == state_machine(hs)


@pytest.mark.parametrize("rows", [3, 1000])
def test_cadence_flag_equals_loop(spark, rows):
    rng = random.Random(3)
    data = [(0, i, rng.choice([2, 3]), rng.random() < 0.8) for i in range(80)]
    out = E.cadence_flag(spark.createDataFrame(data, "stream_id int, frame_no bigint, nb_fields int, progressive boolean"), rows=rows)
    got = [r.film for r in out.orderBy("frame_no").collect()]
    film, last, want = False, None, []
    for _, _, nb, prog in data:
        if last is not None:
            if prog:
                if not film and nb == 3 and last[0] != 3:
                    film = True
                elif film and nb != 3 and last[0] != 3:
                    film = False
            elif film and (last[0] != 3 or not last[1] or nb > 2):
                film = False
        last = (nb, prog)
        want.append(film)
    assert got == want


@pytest.mark.parametrize("rows", [140, 100_000])
def test_movement_counter_is_capped(spark, rows):
    a = np.full((300, 1, 4), 50)
    a[:, 0, 1] = np.arange(300) % 200
    a[200, 0, 2] = 90
    data = [(0, f, "Y", 0, a[f, 0].tolist()) for f in range(300)]
    df = spark.createDataFrame(data, "stream_id int, frame_no bigint, plane string, line_no bigint, px array<int>")
    got = {r.frame_no: r.still for r in L.movement_map(df, rows=rows).collect()}
    assert got[0] == [0, 0, 0, 0] and got[100][0] == 100 and got[299][0] == 127
    assert got[199][2] == 127 and got[200][2] == 0 and got[201][2] == 0 and got[250][2] == 49


@pytest.mark.parametrize("rows", [2, 1000])
def test_temporal_denoise_equals_block_loop(spark, rows):
    a, df = pictures(spark, n=5, h=16, w=24, step=6)
    got = grid(L.temporal_denoise(df, rows=rows), a)
    mean, past = np.zeros((16, 24), dtype=int), np.zeros((4, 5), dtype=int)
    for f in range(5):
        cur = a[f].copy()
        for by in range(2):
            for bx in range(3):
                s = np.s_[by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8]
                sse = int(((mean[s] - cur[s]) ** 2).sum())
                y, x = by + 1, bx + 1
                d = (4 * sse + past[y - 1, x] + past[y, x - 1] + past[y, x + 1] + past[y + 1, x] + 4) >> 3
                past[y, x] = sse
                if d > 1500:
                    v = (mean[s] + cur[s] + 1) >> 1 if d < 3000 else cur[s]
                else:
                    v = (mean[s] * 7 + cur[s] + 4) >> 3 if d < 700 else (mean[s] * 3 + cur[s] + 2) >> 2
                mean[s] = cur[s] = v
        assert (got[f] == cur).all()


def test_weave_interleaves_neighbouring_fields(spark):
    data = [(0, n, "Y", k, n % 2 == 0, [n * 10 + k]) for n in range(4) for k in range(2)]
    df = spark.createDataFrame(data, "stream_id int, field_no bigint, plane string, line_no bigint, is_top boolean, px array<int>")
    got = {(r.field_no, r.line_no): r.px[0] for r in L.weave(df).collect()}
    assert {k: got[(1, k)] for k in range(4)} == {0: 0, 1: 10, 2: 1, 3: 11}
    assert {k: got[(2, k)] for k in range(4)} == {0: 20, 1: 10, 2: 21, 3: 11}
    assert not any(n == 0 for n, _ in got)


def test_constant_picture_is_left_alone(spark):
    data = [(0, 0, "Y", y, [77] * 20) for y in range(10)]
    df = spark.createDataFrame(data, "stream_id int, frame_no bigint, plane string, line_no bigint, px array<int>")
    for f in (L.deint_linear, L.deint_cubic, L.deint_ff, L.deint_lowpass5, L.deint_blend, L.deint_median):
        assert all(r.px == [77] * 20 for r in f(df).collect())
    assert all(r.px == [77] * 13 for r in L.scale(df, 20, 10, 13, 7).collect())
    assert all(r.px == [77] * 10 for r in L.shrink(df, 2).collect())


def python_weights(source, target, kernel, reach):
    wide = max(source / target, 1.0)
    out = np.zeros((target, source))
    for t in range(target):
        centre = (t + 0.5) * source / target - 0.5
        for p in range(-8 * source, 9 * source):
            if abs(p - centre) / wide < reach:
                out[t, min(max(p, 0), source - 1)] += kernel(abs(p - centre) / wide)
    return out / out.sum(axis=1, keepdims=True)


def cubic(d):
    return (1.5 * d - 2.5) * d * d + 1 if d <= 1 else ((2.5 - 0.5 * d) * d - 4) * d + 2


KERNELS = [
    (lambda d: 1 - d, lambda d: 1 - d, 1),
    (lambda d: F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1).otherwise(((2.5 - 0.5 * d) * d - 4) * d + 2), cubic, 2),
    (lambda d: F.exp(-2 * d * d), lambda d: np.exp(-2 * d * d), 3),
]


@pytest.mark.parametrize("kernel", range(len(KERNELS)))
@pytest.mark.parametrize("width,height", [(24, 16), (37, 9), (5, 30)])
def test_scale_by_kernel_matches_matrices(spark, kernel, width, height):
    column, plain, reach = KERNELS[kernel]
    a, df = pictures(spark, n=2)
    got = L.scale_by_kernel(df, 24, 16, width, height, column, reach)
    want = np.clip(np.einsum("ty,fyx,sx->fts", python_weights(16, height, plain, reach), a, python_weights(24, width, plain, reach)), 0, 255)
    got = grid(got, np.zeros((2, height, width)))
    assert np.abs(got - want).max() < 0.6
    if (width, height) == (24, 16) and kernel < 2:
        assert (got == a).all()


def test_kernel_weights_add_up(spark):
    for column, _, reach in KERNELS:
        for source, target in ((64, 40), (1, 7), (7, 1)):
            sums = {}
            for r in L.kernel_weights(spark, source, target, column, reach).collect():
                assert 0 <= r.i < source
                sums[r.t] = sums.get(r.t, 0) + r.w
            assert sums == {t: 1 << 14 for t in range(target)}
    with pytest.raises(Exception, match="more than 0"):
        L.kernel_weights(spark, 4, 4, lambda d: d * 0, 1).collect()


def test_crop_refuses_rectangles_outside(spark):
    _, df = pictures(spark, n=1)
    with pytest.raises(ValueError):
        L.crop(df, 0, 0, 30, 4, height=16, width=24)
    assert L.crop(df, 8, 4, 0, 0, height=16, width=24).count() == 12


def test_map_fields_keeps_edges(spark):
    a, df = pictures(spark, n=4)
    out = L.map_fields(df, lambda st: st.max(axis=0), buffered=2, order="frame_no", rows=2)
    got = grid(out, a)
    assert (got[0] == a[0]).all() and (got[3] == np.maximum(a[3], a[2])).all()


def test_auto_levels_without_clipping(spark):
    df = spark.createDataFrame([(0, 0, 40, 30), (0, 0, 200, 20)], "stream_id int, frame_no int, v int, n bigint")
    r = L.auto_levels(df).collect()[0]
    assert (r.black, r.white) == (0, 256)


def test_apply_levels_stretches(spark):
    df = spark.createDataFrame([(0, 0, "Y", 0, [50, 100, 250])], "stream_id int, frame_no int, plane string, line_no int, px array<int>")
    lv = spark.createDataFrame([(0, 0, 50, 2.0)], "stream_id int, frame_no int, black int, scale double")
    assert L.apply_levels(df, lv).collect()[0].px == [16, 116, 255]
