"""Audio filters, transport parsing, captions and raw sources."""

import itertools
import math
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaspark.operators import audio as A
from mediaspark.operators import cues as C
from mediaspark.operators import stats as S
from mediaspark.operators import transport as T
from mediaspark.sources import files as Fi
from mediaspark.sources import generators as Gen
from mediaspark.sources import raw as R
from mediaspark.sources import sinks as W


def samples(spark, n=400, seed=1):
    x = np.random.default_rng(seed).integers(-20000, 20000, n)
    return x, spark.createDataFrame([(0, i, int(v)) for i, v in enumerate(x)], "stream_id int, sample_no bigint, x int")


@pytest.mark.parametrize("rates", [(44100, 32000), (32000, 48000), (48000, 8000)])
@pytest.mark.parametrize("linear", [False, True])
def test_resample_equals_loop_at_any_block_size(spark, rates, linear):
    x, df = samples(spark)
    i_rate, o_rate = rates
    taps, shift, cutoff = 8, 4, 0.8
    length = max(int(np.ceil(taps / min(o_rate * cutoff / i_rate, 1.0))), 1)
    bank = A.filter_bank(min(o_rate * cutoff / i_rate, 1.0), length, 1 << shift, 1 << 15, 9)
    def output(j):
        """Sample j by its exact position; None where its taps end behind the input."""
        exact = Fraction(j * i_rate * (1 << shift), o_rate)
        place = math.floor(exact) - (1 << shift) * ((length - 1) // 2)
        begin, phase = divmod(place, 1 << shift)
        if begin >= 0 and begin + length > len(x):
            return None
        seen = [int(x[abs(begin + k) % len(x)]) for k in range(length)]
        value = int(np.dot(seen, bank[phase]))
        if linear and begin >= 0:
            other = int(np.dot(seen, bank[phase + 1]))
            value += math.trunc((other - value) * (exact - math.floor(exact)))
        return int(np.clip((value + (1 << 14)) >> 15, -32768, 32767))

    want = list(itertools.takewhile(lambda v: v is not None, map(output, itertools.count())))
    for rows in (64, 1 << 16):
        out = A.resample(df, i_rate, o_rate, taps=taps, phase_shift=shift, linear=linear, rows=rows)
        assert [r.x for r in out.orderBy("sample_no").collect()] == want


def test_convolve_blocks(spark):
    x, df = samples(spark)
    h = [0.5, -0.25, 0.125]
    want = np.convolve(x, h)[: len(x)]
    got = [r.x for r in A.convolve(df, h, rows=32).orderBy("sample_no").collect()]
    assert np.allclose(got, want)


def test_filter_banks_keep_level():
    for kind in (0, 1, 9):
        bank = A.filter_bank(0.5, 16, 8, 1 << 15, kind)
        assert np.all(np.abs(bank[:-1].sum(axis=1) - (1 << 15)) <= 16)


def test_crc_known_value():
    assert T.crc32_mpeg(b"123456789") == 0x0376E6E7


def section(table_id, ext, version, no, last, payload, tamper=False):
    body = struct.pack(">HBBB", ext, 0xC1 | version << 1, no, last) + payload
    head = bytes([table_id]) + struct.pack(">H", 0xB000 | len(body) + 4) + body
    crc = T.crc32_mpeg(head) ^ (1 if tamper else 0)
    return head + crc.to_bytes(4, "big")


def packetize(pid, units, cc=0):
    """Sections back to back: the tail of one shares a packet with the next start."""
    out, stream, starts = [], b"", []
    for u in units:
        starts.append(len(stream))
        stream += u
    at = 0
    while at < len(stream):
        nxt = [s for s in starts if at <= s < at + 183]
        if nxt:
            piece = stream[at : at + 183]
            later = [s for s in starts if s > nxt[0]]
            if later and later[0] < at + 183:
                piece = stream[at : later[0]]
            payload = bytes([nxt[0] - at]) + piece
            pusi = 0x40
            used = len(piece)
        else:
            payload, pusi = stream[at : at + 184], 0
            used = len(payload)
        out.append(bytes([0x47, pusi | pid >> 8, pid & 255, 0x10 | cc % 16]) + payload.ljust(184, b"\xff"))
        cc += 1
        at += used
    return out


def ts_frame(spark, packets):
    df = spark.createDataFrame([(0, i, bytearray(p)) for i, p in enumerate(packets)], "stream_id int, packet_no bigint, data binary")
    return T.parse_header(df)


@pytest.mark.parametrize("rows", [3, 1000])
def test_sections_across_packets(spark, rows):
    want = [section(0, 7, 1, i, 3, bytes([i]) * n) for i, n in enumerate((20, 500, 183, 400))]
    df = ts_frame(spark, packetize(17, want))
    got = T.assemble_sections(df, rows=rows).orderBy("first_packet").collect()
    assert [(r.section_no, len(r.payload)) for r in got] == [(0, 20), (1, 500), (2, 183), (3, 400)]
    assert all(r.table_id == 0 and r.extension == 7 and r.version == 1 and r.last_no == 3 for r in got)


def test_lost_packet_and_bad_crc_drop_a_section(spark):
    ps = packetize(17, [section(0, 7, 1, 0, 0, b"a" * 500), section(0, 7, 1, 1, 1, b"b" * 30, tamper=True), section(0, 7, 1, 2, 2, b"c" * 30)])
    assert [r.section_no for r in T.assemble_sections(ts_frame(spark, ps)).orderBy("first_packet").collect()] == [0, 2]
    del ps[1]
    assert [r.section_no for r in T.assemble_sections(ts_frame(spark, ps)).orderBy("first_packet").collect()] == [2]


def test_pes_units(spark):
    def unit(fill, size):
        return b"\x00\x00\x01\xe0" + struct.pack(">H", size - 6) + bytes([fill]) * (size - 6)

    packets, cc = [], 0
    for fill, size in ((1, 300), (2, 500), (3, 100)):
        u = unit(fill, size)
        for k in range(0, len(u), 184):
            packets.append(bytes([0x47, (0x40 if k == 0 else 0) | 1, 0, 0x10 | cc % 16]) + u[k : k + 184].ljust(184, b"\0"))
            cc += 1
    got = [len(r.data) for r in T.assemble_pes(ts_frame(spark, packets)).orderBy("first_packet").collect()]
    assert got == [300, 500, 100]
    del packets[3]
    got = [len(r.data) for r in T.assemble_pes(ts_frame(spark, packets)).orderBy("first_packet").collect()]
    assert got == [300, 100]


def test_programs_end_to_end(spark):
    pat = section(0, 1, 0, 0, 0, struct.pack(">HHHH", 0, 0xE010, 5, 0xE100))
    es = [(2, 0x101), (3, 0x102), (129, 0x103), (4, 0x104)]
    pmt = section(2, 5, 0, 0, 0, struct.pack(">HH", 0xE101, 0xF000) + b"".join(struct.pack(">BHH", t, 0xE000 | p, 0xF002) + b"\x0a\x00" for t, p in es))
    df = ts_frame(spark, packetize(0, [pat]) + packetize(0x100, [pmt]))
    sec = T.assemble_sections(df)
    programs = T.pat_programs(sec.filter("pid = 0")).select("program", "pmt_pid")
    streams = T.pmt_streams(sec.filter("table_id = 2").withColumnRenamed("extension", "program").select("program", "payload"))
    r = T.program_map(programs, streams).collect()
    assert [(x.program, x.pmt_pid, x.video_pid, x.audio_pid, x.audio_type) for x in r] == [(5, 0x100, 0x101, 0x103, 129)]


def test_services(spark):
    payload = b"\0\1\xff" + struct.pack(">HBBB", 9, 0xFE, 0x90, 2) + b"\x48\x00" + struct.pack(">HBBB", 10, 0xFD, 0x80, 0)
    df = spark.createDataFrame([(bytearray(payload),)], "payload binary")
    got = [(r.service_id, r.eit_schedule, r.eit_present, r.running_status, r.free_ca) for r in T.sdt_services(df).collect()]
    assert got == [(9, True, False, 4, True), (10, False, True, 4, False)]


def test_tables_restart_on_version_change(spark):
    rows = [(0, "v1s0"), (1, "v1s1"), (0, "v2s0"), (0, "v2s0b"), (1, "v2s1"), (0, "late")]
    vers = [1, 1, 2, 2, 2, 2]
    data = [(1, 0, 0, v, s, 1, i + 1, p) for i, ((s, p), v) in enumerate(zip(rows, vers))]
    df = spark.createDataFrame(data, "pid int, table_id int, extension int, version int, section_no int, last_no int, seq bigint, payload string")
    got = [(r.version, r.payloads) for r in T.complete_tables(df, rows=2).orderBy("version").collect()]
    assert got == [(1, ["v1s0", "v1s1"]), (2, ["v2s0b", "v2s1"])]


def test_blocks_with_unaligned_sync_are_pcm():
    assert A.classify_block(b"\0" + A.DTS_SYNCS[0] + b"\0\0\0") == "PCM"
    assert A.classify_block(b"\0\0" + A.BURST + b"\x01\x00") == "AC3"
    assert A.classify_block(A.BURST + b"\x05\x00") == "SILENCE"


def test_ts_scan_in_ranges_drops_short_record(spark, tmp_path):
    p = packetize(300, [section(0, i, 0, 0, 0, bytes([i]) * 150) for i in range(25)])
    (tmp_path / "a.ts").write_bytes(b"".join(p) + b"\x47short")
    out = R.scan_ts(spark, str(tmp_path), range_bytes=188 * 4)
    assert out.rdd.getNumPartitions() > 5
    assert [r.packet_no for r in out.orderBy("packet_no").collect()] == list(range(len(p)))
    assert T.assemble_sections(out.withColumn("stream_id", F.col("path"))).count() == 25


@pytest.mark.parametrize("fmt", sorted(R.pcm_formats()))
def test_every_pcm_layout(spark, tmp_path, fmt):
    width, decode = R.pcm_formats()[fmt]
    raw = bytes((i * 37 + 11) % 256 for i in range(width * 2 * 6)) if not fmt.startswith("f") else np.arange(12).astype((">" if fmt.endswith("be") else "<") + "f" + str(width)).tobytes()
    f = tmp_path / "x.pcm"
    f.write_bytes(raw)
    got = [v for r in R.scan_pcm(spark, str(f), fmt, 2, range_bytes=width * 4).orderBy("sample_no").collect() for v in r.ch]
    assert got == [float(v) for v in decode(raw)]


def test_known_companded_values():
    a, u = R.pcm_formats()["alaw"][1], R.pcm_formats()["mulaw"][1]
    assert list(a(bytes([0xD5, 0x55, 0xAA, 0x2A]))) == [8, -8, 32256, -32256]
    assert list(u(bytes([0xFF, 0x7F, 0x80, 0x00]))) == [0, 0, 32124, -32124]


def test_noise_is_one_sequence(spark):
    got = [r.x for r in Gen.gen_noise(spark, 1000).orderBy("sample_no").collect()]
    s, want = 1, []
    for _ in range(1000):
        s = (s * 314159 + 1) % 2**32
        want.append(s % 20000 - 10000)
    assert got == want


def test_tone_and_chirp(spark):
    t = [r.x for r in Gen.gen_tone(spark, 100).orderBy("sample_no").collect()]
    assert t[0] == 10000 and abs(t[22] + 10000) < 20
    c1 = [r.x for r in Gen.gen_chirp(spark, 300, rows=16).orderBy("sample_no").collect()]
    assert c1 == [r.x for r in Gen.gen_chirp(spark, 300).orderBy("sample_no").collect()]


def test_caption_script(spark, tmp_path):
    text = "[Script Info]\nTitle: x\n[Events]\nFormat: a\nDialogue: 0,0:00:05.50,0:00:06.00,late\nnote\nDialogue: 0,0:00:01.25,0:00:02.00,early\n[Fonts]\nDialogue: 0,0:00:03.00,0,not an event\n"
    (tmp_path / "a.ass").write_text(text)
    got = [(r.event_no, r.pts, r.line.split(",")[-1]) for r in Fi.scan_caption_script(spark, str(tmp_path)).orderBy("event_no").collect()]
    assert got == [(1, 125, "early"), (2, 550, "late")]


def test_numbered_run_ends_at_gap(spark):
    df = spark.createDataFrame([(f"/d/p{i:02d}.png",) for i in (1, 2, 3, 5, 6)] + [("/d/q9.png",)], "filename string")
    assert sorted(r.idx for r in Fi.numbered_run(df, "p%02d.png").collect()) == [1, 2, 3]
    late = spark.createDataFrame([("/d/p07.png",)], "filename string")
    assert Fi.numbered_run(late, "p%02d.png").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 5, 100, 3, True, bytearray(b"abc")), (0, 1, 6, 101, 0, False, bytearray(b""))],
                               "stream_id int, stream_index int, seq bigint, pts bigint, size bigint, is_key boolean, data binary")
    df = df.withColumn("dts", F.col("pts"))
    W.write_frame_manifest(df, str(tmp_path / "m"))
    import zlib
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect())
    assert lines == [f"0, 100, 3, 0x{zlib.adler32(b'abc', 0):08x}", "1, 101, 0, 0x00000000"]
    W.write_packets(df, str(tmp_path / "p"), max_packets=1)
    assert [r.name for r in spark.read.parquet(str(tmp_path / "p")).collect()] == ["00005_00_100_3_K.bin"]
    W.sink_null(df)


def test_adler_equals_library(spark):
    import zlib

    from mediaspark.operators.packets import adler32

    data = bytes(range(256)) * 9
    df = spark.createDataFrame([(0, i, b) for i, b in enumerate(data)], "k int, i bigint, b int")
    for init in (0, 1):
        assert adler32(df, ["k"], "i", "b", init=init).collect()[0].adler32 == zlib.adler32(data, init)


def test_cues_without_time_are_joined_and_lost(spark):
    df = spark.createDataFrame([(0, 0, None, "lost"), (0, 1, 10, "a"), (0, 2, None, "b"), (0, 3, 10, "c"), (0, 4, 30, "d")], "stream_id int, seq bigint, start bigint, payload string")
    got = [(r.cue_no, r.start, r.stop, r.payload) for r in C.close_open_cues(df, rows=2).orderBy("cue_no").collect()]
    assert got == [(1, 10, None, "ab"), (2, 10, 30, "c"), (3, 30, None, "d")]


def test_pca_and_codebook(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) @ np.diag([5.0, 2.0, 0.5])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    rows = S.pca(df, "v", 3).orderBy("rank").collect()
    val, vec = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose([r.eigenvalue for r in rows], val[::-1])
    assert np.allclose(np.abs(rows[0].vector), np.abs(vec[:, -1]))
    codes, error = S.vq_codebook(df, 4, steps=8, gain=0.001)
    d = ((x[:, None] - codes[None]) ** 2).sum(axis=2)
    assert np.isclose(error, d.min(axis=1).sum())
    one = ((x - x.mean(axis=0)) ** 2).sum()
    assert error < one * 0.6


def test_least_squares_with_decay(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(60, 2))
    y = a @ [2.0, -1.0] + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(0, i, float(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, a))], "stream_id int, seq bigint, y double, a double, b double")
    r = {x.order: x for x in S.least_squares(df, "y", ["a", "b"], decay=0.9).collect()}
    w = 0.9 ** np.arange(59, -1, -1)
    want = np.linalg.solve((a.T * w) @ a, (a.T * w) @ y)
    assert np.allclose(r[2].coeff, want)
    assert np.isclose(r[2].variance, (w * (y - a @ want) ** 2).sum())


def test_size_predictor_equals_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, int(rng.integers(10, 999)), int(rng.integers(1, 31)), int(rng.integers(0, 60))) for i in range(40)]
    df = spark.createDataFrame(rows, "stream_id int, frame_no bigint, size bigint, q int, variance bigint")
    got = S.size_predictor(df, rows=7).collect()[0]
    coeff, count = 118 * 7.0, 1.0
    for _, _, size, q, var in rows:
        if var >= 10:
            coeff, count = coeff * 0.4 + size * q / (var + 1), count * 0.4 + 1
    assert np.isclose(got.coeff, coeff) and np.isclose(got["count"], count)


def test_lpc_order_equals_solved_systems(spark):
    rng = np.random.default_rng(5)
    blocks = []
    for k in range(12):
        x = rng.normal(size=64)
        for i in range(2, 64):
            x[i] += 0.3 * (k % 4) * x[i - 1] - 0.2 * (k % 3) * x[i - 2]
        blocks.append((k, x.tolist()))
    df = S.autocorr(spark.createDataFrame(blocks, "block int, x array<double>"), 6, window=False, start=0.0)
    for r in S.lpc_order(df).collect():
        a = np.array(r.autoc)
        want = 1
        for i in range(1, 7):
            system = np.array([[a[abs(p - q)] for q in range(i)] for p in range(i)])
            if abs(np.linalg.solve(system, a[1 : i + 1])[-1]) > 0.10:
                want = i
        assert r.lpc_order == want
