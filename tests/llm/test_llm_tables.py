"""Mixing, chat windows and revisits against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mediaspark.llm import chat, mixing, queries, warc

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string"


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, out, left = set(names), {}, share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(rng):
    rows = []
    for i in range(700):
        source = rng.choice(["hot"] * 6 + ["a", "B", "é", "z", None])
        rows.append((i if i % 50 else None, rng.choice([None, "", "w " * rng.randint(1, 200)]), "en", source))
    return rows + rows[:20]


@pytest.mark.parametrize("cell, options", [(mixing.CELL_ROWS, {}), (16, {"block_words": 64, "shard_blocks": 4})])
def test_mix_meets_its_targets(spark, monkeypatch, cell, options):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell)
    rows = corpus(random.Random(6))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("old")).withColumn("shard", F.lit(-1)).withColumn("cell", F.lit(7))
    out = mixing.mix_plan(df.repartition(7), **options).collect()
    assert len(out) == len(rows) and Counter((r["doc_id"], r["text"], r["source"]) for r in out) == Counter((i, t, s) for i, t, _, s in rows)
    sizes, most = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += n_words(t)
        most[s] = max(most[s], n_words(t))
    want, taken = targets(sizes), Counter()
    for r in out:
        assert r["size"] == n_words(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["taken"] == r["size"] * ((r["shard"] is not None) + (r["again"] is not None))
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    again = mixing.mix_plan(df.repartition(3), **options).collect()
    assert Counter((r["doc_id"], r["text"], r["source"], r["taken"]) for r in out) == Counter((r["doc_id"], r["text"], r["source"], r["taken"]) for r in again)


def test_mix_gives_a_row_per_copy(spark):
    rows = corpus(random.Random(9))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("old"))
    plan = mixing.mix_plan(df.drop("size"), block_words=64, shard_blocks=4).collect()
    out = mixing.mix(df, block_words=64, shard_blocks=4)
    assert out.columns == df.columns
    want = Counter()
    for r in plan:
        want[(r["doc_id"], r["text"], r["source"])] += (r["shard"] is not None) + (r["again"] is not None)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect()) == +want
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_plan(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None, None), (2, "", None, "a")], SCHEMA)
    assert [(r["target"], r["taken"]) for r in mixing.mix_plan(empty).collect()] == [(0.0, 0), (0.0, 0)]


def test_mix_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    sizes = defaultdict(int)
    for r in docs.values():
        sizes[r["source"]] += n_words(r["text"])
    want, taken = targets(sizes), Counter()
    for r in queries.QUERIES["op4_mix"](spark, DIR).collect():
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == n_words(docs[r["doc_id"]]["text"]) and r["target"] == pytest.approx(want[source])
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 * max(n_words(r["text"]) for r in docs.values() if r["source"] == s) + 1e-6 for s in sizes)


def test_the_tree_keeps_quotas_and_sizes(spark):
    quotas = [1000, 1, 0, 37, 250]
    root = spark.createDataFrame([(quotas,)], "counts array<bigint>")
    shares = []
    for seed in range(12):
        shards = sorted((r["shard"], r["counts"]) for r in mixing.split_quotas(root, 4, seed).collect())
        assert [s for s, _ in shards] == list(range(16))
        assert [sum(c[i] for _, c in shards) for i in range(5)] == quotas
        sizes = [sum(c) for _, c in shards]
        assert sum(sizes) == sum(quotas) and max(sizes) - min(sizes) <= 1 and all(x >= 0 for _, c in shards for x in c)
        shares += [c[4] for _, c in shards]
    # 80 or 81 draws from 1288 blocks of which 250 are marked: mean 15.6, deviation 3.4.
    mean = sum(shares) / len(shares)
    spread = (sum((x - mean) ** 2 for x in shares) / len(shares)) ** 0.5
    assert mean == pytest.approx(250 / 16) and 2.5 < spread < 4.4


def test_hypergeometric_draw_follows_its_law(spark):
    from math import comb

    sql = mixing._draw("pop", "marked", "n", "u")
    df = spark.range(4000).selectExpr("20L as pop", "7L as marked", "9L as n", "(id + 0.5D) / 4000 as u")
    got = Counter(r["x"] for r in df.selectExpr(f"{sql} as x").collect())
    for x in range(8):
        assert got[x] / 4000 == pytest.approx(comb(7, x) * comb(13, 9 - x) / comb(20, 9), abs=1e-3)


CHAT = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "a<", "|>", "\n\n", "", None, "<<|im_end|>|>", "é😀" * 40, "word " * 900, "\\", "\u0001"]


def conversations(rng):
    rows = []
    for conv in (1, 2, 3, None, -1):
        for turn in range({1: 1, 2: 90, 3: 12, None: 5, -1: 2}[conv]):
            role = "system" if turn == 0 and conv in (2, 3) else rng.choice(["user", "assistant", "assistant", "to\nol\\n", None, "<|im_end|>"])
            rows.append((conv, rng.choice([turn, turn, None]) if conv == 3 else turn, role, rng.choice([*NASTY, "say " * rng.randint(1, 120)])))
    return rows + rows[:3]


def told(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        # Roles and texts order by their escaped bytes; only ties of turn and role need it.
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode()))
        out[conv] = turns
    return out


@pytest.mark.parametrize("budget, cell", [(1024, chat.CELL_TURNS), (200, 4), (40, 1 << 12)])
def test_windows_read_back_whole(spark, monkeypatch, budget, cell):
    monkeypatch.setattr(chat, "CELL_TURNS", cell)
    rows = [r for r in conversations(random.Random(4))]
    df = spark.createDataFrame(rows, CHAT).withColumn("window", F.lit("old")).withColumn("tokens", F.lit(-1))
    windows = chat.format_windows(df.repartition(3), budget=budget)
    want = told(rows)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        assert r["n_turns"] == len(turns)
        pieces = Counter(f"{role}\n{text}\n" for _, _, role, text in turns)
        assert len(r["turns"]) == sum(len(p) * n for p, n in pieces.items())
        if len({t[:3] for t in turns}) == len(turns):
            assert r["turns"] == "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
            assert r["loss"] == "".join(text for _, _, role, text in turns if role == "assistant")
        assert len(r["loss"]) == sum(len(text) for _, _, role, text in turns if role == "assistant")
    for r in windows.collect():
        assert r["text"].count(chat.START) == r["turns"] == r["text"].count(chat.END) and r["chars"] == len(r["text"])
        parts = r["text"].split(chat.START)[1:]
        tokens = [-(-len(p.split("\n", 1)[1][: -len(chat.END) - 1].encode()) // 3) + 8 for p in parts]
        assert sum(tokens) <= budget or r["turns"] - r["fresh"] == 1 or sum(tokens[r["fresh"] :]) <= budget // 2
        if r["fresh"] and sum(tokens) > budget:  # only the system turn may stand before a fresh part that fills the budget
            assert r["fresh"] == 1 and parts[0].startswith("system\n")
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_history_and_system_turn_are_repeated_and_masked(spark):
    rows = [(7, 0, "system", "Be kind.")] + [(7, i, "user" if i % 2 else "assistant", f"turn {i} " + "x" * 60) for i in range(1, 20)]
    windows = sorted(chat.format_windows(spark.createDataFrame(rows, CHAT), budget=200).collect(), key=lambda r: r["window"])
    assert len(windows) > 3
    for r in windows[1:]:
        assert r["text"].startswith("<|im_start|>system\nBe kind.<|im_end|>\n") and r["fresh"] == 3
        masked = "".join(r["text"][s["start"] : s["start"] + s["length"]] for s in r["loss"])
        assert masked.count("turn") == sum(p.startswith("assistant") for p in r["text"].split(chat.START)[1 + r["fresh"] :])


def test_chat_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{DIR}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", NASTY[0]), (-1, 1, "assistant", NASTY[0])]
    want = told(rows)
    got = {r["conv_id"]: r for r in queries.QUERIES["op5_chat_windows"](spark, DIR).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        text = "".join(f"{role}\n{said}\n" for _, _, role, said in turns)
        loss = "".join(said for _, _, role, said in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        )


CAPTURES = "record_id bigint, url string, at bigint, kind string, status int, headers map<string,string>, digest string"


def resolved(rows):
    out = {}
    for i, url, at, kind, _, headers, digest in rows:
        if kind != "revisit":
            continue
        page = None if url is None else re.sub(r"^https?://(www\.)?", "", url.lower()).split("#")[0].rstrip("/")
        same = [r for r in rows if r[3] == "response" and r[4] == 200 and r[2] is not None and at is not None and r[2] < at and r[1] is not None and page is not None and re.sub(r"^https?://(www\.)?", "", r[1].lower()).split("#")[0].rstrip("/") == page]
        if not same:
            out[i] = (None, "no_response", None)
            continue
        met = max(same, key=lambda r: (r[2], r[0]))
        own = {k.lower(): v for k, v in (headers or {}).items()}
        old = {k.lower(): v for k, v in (met[5] or {}).items()}
        weak = lambda t: None if t is None else t.removeprefix("W/")
        if own.get("etag") is not None:
            ok = weak(own["etag"]) == weak(old.get("etag"))
        elif own.get("last-modified") is not None:
            ok = own["last-modified"] == old.get("last-modified")
        else:
            ok = None if digest is None else digest == met[6]
        name = "unverified" if ok is None else "resolved" if ok else "changed"
        closed = {x.strip() for x in own.get("connection", "").lower().split(",")}
        news = {k: v for k, v in own.items() if k not in warc.KEPT_FIELDS and k not in closed}
        out[i] = (met[0], name, old | news if ok else None)
    return out


def test_revisits_match_plain_python(spark):
    rng = random.Random(13)
    rows = []
    for i in range(600):
        url = rng.choice(["http://hot.example/a"] * 5 + ["HTTPS://www.Hot.example/a/#x", "https://b.example/", "https://b.example", None])
        headers = {}
        if rng.random() < 0.6:
            headers[rng.choice(["ETag", "etag"])] = rng.choice(['"1"', 'W/"1"', '"2"'])
        if rng.random() < 0.4:
            headers["Last-Modified"] = rng.choice("ab")
        if rng.random() < 0.5:
            headers |= {"Connection": "close, X-Hop", "X-Hop": "1", "Content-Length": str(i), "Age": str(i)}
        rows.append((i, url.lower() if url and "www" not in url else url, rng.choice([None, *range(200)]), rng.choice(["response", "revisit", "revisit"]), rng.choice([200, 200, 404]), headers or None, rng.choice([None, "d1", "d2"])))
    df = spark.createDataFrame(rows, CAPTURES).withColumn("page", F.lit(1)).withColumn("range", F.lit(2)).withColumn("merged", F.lit("old"))
    got = {r["record_id"]: (r["refers_to"], r["resolution"], r["merged"]) for r in warc.resolve_revisits(df.repartition(6)).collect()}
    want = resolved([r if r[1] is None else (r[0], r[1], *r[2:]) for r in rows])
    assert got == want
    assert set(Counter(x[1] for x in want.values())) == {"resolved", "changed", "unverified", "no_response"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    twice = spark.createDataFrame([rows[0][:3] + ("revisit", 304, None, None)] * 2, CAPTURES)
    assert warc.resolve_revisits(twice).count() == 2


def test_canonical_urls(spark):
    cases = {
        "HTTP://user@WWW.Example.com:80/A/b/?b=2&utm_source=x&a=1#top": "example.com/A/b?a=1&b=2",
        "https://example.com:443": "example.com", "example.com/?ref=x": "example.com", " https://m.example.com:8080/x?q=%20 ": "m.example.com:8080/x?q=%20", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == cases | {None: None}


def test_revisit_query(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    captures = [tuple(r) for r in warc.captures_of(pages).collect()]
    got = queries.QUERIES["op10_revisits"](spark, DIR).collect()
    assert len(got) == 2 * pages.count()
    full = {r[0]: r for r in captures if r[3] == "response" and r[4] == 200}
    for r in got:
        assert (r["resolution"] == "no_response") == (r["refers_to"] is None)
        assert (r["headers"] is None) == (r["resolution"] != "resolved")
        if r["payload_digest"]:
            assert r["payload_digest"] == full[r["refers_to"]][6]
