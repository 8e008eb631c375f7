"""Benchmark decontamination: word windows of a test set, looked up in training texts and verified."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaspark.llm.common import written

#: Bytes of item text that one pass broadcasts; a larger test set takes as many passes.
BLOCK_BYTES = 8 << 20
#: Words are runs of digits, letters a-z and everything beyond ASCII, after A-Z became a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_HITS = "struct<n_words:bigint,spans:array<struct<first:bigint,stop:bigint>>,items:array<string>>"
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class _Windows:
    """The windows of some items: their hashes in order, and where their words stand to verify with.

    A window takes 24 bytes and its words' numbers stand once per item, whatever windows they are in.
    """

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.ids: dict[bytes, int] = {}
        known = [(item, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], dtype=np.int64)) for item, text in items]
        known = [(item, ids) for item, ids in known if len(ids)]
        rng = np.random.default_rng(11)
        self.mark = rng.integers(0, 1 << 63, len(self.ids) + 1, dtype=np.uint64) * 2 + 1
        self.step = rng.integers(0, 1 << 63, size, dtype=np.uint64) * 2 + 1
        self.owners = [item for item, _ in known]
        self.words = np.concatenate([np.zeros(0, dtype=np.int64), *[ids for _, ids in known]])
        begins = np.cumsum([0, *[len(ids) for _, ids in known]])
        parts: dict[int, list[tuple]] = {}
        for owner, (_, ids) in enumerate(known):
            n = min(size, len(ids))
            hashes = self._hash(ids, n)
            parts.setdefault(n, []).append((hashes, begins[owner] + np.arange(len(hashes)), np.full(len(hashes), owner)))
        self.tables: dict[int, tuple] = {}
        for n, found in parts.items():
            hashes, at, owner = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], at[order]
            # Equal windows are one entry, which the owners between two bounds share.
            same = hashes[1:] == hashes[:-1]
            for k in range(n):
                same &= self.words[at[1:] + k] == self.words[at[:-1] + k]
            heads = np.flatnonzero(np.concatenate(([True], ~same)))
            self.tables[n] = hashes[heads], at[heads], np.append(heads, len(hashes)), owner[order]

    def _hash(self, ids: np.ndarray, n: int) -> np.ndarray:
        marks, last = self.mark[ids], len(ids) - n + 1
        out = np.zeros(last, dtype=np.uint64)
        for k in range(n):
            out += marks[k : k + last] * self.step[k]
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside an occurrence, and the items that occur."""
        hit, items = np.zeros(len(words) + 1, dtype=np.int64), set()
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        for n, (hashes, at, bounds, owner) in self.tables.items():
            if len(words) < n or np.count_nonzero(ids) < n:
                continue
            found = self._hash(ids, n)
            low = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            here = np.flatnonzero(hashes[low] == found)
            if not len(here):
                continue
            high = np.searchsorted(hashes, found[here], side="right")
            # One pair for each window of the text and each entry that has its hash.
            many = high - low[here]
            mine = np.repeat(here, many)
            theirs = np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[here], many)
            same = np.ones(len(mine), dtype=bool)
            for k in range(n):
                same &= ids[mine + k] == self.words[at[theirs] + k]
            starts = np.unique(mine[same])
            hit[starts] += 1
            np.add.at(hit, starts + n, -1)
            for entry in np.unique(theirs[same]).tolist():
                items.update(self.owners[o] for o in owner[bounds[entry] : bounds[entry + 1]].tolist())
        return np.cumsum(hit[:-1]) > 0, items


_built: dict[str, _Windows] = {}


def _windows(token: str, shared, size: int) -> _Windows:
    if token not in _built:
        _built.clear()
        _built[token] = _Windows(shared.value, size)
    return _built[token]


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"first": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scanner(shared, size: int):
    token = uuid.uuid4().hex

    @F.arrow_udf(_HITS)
    def scan(texts: pa.Array) -> pa.Array:
        windows, out = _windows(token, shared, size), []
        for text in texts.to_pylist():
            words = words_of(text)
            hit, items = windows.scan(words)
            out.append({"n_words": len(words), "spans": _spans(hit) if items else [], "items": sorted(items)})
        return pa.array(out, _ARROW)

    return scan


@F.arrow_udf(T.LongType())
def _word_count(texts: pa.Array) -> pa.Array:
    return pa.array([len(words_of(x)) for x in texts.to_pylist()], pa.int64())


@F.arrow_udf(_SPANS)
def _merged(spans: pa.Array) -> pa.Array:
    """Spans of several blocks as runs of hit words: those that overlap or meet are one."""
    out = []
    for found in spans.to_pylist():
        runs: list[dict] = []
        for s in sorted(found, key=lambda s: s["first"]):
            if runs and s["first"] <= runs[-1]["stop"]:
                runs[-1]["stop"] = max(runs[-1]["stop"], s["stop"])
            else:
                runs.append(s)
        out.append(runs)
    return pa.array(out, _ARROW.field("spans").type)


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text is not None and cut:
            at = [m.span() for m in _WORD.finditer(text)]
            keep, last = [], 0
            for s in cut:
                keep.append(text[last : at[s["first"]][0]])
                last = at[s["stop"] - 1][1]
            text = "".join([*keep, text[last:]])
        out.append(text)
    return pa.array(out, pa.string())


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """Add n_words, n_hit, items (item ids as strings, sorted), spans (runs of hit words) and contaminated.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item; a word inside an
    occurrence is hit.  A test set of up to ``block_bytes`` of text is broadcast, and one projection scans the
    texts without a shuffle.  A larger one is dealt by hash to blocks of about that size (or one longer item),
    and each block is a pass of its own over the numbered texts, so that the driver and a task hold one block at
    a time; the hits of all passes are written, merged per text and joined to their rows.  The result is the
    same.  Rolling hashes find candidates; word numbers verify them.

    Null and empty texts have no words and aren't contaminated; a very long text is scanned whole, in memory
    of some hundred bytes a word.  An item without words has no windows, and a null item id is listed as the
    empty string.  Items that share an id count once; a window that several items share names all of them.
    Repeated documents are scanned alike; an empty test set hits nothing.  Columns of the new names are
    replaced, others are kept.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("words"))
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        found = docs.withColumn("__hits", _scanner(_share(items), window)(F.col(text)))
    else:
        found = _pass_by_pass(docs, [items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) for k in range(blocks)], window, text)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["first"])
    found = found.withColumns({n: F.col("__hits")[n] for n in ("n_words", "spans", "items")})
    return found.withColumns({"n_hit": n_hit, "contaminated": F.size("spans") > 0}).drop("__hits")


def _share(items: DataFrame):
    return items.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])


def _pass_by_pass(docs: DataFrame, blocks: list[DataFrame], window: int, text: str) -> DataFrame:
    """``docs`` with ``__hits``, one scan of all texts per block of the test set."""
    # Columns go by place, whatever their names; the numbers hold once they are written.
    place = [f"c{i}" for i in range(len(docs.columns))]
    texts = docs.withColumns({"__text": F.col(text), "__id": F.monotonically_increasing_id()}).toDF(*place, "__text", "__id")
    rows = written(texts, "numbered")
    found = None
    for block in blocks:
        shared = _share(block)
        hits = F.filter(F.array(_scanner(shared, window)(F.col("__text"))), lambda h: F.size(h["items"]) > 0)
        part = written(rows.select("__id", F.explode(hits).alias("h")), "hits")
        shared.destroy()
        found = part if found is None else found.union(part)
    # A text has one row per block at most, so what is gathered for it grows with the text alone.
    each = found.groupBy("__id").agg(F.flatten(F.collect_list("h.spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("i"))
    each = written(each.select("__id", _merged("s").alias("s"), "i"), "merged")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    hits = F.struct(
        _word_count("__text").alias("n_words"), none(F.col("s"), _SPANS).alias("spans"), none(F.col("i"), "array<string>").alias("items")
    )
    return rows.join(each, "__id", "left").select(*place, hits.alias("__hits")).toDF(*docs.columns, "__hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """Drop contaminated documents, or with ``remove="spans"`` cut the hit words out of their texts.

    The columns are those of ``docs``.  A cut runs from the first hit word's start to the last one's end.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    found = find_contamination(docs.select(F.struct("*").alias("__row"), F.col(text).alias("text")), benchmark, **options)
    if remove == "documents":
        return found.where("not contaminated").select("__row.*")
    cut = found.withColumn("__row", F.col("__row").withField(text, _without("text", "spans")))
    return cut.select("__row.*")
