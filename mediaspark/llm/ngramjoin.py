"""N-gram Jaccard join: size-banded tiles, bitmap signatures as a bound, exact set intersection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaspark.llm.common import components, sieve, written

#: Smallest shingle hashes by which two texts may meet.
KEYS = 32
#: A key of more texts than this is set aside for texts that keep PLENTY other keys.
COMMON, PLENTY = 128, 24
#: Texts of one block of a tile, and partners that one copy of a set is compared with.
BLOCK, PARTNERS = 2048, 256
#: Word hashes that a worker keeps; beyond it the memory starts afresh.
KEPT = 60_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(17)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_known: dict[bytes, int] = {}


def _hash(word: bytes) -> int:
    if len(_known) >= KEPT:
        _known.clear()
    _known[word] = found = xxhash.xxh64_intdigest(word)
    return found


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different shingles; a shorter text is one shingle."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _known
    h = np.fromiter((known.get(w) or _hash(w) for w in words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    last = len(h) - n + 1
    out = np.full(last, n, dtype=np.uint64)
    for k in range(n):
        out += h[k : k + last] * _STEP[k]
    return np.unique(_mix(out))


def _marks(size: int):
    fields = [("n", T.LongType()), ("f1", T.LongType()), ("f2", T.LongType()), ("keys", T.ArrayType(T.LongType())), ("map", T.BinaryType())]

    @F.arrow_udf(T.StructType([T.StructField(*f) for f in fields]))
    def marks(texts: pa.Array) -> pa.Array:
        n, f1, f2, keys, maps = [], [], [], [], []
        for text in texts:
            s = shingles(text.as_py(), size)
            n.append(len(s))
            f1.append(_sum(s))
            f2.append(_sum(_mix(s + np.uint64(7))))
            keys.append(s[:KEYS].view(np.int64))
            maps.append(bitmap(s).tobytes())
        columns = [pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
        return pa.StructArray.from_arrays(columns, ["n", "f1", "f2", "keys", "map"])

    return marks


def _sum(s: np.ndarray) -> int:
    return int(s.sum(dtype=np.uint64).view(np.int64))


def _set(size: int):
    """A text's set, if its sum is the one looked for: an id may stand for several texts."""

    @F.arrow_udf(T.BinaryType())
    def sets(texts: pa.Array, sums: pa.Array) -> pa.Array:
        found = ((shingles(text.as_py(), size), f1) for text, f1 in zip(texts, sums.to_pylist(), strict=True))
        return pa.array([s.tobytes() if _sum(s) == f1 else None for s, f1 in found], pa.binary())

    return sets


def bitmap(s: np.ndarray) -> np.ndarray:
    """A signature of eight to sixteen bits a shingle, as 64-bit words; its length is a power of two."""
    words = max(1, 1 << (max(1, 8 * len(s)) - 1).bit_length() >> 6)
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_or.at(out, ((s >> np.uint64(20)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
    return out


def _fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Shorten signatures to ``words`` words; a shingle's bit stays where its shorter signature has it."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)


def may_overlap(a: np.ndarray, size_a: int, maps: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of ``maps`` can reach ``percent`` with set ``a``: a bit of one alone is a shingle of it alone."""
    only_a = np.bitwise_count(a & ~maps).sum(axis=1, dtype=np.int64)
    only_b = np.bitwise_count(~a & maps).sum(axis=1, dtype=np.int64)
    most = np.minimum(size_a - only_a, sizes - only_b)
    return 100 * most >= percent * (size_a + sizes - most)


def _may_link(percent: int):
    """Whether the bitmaps of two sets leave a link open."""

    @F.arrow_udf(T.BooleanType())
    def open_(size_a: pa.Array, maps_a: pa.Array, size_b: pa.Array, maps_b: pa.Array) -> pa.Array:
        out = []
        for n, a, m, b in zip(size_a.to_pylist(), maps_a, size_b.to_pylist(), maps_b, strict=True):
            a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (a, b))
            words = min(len(a), len(b))
            out.append(bool(may_overlap(_fold(a[None], words)[0], n, _fold(b[None], words), np.array([m]), percent)[0]))
        return pa.array(out, pa.bool_())

    return open_


def _reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int(np.count_nonzero(a[at] == b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _check(percent: int):
    """Rows sorted by (a, part, kind): the set of ``a`` (kind 0), then those of its partners (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, heads, heads_open = None, [], False
        for batch in batches:
            found = []
            for a, b, kind, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if not raw.is_valid:
                    continue
                s = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if kind == 0:  # an id that stands for several texts has several sets
                    heads = [*(heads if head == a and heads_open else ()), s.copy()]
                    head, heads_open = a, True
                    continue
                heads_open = False
                if any(_reaches(mine, s, percent) for mine in heads if head == a):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _tile(percent: int):
    """Pairs of a tile that the bitmaps can't rule out; a tile is the rows of one run of the sort order.

    A pair comes out in the tile of the smallest key that both nodes have, once for all their keys.
    """

    def pairs(key: int, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if len(rows) < 2:
            return
        nodes = np.array([r[0] for r in rows])
        sizes = np.array([r[1] for r in rows])
        comps = np.array([r[2] for r in rows])
        low = np.array([r[3] for r in rows])
        raw = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
        words = min(map(len, raw))
        maps = np.concatenate([_fold(x[None], words) for x in raw])
        keys = [np.array(r[5]) for r in rows]
        for i in range(len(rows) - 1):
            others = np.arange(i + 1, len(rows))
            ok = (comps[others] != comps[i]) & (low[others] | low[i])
            ok &= 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
            others = others[ok]
            if len(others):
                near = may_overlap(maps[i], int(sizes[i]), maps[others], sizes[others], percent)
                for j in others[near].tolist():
                    if np.intersect1d(keys[i], keys[j], assume_unique=True)[0] == key:
                        yield min(nodes[i], nodes[j]), max(nodes[i], nodes[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = (0,), []
        for batch in batches:
            found: set = set()
            columns = [batch.column(i).to_pylist() for i in range(10)]
            for key, band, i, j, *row in zip(*columns, strict=True):
                if (key, band, i, j) != tile:
                    found.update(pairs(tile[0], rows))
                    tile, rows = (key, band, i, j), []
                rows.append(row)
            yield _pairs(found)
        yield _pairs(set(pairs(tile[0], rows)))

    def _pairs(found: set) -> pa.RecordBatch:
        found = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _fits(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def jaccard_classes(docs: DataFrame, *, size: int = 5, percent: int = 75, text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per row of ``docs``.

    Two documents link when 100 * shared >= percent * united over their sets of different ``size``-word
    shingles (A-Z lower-cased).  component_id is the smallest doc_id that links reach.  Shingles are compared
    by 64-bit hashes.

    Equal sets are one node from the start.  Nodes can only link if they share one of their smallest hashes
    (a prefix filter), of which KEYS are kept.  Keys that more than COMMON nodes have are left out for nodes with
    PLENTY other keys, so that a passage in many texts brings no candidates for texts with keys of their own.  A set
    of fewer than 4 * PLENTY shingles so has all hashes that its prefix needs; for larger sets a link none of whose
    PLENTY to KEYS hashes is shared goes unseen, with odds under 0.25 ** PLENTY where hashes are independent.
    Then (1) every node is compared with the first node of each of its keys, a number of pairs that grows with
    the rows; (2) keys whose nodes are still in different components are cut into tiles of two adjacent size
    bands and blocks of BLOCK nodes, where bit counts of bitmap signatures bound the overlap from above; (3)
    what is left is intersected exactly.  Groups are never gathered whole: a hot key has as many tiles as its
    blocks have pairs.  Sets travel only for nodes that have a candidate.

    Null and empty texts have 0 shingles and their own id as component.  Rows that share a doc_id are one node
    per different set, under that id; a null doc_id takes the smallest id of its equal sets and links, or null.
    Repeated rows link to each other.  Very long texts give all their shingles.  Ties don't matter, as every
    decision is by a smallest id or an exact count.  An empty table gives an empty result; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    marks = written(plain.select("doc_id", _marks(size)("text").alias("m")).select("doc_id", "m.*"), "marks")
    same = marks.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "keys", "map")).alias("m"), F.min("doc_id").alias("node"))
    nodes = written(same.where("node is not null").select("f1", "f2", "n", "node", "m.keys", "m.map"), "nodes")

    every = nodes.select("node", "n", "f1", F.size("keys").alias("kept"), F.explode("keys").alias("key"))
    shared = written(every.groupBy("key").agg(F.count("*").alias("of"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high"), "shared")
    rows = written(every.join(shared.select("key", "of"), "key"), "keys")
    common = rows.where(F.col("of") > COMMON).groupBy("node", "f1").agg(F.count("*").alias("commons"))
    rows = rows.join(common, ["node", "f1"], "left").where((F.col("of") <= COMMON) | (F.col("kept") - F.col("commons") < PLENTY))
    rows = written(rows.select("key", "node", "n"), "keys")

    first = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"))
    star = rows.join(first, "key").where(F.col("node") != F.col("first.node")).where(_fits(F.col("n"), F.col("first.n"), percent))
    star = star.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    for end in ("a", "b"):
        star = star.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("map").alias(f"map_{end}")), end)
    star = written(star.where(_may_link(percent)("n_a", "map_a", "n_b", "map_b")).select("a", "b").distinct(), "pairs")
    links = written(_verified(star, plain, nodes, size, percent), "links")
    found = written(components(links), "components")

    placed = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = rows.groupBy("node", "n").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    tiles = _tiles(placed).join(nodes.select("node", "n", "map"), ["node", "n"]).join(held, ["node", "n"])
    tiles = tiles.select("key", "band", "i", "j", "node", "n", "component", "low", "map", "keys")
    left = tiles.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j").mapInArrow(_tile(percent), "a bigint, b bigint")
    left = written(left.distinct(), "pairs")
    if left.take(1):
        links = links.unionByName(written(_verified(left, plain, nodes, size, percent), "links"))
        found = written(components(links), "components")
    named = nodes.join(found, "node", "left").select("f1", "f2", "n", "node", F.coalesce("component", "node").alias("component"))
    out = marks.join(named, ["f1", "f2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _tiles(placed: DataFrame) -> DataFrame:
    """Rows of the tiles that hold nodes of different components: ``(key, band, i, j, node, n, component, low)``.

    Sets that may link differ by at most one size band; a tile of band x holds bands x (low) and x + 1.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    both = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("low")), F.struct((band - 1).alias("band"), F.lit(False).alias("low"))))
    rows = written(placed.select("key", "node", "n", "component", both.alias("t")).select("key", "node", "n", "component", "t.*"), "bands")
    counts = rows.groupBy("key", "band").agg(
        F.count("*").alias("of"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.max("low").alias("lows")
    )
    counts = counts.where("c1 <> c2 and lows").select("key", "band", F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(counts, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return written(rows.select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n", "component", "low"), "tiles")


def _sets_of(wanted: DataFrame, plain: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``(node, set)`` of some nodes, from their texts; null where an id's other texts have another set."""
    ids = written(wanted.join(nodes.select("node", "f1"), "node").select(F.col("node").alias("doc_id"), F.col("f1").alias("g")), "ids")
    return sieve(plain, ids, "doc_id").join(ids, "doc_id").select(F.col("doc_id").alias("node"), _set(size)("text", "g").alias("set"))


def _verified(pairs: DataFrame, plain: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the threshold.

    A set is sent once as head of each block of its partners, and once to each of its heads.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets_of(wanted, plain, nodes, size)
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("blocks"))
    heads = blocks.join(sets, F.col("a") == F.col("node")).select("a", F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("kind"), "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    parts = pairs.join(blocks, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    others = parts.join(sets, F.col("b") == F.col("node")).select("a", "b", F.lit(1).alias("kind"), "set", "part")
    rows = heads.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return rows.select("a", "b", "kind", "set").mapInArrow(_check(percent), "a bigint, b bigint")


def _told_apart(docs: DataFrame, text: str) -> DataFrame:
    """Documents with ``__node``, which tells different texts under one id apart, and whether the id is ``__again``.

    The text with the smallest digest goes by the id itself, the others by numbers beyond all ids.  Texts are
    digested only where an id repeats, of which a small table is written down.
    """
    again = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("of")).where("of > 1").select(F.col("doc_id").alias("__id")), "again")
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    first = docs.join(again, F.col("doc_id") == F.col("__id")).groupBy(F.col("doc_id").alias("__id")).agg(F.min(digest).alias("__first"))
    first = written(first, "first")
    other = F.pmod(F.xxhash64("doc_id", digest), F.lit(1 << 62)) + F.lit(1 << 62)
    own = F.col("doc_id").cast("bigint")
    found = docs.join(first, F.col("doc_id") == F.col("__id"), "left")
    node = F.when(F.col("__first").isNull() | (digest == F.col("__first")), own).otherwise(other)
    return found.withColumns({"__node": node, "__again": F.col("__first").isNotNull()}).drop("__id", "__first")


def keep_one(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """One document of each class stays, and of rows equal in doc_id and text one.

    Classes are those of ``jaccard_classes`` over different texts: texts that share a doc_id are judged one by
    one, and no text goes unless one of its class stays.  The smallest doc_id stays; among texts of one id the
    one of the smallest digest; of rows equal in both the first by their other columns.  Only rows whose id
    repeats are grouped, and aggregated ahead of the shuffle.

    Rows without a doc_id can't be told apart and all stay, as do documents without words, of which those with
    equal id and text are one.  Very long texts are compared whole; an empty table stays empty; other columns,
    whatever their names, are kept.
    """
    marked = _told_apart(docs, text)
    ids = jaccard_classes(marked.select(F.col("__node").alias("doc_id"), F.col(f"`{text}`").alias("text")), **options)
    gone = written(ids.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    kept = marked.join(gone, F.col("__node") == F.col("__gone"), "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    singles = kept.where("not __again").select(*docs.columns)
    return singles.unionByName(kept.where("__again").groupBy("__node").agg(F.min(whole).alias("__row")).select("__row.*"))
