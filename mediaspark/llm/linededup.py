"""Line dedup by a segment-partition edit join, in DataFrame and SQL functions only."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import components, native_sieve, written

#: Lines of one block of a tile.
BLOCK = 64
#: A key with more lines than this is split by keys of several segments.
HOT = 512
#: Segments asked for beyond the first, each time that keys are still hot.
FINER = (1, 3)


def _segment(part: int, parts: int, length: str) -> tuple[str, str]:
    """Start (from 0) and stop of an even segment of a line of ``length`` characters."""
    return f"(({length}) * {part} div {parts})", f"(({length}) * {part + 1} div {parts})"


def _keys(edits: int) -> Column:
    """``array<struct<key, indexed>>`` of a line of ``len`` characters, four bytes each in ``units``.

    A line is cut into edits + 1 segments, so that one of them is untouched by any ``edits`` changes.  It is
    indexed by (its length, segment number, segment), and probes the indexes of lines up to ``edits`` shorter
    with the substrings that may have been that segment: those whose distance from the segment's place leaves
    the left and the right part enough changes to make up for it.
    """
    parts, keys = edits + 1, []
    for shorter in range(edits + 1):
        length = f"len - {shorter}" if shorter else "len"
        for i in range(parts):
            start, stop = _segment(i, parts, length)
            least, most = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            for move in range(least, most + 1):
                own = shorter == 0 and move == 0
                piece = f"substring(units, int({start}) * 4 + {4 * move + 1}, int({stop} - {start}) * 4)"
                keys.append(f"named_struct('key', xxhash64({length}, {i}, {piece}), 'indexed', {str(own).lower()})")
    return F.expr(f"array({', '.join(keys)})")


def _finer_keys(edits: int, more: int) -> Column:
    """As ``_keys``, of ``1 + more`` segments at once: of edits + 1 + more, so many are untouched by any ``edits`` changes.

    Every choice of segments is a key, with every way to move them: the first by so many characters, the next by
    others, the end by the difference of the lengths, where the changes between neighbours add up to ``edits`` at
    most.  Such a key holds nearly the whole line, so few lines share it.
    """
    parts, keys = edits + 1 + more, []
    for shorter in range(edits + 1):
        paths = [m for m in product(range(-edits, edits + 1), repeat=1 + more) if sum(abs(b - a) for a, b in zip((0, *m), (*m, shorter))) <= edits]
        for chosen in combinations(range(parts), 1 + more):
            # No character stands before a first segment, or behind a last one, that could move it to the left.
            fit = [m for m in paths if (chosen[0] or m[0] >= 0) and (chosen[-1] < parts - 1 or m[-1] <= shorter)]
            keys += [(shorter, list(zip(chosen, m))) for m in fit]
    spec = lambda n, k: f"named_struct('n', {n}, 'less', {k[0]}, 'own', {str(not k[0] and not any(m for _, m in k[1])).lower()}, 'at', array({', '.join(f'{i}, {m}' for i, m in k[1])}))"
    # A choice of segments has one number, however it is moved.
    number = {c: n for n, c in enumerate(combinations(range(parts), 1 + more))}
    table = ", ".join(spec(number[tuple(i for i, _ in k[1])], k) for k in keys)
    start = "(len - k.less) * k.at[2 * i] div {0}".format(parts)
    stop = "(len - k.less) * (k.at[2 * i] + 1) div {0}".format(parts)
    piece = f"substring(units, int({start} + k.at[2 * i + 1]) * 4 + 1, int({stop} - {start}) * 4)"
    pieces = f"transform(sequence(0, {more}), i -> if({start} + k.at[2 * i + 1] < 0, null, {piece}))"
    return F.expr(f"transform(array({table}), k -> named_struct('key', xxhash64(len - k.less, k.n, {pieces}), 'indexed', k.own))")


def _signature(line: str) -> Column:
    """128 parities of the line's hashed character pairs; one edit changes at most four pairs."""
    half = lambda seed: (
        f"aggregate(sequence(0, size(chars) - 2), 0L, (acc, i) -> acc ^ shiftleft(1L, pmod(hash(get(chars, i), get(chars, i + 1), {seed}), 64)))"
    )
    return F.expr(f"transform(array(split({line}, '')), chars -> if(size(chars) < 2, array(0L, 0L), array({half(1)}, {half(2)})))[0]")


def _may_match(a: str, b: str, edits: int) -> str:
    """Both parities of the pairs leave the threshold open (each counts every pair once)."""
    return f"(bit_count({a}[0] ^ {b}[0]) <= {4 * edits} and bit_count({a}[1] ^ {b}[1]) <= {4 * edits})"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, which so is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def within(x: str, y: str, edits: int) -> Column:
    """Whether the texts in columns ``x`` and ``y`` are at most ``edits`` insertions, deletions or substitutions apart.

    Common ends are cut off by doubling steps.  Over the middle runs a banded bit-parallel edit distance: one
    word of 2 * edits + 1 bits per number of edits says which diagonals are alive, and one step per character
    moves all diagonals at once.
    """
    steps = "array(" + ", ".join(str(1 << k) for k in range(20, -1, -1)) + ")"
    lx, ly = f"char_length({x})", f"char_length({y})"
    ahead = f"aggregate({steps}, 0, (p, s) -> if(p + s <= n.low and substring({x}, p + 1, s) = substring({y}, p + 1, s), p + s, p))"
    behind = f"aggregate({steps}, 0, (q, s) -> if(q + s <= n.low - p and substring({x}, n.x - q - s + 1, s) = substring({y}, n.y - q - s + 1, s), q + s, q))"
    middle = lambda c, n: f"if({n} - p - q <= 0, array(), split(substring({c}, p + 1, {n} - p - q), ''))"
    width = 2 * edits + 1
    match = " | ".join(f"if(get(t.a, j + {o - edits}) = get(t.b, j), {1 << o}L, 0L)" for o in range(width))
    # r0 .. rk: the diagonals alive after as many edits; a diagonal is a place in a less the place in b.
    moved, fields = [], []
    for e in range(edits + 1):
        step = f"(s.r{e} & m)"
        if e:
            step = f"(({step} | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | shiftleft({moved[-1]}, 1)) & {(1 << width) - 1}L)"
        moved.append(step)
        fields.append(f"'r{e}', {step}")
    start = ", ".join(f"'r{e}', {sum(1 << min(edits + d, width - 1) for d in range(e + 1))}L" for e in range(edits + 1))
    alive = f"""aggregate(sequence(0, size(t.b) - 1), named_struct({start}), (s, j) -> {_let(match, 'm', f"named_struct({', '.join(fields)})")},
        s -> ({' | '.join(f's.r{e}' for e in range(edits + 1))}) & shiftleft(1L, size(t.a) - size(t.b) + {edits}) <> 0)"""
    near = f"case when size(t.a) = 0 or size(t.b) = 0 then greatest(size(t.a), size(t.b)) <= {edits} else {alive} end"
    texts = f"named_struct('a', {middle(x, 'n.x')}, 'b', {middle(y, 'n.y')})"
    whole = _let(ahead, "p", _let(behind, "q", _let(texts, "t", near)))
    sizes = f"named_struct('x', {lx}, 'y', {ly}, 'low', least({lx}, {ly}))"
    return F.expr(_let(sizes, "n", f"case when abs(n.x - n.y) > {edits} then false else {whole} end"))


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc, line_no, line)`` of all lines; ``doc`` is (doc_id, hash of the text)."""
    doc = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"))
    return docs.where("text is not null").select(doc.alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_classes(docs: DataFrame, *, min_chars: int = 32, edits: int = 2, equal_chars: int = 20) -> DataFrame:
    """``(line_id, first)`` of every line that isn't alone: of ``min_chars`` or more characters, or, if only equal
    lines count, of ``equal_chars`` or more.

    ``line_id`` is the line's 128-bit digest, ``first`` the class's first occurrence (doc, line_no).  Lines are
    in one class if links of at most ``edits`` edits connect them; equal lines are one node from the start.

    Keys that different lines share are found first, as numbers only.  Lines with such keys are compared with
    the first line of each key; where lines of one key are still in different classes, the key's lines are cut
    into tiles of two blocks, and pairs whose character-pair parities leave the threshold open are verified.
    Where a key has more than ``HOT`` lines, those are cut into more segments first and must share several of
    them, once and again as ``FINER`` says; only lines that share the finest keys too meet in tiles.
    """
    lines = _lines(docs).where(F.char_length("line") >= min(min_chars, equal_chars))
    lines = lines.withColumns({"line_id": F.unhex(F.md5("line")), "h": F.xxhash64("line")})
    place = F.struct("doc", "line_no")
    counts = lines.groupBy("line_id").agg(F.count("*").alias("of"), F.min(place).alias("first"))
    repeated = written(counts.where("of > 1").select("line_id", "first"), "repeated")
    lines = lines.where(F.char_length("line") >= min_chars)

    # Characters of equal width are cut out without reading those before them.
    wide = lines.select("h", F.char_length("line").alias("len"), F.encode("line", "UTF-32").alias("units"))
    narrow = wide.select("h", F.explode(_keys(edits)).alias("k")).select("h", F.col("k.key").alias("key"), F.col("k.indexed").alias("indexed"))
    shared = narrow.groupBy("key").agg(F.min("h").alias("h1"), F.max("h").alias("h2"), F.max("indexed").alias("indexed"))
    shared = written(shared.where("h1 <> h2 and indexed").select("key"), "keys")
    # Texts travel once, and only those of lines that met another.  Up to here a line is known by 64 bits;
    # lines that share them share their keys, and are told apart from here on.
    met = narrow.where(native_sieve(shared)(F.col("key"))).select("key", "h")
    met = written(met.join(shared, "key", "left_semi").distinct(), "met")
    ids = written(met.select("h").distinct(), "ids")
    nodes = lines.where(native_sieve(ids)(F.col("h"))).join(ids, "h").groupBy("line_id", "h").agg(F.min(place).alias("first"), F.min("line").alias("line"))
    nodes = written(nodes.withColumn("signature", _signature("line")), "nodes")
    rows = written(met.join(nodes.select("h", "line_id", "signature"), "h").drop("h"), "rows")

    links, found = _linked(rows, nodes, edits, None)
    for more in FINER:
        mixed = _mixed(rows, found).where(F.col("of") > HOT).select("key")
        hot = written(rows.join(mixed, "key", "left_semi").select("line_id").distinct(), "hot")
        if hot.isEmpty():
            break
        cold = rows.join(mixed, "key", "left_anti")
        links, found = _tiled(cold, nodes, edits, links, found)
        rows = _narrowed(hot, nodes, found, edits, more)
        links, found = _linked(rows, nodes, edits, links)
    links, found = _tiled(rows, nodes, edits, links, found)

    firsts = nodes.select("line_id", "first").join(found, F.col("line_id") == F.col("node"))
    least = firsts.groupBy("component").agg(F.min("first").alias("first"))
    classes = firsts.select("line_id", "component").join(least, "component").select("line_id", "first")
    alone = repeated.join(classes, "line_id", "left_anti")
    return written(classes.unionByName(alone), "classes")


def _linked(rows: DataFrame, nodes: DataFrame, edits: int, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``links`` with those between each key's lines and its first one, and the classes that they make."""
    head = rows.groupBy("key").agg(F.min(F.struct("line_id", "signature")).alias("head"))
    star = rows.join(head, "key").where(F.col("line_id") != F.col("head.line_id")).where(_may_match("signature", "head.signature", edits))
    star = star.select(F.col("head.line_id").alias("a"), F.col("line_id").alias("b")).distinct()
    new = written(_verified(star, nodes, edits), "links")
    links = new if links is None else links.unionByName(new)
    return links, written(components(links), "classes")


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, F.col("line_id") == F.col("node"), "left").withColumn("class", F.coalesce("component", "line_id"))


def _mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Keys whose lines are in different classes: ``(key, of)``."""
    keys = _placed(rows, found).groupBy("key").agg(F.count("*").alias("of"), F.min("class").alias("c1"), F.max("class").alias("c2"))
    return keys.where("c1 <> c2").select("key", "of")


def _narrowed(hot: DataFrame, nodes: DataFrame, found: DataFrame, edits: int, more: int) -> DataFrame:
    """Rows ``(key, line_id, signature)`` of the lines ``hot`` by keys of ``1 + more`` segments that different classes share."""
    texts = nodes.join(hot, "line_id", "left_semi").select("line_id", F.char_length("line").alias("len"), F.encode("line", "UTF-32").alias("units"))
    # Each line makes many keys here, so the number of tasks is the session's, not one by size.
    texts = texts.repartition(int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = texts.select("line_id", F.explode(_finer_keys(edits, more)).alias("k")).select("line_id", F.col("k.key").alias("key"), F.col("k.indexed").alias("indexed"))
    keys = written(_placed(keys, found).select("key", "line_id", "class", "indexed"), "finer")
    shared = keys.groupBy("key").agg(F.min("class").alias("c1"), F.max("class").alias("c2"), F.max("indexed").alias("indexed"))
    met = keys.join(shared.where("c1 <> c2 and indexed").select("key"), "key", "left_semi").select("key", "line_id").distinct()
    return written(met.join(nodes.select("line_id", "signature"), "line_id"), "rows")


def _tiled(rows: DataFrame, nodes: DataFrame, edits: int, links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` with those between lines of one key that are still in different classes, and the classes they make."""
    tiles = _placed(rows, found).join(_mixed(rows, found).select("key", F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks")), "key")
    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("line_id", "key"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct(F.col("line_id").alias("id"), F.col("class").alias("class"), F.col("signature").alias("signature"))
    tiles = tiles.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(member).alias("m"))
    partners = f"transform(filter(m, b -> a.id < b.id and a.class <> b.class and {_may_match('a.signature', 'b.signature', edits)}), b -> named_struct('a', a.id, 'b', b.id))"
    left = tiles.select(F.explode(F.expr(f"flatten(transform(m, a -> {partners}))")).alias("p")).select("p.*").distinct()
    links = links.unionByName(written(_verified(left, nodes, edits), "links"))
    return links, written(components(links), "classes")


def _verified(pairs: DataFrame, nodes: DataFrame, edits: int) -> DataFrame:
    texts = nodes.select("line_id", "line")
    both = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("x")), "a")
    both = both.join(texts.select(F.col("line_id").alias("b"), F.col("line").alias("y")), "b")
    # Few bytes may hold much work here, so the number of tasks is the session's, not one by size.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks).where(within("x", "y", edits)).select("a", "b")


def dedup_lines(docs: DataFrame, *, text: str = "text", min_chars: int = 32, edits: int = 2, equal_chars: int = 20) -> DataFrame:
    """Every row of ``docs`` with ``text`` without its repeated lines, n_lines and n_dropped.

    A line (between newlines) of ``min_chars`` or more characters goes if an equal line, or one linked to it by
    at most ``edits`` edits, stands earlier: at a smaller doc_id, or further up in the same text.  Of shorter lines
    those of ``equal_chars`` or more go if an equal one stands earlier; below that two or three words are equal by
    chance, and all stay.  The first line of a class stays, so no text is lost from the table as a whole.

    Null texts have 0 lines and stay null; an empty text is one empty line.  Rows equal in doc_id and text are
    one document, and both keep the same lines; a null doc_id comes before all others.  Very long lines are
    cut, probed and verified like others.  An empty table stays empty.  Columns named n_lines and n_dropped are
    replaced, other columns are kept, whatever their names.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    classes = line_classes(plain, min_chars=min_chars, edits=edits, equal_chars=equal_chars)
    lines = _lines(plain).where(F.char_length("line") >= min(min_chars, equal_chars)).select("doc", "line_no", F.unhex(F.md5("line")).alias("line_id"))
    repeats = lines.join(classes, "line_id").where(F.struct("doc", "line_no") != F.col("first"))
    drops = repeats.groupBy(F.col("doc.id").alias("__id"), F.col("doc.print").alias("__print")).agg(F.collect_set("line_no").alias("__drop"))
    rows = docs.withColumns({"__key": F.col("doc_id").cast("bigint"), "__hash": F.xxhash64(F.col(text).cast("string"))})
    # A null id joins as one value, by a flag beside a number that stands in for it.
    on = (F.coalesce("__key", F.lit(0)) == F.coalesce("__id", F.lit(0))) & (F.col("__key").isNull() == F.col("__id").isNull()) & (F.col("__hash") == F.col("__print"))
    rows = rows.join(drops, on, "left").withColumn("__text", F.col(text).cast("string"))
    kept = F.expr(_let("split(__text, '\\n')", "l", "array_join(transform(array_except(sequence(0, size(l) - 1), __drop), i -> l[i]), '\\n')"))
    rows = rows.withColumns({
        text: F.when(F.col("__drop").isNull(), F.col(text)).otherwise(kept),
        "n_lines": F.coalesce(F.char_length("__text") - F.char_length(F.translate("__text", "\n", "")) + 1, F.lit(0)).cast("bigint"),
        "n_dropped": F.greatest(F.coalesce(F.size("__drop"), F.lit(0)), F.lit(0)).cast("bigint"),
    })
    return rows.drop("__key", "__hash", "__id", "__print", "__drop", "__text")
