"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspark.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Rows of one cell of a source's permutation, which one task puts in order.
CELL_ROWS = 1 << 13
#: Levels of the tree after which its nodes are dealt anew to the tasks.
DEAL = 6


def _name(c: Column) -> Column:
    """A source's name that can't be null: sorted by code point, the null source last."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), c.cast("string")))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source_key, source_size, target, rank)`` from ``(source_key, source_size)``.

    The sources share ``share`` times all sizes by weight; a target stops at ``most`` times its source's size and
    what is above is shared again by weight.  That fixes one level: every target is the smaller of its cap and
    its weight times the level.  Sources reach their caps in the order of cap over weight, so running sums over
    that order give the level at each source; the first that stays below its cap has the final one.
    """
    named = Window.orderBy("source_key")
    weight = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("rank", F.row_number().over(named) - 1)
    rows = rows.withColumns({"weight": weight[F.col("rank") % len(weights)], "cap": most * F.col("source_size")})
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns({
        "want": share * F.sum("source_size").over(every),
        "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
    })
    rows = rows.withColumn("level", (F.col("want") - F.col("used")) / F.col("left"))
    final = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * final["level"], F.col("cap")))
    return rows.select("source_key", "source_size", target.alias("target"), "rank")


def _draw(pop: str, marked: str, n: str, u: str) -> str:
    """SQL of a hypergeometric number: how many of ``n`` draws from ``pop`` hit the ``marked``, by inversion at ``u``.

    The weights of the possible numbers follow from each other by their ratio; numbers more than 12 standard
    deviations from the mean are left out, whose odds are beyond a double.
    """
    span = f"""named_struct(
        'm', {n} * cast({marked} as double) / {pop},
        'd', sqrt({n} * (cast({marked} as double) / {pop}) * (1 - cast({marked} as double) / {pop}) * ({pop} - {n}) / greatest({pop} - 1, 1)))"""
    low = f"greatest(0L, {n} - ({pop} - {marked}), bigint(floor(t.m - 12 * t.d)) - 2)"
    high = f"least({marked}, {n}, bigint(ceil(t.m + 12 * t.d)) + 2)"
    ratio = f"(({marked} - (k - 1)) * cast({n} - (k - 1) as double)) / (k * cast({pop} - {marked} - {n} + k as double))"
    step = f"if(k = r.lo, 1D, a.w * {ratio})"
    total = f"aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 's', 0D), (a, k) -> named_struct('w', {step}, 's', a.s + {step}), a -> a.s)"
    pick = f"aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 's', 0D, 'x', r.lo), (a, k) -> named_struct('w', {step}, 's', a.s + {step}, 'x', if(a.s < goal, k, a.x)), a -> a.x)"
    whole = f"transform(array({total} * {u}), goal -> {pick})[0]"
    spans = f"transform(array({span}), t -> named_struct('lo', {low}, 'hi', {high}))"
    return f"if({pop} = 0 or {marked} = 0 or {n} = 0, 0L, transform({spans}, r -> {whole})[0])"


def split_quotas(root: DataFrame, levels: int, seed: int) -> DataFrame:
    """``(shard, counts)``: the blocks that each of 2 ** levels shards takes of each source.

    ``root`` is one row, ``counts``: the exact quota of each source.  A node's shards are halved; the left half
    takes its exact number of blocks, of which sources is one multivariate-hypergeometric draw (source after
    source, each from what is left), the right half the rest.  So every shard holds its exact number of blocks,
    every source its exact quota, and the shards look alike.  A draw depends on the node, source and seed alone.
    """
    nodes = root.select(F.lit(0).cast("bigint").alias("low"), "counts", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c).alias("all"))
    for level in range(levels):
        wide = 1 << (levels - level)
        if level and level % DEAL == 0:
            nodes = nodes.repartition("low")
        quota = lambda shard: f"bigint(floor(cast(({shard}) as decimal(38, 0)) * all / {1 << levels}))"
        nodes = nodes.withColumn("n", F.expr(f"{quota(f'low + {wide // 2}')} - {quota('low')}"))
        u = f"(shiftrightunsigned(xxhash64({seed}, low, {wide}, s.i), 11) / 9007199254740992D)"
        each = f"""named_struct('pop', s.pop - c, 'n', s.n - x, 'out', concat(s.out, array(x)), 'i', s.i + 1)"""
        draw = _draw("s.pop", "c", "s.n", u)
        left = f"""aggregate(counts, named_struct('pop', aggregate(counts, 0L, (a, c) -> a + c), 'n', n, 'out', cast(array() as array<bigint>), 'i', 0),
            (s, c) -> transform(array({draw}), x -> {each})[0], s -> s.out)"""
        nodes = nodes.withColumn("left", F.expr(left))
        halves = F.array(
            F.struct("low", F.col("left").alias("counts")),
            F.struct((F.col("low") + wide // 2).alias("low"), F.expr("zip_with(counts, left, (c, x) -> c - x)").alias("counts")),
        )
        nodes = nodes.select("all", F.explode(halves).alias("h")).select("all", "h.*")
    return nodes.select(F.col("low").alias("shard"), "counts")


def mix_plan(docs: DataFrame, *, text: str = "text", source: str = "source", block_words: int = 1 << 13, shard_blocks: int = 128, seed: int = 1, keep_text: bool = True, **targets) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, taken, shard and again.

    A source's documents are laid end to end in a random order that their id, text and the seed fix.  The mix
    takes a document if its middle lies within the target, and once more if it does so one source's length
    further on: a source's words miss the target by half a document at most, and none comes more than twice.
    Every ``block_words`` words of that line are a block; the exact number of blocks a target takes is the
    source's quota, which a splitting tree deals out to shards of about ``shard_blocks`` blocks.  ``shard`` and
    ``again`` are the shards that got the block of a document's first and second copy, null if it isn't taken.

    The order is built from cells of about CELL_ROWS rows, so a source with a third of all rows is put in order by
    many tasks; what meets in one task are the sources (for their targets) and one source's cells.

    Without ``keep_text`` the texts are read for their sizes and stay out of the shuffles and the result.

    Size is the number of words; null and empty texts have size 0 and are never taken.  Null sources are one
    source, the last.  Rows that are equal in id, source and text are copies of each other, and stand side by side.
    Documents longer than a block belong to the block of their first word.  An empty table gives an empty result;
    result columns replace columns of their names, other columns are kept.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    fresh = ("size", "source_size", "target", "taken", "shard", "again", *(() if keep_text else (text.lower(),)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in fresh]).alias("row"), _name(F.col(source)).alias("source_key"), size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text)).alias("hash"), F.col("doc_id").alias("id"))
    rows = rows.withColumn("at", F.expr("shiftrightunsigned(hash, 33)"))
    totals = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("of"))
    sources = source_targets(totals, **targets).join(totals.select("source_key", "of"), "source_key")
    sources = sources.withColumns({"cells": F.ceil(F.col("of") / CELL_ROWS).cast("bigint"), "quota": F.ceil(F.col("target") / block_words).cast("bigint")})
    sources = written(sources, "sources")

    placed = rows.join(sources, "source_key").withColumn("cell", F.expr("(at * cells) div 2147483648L"))
    cells = placed.groupBy("source_key", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source_key", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    cells = written(cells, "cells")
    inside = Window.partitionBy("source_key", "cell").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["source_key", "cell"])
    lined = lined.withColumn("start", F.col("start") + F.col("offset"))
    middle = F.col("start") + F.col("size") / 2
    block = lambda turn: F.when((F.col("size") > 0) & (middle + turn <= F.col("target")), F.floor((F.col("start") + turn) / block_words).cast("bigint"))
    lined = lined.withColumns({"b1": block(F.lit(0)), "b2": block(F.col("source_size"))})

    blocks = _block_shards(sources, shard_blocks, seed)
    for number, name in (("b1", "shard"), ("b2", "again")):
        of = blocks.select(F.col("source_key").alias("k"), F.col("block").alias("b"), F.col("shard").alias(name))
        lined = lined.join(of, (F.col("source_key") == F.col("k")) & (F.col(number) == F.col("b")), "left").drop("k", "b")
    copies = F.col("shard").isNotNull().cast("bigint") + F.col("again").isNotNull().cast("bigint")
    return lined.select("row.*", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "shard", "again")


def _block_shards(sources: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """``(source_key, block, shard)`` of every block of every quota."""
    total = sources.agg(F.sum("quota")).first()[0] or 0
    levels = max(0, (-(-total // shard_blocks) - 1).bit_length())
    root = sources.agg(F.array_sort(F.collect_list(F.struct("rank", "quota", "source_key"))).alias("s"))
    shards = split_quotas(root.select(F.expr("transform(s, x -> x.quota)").alias("counts")), levels, seed)
    each = shards.select("shard", F.posexplode("counts").alias("rank", "count"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).where("count > 0")
    each = each.join(sources.select("source_key", "rank"), "rank")
    blocks = each.select("source_key", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("block"))
    return written(blocks, "blocks")


def mix(docs: DataFrame, *, seed: int = 1, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per copy taken, each shard's rows together and shuffled.

    A shard's rows come from the blocks it drew, in an order that the seed, id and copy fix.
    """
    own = ("doc_id", "text", "source")
    rest = [c for c in docs.columns if c.lower() not in own]
    packed = docs.select(*own, F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("__rest"))
    copies = F.array(F.struct(F.col("shard").alias("to"), F.lit(1).alias("copy")), F.struct(F.col("again").alias("to"), F.lit(2).alias("copy")))
    taken = F.filter(copies, lambda c: c["to"].isNotNull())
    rows = mix_plan(packed, seed=seed, **options).select(*own, "__rest", F.explode(taken).alias("c"))
    rows = rows.withColumns({"__to": F.col("c.to"), "__key": F.xxhash64(F.lit(seed), "c.to", "c.copy", "doc_id", "text")})
    rows = rows.repartition("__to").sortWithinPartitions("__to", "__key")
    return rows.select(*[F.col(c) if c.lower() in own else F.col(f"__rest.`{c}`") for c in docs.columns])
