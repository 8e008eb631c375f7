"""Ordered operators that never send a whole stream through one task.

A plain ``Window.partitionBy(stream).orderBy(seq)`` puts all rows of a stream
into one task, which breaks when one stream holds a third of the data.  The
helpers here cut a stream into chunks of its integer order column
(``order div rows``), so a group never exceeds the chunk size:

* ``running``   - running sum / count / max / min / last over any prefix: local
  windows inside a chunk, one aggregated row per chunk, and a carry joined back;
* ``nearest_two`` - the two nearest values on either side of a row, from one pass;
* ``neighbours`` - windows that look a bounded number of rows back or ahead: the
  rows next to a chunk border are copied into the next chunk before the shuffle;
* ``number_rows`` - dense row numbers from counts per cell;
* ``number_sorted`` - dense row numbers in any order, from ranges of the sort key.

Key columns name a stream and must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one stream that are handled as one group.
CHUNK_ROWS = 1 << 18

_CHUNK = "__chunk"


def chunk_id(order: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of an integer order column; rises with the order."""
    return F.expr(f"CAST(`{order}` AS BIGINT) div {int(rows)}")


def _join_carry(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of one row per key; plain equality keeps the left side's partitioning."""
    return left.join(right, list(keys), "left")


_AGGS: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda v, o: F.sum(v),
    "count": lambda v, o: F.count(v),
    "max": lambda v, o: F.max(v),
    "min": lambda v, o: F.min(v),
    "last": lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)),
    "first": lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)),
}


def _window_agg(kind: str, v: Column) -> Column:
    if kind in ("last", "first"):
        # "last" looks back and "first" looks ahead (the window is then reversed),
        # so in both cases the nearest non-null value is the last one of the frame.
        return F.last(v, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](v)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, tuple[str, Column]],
    *,
    include_current: bool = True,
    reverse: bool = False,
    rows: int | None = CHUNK_ROWS,
    ahead: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add running aggregates over all earlier rows of a key.

    Chunks are ``rows`` steps of the order column, which bounds them where it is a
    row number.  For times, whose density isn't known, ``rows=None`` cuts chunks by
    ranges of (key, order) from a sample: each holds a bounded number of rows, and
    the input is read once.

    ``values`` maps an output name to ``(kind, column)``; kinds are sum, count,
    max, min and last (nearest non-null value at or before the row).  With
    ``reverse`` the prefix runs from the end of the stream, so ``first`` gives the
    nearest non-null value at or after the row.  ``ahead`` names values over the rows
    strictly on the other side, which the same pass gives.  ``order`` must be an
    integer that is unique per key.
    """
    keys = list(keys)
    specs = [(n, k, c, reverse, include_current) for n, (k, c) in values.items()]
    specs += [(n, k, c, not reverse, False) for n, (k, c) in (ahead or {}).items()]
    base = df.withColumns({f"__v{i}": s[2] for i, s in enumerate(specs)})
    if rows is None:
        ranged = base.repartitionByRange(*[F.col(k) for k in keys], F.col(order))
        base = cut_lineage(ranged.withColumn(_CHUNK, F.spark_partition_id()))
    else:
        base = base.withColumn(_CHUNK, chunk_id(order, rows))
    o, c = F.col(order), F.col(_CHUNK)

    def prefix(by: Sequence[str], at: Column, back: bool, last: int) -> Window:
        w = Window.partitionBy(*by).orderBy(at.desc() if back else at.asc())
        return w.rowsBetween(Window.unboundedPreceding, last)

    within, between = [*keys, _CHUNK], keys
    local = base.withColumns(
        {f"__l{i}": _window_agg(k, F.col(f"__v{i}")).over(prefix(within, o, back, 0 if own else -1)) for i, (_, k, _, back, own) in enumerate(specs)}
    )
    summary = base.groupBy(*within).agg(*[_AGGS[s[1]](F.col(f"__v{i}"), o).alias(f"__s{i}") for i, s in enumerate(specs)])
    over_chunks = lambda k, v, back: (F.sum(v) if k == "count" else _window_agg(k, v)).over(prefix(between, c, back, -1))
    carry = summary.select(*within, *[over_chunks(s[1], F.col(f"__s{i}"), s[3]).alias(f"__c{i}") for i, s in enumerate(specs)])
    out = _join_carry(local, carry, within)
    names = [s[0] for s in specs]
    done = [_merge(s[1], F.col(f"__c{i}"), F.col(f"__l{i}")).alias(s[0]) for i, s in enumerate(specs)]
    return out.select(*[x for x in df.columns if x not in names], *done)


def nearest_two(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, *, before: str, after: str, rows: int = CHUNK_ROWS
) -> DataFrame:
    """The two nearest non-null values on either side of each row, in one pass.

    Adds two arrays of ``(o, v)``, nearest first: ``before`` at or before the row,
    ``after`` strictly after it.  What chunks hand on is made from the rows that have
    a value; the others only say that their chunk is there, and are pre-aggregated to
    one row.  The input is read twice and its rows are shuffled once.
    """
    keys = list(keys)
    o, within = F.col(order), [*keys, _CHUNK]
    base = df.withColumns({_CHUNK: chunk_id(order, rows), "__e": F.when(value.isNotNull(), F.struct(o.alias("o"), value.alias("v")))})

    def pairs(frame: DataFrame, at: Column, e: str, name: str, back: bool) -> DataFrame:
        """On a row with a value: it and the one next to it in the chunk."""
        w = Window.partitionBy(*within).orderBy(at.desc() if back else at.asc()).rowsBetween(Window.unboundedPreceding, -1)
        both = F.filter(F.array(F.col(e), F.last(e, ignorenulls=True).over(w)), lambda x: x.isNotNull())
        return frame.withColumn(name, F.when(F.col(e).isNotNull(), both))

    known = base.groupBy(*within, F.col("__e.o").alias("__o")).agg(F.max("__e").alias("__e"))
    known = pairs(pairs(known, F.col("__o"), "__e", "__b", False), F.col("__o"), "__e", "__a", True)
    summary = known.groupBy(*within).agg(F.max_by("__b", "__o").alias("__b"), F.min_by("__a", "__o").alias("__a"))
    # Chunks in turn: the two nearest of all chunks before, or after, may lie in two chunks.
    for name, back in (("__b", False), ("__a", True)):
        w = Window.partitionBy(*keys).orderBy(F.col(_CHUNK).desc() if back else F.col(_CHUNK).asc()).rowsBetween(Window.unboundedPreceding, -1)
        summary = summary.withColumn(f"{name}1", F.last(name, ignorenulls=True).over(w))
        full = F.when(F.col(name).isNotNull(), _two(F.col(name), F.col(f"{name}1")))
        summary = summary.withColumn(f"{name}2", full).withColumn(f"{name}2", F.last(f"{name}2", ignorenulls=True).over(w))
    carry = summary.select(*within, "__b2", "__a2")

    local = pairs(pairs(base, o, "__e", "__b", False), o, "__e", "__a", True)
    look = lambda back, last: Window.partitionBy(*within).orderBy(o.desc() if back else o.asc()).rowsBetween(Window.unboundedPreceding, last)
    local = local.withColumn("__b", F.last("__b", ignorenulls=True).over(look(False, 0)))
    local = local.withColumn("__a", F.last("__a", ignorenulls=True).over(look(True, -1)))
    out = _join_carry(local, carry, within)
    kept = [x for x in df.columns if x not in (before, after)]
    none = F.filter(F.array(F.struct(o.alias("o"), value.alias("v"))), lambda x: F.lit(False))
    found = lambda near, far: F.coalesce(_two(F.col(near), F.col(far)), none)
    return out.select(*kept, found("__b", "__b2").alias(before), found("__a", "__a2").alias(after))


def _two(near: Column, far: Column) -> Column:
    """The first two of the near values and then the far ones; null stands for none."""
    return F.when(near.isNull(), far).when(far.isNull(), near).otherwise(F.slice(F.concat(near, far), 1, 2))


def anchored_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    anchor: Column,
    step: Column,
    *,
    default: int | None = 0,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Value of the nearest anchor at or before a row plus the steps since it.

    A row with an anchor gets the anchor; the next one the anchor plus the first
    row's step, and so on.  Ahead of the first anchor the sum starts at
    ``default``.  One pass: a chunk hands on its total and its last anchor.
    """
    keys = list(keys)
    base = df.withColumns({_CHUNK: chunk_id(order, rows), "__a": anchor, "__s": step})
    w = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    before = F.coalesce(F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = base.withColumn("__p", before)
    # The anchor less the steps ahead of it, so that adding a prefix gives the value.
    base = base.withColumn("__r", F.when(F.col("__a").isNotNull(), F.col("__a") - F.col("__p")))
    local = base.withColumn("__lr", F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    summary = base.groupBy(*keys, _CHUNK).agg(
        F.coalesce(F.sum("__s"), F.lit(0)).alias("__tot"),
        F.max_by("__r", F.when(F.col("__r").isNotNull(), F.col(order))).alias("__rel"),
    )
    wc = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("__off", F.coalesce(F.sum("__tot").over(wc), F.lit(0)))
    carried = F.last(F.when(F.col("__rel").isNotNull(), F.col("__rel") - F.col("__off")), ignorenulls=True).over(wc)
    carry = summary.select(*keys, _CHUNK, "__off", carried.alias("__cr"))
    out = _join_carry(local, carry, [*keys, _CHUNK])
    start = F.coalesce("__cr", F.lit(default).cast("bigint")) + F.col("__off")
    kept = [x for x in df.columns if x != name]
    return out.select(*kept, (F.coalesce("__lr", start) + F.col("__p")).alias(name))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors can reach.

    Where the session names none it is a folder in its warehouse.  What is written
    goes when the session ends.
    """
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
        _drop_at_exit(spark, sc.getCheckpointDir())
    return shared


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read, to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def previous(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], *, rows: int = CHUNK_ROWS
) -> DataFrame:
    """The value of the row before, also where the order column has gaps."""
    wrapped = {n: ("last", F.struct(c.alias("v"))) for n, c in values.items()}
    out = running(df, keys, order, wrapped, include_current=False, rows=rows)
    return out.withColumns({n: F.col(n)["v"] for n in values})


def following(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], *, rows: int = CHUNK_ROWS
) -> DataFrame:
    """The value of the row after, also where the order column has gaps."""
    wrapped = {n: ("first", F.struct(c.alias("v"))) for n, c in values.items()}
    out = running(df, keys, order, wrapped, include_current=False, reverse=True, rows=rows)
    return out.withColumns({n: F.col(n)["v"] for n in values})


def with_halo(
    df: DataFrame, order: str, before: int, after: int, *, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Copy border rows into the next chunk; adds ``__chunk`` and ``__own``.

    ``order`` must be consecutive integers per key.  At most ``before + after`` of
    every ``rows`` rows are copied, map-side, before any shuffle.
    """
    rows = max(rows, before + after + 1)
    home = chunk_id(order, rows)
    chunks = F.array_distinct(
        F.array(
            home,
            F.expr(f"(CAST(`{order}` AS BIGINT) + {before}) div {rows}"),
            F.expr(f"(CAST(`{order}` AS BIGINT) - {after}) div {rows}"),
        )
    )
    out = df.withColumn("__home", home).withColumn(_CHUNK, F.explode(chunks))
    return out.withColumn("__own", F.col("__home") == F.col(_CHUNK)).drop("__home")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    before: int,
    after: int,
    columns: Mapping[str, Callable[[Window], Column]],
    *,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``before`` back and ``after`` ahead.

    Each entry of ``columns`` gets the window specification (partitioned by key
    and chunk, ordered by ``order``) and returns a column.
    """
    out = with_halo(df, order, before, after, rows=rows)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    out = out.withColumns({name: fn(w) for name, fn in columns.items()})
    return out.filter("__own").drop(_CHUNK, "__own")


#: Rows that one task counts up at a time.
COUNT_BLOCK = 1 << 16


def count_up(df: DataFrame, keys: Sequence[str], n: Column, name: str, *, block: int = COUNT_BLOCK) -> DataFrame:
    """``(keys, name)``: the numbers 0 to ``n`` - 1 of each row.

    Two levels: blocks first, which are dealt out, and the numbers within a block second, so that neither an array
    nor a task grows with ``n``.  The number of tasks is given: without it adaptive execution, which sees a few
    bytes a block and not the numbers in it, gives all blocks to one task.
    """
    keys = list(keys)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.select(*keys, n.cast("bigint").alias("__n")).where("__n > 0")
    blocks = blocks.withColumn("__b", F.explode(F.expr(f"sequence(0L, (__n - 1) div {block})"))).repartition(tasks, *keys, "__b")
    within = F.explode(F.expr(f"sequence(__b * {block}, least(__n, (__b + 1) * {block}) - 1)"))
    return blocks.select(*keys, within.alias(name))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    levels: Sequence[Column],
    name: str = "seq",
    start: int = 1,
) -> DataFrame:
    """Dense row numbers per key from counts per cell.

    ``levels`` are expressions, coarse to fine, that rise with ``order``; rows are
    numbered inside the finest cell and shifted by the number of rows in all
    earlier cells.  No group is larger than one cell, and no running sum sees more
    rows than one level has cells.
    """
    keys = list(keys)
    lv = [f"__lv{i}" for i in range(len(levels))]
    base = df.withColumns(dict(zip(lv, levels)))
    counts = base.groupBy(*keys, *lv).agg(F.count(F.lit(1)).alias("__n"))
    shift = None
    for depth in range(len(lv)):
        up_to = [*keys, *lv[: depth + 1]]
        cells = counts if depth == len(lv) - 1 else counts.groupBy(*up_to).agg(F.sum("__n").alias("__n"))
        w = (
            Window.partitionBy(*keys, *lv[:depth])
            .orderBy(lv[depth])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        here = cells.select(*up_to, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
        if shift is None:
            shift = here
        else:
            joined = _join_carry(here, shift.withColumnRenamed("__before", "__outer"), up_to[:-1])
            shift = joined.select(*up_to, (F.col("__before") + F.col("__outer")).alias("__before"))
    w = Window.partitionBy(*keys, *lv).orderBy(*order)
    local = base.withColumn("__rn", F.row_number().over(w))
    out = _join_carry(local, shift, [*keys, *lv])
    number = F.col("__rn").cast("bigint") + F.col("__before") + F.lit(start - 1).cast("bigint")
    return out.select(*[x for x in df.columns if x != name], number.alias(name))


def number_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "seq", start: int = 1
) -> DataFrame:
    """Dense row numbers per key in any order, nulls where ``order`` puts them.

    Rows are dealt by ranges of (key, order), which Spark cuts from a sample, so a
    hot key is spread over as many ranges as its rows need, whatever the unit of the
    order columns.  A range numbers its own rows; a key's earlier ranges give the
    rows to add.
    """
    keys = list(keys)
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], *cols).withColumn("__range", F.spark_partition_id())
    # Ranges are sampled anew on each run, so they are written down once.
    dealt = cut_lineage(dealt)
    own = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*cols)).cast("bigint")
    w = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*keys, "__range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    out = _join_carry(dealt.withColumn("__rn", own), before, [*keys, "__range"])
    number = F.col("__rn") + F.col("__before") + F.lit(start - 1).cast("bigint")
    return out.select(*[x for x in df.columns if x != name], number.alias(name))
