"""Whole-file sources, numbered sequences, captions and joined inputs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.operators.cues import caption_events


def scan_media(
    spark: SparkSession, path: str, *, glob: str | None = None, modified_after: str | None = None, payload: bool = True
) -> DataFrame:
    """Files with name, size and, if asked, payload."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    df = r.load(path).withColumnsRenamed({"path": "filename", "length": "file_size", "content": "data"})
    return df if payload else df.drop("data")


def numbered_run(files: DataFrame, pattern: str, *, keys: Sequence[str] = (), name: str = "filename") -> DataFrame:
    """Files of a numbered sequence: the first index is 0 to 4, then no gap.

    ``pattern`` has one ``%d`` or ``%0Nd``.  The run ends at the first index whose
    successor is missing, found with a join instead of walking the sequence.
    """
    marks = re.findall(r"%0?(\d*)d", pattern)
    if len(marks) != 1:
        raise ValueError("pattern needs exactly one %d")
    head, tail = re.split(r"%\d*d", pattern)
    width = int(marks[0] or 1)
    rx = re.escape(head) + r"(\d{" + str(width) + r",})" + re.escape(tail) + "$"
    keys = list(keys)
    found = files.withColumn("idx", F.regexp_extract(name, rx, 1)).filter("idx <> ''").withColumn("idx", F.col("idx").cast("bigint"))
    idx = found.select(*keys, "idx").distinct()
    first = idx.filter("idx < 5").groupBy(*keys, F.lit(0).alias("__k")).agg(F.min("idx").alias("__first"))
    nxt = idx.withColumn("idx", F.col("idx") - 1)
    ends = idx.join(nxt, [*keys, "idx"], "left_anti").withColumn("__k", F.lit(0)).join(first, [*keys, "__k"]).filter("idx >= __first")
    last = ends.groupBy(*keys, "__k", "__first").agg(F.min("idx").alias("__last"))
    out = found.withColumn("__k", F.lit(0)).join(last, [*keys, "__k"])
    return out.filter("idx BETWEEN __first AND __last").drop("__k", "__first", "__last")


def scan_numbered(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The files of a folder that make up a numbered sequence."""
    return numbered_run(scan_media(spark, folder, payload=False), pattern)


def concat_sources(parts: Sequence[DataFrame], *, size: str = "size", pos: str | None = "pos") -> DataFrame:
    """Inputs played one after another: ordinal and position from the first one's start."""
    out, starts = None, None
    for i, p in enumerate(parts):
        p = p.withColumn("part_no", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    sizes = out.groupBy("part_no").agg(F.sum(size).alias("__n"))
    # One row per input.
    later = sizes.select(F.explode(F.sequence(F.col("part_no") + 1, F.lit(len(parts)))).alias("part_no"), "__n")
    starts = later.groupBy("part_no").agg(F.sum("__n").alias("part_start"))
    out = out.join(starts, "part_no", "left").withColumn("part_start", F.coalesce("part_start", F.lit(0)))
    return out.withColumn(pos, F.col(pos) + F.col("part_start")) if pos else out


def caption_lines(files: DataFrame, *, key: str = "file_id", text: str = "text") -> DataFrame:
    """Lines of caption scripts with their numbers."""
    return files.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def scan_caption_script(spark: SparkSession, path: str) -> DataFrame:
    """Dialogue events of caption scripts (small text files, read whole)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))
    return caption_events(caption_lines(files))
