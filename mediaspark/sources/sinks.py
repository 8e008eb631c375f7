"""Writers: manifests, packets, logs, raw bytes and indexes."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.operators.packets import frame_manifest


def manifest_lines(df: DataFrame, *, data: str = "data") -> DataFrame:
    """Text lines ``stream, time, size, checksum`` of a frame manifest."""
    m = frame_manifest(df, data=data)
    line = F.format_string("%d, %d, %d, 0x%08x", "stream_index", "dts", "size", "checksum")
    return m.select("stream_id", "stream_index", "dts", line.alias("line"))


def write_frame_manifest(df: DataFrame, path: str, *, data: str = "data") -> None:
    manifest_lines(df, data=data).select("line").write.mode("overwrite").text(path)


def packet_names(df: DataFrame, *, num: str = "seq") -> DataFrame:
    """Object names: number, stream, time, size and key flag."""
    flag = F.when(F.col("is_key"), "K").otherwise("_")
    ts = F.coalesce(F.col("pts"), F.lit(-(1 << 63)))
    return df.withColumn("name", F.format_string("%05d_%02d_%d_%d_%s.bin", F.col(num), F.col("stream_index"), ts, F.col("size"), flag))


def write_packets(df: DataFrame, path: str, *, max_packets: int | None = None, num: str = "seq") -> None:
    """Packets with their names, in one folder per stream; optionally the first N."""
    if max_packets is not None:
        df = df.orderBy(num).limit(max_packets)
    packet_names(df, num=num).write.mode("overwrite").partitionBy("stream_index").parquet(path)


def vstats_lines(stats: DataFrame) -> DataFrame:
    """Log lines per frame from ``frame_stats``."""
    line = F.format_string(
        "frame= %5d q= %2.1f f_size= %6d s_size= %8.0fkB time= %.3f br= %7.1fkbits/s avg_br= %7.1fkbits/s type= %s",
        "frame_no", F.col("q").cast("double"), "size", F.col("total_size") / F.lit(1024.0), "time", "bitrate", "avg_bitrate", "pict_type",
    )
    return stats.select("stream_id", "frame_no", line.alias("line"))


def write_vstats(stats: DataFrame, path: str) -> None:
    vstats_lines(stats).write.mode("overwrite").partitionBy("stream_id").text(path)


def write_seek_index(index: DataFrame, table: str, *, buckets: int = 64) -> None:
    """A seek index bucketed by stream and sorted by time, for joins without a shuffle."""
    index.write.mode("overwrite").bucketBy(buckets, "stream_id").sortBy("stream_id", "stream_index", "ts").saveAsTable(table)


def write_raw(df: DataFrame, path: str, *, order: str = "packet_no", data: str = "data", parts: int | None = None) -> DataFrame:
    """Bytes in order as numbered part files; returns part names and sizes.

    A task writes its part under a temporary name and moves it into place, so a
    repeated task leaves one whole file.
    """
    parts = parts or max(df.sparkSession.sparkContext.defaultParallelism, 1)
    ranged = df.select(order, data).repartitionByRange(parts, order).sortWithinPartitions(order)

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        ctx = TaskContext.get()
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{ctx.partitionId():05d}.bin"
        temp = f"{root}/_temp-{ctx.taskAttemptId()}"
        size = 0
        with system.open_output_stream(temp) as out:
            for b in batches:
                for piece in b[data]:
                    size += len(piece)
                    out.write(bytes(piece))
        system.move(temp, name)
        yield pd.DataFrame({"part": [name], "size": [size]})

    result = ranged.mapInPandas(run, "part string, size bigint")
    # Write now; the list of parts is one row per task.
    return df.sparkSession.createDataFrame(result.collect(), "part string, size bigint")


def sink_null(df: DataFrame) -> None:
    """Compute every row and throw it away."""
    df.write.format("noop").mode("overwrite").save()
