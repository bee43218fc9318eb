"""Stateless and aggregating streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import dims, enrich
from ..plans.rollup import LG_K, Rollup, build, merge, partials, write_partials
from ..plans.sizing import pin_if_small
from ..sources import netflow

LATENESS = "24 hours"


def read_stream(
    spark: SparkSession, path: str, schema: StructType, max_files: int = 1000, newest_first: bool = False, files: str = "*"
) -> DataFrame:
    """File stream over a folder; ``max_files`` per trigger is the back-pressure."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("latestFirst", newest_first)
        .option("pathGlobFilter", files)
        .parquet(path)
    )


def _run(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def with_counters(flows: DataFrame, name: str = "ingest") -> DataFrame:
    """Ingest counters as observed metrics (seen by a StreamingQueryListener or Observation)."""
    clamped = F.count(F.when(F.col("clamped"), 1)) if "clamped" in flows.columns else F.lit(0).cast("long")
    return flows.observe(name, F.count("*").alias("received"), clamped.alias("clamped"))


def ingest_counters(flows: DataFrame) -> DataFrame:
    """The same counters of a finished batch."""
    return flows.agg(
        F.count("*").alias("received"), F.count(F.when(F.col("clamped"), 1)).alias("clamped"),
        F.count(F.when(~F.col("clamped"), 1)).alias("kept"),
    )


COUNTERS = ("received", "decode_errors", "written", "clamped")


def ingest_v5(datagrams: DataFrame, root: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Decodes a stream of v5 datagrams into ``root/flows``, with undecodable ones in ``root/dead_letters`` and what happened in ``root/counters``.

    Counters are observed on the rows as they are written, so no batch is read again for them. A batch owns its ``batch_id`` partition of all three tables
    and overwrites it on retry, so replays neither lose nor double count.
    """

    def save(rows: DataFrame, name: str, batch_id: int) -> None:
        out = rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("batch_id").parquet(f"{root}/{name}")

    def batch(df: DataFrame, batch_id: int) -> None:
        came, went = Observation(), Observation()
        checked = df.withColumn("error", netflow.v5_error()).observe(came, F.count("*").alias("received"), F.count("error").alias("decode_errors"))
        save(checked.filter("error IS NOT NULL"), "dead_letters", batch_id)
        flows = enrich.clamp_timestamps(netflow.decode_netflow_v5(df, keep=("received_at",)))
        flows = flows.observe(went, F.count("*").alias("written"), F.count(F.when(F.col("clamped"), 1)).alias("clamped"))
        save(flows, "flows", batch_id)
        counted = came.get | went.get
        save(df.sparkSession.createDataFrame([tuple(int(counted[c]) for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS)), "counters", batch_id)

    return _run(datagrams.writeStream.foreachBatch(batch), checkpoint, interval)


def read_counters(spark: SparkSession, root: str) -> DataFrame:
    """Totals of all batches of :func:`ingest_v5`, one row."""
    return spark.read.parquet(f"{root}/counters").agg(*(F.sum(c).alias(c) for c in COUNTERS))


def write_flow_stream(flows: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append sink, day partitioned; exactly once through the checkpoint and the file sink log."""
    out = flows.withColumn("dt", F.to_date("timestamp"))
    return _run(out.writeStream.format("parquet").partitionBy("dt").option("path", path), checkpoint, interval)


def enrich_batches(
    flows: DataFrame,
    links: Callable[[], DataFrame],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Re-reads the link dimension for every micro-batch, so configuration changes take effect in the stream."""

    def batch(df: DataFrame, batch_id: int) -> None:
        interfaces = pin_if_small(enrich.interface_map(dims.current_links(links())))
        sink(enrich.attribute_links(df, interfaces), batch_id)

    return _run(flows.writeStream.foreachBatch(batch), checkpoint, interval)


def rollup_stream(
    flows: DataFrame, specs: list[Rollup], root: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Incremental rollups: every micro-batch appends its partial rows, however late its flows are.

    A batch owns its ``batch_id`` partition and overwrites it on retry, so replays do not double count.
    Readers merge.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        # Kept for the other rollups of the batch (spills to disk; a lost executor recomputes its part).
        kept = df.persist() if len(specs) > 1 else df
        for spec in specs:
            write_partials(build(kept, spec), spec, f"{root}/{spec.name}", batch_id)
        kept.unpersist()

    return _run(flows.writeStream.foreachBatch(batch), checkpoint, interval)


def read_rollup(spark: SparkSession, root: str, spec: Rollup) -> DataFrame:
    """Merged view of a rollup written by :func:`rollup_stream`."""
    rows = spark.read.parquet(f"{root}/{spec.name}")
    return merge(rows.drop("batch_id", "dt"), spec)


def windowed_rollup(flows: DataFrame, spec: Rollup, lateness: str = LATENESS) -> DataFrame:
    """Watermarked variant: final rows in append mode, flows later than the watermark are dropped. Sketches are built from the flows."""
    timed = flows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    rows = partials(timed, spec, bucketed=False)
    w = F.window("ts", f"{spec.seconds} seconds").alias("w")
    aggs = [F.sum(c).alias(c) for c in spec.sums] + [F.hll_sketch_agg(src, F.lit(LG_K)).alias(out) for out, src in spec.sketches]
    sums = rows.groupBy(w, *spec.keys).agg(*aggs)
    return sums.select(F.col("w.start").alias("ts"), *spec.keys, *spec.sums, *(out for out, _ in spec.sketches))


def sliding_rates(minutes: DataFrame, window_seconds: int, step_seconds: int = 30, lateness: str = LATENESS) -> DataFrame:
    """Per-target sums of the last W seconds every step, over a stream of minute rows (ts, dst_ip, bytes, packets)."""
    timed = minutes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    slide = F.window("ts", f"{window_seconds} seconds", f"{step_seconds} seconds")
    return timed.groupBy(slide.alias("w"), "dst_ip").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets")).select(
        F.col("w.end").alias("tick"), "dst_ip", (F.col("bytes") * 8 / window_seconds).alias("bps"),
        (F.col("packets") / window_seconds).alias("pps"),
    )
