"""Sessions, leases and work time from heartbeats, as batch operators and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def sessions(beats: DataFrame, gap_seconds: float, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Stretches of heartbeats of a key that are no more than the gap apart: key, n, first and last beat.

    A gap as long as the limit still joins; a key's beats are sorted in one task, as a session of a key is a sequence.
    """
    w = Window.partitionBy(key).orderBy(ts)
    far = _seconds(ts) - F.lag(_seconds(ts)).over(w) > gap_seconds
    numbered = beats.where(F.col(ts).isNotNull()).withColumn("_s", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_s").agg(F.count("*").alias("n"), F.min(ts).alias("desde"), F.max(ts).alias("hasta")).drop("_s")


def work_seconds(touches: DataFrame, idle_seconds: float, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Seconds worked per key: gaps between touches, each counted up to the idle limit."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = _seconds(ts) - F.lag(_seconds(ts)).over(w)
    return touches.withColumn("_g", F.least(gap, F.lit(float(idle_seconds)))).groupBy(key).agg(F.coalesce(F.sum("_g"), F.lit(0.0)).alias("segundos"))


def leases(requests: DataFrame, ttl_seconds: float, item: str = "item", who: str = "user_id", ts: str = "ts") -> DataFrame:
    """Outcome of each request for an item: granted if free, one's own, or the last holder has been silent for longer than the limit.

    A request that comes more than the limit after the one before it is granted whatever went before, so an item's history
    falls into stretches that do not depend on each other. Stretches are dealt over the tasks, and their rows pass in order
    of time through a state machine that holds the last item, holder and time only. Requests without a time are left out.
    """
    order = [F.col(item), F.col("_t"), F.col(who), F.col("event_id")]
    rows = requests.where(F.col(ts).isNotNull()).select(item, who, "event_id", _seconds(ts).alias("_t"))
    w = Window.partitionBy(item).orderBy("_t", who, "event_id")
    far = F.col("_t") - F.lag("_t").over(w) > ttl_seconds
    cut = rows.withColumn("_s", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, holder, seen = None, None, 0.0
        for b in batches:
            out = []
            for i, n, u, t in zip(b[item], b["_s"], b[who], b["_t"]):
                ok = (i, n) != now or u == holder or t - seen > ttl_seconds
                if ok:
                    now, holder, seen = (i, n), u, t
                out.append(ok)
            yield pd.DataFrame({item: b[item], "event_id": b["event_id"], "concedido": out})

    kind = requests.schema[item].dataType.simpleString()
    dealt = cut.repartition(item, "_s").sortWithinPartitions(item, "_s", *order[1:])
    return dealt.mapInPandas(run, f"{item} {kind}, event_id long, concedido boolean")


def session_stream(beats: DataFrame, gap: str = "60 seconds", late: str = "5 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The sessions of a stream: event-time session windows under a watermark; works on batches too."""
    return beats.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), "n")


def ingest_stream(spark, path: str, schema, sink, checkpoint: str):
    """Reads what is new under a path in one go and hands each micro-batch to `sink`; the checkpoint is the ledger of what is done."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
