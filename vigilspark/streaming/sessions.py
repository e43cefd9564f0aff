"""Sessions from a stream of events, with the batch engine's own sessions, features and labels.

Each micro-batch takes the events of the sessions that are still open from the state, adds its own, and
splits them at close events. Closed sessions go through ``finish`` and are written; events of open ones
are the next state, with the number of sessions that each key has had, so ``seg`` goes on. State and
output are versions named by the micro-batch, written whole before the next one begins: a batch that is
run again replaces its own. Nothing is kept but open sessions and, until ``forget``, one row a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilspark.operators.agents import durable
from vigilspark.operators.documents import labelled
from vigilspark.operators.sessionize import segments

KEY = ["location", "session"]
_KEPT_VERSIONS = 2


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole versions under ``path``, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if n.startswith("v-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/keys/_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _advance(rows: DataFrame, keys: DataFrame | None, out: str, state: str, name: str, finish: Callable[[DataFrame], DataFrame], expire: str | None, forget: str | None, flush: bool = False) -> None:
    """Split ``rows``, of open sessions, at close events: write the sessions that have ended to ``out`` and what is left as version ``name`` of ``state``."""
    tagged = durable(segments(rows))
    now = tagged.groupBy(*KEY).agg(F.count_if(F.col("kind") == "session.closed").alias("n"), F.max("ts").alias("last"), F.max("seg").alias("top"))
    old = (keys if keys is not None else now.limit(0).select(*KEY, F.lit(0).cast("long").alias("had"), "last")).withColumnRenamed("last", "before")
    both = now.join(old, KEY, "full").select(*KEY, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("had", F.lit(0)).alias("had"), F.greatest("last", "before").alias("last"), "top")
    newest = tagged.agg(F.max("ts")).first()[0]
    late = F.lit(flush)
    if expire and newest is not None:
        late = late | (F.col("last") < F.lit(newest) - F.expr(f"interval {expire}"))
    # an open session is the one of the greatest number, unless that one is closed
    both = durable(both.withColumn("over", F.coalesce(late & (F.col("top") == F.col("n")), F.lit(False))))
    with_keys = tagged.join(both.select(*KEY, "n", "had", "over"), KEY)
    ended = with_keys.where("seg < n or over").withColumn("seg", F.col("seg") + F.col("had")).drop("n", "had", "over")
    finish(ended).write.mode("overwrite").parquet(f"{out}/batch={name}")
    with_keys.where("seg = n and not over").select(*rows.columns).write.mode("overwrite").parquet(f"{state}/{name}/open")
    kept = both.select(*KEY, (F.col("had") + F.col("n") + F.col("over").cast("long")).alias("had"), "last", (F.coalesce(F.col("top") == F.col("n"), F.lit(False)) & ~F.col("over")).alias("is_open"))
    if forget and newest is not None:
        kept = kept.where(F.col("is_open") | F.col("last").isNull() | (F.col("last") >= F.lit(newest) - F.expr(f"interval {forget}")))
    kept.drop("is_open").write.mode("overwrite").parquet(f"{state}/{name}/keys")


def stream_sessions(events: DataFrame, out: str, state: str, finish: Callable[[DataFrame], DataFrame] = labelled, expire: str | None = None, forget: str | None = None, **trigger: object) -> StreamingQuery:
    """Start a query that writes the sessions of a streaming ``events`` to ``out`` (Parquet, by micro-batch) as they end.

    ``finish`` makes session rows of events with ``seg``; by default features and labels, as in batch.
    With ``expire``, an interval such as '1 hour', a session whose last event is so much older than the
    newest one comes out unclosed; with ``forget``, so do the numbers of keys, whose ``seg`` then begins
    anew. ``trigger`` is that of the writer, by default what is available now. Events of a key are ordered
    by ``seq`` within what is open; one that arrives after its session has ended begins another.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"v-{number:09d}"
        earlier = [v for v in _versions(spark, state) if v < name]
        rows, keys = batch, None
        if earlier:
            rows = spark.read.schema(batch.schema).parquet(f"{state}/{earlier[-1]}/open").unionByName(batch)
            keys = spark.read.parquet(f"{state}/{earlier[-1]}/keys")
        _advance(rows, keys, out, state, name, finish, expire, forget)
        for v in earlier[:-_KEPT_VERSIONS]:
            _drop(spark, f"{state}/{v}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", f"{state}/progress").trigger(**(trigger or {"availableNow": True})).start()


def flush_sessions(spark: SparkSession, out: str, state: str, finish: Callable[[DataFrame], DataFrame] = labelled) -> None:
    """Once the query has ended: write the sessions that are still open, unclosed. A query begun later goes on after them."""
    found = _versions(spark, state)
    if found and not found[-1].endswith("-flush"):
        rows, keys = spark.read.parquet(f"{state}/{found[-1]}/open"), spark.read.parquet(f"{state}/{found[-1]}/keys")
        _advance(rows, keys, out, state, f"{found[-1]}-flush", finish, None, None, flush=True)
