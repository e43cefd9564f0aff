"""Shared parts: lineage cuts, size-checked joins, ranks without a hot window."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a table, as estimated from its rows and column types, that may be broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20
_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "boolean": 1}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where that is unset, and under a local master, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="vigilspark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute now, once, into the shared folder: a lost executor loses nothing of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether an already materialised ``df`` is within ``limit``: 32 bytes a row for the hash table, 8 a number; text columns are measured."""
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    row = 32 + sum(_WIDTH.get(t, 8) for _, t in df.dtypes)
    most = limit // row + 1
    found = df.limit(most).agg(F.count(F.lit(1)), *text).first()
    return found[0] < most and found[0] * row + sum(found[1:]) <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a materialised table after measuring it; a larger one is left to a shuffle join."""
    return F.broadcast(df) if small(df, limit) else df


def numbered(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ``id_col`` as a long, and the (name, number) table where the identifiers aren't whole numbers, else None.

    Other identifiers are numbered in their order as strings: distinct ones are range-partitioned and
    sorted, so the smallest number is the smallest name.
    """
    if rows.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return rows.withColumn(id_col, F.col(id_col).cast("long")), None
    rows = rows.withColumn(id_col, F.col(id_col).cast("string"))
    names = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__name")).distinct().repartitionByRange("__name").sortWithinPartitions("__name")
    names = cut(names.select("__name", F.monotonically_increasing_id().alias("__number")))
    joined = rows.join(maybe_broadcast(names), rows[id_col] == names["__name"], "left").drop("__name")
    return joined.withColumn(id_col, F.col("__number")).drop("__number"), names


def renamed(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """``columns`` of ``numbered`` back as they were; as they are where ``names`` is None."""
    if names is None:
        return df
    order = df.columns
    for c in columns:
        df = df.join(maybe_broadcast(names.select(F.col("__number").alias(c), F.col("__name").alias("__back"))), c, "left").withColumn(c, F.col("__back")).drop("__back")
    return df.select(*order)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ranked(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, name: str) -> DataFrame:
    """Zero-based rank ``name`` by (chunk, order) within ``keys``.

    A window over ``keys`` alone would put a hot key into one task. Rows are ranked within
    (keys, chunk) instead and shifted by the rows in earlier chunks, a table of keys x chunks.
    """
    df = df.withColumn("__chunk", chunk)
    sizes = df.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    return (
        df.withColumn("__rank", F.row_number().over(inner) - 1)
        .join(shift, [*keys, "__chunk"])
        .withColumn(name, F.col("__rank") + F.col("__before"))
        .drop("__rank", "__before", "__chunk")
    )


def running_total(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows by (chunk, order) within ``keys``, in two levels as in ``ranked``."""
    df = df.withColumn("__chunk", chunk)
    sizes = df.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn(
        "__before", F.coalesce(F.sum("__n").over(earlier(Window.partitionBy(*keys).orderBy("__chunk"))), F.lit(0))
    ).drop("__n")
    inner = earlier(Window.partitionBy(*keys, "__chunk").orderBy(*order))
    return (
        df.withColumn("__sum", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(shift, [*keys, "__chunk"])
        .withColumn(name, F.col("__sum") + F.col("__before"))
        .drop("__sum", "__before", "__chunk")
    )


def word_tokens(text: Column) -> Column:
    """Number of runs of non-blank characters: the token count of the mixing and packing operators, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _star_round(e: DataFrame) -> DataFrame:
    # large star: every larger neighbour of u goes to the smallest of u and its neighbours
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    e1 = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    # small star: the smaller neighbours of u, and u, go to the smallest of them
    low = e1.groupBy("a").agg(F.min("b").alias("m"))
    e2 = e1.join(low, "a")
    e2 = e2.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return e2.where("a != b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each is one shuffle of at
    most the edges left, rounds grow with the logarithm of the diameter. A hot node's neighbours are
    not gathered into one row: its minimum comes from an aggregate with map-side combining and is
    joined back. Two rounds go between lineage cuts. Loops only keep single nodes. Null ends are dropped.
    Raises if rounds run out.
    """
    e = edges.where("a is not null and b is not null").select("a", "b")
    nodes = cut(e.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    e = cut(e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.isEmpty():
        return nodes.select("node", F.col("node").alias("component"))
    seen = None
    for _ in range(max_rounds // 2):
        e = cut(_star_round(_star_round(e)))
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
