"""Sharding by a k-d tree over document metadata.

The cell of most bytes is not sought: every cell above the target is split in the same round, at the
weighted median of its relatively widest dimension, until all cells are small enough. Medians come
from histograms: a pass counts bytes in ``BINS`` bins a cell, the next one looks into the bin that
holds the middle, until that bin is one value. No large cell's rows are ever brought together; a cell
of at most ``LOCAL_ROWS`` rows, and an eighth of all, is split to its leaves by one task, in the same
way, which spares the deep levels a round each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

SHARD_BYTES, BINS = 256 << 20, 4096
#: Rows, and share of all rows, of a cell that one task splits to its leaves.
LOCAL_ROWS, LOCAL_SHARE = 20_000, 8
#: Levels whose paths fit a long.
DEEPEST = 62


def coded(value: Column) -> Column:
    """A string as a whole number, equal for equal values: the first 32 bits of its MD5; null as -1."""
    return F.coalesce(F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long"), F.lit(-1).cast("long"))


def number(value: Column) -> Column:
    return F.coalesce(value.cast("long"), F.lit(-1).cast("long"))


def medians(rows: DataFrame, cells: DataFrame, bins: int = BINS) -> DataFrame:
    """(cell, at): the least value v of each cell with at least half of its weight at values up to v; where that is the greatest value, the next lower one.

    ``rows(cell, v, w)``; ``cells(cell, low, high, total)`` with the range of v, of more than one value, and the sum of w.
    """
    done, cells = None, cells.select("cell", "low", "high", "total", F.lit(0).cast("long").alias("under"), F.lit(None).cast("long").alias("lower"), F.col("high").alias("top"))
    while True:
        here = rows.join(maybe_broadcast(cells), "cell").where("v between low and high")
        kept = [F.first(c).alias(c) for c in ("total", "under", "lower", "top")]
        counted = here.groupBy("cell", F.expr(f"(v - low) div ((high - low) div {bins} + 1)").alias("bin")).agg(F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"), *kept)
        up = Window.partitionBy("cell").orderBy("bin")
        # ``lower`` is the greatest value below the bin: of the bins before it, or from the pass before
        counted = counted.withColumn("upto", F.col("under") + F.sum("w").over(up)).withColumn("lower", F.coalesce(F.lag("high").over(up), F.col("lower")))
        middle = counted.where("2 * upto >= total").withColumn("k", F.row_number().over(up)).where("k = 1")
        middle = cut(middle.select("cell", "low", "high", "total", (F.col("upto") - F.col("w")).alias("under"), "lower", "top"))
        found = middle.where("low = high").select("cell", F.when(F.col("high") == F.col("top"), F.col("lower")).otherwise(F.col("high")).alias("at"))
        done = found if done is None else done.union(found)
        cells = middle.where("low < high")
        if cells.isEmpty():
            return done


def _leaves(names: list[str], spans: list[float], target: int):
    """The whole subtree of one cell."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows[names].to_numpy(np.int64).T
        weight, out = rows["w"].to_numpy(np.int64), rows["cell"].to_numpy(np.int64).copy()
        left = [np.arange(len(rows))]
        while left:
            own = left.pop()
            v = values[:, own]
            share = [(float(x.max()) - float(x.min())) / s if s else 0.0 for x, s in zip(v, spans)]
            if weight[own].sum() <= target or max(share) <= 0:
                continue
            x = v[share.index(max(share))]
            order = np.argsort(x, kind="stable")
            upto = np.cumsum(weight[own][order])
            at = x[order][np.searchsorted(2 * upto, upto[-1])]
            if at == x.max():
                at = x[x < at].max()
            if out[own[0]] >= 1 << DEEPEST:
                raise OverflowError(f"the tree is deeper than {DEEPEST} levels")
            out[own] = 2 * out[own] + (x > at)
            left += [own[x <= at], own[x > at]]
        return pd.DataFrame({"id": rows["id"], "w": weight, "cell": out})

    return run


def kd_shards(docs: DataFrame, numbers: tuple[str, ...] = ("n_chars", "doc_id"), strings: tuple[str, ...] = ("source", "lang"), target_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, local_rows: int | None = None) -> DataFrame:
    """(doc_id, bytes, shard), a row for each row of ``docs``.

    ``shard`` is the path from the root (1): 2 s below or at the median of cell s, 2 s + 1 above it. A
    cell is split while its texts have more than ``target_bytes`` bytes and its rows differ in some
    dimension; the widest is that of the largest span, relative to the span of the whole table, the
    first of equal ones. Where the median is the greatest value, the next lower value takes its place,
    so both sides have rows. Null metadata counts as -1, null and empty texts have 0 bytes. A text
    above the target is a shard of its own or with rows of equal metadata, and so are repeated rows.
    A column of ``numbers`` that isn't a number goes by the hash of its text, as ``strings`` do;
    identifiers may be of any type. Other columns aren't read; an empty table gives no rows. Raises
    OverflowError beyond 62 levels.
    """
    kinds = {f.name: f.dataType.typeName() for f in docs.schema.fields}
    is_number = lambda c: kinds.get(c) in ("byte", "short", "integer", "long", "float", "double", "decimal")
    dims = [number(F.col(c)) if is_number(c) else coded(F.col(c).cast("string")) for c in numbers] + [coded(F.col(c).cast("string")) for c in strings]
    names = [f"d{i}" for i in range(len(dims))]
    weight = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    level = cut(docs.select(F.col(id_col).alias("id"), weight.alias("w"), F.lit(1).cast("long").alias("cell"), *[d.alias(n) for d, n in zip(dims, names)]))
    ends = [f(n).alias(f"{k}_{n}") for n in names for k, f in (("low", F.min), ("high", F.max))]
    whole = level.agg(F.count(F.lit(1)).alias("n"), *ends).first()
    local_rows = min(LOCAL_ROWS, whole["n"] // LOCAL_SHARE) if local_rows is None else local_rows
    spans = [float(whole[f"high_{n}"] or 0) - float(whole[f"low_{n}"] or 0) for n in names]
    share = [(F.col(f"high_{n}").cast("double") - F.col(f"low_{n}").cast("double")) / F.lit(s) if s else F.lit(0.0) for n, s in zip(names, spans)]
    widest = F.greatest(*share) if len(share) > 1 else share[0]
    dim, low, high = (F.lit(None).cast("long") for _ in range(3))
    for i in reversed(range(len(names))):
        best = share[i] == widest
        dim, low, high = F.when(best, i).otherwise(dim), F.when(best, F.col(f"low_d{i}")).otherwise(low), F.when(best, F.col(f"high_d{i}")).otherwise(high)
    finished, near = [], []
    for _ in range(DEEPEST + 1):
        cells = level.groupBy("cell").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"), *ends)
        cells = cut(cells.where(F.col("total") > target_bytes).where(widest > 0).select("cell", "total", "n", dim.alias("dim"), low.alias("low"), high.alias("high")))
        known = maybe_broadcast(cells.select("cell", "n", "dim"))
        finished.append(level.join(maybe_broadcast(cells.select("cell")), "cell", "left_anti").select("id", "w", "cell"))
        if cells.isEmpty():
            break
        level = level.join(known, "cell")
        near.append(level.where(F.col("n") <= local_rows).select("id", "w", "cell", *names))
        large = cells.where(F.col("n") > local_rows)
        if large.isEmpty():
            break
        valued = level.where(F.col("n") > local_rows).withColumn("v", F.coalesce(*[F.when(F.col("dim") == i, F.col(n)) for i, n in enumerate(names)]))
        split = maybe_broadcast(cut(medians(valued.select("cell", "v", "w"), large, bins)))
        level = cut(valued.join(split, "cell").withColumn("cell", F.expr("if(v <= at, 2 * cell, 2 * cell + 1)")).select("id", "w", "cell", *names))
    else:
        raise OverflowError(f"the tree is deeper than {DEEPEST} levels")
    out = finished[0]
    for more in finished[1:]:
        out = out.union(more)
    if near:
        every = near[0]
        for more in near[1:]:
            every = every.union(more)
        kind = docs.schema[id_col].dataType.simpleString()
        out = out.union(every.groupBy("cell").applyInPandas(_leaves(names, spans, target_bytes), f"id {kind}, w long, cell long"))
    return out.select(F.col("id").alias("doc_id"), F.col("w").alias("bytes"), F.col("cell").alias("shard"))
