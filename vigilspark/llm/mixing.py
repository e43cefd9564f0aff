"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled and cut into blocks of equal tokens. Slot i of the schedule is
the golden-ratio point frac((i + 1) / phi) mapped through the cumulative weights to a source; the
slot's rank among its source's slots picks the block. Any stretch of the schedule is close to the
weights, without randomness and without a hot window: ranks and running totals are taken in two levels.
The schedule runs until every source has been used whole; sources of more weight than share are
repeated as often as that takes, so the weights hold to its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, ranked, running_total, word_tokens

BLOCK_TOKENS, SEED = 8192, 11
#: Weight of a source without a given target: its blocks to this power. So the largest source sets the schedule's length, and one of n times fewer blocks is repeated n^0.1 times.
POWER = 0.9
GOLDEN = 0.6180339887498949
#: Weights are whole parts of this, so that they don't hang on the order of a sum.
UNIT = 1_000_000
_SLOTS_A_CHUNK, _CELLS = 65_536, 4096


def token_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, h, source, tokens, shuffle): once for rows that repeat identifier, text and source, of which h is the hash."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col), source).alias("h"), source.alias("source"),
        word_tokens(F.col(text_col)).alias("tokens"), key.alias("shuffle"),
    ).dropDuplicates()


def weighted(totals: DataFrame, targets: dict[str, float] | None, block: int) -> DataFrame:
    """(source, blocks, weight, low, high): whole weights and the interval of each source, in their order."""
    blocks = F.expr(f"(total + {block - 1}) div {block}")
    base = F.pow(blocks.cast("double"), F.lit(POWER))
    if targets is not None:
        base = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col("source")], F.lit(0.0)) if targets else F.lit(0.0)
    every = Window.partitionBy()
    rows = totals.where("total > 0").withColumn("base", base).where("base > 0")
    rows = rows.withColumn("weight", F.greatest(F.lit(1), F.floor(F.col("base") / F.sum("base").over(every) * UNIT)).cast("long"))
    high = F.sum("weight").over(every.orderBy("source"))
    return rows.select("source", blocks.alias("blocks"), "weight", (high - F.col("weight")).alias("low"), high.alias("high"), F.sum("weight").over(every).alias("all"))


def _slots(sources: DataFrame, first: int, end: int) -> DataFrame:
    """(slot, columns of sources) of the slots first .. end - 1, each with the source on whose interval its point falls."""
    point = F.col("id") + 1
    slots = sources.sparkSession.range(first, end).select(F.col("id").alias("slot"), (point * GOLDEN - F.floor(point * GOLDEN)).alias("u"))
    # interval join by cells of the unit interval: a source lies in its cells and no others
    cells = sources.withColumn("cell", F.explode(F.sequence(F.expr(f"low * {_CELLS} div all"), F.expr(f"(high - 1) * {_CELLS} div all + 1"))))
    at = F.col("u") * F.col("all")
    return slots.withColumn("cell", F.floor(F.col("u") * _CELLS)).join(maybe_broadcast(cells), "cell").where((at >= F.col("low")) & (at < F.col("high"))).drop("cell", "u")


def _whole_length(sources: DataFrame) -> int:
    """Slots until each source is expected to have as many as blocks and does have them; 0 without sources."""
    length = sources.agg(F.max(F.expr("(blocks * all + weight - 1) div weight"))).first()[0] or 0
    got = _slots(sources, 0, length).groupBy("source").agg(F.count(F.lit(1)).alias("got"))
    short = cut(sources.join(got, "source", "left").withColumn("left", F.col("blocks") - F.coalesce("got", F.lit(0))).where("left > 0"))
    number, end, gap = short.count(), length, 3
    while number:
        # n points in a row leave no gap of 2 / n: gap * all / weight slots meet a source; twice as many should rounding be in the way
        reach = short.withColumn("reach", F.expr(f"{length} + left * ({gap} * all div weight + 1)"))
        more = _slots(reach, length, reach.agg(F.max("reach")).first()[0]).where("slot < reach")
        more = more.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("slot"))).where("nth = left")
        last, found = more.agg(F.max("slot"), F.count(F.lit(1))).first()
        if found == number:
            end = last + 1
            break
        gap *= 2
    return end


def schedule(docs: DataFrame, targets: dict[str, float] | None = None, block: int = BLOCK_TOKENS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", until: str = "every") -> DataFrame:
    """(id, h, source, tokens, slot, epoch, start): where each document goes; h is the hash of its text and source.

    The schedule is as long as it takes every source to be used whole at least once: as long as is
    expected by the weights, or to the slot at which the last source has one for each of its blocks
    where points fall late. Sources of more weight than share are repeated; no slot is left empty, so
    every stretch has the weights. With ``until='first'`` it ends where the first source would be
    repeated: nothing comes twice, and what the other sources have left over is left out.

    With ``targets``, sources that it doesn't name or gives nothing are left out. A block is a stretch
    of ``block`` tokens of its source's stream; a document belongs to the block in which it starts, one
    without tokens to that of the document before it, and is never cut, however long. Null sources are
    the source '', null texts have no tokens, null identifiers are shuffled as ''. Identifiers may be of
    any type. An empty table, or one without tokens, gives no rows.
    """
    rows = cut(token_rows(docs, id_col, text_col, source_col, seed))
    sources = cut(weighted(rows.groupBy("source").agg(F.sum("tokens").alias("total")), targets, block))
    order = [F.col(c) for c in ("shuffle", "id", "h", "tokens")]
    placed = running_total(rows.where("tokens >= 0"), ["source"], order, F.substring("shuffle", 1, 3), "tokens", "start")
    known = maybe_broadcast(sources.select("source", "blocks"))
    placed = placed.join(known, "source").withColumn("block", F.least(F.expr(f"start div {block}"), F.col("blocks") - 1))

    slots = _slots(sources, 0, _whole_length(sources))
    slots = ranked(slots.select("source", "blocks", "slot"), ["source"], [F.col("slot")], F.expr(f"slot div {_SLOTS_A_CHUNK}"), "rank")
    if until == "first":
        slots = cut(slots)
        end = slots.where("rank = blocks").agg(F.min("slot")).first()[0]
        slots = slots if end is None else slots.where(F.col("slot") < end)
    slots = slots.select("source", "slot", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("epoch"))
    return placed.join(slots, ["source", "block"]).select("id", "h", "source", "tokens", "slot", "epoch", "start")


def mixed_order(docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, source, tokens, slot, epoch, start): the schedule over ``docs``; edge cases as in ``schedule``."""
    return schedule(docs, targets).select(F.col("id").alias("doc_id"), "source", "tokens", "slot", "epoch", "start")


def mix_documents(docs: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` in the order of the schedule, once for each epoch; all columns, whatever their names.

    Partition p holds the p-th stretch of slots, sorted: files read in order are the mixed stream. Rows
    that are equal in identifier, text and source share a place and all come. Rows of null identifier,
    text or source are placed as in ``schedule``; a table without tokens gives no rows.
    """
    plan = cut(schedule(docs, targets, id_col=id_col, text_col=text_col, source_col=source_col))
    ends = plan.agg(F.max("slot"), F.count(F.lit(1))).first()
    if not ends[1]:
        return docs.limit(0)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = {c: f"__mix_{c}" for c in ("id", "h", "slot", "start", "part")}
    while any(n.lower() in {c.lower() for c in docs.columns} for n in names.values()):
        names = {c: "_" + n for c, n in names.items()}
    plan = plan.select(
        *[F.col(c).alias(names[c]) for c in ("id", "h", "slot", "start")], F.expr(f"cast(slot * {parts} div {ends[0] + 1} as int)").alias(names["part"])
    )
    same = docs[id_col].eqNullSafe(plan[names["id"]]) & (F.xxhash64(docs[text_col], F.coalesce(docs[source_col].cast("string"), F.lit(""))) == plan[names["h"]])
    rows = docs.join(maybe_broadcast(plan), same).repartitionById(parts, F.col(names["part"]))
    return rows.sortWithinPartitions(names["slot"], names["start"]).select(*[F.col(f"`{c}`") for c in docs.columns])
