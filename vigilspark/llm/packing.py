"""Packing of documents into sequences by the histogram of their lengths.

Shortest-pack-first (Krell et al., 2021): lengths are placed longest first, each into the open packs
with the most room, and only counts of packing patterns are kept. The histogram has at most
``PACK_TOKENS`` bins however many documents there are, so this part runs on the driver. Patterns are
then joined back to documents by their rank among those of their length.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked, running_total, word_tokens

PACK_TOKENS = 2048
#: Rows of a chunk, within which one task ranks documents of one length.
CHUNK_ROWS = 200_000


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, longest first; how many such packs). Every length is used as often as it is counted."""
    room: dict[int, Counter] = defaultdict(Counter)  # space left -> pattern -> packs
    spaces: list[int] = []

    def put(space: int, pattern: tuple[int, ...], packs: int) -> None:
        if not room[space]:
            bisect.insort(spaces, space)
        room[space][pattern] += packs

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and spaces and spaces[-1] >= length:
            space = spaces[-1]
            pattern = min(room[space])
            used = min(room[space][pattern], left)
            left -= used
            room[space][pattern] -= used
            if not room[space][pattern]:
                del room[space][pattern]
            if not room[space]:
                spaces.pop()
            put(space - length, pattern + (length,), used)
        each = size // length  # a new pack is the one of most room until the length no longer fits
        if left // each:
            put(size - each * length, (length,) * each, left // each)
        if left % each:
            put(size - left % each * length, (length,) * (left % each), 1)
    return sorted((p, n) for by in room.values() for p, n in by.items())


def entries(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, past the last rank, first pack, uses in a pack, place in the pack of the first use)."""
    out, rank, pack = [], Counter(), 0
    for pattern, packs in found:
        offset = 0
        for length, uses in sorted(Counter(pattern).items(), reverse=True):
            out.append((length, rank[length], rank[length] + packs * uses, pack, uses, offset))
            rank[length] += packs * uses
            offset += length * uses
        pack += packs
    return out


def pack_documents(docs: DataFrame, size: int = PACK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack_id, doc_id, first_token, tokens, place): every token of every document once, at ``place`` in its pack.

    A document of more than ``size`` tokens is cut into full packs of its own and a rest; rests and
    shorter documents are packed together and never cut. Documents without tokens (null, empty or
    blank text) are in no pack. A null identifier is kept as null. Repeated rows are packed as often
    as they occur. Identifiers may be of any type. Ties of length go by chunk, identifier and text. Other columns aren't read. An empty table gives no packs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), word_tokens(F.col(text_col)).alias("total"), F.xxhash64(text_col).alias("h")).where("total > 0")
    rows = rows.select("doc_id", "h", "total", F.expr(f"total div {size}").alias("full"), F.expr(f"total % {size}").alias("rest"))
    rows = cut(rows)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "h"), F.lit(max(1, -(-rows.count() // CHUNK_ROWS)))))
    histogram = {r["rest"]: r["n"] for r in rows.where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = patterns(histogram, size)
    table = entries(found) or [(0, 0, 0, 0, 1, 0)]
    plan = spark.createDataFrame(table, "rest long, low long, high long, pack long, uses long, offset long")
    if len(table) < 500_000:
        plan = F.broadcast(plan)
    rests = ranked(rows.where("rest > 0"), ["rest"], [F.col("doc_id"), F.col("h")], F.col("chunk"), "rank")
    rests = rests.join(plan, "rest").where("rank >= low and rank < high")
    rests = rests.select(
        (F.col("pack") + F.expr("(rank - low) div uses")).alias("pack_id"), "doc_id", (F.col("total") - F.col("rest")).alias("first_token"), F.col("rest").alias("tokens"),
        (F.col("offset") + F.expr("(rank - low) % uses") * F.col("rest")).alias("place"),
    )
    first = sum(n for _, n in found)
    one = F.lit(0).alias("one")
    long = running_total(rows.where("full > 0").select("*", one), ["one"], [F.col("doc_id"), F.col("h")], F.col("chunk"), "full", "before")
    piece = long.select("doc_id", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k"))
    whole = piece.select((F.col("before") + F.col("k") + first).alias("pack_id"), "doc_id", (F.col("k") * size).alias("first_token"), F.lit(size).cast("long").alias("tokens"), F.lit(0).cast("long").alias("place"))
    return rests.union(whole)
