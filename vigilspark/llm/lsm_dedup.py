"""Exact dedup over a log-structured merge index of digests.

Documents are 128-bit digests of whole texts, which go to shards by digest range; repeats of a task are
settled before they are sent. In a shard a memtable is flushed as a sorted run with a Bloom filter. A
run asks the filter of every older table which of its digests may be there, searches for those alone,
and hands the ones it finds over to that table; what is left becomes a table of tier 0. So tables have
no digest in common, and once a tier has ``FANOUT`` tables they are merged into one of the next. An
entry keeps the smallest identifier and the number of rows. Hits are verified by the bytes of their texts.

The tables can be stored: a later batch probes and extends them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, numbered, renamed

MEMTABLE_ROWS, SHARD_ROWS, FANOUT = 250_000, 2_000_000, 4
BITS_PER_KEY, PROBES = 10, 7
_HIT = "d1 long, d2 long, keep long, n long"
_TABLE = "shard long, shards long, tier long, rows binary, bloom binary"


class Run:
    """Sorted distinct digests, the smallest identifier and the number of rows of each, and a Bloom filter."""

    def __init__(self, d1: np.ndarray, d2: np.ndarray, ids: np.ndarray, n: np.ndarray, bloom: np.ndarray | None = None):
        self.d1, self.d2, self.ids, self.n = d1, d2, ids, n
        self.bloom = make_bloom(d1, d2) if bloom is None else bloom
        self.asked = self.searched = 0

    def __len__(self) -> int:
        return len(self.ids)

    def find(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Position of each digest in the run, -1 where it is not there; only what passes the filter is searched for."""
        out = np.full(len(d1), -1, np.int64)
        maybe = np.flatnonzero(in_bloom(self.bloom, d1, d2))
        self.asked += len(d1)
        self.searched += len(maybe)
        if not len(maybe) or not len(self):
            return out
        at, last = np.searchsorted(self.d1, d1[maybe], "left"), np.searchsorted(self.d1, d1[maybe], "right")
        while (open_ := at < last).any():  # equal first halves are walked over
            maybe, at, last = maybe[open_], at[open_], last[open_]
            hit = self.d2[at] == d2[maybe]
            out[maybe[hit]] = at[hit]
            maybe, at, last = maybe[~hit], at[~hit] + 1, last[~hit]
        return out


def _bits(m: int, d1: np.ndarray, d2: np.ndarray) -> Iterator[np.ndarray]:
    step = d2.view(np.uint64) | np.uint64(1)
    for i in range(PROBES):
        yield ((d1.view(np.uint64) + np.uint64(i) * step) & np.uint64(m - 1)).astype(np.int64)


def make_bloom(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    m = 1 << max(6, int(BITS_PER_KEY * max(1, len(d1)) - 1).bit_length())
    bits = np.zeros(m, bool)
    for at in _bits(m, d1, d2):
        bits[at] = True
    return np.packbits(bits)


def in_bloom(bloom: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    maybe = np.arange(len(d1))
    for i in range(PROBES):
        if not len(maybe):
            break
        step = d2[maybe].view(np.uint64) | np.uint64(1)
        at = ((d1[maybe].view(np.uint64) + np.uint64(i) * step) & np.uint64(len(bloom) * 8 - 1)).astype(np.int64)
        maybe = maybe[(bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
    found = np.zeros(len(d1), bool)
    found[maybe] = True
    return found


def settled(d1: np.ndarray, d2: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows sorted by digest, equal ones as one: the smallest identifier, all rows counted."""
    order = np.lexsort((ids, d2, d1))
    d1, d2, ids, n = d1[order], d2[order], ids[order], n[order]
    first = np.flatnonzero(np.r_[True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])][: len(ids)])
    return d1[first], d2[first], ids[first], np.add.reduceat(n, first) if len(first) else n


class Index:
    """The tables of one shard, by tier; no two have a digest in common."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.tiers = fanout, []
        self.asked = self.searched = 0

    def tables(self) -> list[Run]:
        return [t for tier in self.tiers for t in tier]

    def insert(self, d1: np.ndarray, d2: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Flush a memtable: what older tables have goes there, the rest is a new table."""
        d1, d2, ids, n = settled(d1, d2, ids, n)
        for t in self.tables():
            asked, searched = t.asked, t.searched
            at = t.find(d1, d2)
            self.asked, self.searched = self.asked + t.asked - asked, self.searched + t.searched - searched
            hit = at >= 0
            if hit.any():
                t.ids[at[hit]] = np.minimum(t.ids[at[hit]], ids[hit])
                t.n[at[hit]] += n[hit]
                d1, d2, ids, n = (x[~hit] for x in (d1, d2, ids, n))
        if len(ids):
            self.add(Run(d1, d2, ids, n))

    def add(self, run: Run, tier: int = 0) -> None:
        while len(self.tiers) <= tier:
            self.tiers.append([])
        self.tiers[tier].append(run)
        if len(self.tiers[tier]) >= self.fanout:
            d1, d2, ids, n = (np.concatenate([getattr(r, k) for r in self.tiers[tier]]) for k in ("d1", "d2", "ids", "n"))
            order = np.lexsort((d2, d1))
            self.tiers[tier] = []
            self.add(Run(d1[order], d2[order], ids[order], n[order]), tier + 1)


def with_digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d1, d2, body) of rows that have an identifier and a text."""
    text = F.col(text_col).cast("string")
    return docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("second half"), text).alias("d2"), text.alias("body"))


def shard_of(d1: str, shards: int):
    """Digest ranges of equal width."""
    return F.expr(f"shiftright((shiftrightunsigned({d1}, 32)) * {shards}L, 32)")


def _presettle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's rows by memtables, repeats settled: a text that a third of all rows have is one row of each."""
    held, n = [], 0

    def flush() -> pd.DataFrame:
        rows = pd.concat(held)
        return pd.DataFrame(dict(zip(("d1", "d2", "id", "n"), settled(*(rows[c].to_numpy(np.int64) for c in ("d1", "d2", "id")), np.ones(len(rows), np.int64)))))

    for b in batches:
        held.append(b)
        n += len(b)
        if n >= MEMTABLE_ROWS:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _grown(rows: pd.DataFrame, stored: pd.DataFrame | None, memtable: int) -> tuple[Index, int]:
    index, shards = Index(), 0
    for r in () if stored is None else stored.itertuples(index=False):
        d1, d2, ids, n = np.frombuffer(r.rows, np.int64).reshape(4, -1).copy()
        while len(index.tiers) <= r.tier:
            index.tiers.append([])
        index.tiers[r.tier].append(Run(d1, d2, ids, n, np.frombuffer(r.bloom, np.uint8)))
        shards = r.shards
    for k in range(0, len(rows), memtable):
        part = rows.iloc[k : k + memtable]
        index.insert(*(part[c].to_numpy(np.int64) for c in ("d1", "d2", "id", "n")))
    return index, shards


def _hits(memtable: int):
    """Digests of more than one row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tables = [(t, t.n > 1) for t in _grown(rows, None, memtable)[0].tables()]
        return pd.concat([pd.DataFrame({"d1": t.d1[m], "d2": t.d2[m], "keep": t.ids[m], "n": t.n[m]}) for t, m in tables])

    return run


def _tables(memtable: int, shards: int):
    def run(key: tuple, rows: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        index, _ = _grown(rows, stored, memtable)
        out = [(key[0], shards, k, np.stack([t.d1, t.d2, t.ids, t.n]).tobytes(), t.bloom.tobytes()) for k, tier in enumerate(index.tiers) for t in tier]
        return pd.DataFrame(out, columns=["shard", "shards", "tier", "rows", "bloom"])

    return run


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for blob in b["rows"]:
            d1, d2, ids, n = np.frombuffer(blob, np.int64).reshape(4, -1)
            yield pd.DataFrame({"d1": d1[n > 1], "d2": d2[n > 1], "keep": ids[n > 1], "n": n[n > 1]})


def _latest(spark: SparkSession, path: str) -> tuple[str | None, int]:
    """The newest whole version of a stored index, and its number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(m[1]) for s in (fs.listStatus(at) if fs.exists(at) else []) if (m := re.fullmatch(r"version-(\d+)", s.getPath().getName())) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return (f"{path}/version-{max(found)}", max(found)) if found else (None, 0)


def probe(digests: DataFrame, index: str | None = None, memtable_rows: int = MEMTABLE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(d1, d2, keep, n) of the digests that more than one row has, materialised.

    Shards are sized by the number of rows. With ``index``, a folder, its newest tables are probed and
    grown, and written as the next version; a lost run leaves the last version as it was.
    """
    spark, count = digests.sparkSession, digests.count()
    stored, version = _latest(spark, index) if index else (None, 0)
    shards = max(1, -(-count // shard_rows))
    if stored:
        shards = spark.read.parquet(stored).agg(F.max("shards")).first()[0] or shards
    sent = digests.select("id", "d1", "d2").mapInPandas(_presettle, "d1 long, d2 long, id long, n long").withColumn("shard", shard_of("d1", shards))
    if index is None:
        return cut(sent.groupBy("shard").applyInPandas(_hits(memtable_rows), _HIT))
    old = spark.read.parquet(stored) if stored else spark.createDataFrame([], _TABLE)
    grown = sent.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(_tables(memtable_rows, shards), _TABLE)
    grown.write.parquet(f"{index}/version-{version + 1}")
    return cut(spark.read.parquet(f"{index}/version-{version + 1}").mapInPandas(_unpacked, _HIT))


def _verified(texts: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The hits whose texts are equal byte for byte; and (id, d1, d2, keep) of the rows of two texts with one digest, if there are such.

    Least and greatest text of a digest are aggregated on the map side, so a hot group's texts aren't brought together.
    """
    of_hits = texts.join(maybe_broadcast(hits.select("d1", "d2")), ["d1", "d2"], "left_semi")
    checked = cut(of_hits.groupBy("d1", "d2").agg((F.min("body") == F.max("body")).alias("same")))
    clashes = checked.where("not same").select("d1", "d2")
    if clashes.isEmpty():
        return hits, None
    clashes = cut(clashes)
    both = texts.join(maybe_broadcast(clashes), ["d1", "d2"], "left_semi")
    least = both.groupBy("d1", "d2", "body").agg(F.min("id").alias("keep"))
    return hits.join(clashes, ["d1", "d2"], "left_anti"), cut(both.join(least, ["d1", "d2", "body"]).select("id", "d1", "d2", "keep").distinct())


def _kept(docs: DataFrame, id_col: str, text_col: str, memtable_rows: int, index: str | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """(id, d1, d2) of each row with identifier and text; (d1, d2, keep, n) of digests in several rows; the rows of clashing digests; names."""
    rows = with_digests(docs, id_col, text_col)
    digests, names = numbered(rows.select("id", "d1", "d2"), "id")
    digests = cut(digests)
    hits = probe(digests, index, memtable_rows)
    texts = rows if known is None else rows.unionByName(with_digests(known, id_col, text_col))
    if names is not None:  # a clash is told apart by identifier, so texts need the numbers, which few digests have
        few = digests.join(maybe_broadcast(hits.select("d1", "d2")), ["d1", "d2"], "left_semi").distinct()
        named = renamed(few.withColumn("name", F.col("id")), names, "name")
        texts = texts.withColumnRenamed("id", "name").withColumn("name", F.col("name").cast("string")).join(maybe_broadcast(cut(named)), ["name", "d1", "d2"]).select("id", "d1", "d2", "body")
    good, odd = _verified(texts, hits)
    return digests, good, odd, names


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = MEMTABLE_ROWS, index: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rows (id, keep, d1, d2), one for each row whose text a row of smaller identifier has, byte for byte.

    With ``index``, a folder, also copies of documents that earlier calls put there, whose rows are
    ``known``; identifiers then have to be whole numbers.

    Nulls: a row without identifier or text is no copy and has none. Empty texts are copies of each
    other. A repeated row (same identifier and text) is no copy of itself. One identifier on two texts
    is two entries, told apart by their digest (d1, d2). Identifiers may be of any type; those that
    aren't whole numbers come back, and are ordered, as strings. Other columns are never read. Empty
    tables give no rows.
    """
    digests, good, odd, names = _kept(docs, id_col, text_col, memtable_rows, index, known)
    out = digests.join(maybe_broadcast(good), ["d1", "d2"]).select("id", "keep", "d1", "d2")
    if odd is not None:
        out = out.unionByName(digests.join(odd, ["id", "d1", "d2"]).select("id", "keep", "d1", "d2"))
    return renamed(out.where("id != keep"), names, "id", "keep")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, is_copy) for every row with an identifier; edge cases as in ``find_copies``. Texts are read twice: for digests, and those of hits for their bytes."""
    digests, good, odd, names = _kept(docs, id_col, text_col, MEMTABLE_ROWS)
    found = digests.join(maybe_broadcast(good.select("d1", "d2", "keep")), ["d1", "d2"], "left").select("id", "d1", "d2", "keep")
    if odd is not None:
        found = found.join(odd.withColumnRenamed("keep", "other"), ["id", "d1", "d2"], "left").withColumn("keep", F.coalesce("other", "keep")).drop("other")
    keep = F.coalesce("keep", "id")
    out = renamed(found.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), (keep != F.col("id")).alias("is_copy")), names, "doc_id", "keep_id")
    kind = "long" if names is None else "string"
    alone = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNull()).select(F.col(id_col).cast(kind).alias("doc_id"))
    return out.union(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(False).alias("is_copy")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every text, that of the smallest identifier; all columns, whatever their names.

    Rows without identifier or text stay. Of repeated rows (same identifier and text) that of the least
    hash over all columns stays. Identifiers may be of any type; those that aren't whole numbers are
    ordered as strings. Texts are compared whole; an empty table gives an empty one.
    """
    digests, good, odd, names = _kept(docs, id_col, text_col, MEMTABLE_ROWS)
    keepers = good.select("d1", "d2", "keep")
    gone = digests.join(maybe_broadcast(keepers), ["d1", "d2"]).where("id != keep").select("id", "d1", "d2")
    if odd is not None:
        gone = gone.union(odd.where("id != keep").select("id", "d1", "d2"))
    gone = cut(renamed(gone.distinct(), names, "id"))
    kept_twice = digests.join(maybe_broadcast(keepers.withColumnRenamed("keep", "id")), ["id", "d1", "d2"], "left_semi")
    if odd is not None:
        kept_twice = kept_twice.union(digests.join(odd.where("id = keep").select("id", "d1", "d2"), ["id", "d1", "d2"], "left_semi"))
    twice = cut(renamed(kept_twice.groupBy("id", "d1", "d2").count().where("count > 1").select("id", "d1", "d2"), names, "id"))
    body = docs[text_col].cast("string")
    digest = [F.xxhash64(body), F.xxhash64(F.lit("second half"), body)]

    def matches(h: DataFrame):
        return (docs[id_col].cast("long" if names is None else "string") == h["id"]) & (digest[0] == h["d1"]) & (digest[1] == h["d2"]) & body.isNotNull()

    gone = maybe_broadcast(gone)
    rest = docs.join(gone, matches(gone), "left_anti")
    if twice.isEmpty():
        return rest
    twice = maybe_broadcast(twice)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = docs.join(twice, matches(twice), "left_semi").groupBy(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    once = again.agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row")).select("__row.*")
    return rest.join(twice, matches(twice), "left_anti").unionByName(once)
