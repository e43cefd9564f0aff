"""Postings in numpy: blobs that go to buckets, and the self-join of a bucket's lists or the members of these.

A posting says that a document has a key; keys have 48 bits, their upper bits are the bucket. What a
task sends to a bucket is one blob. Beyond ``FAN`` buckets a blob first goes to a range of buckets and
is taken apart there, so that blobs don't become tiny as the corpus grows. Where documents have a family,
those of one family aren't paired, nor are their pairs gone through. What is ``before`` a posting is the
character there or, where lists are ``ranked``, how many keys of its document come before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import expand, squeeze
from .common import cut, maybe_broadcast

PIECE, FAN, BITS = 400_000, 1024, 48
#: Postings of a bucket from which on it is cut into parts, and members of a list that are paired in one go.
PART_POSTINGS, LIST_BLOCK = 3_000_000, 4096
INDEX = "bucket long, n long, ids binary, sizes binary, tags binary, keys binary, owners binary, before binary, families binary"
INDEX_ARROW = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "tags", "keys", "owners", "before", "families"))])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of equal width of 48-bit keys, by their upper 32 bits."""
    return (((keys >> np.uint64(BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def first_step(buckets: int, fan: int = FAN) -> int:
    """Buckets in a range, such that there are at most ``fan`` ranges."""
    step = 1
    while -(-buckets // step) > fan:
        step *= fan
    return step


def fan_out(rows: DataFrame, buckets: int, respread: Callable[[int], Callable], fan: int = FAN) -> DataFrame:
    """``rows`` whose ``bucket`` is a range of ``first_step`` buckets, taken apart until each range is one bucket."""
    step = first_step(buckets, fan)
    while step > 1:
        step //= fan
        rows = rows.repartition("bucket").mapInArrow(respread(step), rows.schema)
    return rows


def cuts(sorted_targets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(target, from, to) of each run."""
    edge = np.append(np.flatnonzero(np.r_[True, sorted_targets[1:] != sorted_targets[:-1]][: len(sorted_targets)]), len(sorted_targets))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(sorted_targets[a]), a, b


def key_pairs(keys: np.ndarray, longest: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of equal values in sorted ``keys``, all of them, about ``PIECE`` at a time; runs above ``longest`` are left out."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    length = np.diff(np.append(start, len(keys)))
    for c in np.unique(length[(length > 1) & (length <= (longest or len(keys)))]).tolist():
        runs = start[length == c]
        if c <= 512:
            i, j = np.triu_indices(c, 1)
            step = max(1, PIECE // len(i))
            for k in range(0, len(runs), step):
                base = runs[k : k + step, None]
                yield (base + i).ravel(), (base + j).ravel()
            continue
        step = max(1, PIECE // c)
        for s in runs.tolist():
            for k in range(0, c, step):
                i, j = np.meshgrid(np.arange(k, min(k + step, c)), np.arange(c), indexing="ij")
                above = j > i
                yield s + i[above], s + j[above]


def cross_left(keys: np.ndarray, families: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``keys``, sorted by key and family: where its family ends within its key, and how many places of the key come after that."""
    n = len(keys)
    new = np.r_[True, keys[1:] != keys[:-1]][:n]
    start = np.flatnonzero(new)
    end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    start = np.flatnonzero(new | np.r_[True, families[1:] != families[:-1]][:n])
    own = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    return own, end - own


def cross_pairs(own: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of one key and two families, all of them, about ``PIECE`` at a time."""
    at = np.flatnonzero(left)
    total, k = np.cumsum(left[at]), 0
    while k < len(at):
        m = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PIECE, "right")))
        n = left[at[k:m]]
        i = np.repeat(at[k:m], n)
        yield i, own[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        k = m


class PairSet:
    """Distinct pair codes, settled now and then so that repeats take no room."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.held, self.n, self.codes = limit, [], 0, np.zeros(0, np.uint64)

    def add(self, codes: np.ndarray) -> None:
        self.held.append(codes)
        self.n += len(codes)
        if self.n >= self.limit:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            self.codes = np.unique(np.concatenate([self.codes, *self.held]))
            self.held, self.n = [], 0
            self.limit = max(self.limit, len(self.codes))
        return self.codes


def index_rows(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, sizes: np.ndarray, tags: np.ndarray, buckets: int, step: int, before: np.ndarray | None = None, families: np.ndarray | None = None) -> Iterator[dict]:
    """Blobs of postings (keys[i] of document owner[i]), one for each range of ``step`` buckets; a document without a family has its own identifier for one."""
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    before = None if before is None else before[order]
    for target, a, b in cuts(bucket_of(keys, buckets) // step):
        docs, local = np.unique(owner[a:b], return_inverse=True)
        yield {
            "bucket": target, "n": b - a, "ids": squeeze(ids[docs], True), "sizes": squeeze(sizes[docs].astype(np.uint32)), "tags": squeeze(tags[docs].astype(np.uint8)),
            "keys": squeeze(keys[a:b], True), "owners": squeeze(local.astype(np.uint32)), "before": squeeze(before[a:b]) if before is not None else b"",
            "families": squeeze(families[docs] - ids[docs]) if families is not None else b"",
        }


def opened(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(key, document, what is before) of postings in the order of keys, and (id, size, tag, part, family) of documents; with families, in their order within a key."""
    ids = [expand(x) for x in rows["ids"]]
    shift = np.cumsum([0, *map(len, ids)])
    size, tag = (np.concatenate([expand(x) for x in rows[c]]).astype(np.int64) for c in ("sizes", "tags"))
    part = np.repeat(rows["part"].to_numpy(np.int64) if "part" in rows else np.zeros(len(rows), np.int64), [len(x) for x in ids])
    key = np.concatenate([expand(x) for x in rows["keys"]])
    doc = np.concatenate([expand(x).astype(np.int64) + d for x, d in zip(rows["owners"], shift)])
    before = np.concatenate([expand(x) for x in rows["before"]]) if rows["before"].iloc[0] else None
    ids = np.concatenate(ids)
    family = ids + np.concatenate([expand(x) for x in rows["families"]]) if rows["families"].iloc[0] else None
    order = np.argsort(key, kind="stable") if family is None else np.lexsort((family[doc], key))
    return key[order], doc[order], None if before is None else before[order], ids, size, tag, part, family


def _respread_index(buckets: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pandas().itertuples(index=False):
                one = pd.DataFrame([row], columns=b.schema.names)
                key, doc, before, ids, size, tag, _, family = opened(one)
                out = list(index_rows(key, doc, ids, size, tag, buckets, step, before, family))
                yield pa.RecordBatch.from_pylist(out, INDEX_ARROW)

    return run


_FOUND = "a binary, b binary, tags binary, list string, side long, block long, low long, high long, kin long, members binary"


def _packed(a: np.ndarray, b: np.ndarray, tag: np.ndarray) -> tuple[bytes, bytes, bytes]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    return squeeze(low[order], True), squeeze(high[order]), squeeze(tag[order].astype(np.uint8))


def _pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a, b, tags in zip(batch["a"], batch["b"], batch["tags"]):
            yield pd.DataFrame({"a": expand(a), "b": expand(b), "tag": expand(tags).astype(np.int64)})


def _enough(a: np.ndarray, b: np.ndarray, left_a: np.ndarray, left_b: np.ndarray, t: float) -> np.ndarray:
    """Whether what is left of sets of sizes ``a`` and ``b`` can be an overlap for a Jaccard similarity of ``t``, safe against rounding."""
    return np.minimum(left_a, left_b) * (1 + t) >= (a + b) * t - 1e-6


def _pair(t: float, block: int, ranked: bool):
    """Pairs of one bucket, or between two parts of one; lists too long for that come out in blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key, doc, before, ids, size, tag, part, family = opened(rows)
        across = rows["i"].iloc[0] != rows["j"].iloc[0]
        if ranked:
            # a posting that leaves too little even for the smallest set of its list
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            least = np.repeat(np.minimum.reduceat(size[doc], new), np.diff(np.append(new, len(key))))
            left = size[doc] - before
            useful = _enough(size[doc], least, left, left, t)
            key, doc, before = key[useful], doc[useful], before[useful]
            if not len(key):
                return pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in _FOUND.split(", ")})
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        length = np.diff(np.append(start, len(key)))
        long = length > block
        if family is None:
            meeting = key_pairs(key, block)
        else:
            # a list is long by the pairs between its families
            own, left = cross_left(key, family[doc])
            long &= np.add.reduceat(left, start) > block * (block - 1) // 2
            left[np.repeat(long, length)] = 0
            meeting = cross_pairs(own, left)
        pairs = PairSet()
        for i, j in meeting:
            a, b = doc[i], doc[j]
            fits = (ids[a] != ids[b]) & (np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - 1e-9)
            if ranked:
                fits &= _enough(size[a], size[b], size[a] - before[i], size[b] - before[j], t)
            elif before is not None:  # a longer common run is met once, where it begins
                fits &= (before[i] != before[j]) | (before[i] == 64)
            if across:
                fits &= part[a] != part[b]
            a, b = a[fits].astype(np.uint64), b[fits].astype(np.uint64)
            pairs.add(np.minimum(a, b) << np.uint64(32) | np.maximum(a, b))
        codes = pairs.settle()
        a, b = (codes >> np.uint64(32)).astype(np.int64), (codes & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = [(*_packed(ids[a], ids[b], tag[a]), None, -1, -1, -1, -1, None, None)] if len(codes) else []
        kin = ids if family is None else family
        for s, n in zip(start[long].tolist(), length[long].tolist()):
            own = np.arange(s, s + n)
            # by size, families after the others and each on its own
            d = doc[own]
            own = own[np.lexsort((size[d], np.where(kin[d] == ids[d], np.iinfo(np.int64).min, kin[d])))]
            for side in np.unique(part[doc[own]]).tolist() if across else [-1]:
                mine = own[part[doc[own]] == side] if across else own
                for k in range(0, len(mine), block):
                    d = doc[mine[k : k + block]]
                    name = f"{rows['bucket'].iloc[0]} {rows['i'].iloc[0]} {rows['j'].iloc[0]} {key[s]}"
                    out.append((None, None, None, name, side, k // block, int(size[d].min()), int(size[d].max()), int(kin[d[0]]) if (kin[d] == kin[d[0]]).all() else None, squeeze(np.stack([ids[d], size[d], tag[d], before[mine[k : k + block]] if before is not None else np.full(len(d), -1), kin[d]]))))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])
        return frame.assign(kin=pd.array([x[8] for x in out], "Int64"))  # no way through floats

    return run


def _pair_blocks(t: float, ranked: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, left, right in zip(batch["same"], batch["x"], batch["y"]):
                x, y = (expand(m).reshape(5, -1) for m in (left, right))
                step = max(1, PIECE // y.shape[1])
                for k in range(0, x.shape[1], step):
                    i, j = np.meshgrid(np.arange(k, min(k + step, x.shape[1])), np.arange(y.shape[1]), indexing="ij")
                    i, j = i.ravel(), j.ravel()
                    a, b = x[:, i], y[:, j]
                    fits = (a[4] != b[4]) & (np.minimum(a[1], b[1]) >= t * np.maximum(a[1], b[1]) - 1e-9)
                    if ranked:
                        fits &= _enough(a[1], b[1], a[1] - a[3], b[1] - b[3], t)
                    else:
                        fits &= (a[3] != b[3]) | (a[3] == 64) | (a[3] == -1)
                    if same:
                        fits &= j > i
                    a, b = a[:, fits], b[:, fits]
                    yield pd.DataFrame({"a": np.minimum(a[0], b[0]), "b": np.maximum(a[0], b[0]), "tag": a[2]})

    return run


def joined_lists(index: DataFrame, buckets: int, t: float, block: int = LIST_BLOCK, part_postings: int = PART_POSTINGS, fan: int = FAN, by: tuple[str, ...] = ("a", "b"), ranked: bool = False) -> DataFrame:
    """(a, b, tag), a < b, once each and partitioned ``by`` columns that a join may go on with: documents that have a key in common, are of different families, and whose sizes are within the factor ``t``; ``ranked``: and have a key in common from which on both have enough left for a Jaccard similarity of ``t``.

    A bucket above ``part_postings`` is cut into parts, and every two parts meet in a task of their
    own; a list above ``block`` members is cut into blocks, and every two blocks meet in a row of their
    own. So no task holds a hot list, whatever its share of the corpus.
    """
    index = cut(fan_out(index, buckets, lambda step: _respread_index(buckets, step), fan))
    loads = index.groupBy("bucket").agg(F.ceil(F.sum("n") / part_postings).cast("long").alias("parts"))
    heavy = cut(loads.where("parts > 1"))
    none = [F.lit(0).cast("long").alias(c) for c in ("part", "i", "j")]
    if heavy.isEmpty():
        placed = index.select("*", *none)
    else:
        heavy = maybe_broadcast(heavy)
        split = index.join(heavy, "bucket").withColumn("part", F.pmod(F.xxhash64("ids", "keys"), F.col("parts")))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        split = split.select(*index.columns, "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        placed = index.join(heavy, "bucket", "left_anti").select("*", *none).union(split)
    # by number, as a bucket is small in bytes and large in pairs
    tasks = min(100_000, 2 * (loads.agg(F.sum(F.expr("parts * (parts + 1) div 2"))).first()[0] or 1))
    found = cut(placed.repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(_pair(t, block, ranked), _FOUND))
    pairs = found.where("a is not null").select("a", "b", "tags").mapInPandas(_pairs_of, "a long, b long, tag long")
    blocks = found.where("list is not null")
    if not blocks.isEmpty():
        x = blocks.select("list", F.col("side").alias("xs"), F.col("block").alias("xb"), F.col("low").alias("xl"), F.col("high").alias("xh"), F.col("kin").alias("xk"), F.col("members").alias("x"))
        y = blocks.select("list", F.col("side").alias("ys"), F.col("block").alias("yb"), F.col("low").alias("yl"), F.col("high").alias("yh"), F.col("kin").alias("yk"), F.col("members").alias("y"))
        near = f"xl <= yh / {t} + 1 and yl <= xh / {t} + 1"
        meet = x.join(y, "list").where(f"((xs = -1 and xb <= yb) or xs < ys) and {near} and coalesce(xk != yk, true)")
        meet = meet.select((F.expr("xs = -1 and xb = yb")).alias("same"), "x", "y").repartition(F.xxhash64("x", "y"))
        pairs = pairs.union(meet.mapInPandas(_pair_blocks(t, ranked), "a long, b long, tag long"))
    return pairs.repartition(*by).distinct()


_MEMBERS = "bucket long, list long, id long, tag long, before long, block long, blocks long"


def _members_of(block: int):
    """Members of a bucket's lists in which some two have different characters before them, in blocks by size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key, doc, before, ids, size, tag, _, _ = opened(rows)
        order = np.lexsort((size[doc], key))
        key, doc, before = key[order], doc[order], before[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        length = np.diff(np.append(start, len(key)))
        low, high = np.minimum.reduceat(before, start), np.maximum.reduceat(before, start)
        meets = np.repeat((length > 1) & ((low != high) | (high == 64)), length)
        place, blocks = np.arange(len(key)) - np.repeat(start, length), np.repeat(-(-length // block), length)
        cols = (key.astype(np.int64), ids[doc], tag[doc], before.astype(np.int64), place // block, blocks)
        out = pd.DataFrame({c: x[meets] for c, x in zip(("list", "id", "tag", "before", "block", "blocks"), cols)})
        out.insert(0, "bucket", rows["bucket"].iloc[0])
        return out

    return run


def _all_postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(len(batch)):
            one = batch.iloc[k : k + 1]
            key, doc, before, ids, _, tag, _, _ = opened(one)
            yield pd.DataFrame({"bucket": one["bucket"].iloc[0], "list": key.astype(np.int64), "id": ids[doc], "tag": tag[doc], "before": before.astype(np.int64)})


def list_members(index: DataFrame, buckets: int, block: int = LIST_BLOCK, part_postings: int = PART_POSTINGS, fan: int = FAN) -> DataFrame:
    """(bucket, list, id, tag, before, block, blocks): the lists in which two documents may have different characters before a key, cut into blocks of about ``block`` members.

    A run of equal lists is thus met once, where it begins, and lists of one document are gone. What comes
    out is no more than the postings, whatever the number of pairs in them. The lists of a bucket above
    ``part_postings`` aren't held by one task but found by an aggregate, in blocks by hash.
    """
    index = cut(fan_out(index, buckets, lambda step: _respread_index(buckets, step), fan))
    heavy = cut(index.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > part_postings).select("bucket"))
    if heavy.isEmpty():
        return index.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_members_of(block), _MEMBERS)
    heavy = maybe_broadcast(heavy)
    found = index.join(heavy, "bucket", "left_anti").repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_members_of(block), _MEMBERS)
    rows = cut(index.join(heavy, "bucket").mapInPandas(_all_postings, "bucket long, list long, id long, tag long, before long"))
    sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("low"), F.max("before").alias("high")).where("n > 1 and (low != high or high = 64)")
    sizes = sizes.select("list", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    return found.unionByName(rows.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select(*found.columns))


def buckets_for(postings: int, least: int, each: int) -> int:
    return max(least, math.ceil(postings / each), 1)
