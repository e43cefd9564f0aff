"""Join of documents by the Jaccard similarity of their word n-gram sets, over token-combination prefixes.

1. Texts are read once. Every distinct n-gram (token) of a document is a posting; in its token's bucket
   it learns in how many documents the token is. Tokens of one document alone join nothing and go no
   further; the others go back to their document.
2. A set's tokens are ordered by frequency. The rare ones (at most ``FREQUENT`` documents) of a prefix
   are indexed one by one. The frequent ones fall into classes by hash, and the prefix is extended until
   its tokens, less one for each class it meets, are one more than the set can do without: then a
   partner has a rare token of it, or two tokens of one class. So frequent tokens are indexed as
   combinations of k = 2 within their class, about as many as the set has tokens. The number of classes
   follows the size, so a set is indexed for its own band of sizes and for that of its largest partner.
   Sets of a few tokens, that may share one only, have single tokens.
3. A posting says how many tokens of its set come before it in that order and can't be common. Of a
   similar pair's meetings the first one leaves both sets enough tokens for their overlap; pairs that
   have no such meeting are no candidates. So the vocabulary that unrelated texts come to share as a
   corpus grows costs meetings and few comparisons.
4. Candidates are verified on their whole sets; tokens of one document alone count by number.
5. Many near copies of one text would meet in the index once for each of their combinations. So a set
   most of whose tokens many sets have first votes, by a few of those, for one set, the family's hub:
   the one with the fewest other tokens, as the text is that was copied. It joins the family if it is
   similar to the hub indeed. Sets of one family don't meet in the index: their overlaps are counted by
   products of matrices, and where only the components are asked for, not at all. What a family is
   changes the cost and never the result.

Tokens are 48-bit hashes. Documents with the same set are joined once, through the smallest identifier.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from .blobs import expand, squeeze
from .common import connected_components, cut, maybe_broadcast, numbered, renamed, shuffle_partitions
from .ngrams import mix, ngram_blocks

NGRAM, THRESHOLD, FREQUENT = 3, 0.5, 256
#: Bytes of text a token, at least about; only for the number of buckets.
BYTES_A_TOKEN = 6
TASK_PAIRS = 5_000
#: Tokens of a set that vote, and votes for a hub from which on the set is compared with it.
VOTERS, VOTES = 8, 2
_POSTING, _COUNT, _HOME, _INFO = range(4)
_DENSE = np.uint32(0xFFFFFFFF)
_SINGLE, _RARE, _LEFT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E6C63D0876A9A99), np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Plan:
    """How the work is cut; no value of it changes the result.

    ``frequent``: documents from which on a token is frequent. ``flush``: tokens of a block. ``bucket``:
    postings of a bucket. ``dense``: postings of a token from one task, after which further ones are
    only counted. ``list_block``, ``part``, ``fan``: see ``postings``. ``hot``: documents beyond which a
    token votes for families. ``family``: least members of one. ``members``, ``member_tokens``: what a
    family's matrix has at most on a side, about.
    """

    frequent: int = FREQUENT
    flush: int = 400_000
    bucket: int = 1_000_000
    dense: int = 64
    counters: int = 200_000
    list_block: int = postings.LIST_BLOCK
    part: int = postings.PART_POSTINGS
    fan: int = postings.FAN
    hot: int = 64
    family: int = 32
    members: int = 2048
    member_tokens: int = 1_000_000


def _need(size, t: float):
    """Least overlap of a set with any partner: ceil(t * size), safe against rounding."""
    return np.ceil(np.asarray(size) * t - 1e-9).astype(np.int64)


def one_row_per_id(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, DataFrame | None]:
    """(id, body) rows, the bytes of all bodies, and names as in ``numbered``.

    Rows without identifier or text are left out; the distinct texts of a repeated identifier, in
    order, become one of several lines.
    """
    rows, names = numbered(docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")), "id")
    each = cut(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body").cast("long")).alias("bytes")))
    total = each.agg(F.sum("bytes")).first()[0] or 0
    again = cut(each.where("n > 1").select("id"))
    if again.isEmpty():
        return rows, total, names
    again = maybe_broadcast(again)
    joined = cut(rows.join(again, "id", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("body")), "\n").alias("body")))
    return rows.join(again, "id", "left_anti").union(joined), total, names


# -- token frequencies

_TOKENS = pa.schema([("bucket", pa.int64()), ("kind", pa.int64()), *((c, pa.binary()) for c in ("ids", "tokens", "owners", "weights"))])
_TOKENS_SQL = "bucket long, kind long, ids binary, tokens binary, owners binary, weights binary"
_NOTHING = squeeze(np.zeros(0, np.int64))


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    return postings.bucket_of(mix(ids.view(np.uint64).copy()) >> np.uint64(16), buckets)


def _blob(bucket: int, kind: int, ids=None, tokens=None, owners=None, weights=None) -> dict:
    """Postings in the order of tokens; ``owners`` are places in ``ids``."""
    pack = lambda x, delta=False: _NOTHING if x is None else squeeze(x, delta)
    return {"bucket": bucket, "kind": kind, "ids": pack(ids, True), "tokens": pack(tokens, True), "owners": pack(owners), "weights": pack(weights)}


def _sent(kind: int, target: np.ndarray, ids: np.ndarray, tokens: np.ndarray, weights: np.ndarray | None) -> Iterator[dict]:
    """Blobs of postings (ids[i], tokens[i]) by target, in the order of tokens within each."""
    order = np.lexsort((tokens, target))
    target, ids, tokens = target[order], ids[order], tokens[order]
    weights = None if weights is None else weights[order]
    for b, i, j in postings.cuts(target):
        own, local = np.unique(ids[i:j], return_inverse=True)
        yield _blob(b, kind, own, tokens[i:j], local.astype(np.uint32), None if weights is None else weights[i:j])


class _Heavy:
    """Tokens that a task has met often: counts of those that repeat within a block, the least of them forgotten beyond a bound."""

    def __init__(self, dense: int, counters: int):
        self.dense, self.limit = dense, counters
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The dense ones, sorted, with these counted too."""
        both, inverse = np.unique(np.concatenate([self.tokens, tokens]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([self.counts, counts])).astype(np.int64)
        if len(both) > self.limit:
            keep = np.sort(np.argsort(-total, kind="stable")[: self.limit // 2])
            both, total = both[keep], total[keep]
        self.tokens, self.counts = both, total
        return both[total > self.dense]


def _token_map(n: int, plan: Plan, buckets: int):
    step = postings.first_step(buckets, plan.fan)

    def flush(ids: list, sets: list, heavy: _Heavy) -> Iterator[dict]:
        size = np.array([len(s) for s in sets], np.int64)
        ids = np.array(ids, np.int64)[size > 0]
        sets, size = [s for s in sets if len(s)], size[size > 0]
        if not sets:
            return
        tokens = np.concatenate(sets)
        start = np.cumsum(size) - size
        d1, d2 = np.add.reduceat(tokens, start), np.add.reduceat(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
        home = _home(ids, buckets) // step
        for b in np.unique(home).tolist():
            own = home == b
            yield _blob(b, _INFO, ids[own], None, None, np.stack([size[own], d1[own].view(np.int64), d2[own].view(np.int64)]))
        tokens >>= np.uint64(16)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], np.repeat(ids, size)[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        count = np.diff(np.append(first, len(tokens)))
        dense = heavy.add(tokens[first][count > 1], count[count > 1])
        if len(dense):
            at = np.minimum(np.searchsorted(dense, tokens), len(dense) - 1)
            far = dense[at] == tokens
            u, c = np.unique(tokens[far], return_counts=True)
            for b, i, j in postings.cuts(postings.bucket_of(u, buckets) // step):
                yield _blob(b, _COUNT, None, u[i:j], None, c[i:j].astype(np.uint32))
            yield from _sent(_HOME, _home(owner[far], buckets) // step, owner[far], tokens[far], np.full(int(far.sum()), _DENSE))
            tokens, owner = tokens[~far], owner[~far]
        yield from _sent(_POSTING, postings.bucket_of(tokens, buckets) // step, owner, tokens, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            ids, sets, held, heavy = [], [], 0, _Heavy(plan.dense, plan.counters)
            for b in batches:
                names = b["id"].to_pylist()
                for i, j, found in ngram_blocks(b["body"], n):
                    ids += names[i:j]
                    sets += found
                    held += sum(map(len, found))
                    if held >= plan.flush:
                        yield from _batches(flush(ids, sets, heavy))
                        ids, sets, held = [], [], 0
            if ids:
                yield from _batches(flush(ids, sets, heavy))

    return run


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == 64:
            yield pa.RecordBatch.from_pylist(held, _TOKENS)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _TOKENS)


def _respread(buckets: int, homes_only: bool):
    """Ranges of buckets taken apart into ranges of ``step``."""

    def of(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                for b in batches:
                    for r in b.to_pylist():
                        yield from _batches(one(r, step))

        return run

    def one(r: dict, step: int) -> Iterator[dict]:
        kind, ids = r["kind"], expand(r["ids"])
        if kind == _INFO:
            info = expand(r["weights"]).reshape(3, -1)
            home = _home(ids, buckets) // step
            for b in np.unique(home).tolist():
                yield _blob(b, _INFO, ids[home == b], None, None, info[:, home == b])
            return
        tokens, weights = expand(r["tokens"]), expand(r["weights"])
        weights = weights if len(weights) else None
        if kind == _COUNT:
            for b, i, j in postings.cuts(postings.bucket_of(tokens, buckets) // step):
                yield _blob(b, _COUNT, None, tokens[i:j], None, weights[i:j])
            return
        owner = ids[expand(r["owners"])]
        target = _home(owner, buckets) if kind == _HOME else postings.bucket_of(tokens, buckets)
        yield from _sent(kind, target // step, owner, tokens, weights)

    return of


def _opened(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, weight) of all postings."""
    docs = [expand(i)[expand(o)] for i, o in zip(rows["ids"], rows["owners"])]
    join = lambda x, kind: np.concatenate(x) if len(x) else np.zeros(0, kind)
    return join(docs, np.int64), join([expand(x) for x in rows["tokens"]], np.uint64), join([expand(x) for x in rows["weights"]], np.uint32)


def _weigh(buckets: int, step: int):
    """In a token's bucket: postings of tokens of several documents, with that number, sent on to the documents' homes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs, tokens, _ = _opened(rows[rows["kind"] == _POSTING])
        counted = rows[rows["kind"] == _COUNT]
        dense = np.unique(np.concatenate([expand(x) for x in counted["tokens"]])) if len(counted) else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        docs, tokens = docs[order], tokens[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)])
        df = np.diff(np.append(first, len(tokens)))
        weight = np.minimum(df, 0xFFFFFFFE).astype(np.uint32)
        if len(dense):
            weight[np.isin(tokens[first], dense, assume_unique=True)] = _DENSE
        weight = np.repeat(weight, df)
        keep = weight > 1
        docs, tokens, weight = docs[keep], tokens[keep], weight[keep]
        with np.errstate(over="ignore"):
            out = pd.DataFrame(_sent(_HOME, _home(docs, buckets) // step, docs, tokens, weight), columns=_TOKENS.names)
        return pd.concat([out, rows[rows["kind"] >= _HOME]])

    return run


def _gather(hot: int, t: float):
    """(id, size, d1, d2, tokens, weights, cold, voters): of each document the tokens it has in common with others, sorted, and their frequencies; how many of its tokens aren't hot; hashes of the few that vote, if the hot ones could make it similar to a hub."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        info = rows[rows["kind"] == _INFO]
        ids = np.concatenate([expand(x) for x in info["ids"]])
        size, d1, d2 = np.concatenate([expand(x).reshape(3, -1) for x in info["weights"]], 1)
        docs, tokens, weights = _opened(rows[rows["kind"] == _HOME])
        order = np.lexsort((tokens, docs))
        docs, tokens, weights = docs[order], tokens[order], weights[order]
        low, high = np.searchsorted(docs, ids, "left"), np.searchsorted(docs, ids, "right")
        voter = np.flatnonzero(weights > hot)
        with np.errstate(over="ignore"):
            hashed = (mix(tokens[voter]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        order = np.lexsort((hashed, docs[voter]))
        voter, hashed = docs[voter[order]], hashed[order]
        first = np.searchsorted(voter, ids, "left")
        last = np.searchsorted(voter, ids, "right")
        cold = size - (last - first)
        last = np.where(last - first >= _need(size, t), np.minimum(last, first + VOTERS), first)
        voters = [hashed[i:j] for i, j in zip(first.tolist(), last.tolist())]
        packed = [(squeeze(tokens[i:j], True), squeeze(weights[i:j])) if j > i else (None, None) for i, j in zip(low.tolist(), high.tolist())]
        return pd.DataFrame({"id": ids, "size": size, "d1": d1, "d2": d2, "tokens": [p[0] for p in packed], "weights": [p[1] for p in packed], "cold": cold, "voters": voters})

    return run


# -- signatures


def classes(band: int, t: float) -> int:
    """Classes of frequent tokens for pairs whose larger set has 2^band to 2^(band + 1) tokens; 0: single tokens.

    At most so many that a set of that band, or a partner of one, can always extend its prefix far enough.
    """
    return max(0, min((1 << band) // 4, math.ceil(t * t * (1 << band) - 1e-9) - 1))


def signatures(tokens: np.ndarray, weights: np.ndarray, size: int, frequent: int, t: float) -> np.ndarray:
    """Keys of a set; two sets of Jaccard ``t`` or more have one in common. ``tokens``: those that other sets have too."""
    return _ranked(tokens, weights, size, frequent, t)[0]


def _ranked(tokens: np.ndarray, weights: np.ndarray, size: int, frequent: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys, and for each how many of the set's tokens come before it and can't be common if the pair meets first there.

    A pair's first common token, if it is rare or single, has none in common before it. If there is no
    rare one, take the first combination to be complete: up to its later token each class that was met
    has one common token at most, and its own class two. So all tokens up to there but one for each
    class, and one more, are not common.
    """
    spare = size - int(_need(size, t))
    alone = size - len(tokens)
    order = np.lexsort((tokens, weights))
    tokens, rare = tokens[order], int((weights <= frequent).sum())
    single = tokens[: max(0, min(rare, spare + 1 - alone))]
    out, before = [mix(single ^ _RARE)], [alone + np.arange(len(single))]
    if alone + rare <= spare and rare < len(tokens):
        more = tokens[rare:]
        hashed = mix(more.copy())
        for band in range(size.bit_length() - 1, int(size / t + 1e-9).bit_length()):
            m = classes(band, t)
            if not m:
                out.append(mix(more[: spare + 1 - alone - rare] ^ (_SINGLE + np.uint64(band))))
                before.append(alone + rare + np.arange(len(out[-1])))
                continue
            home = (hashed % np.uint64(m)).astype(np.int64)
            fresh = np.zeros(len(more), bool)
            fresh[np.unique(home, return_index=True)[1]] = True
            passed = alone + rare + np.cumsum(~fresh)
            reach = int(np.searchsorted(passed, spare + 1)) + 1
            own, home = more[:reach], home[:reach]
            by = np.lexsort((own, home))
            own, home, passed = own[by], home[by], passed[by]
            left = np.searchsorted(home, home, "right") - np.arange(len(home)) - 1  # later ones of the class
            i = np.repeat(np.arange(len(home)), left)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
            out.append(mix(mix(own[i] * _LEFT + np.uint64(band)) + own[j]))
            before.append(np.maximum(passed[i], passed[j]) - 1)
    return np.concatenate(out), np.concatenate(before)


def _index_map(plan: Plan, t: float, buckets: int):
    step = postings.first_step(buckets, plan.fan)

    def flush(keys: list, before: list, ids: list, sizes: list, families: list) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
        rows = postings.index_rows(np.concatenate(keys) >> np.uint64(16), owner, np.array(ids, np.int64), np.array(sizes, np.int64), np.zeros(len(ids), np.uint8), buckets, step, np.concatenate(before).astype(np.uint32), np.array(families, np.int64))
        return pa.RecordBatch.from_pylist(list(rows), postings.INDEX_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            keys, before, ids, sizes, families, held = [], [], [], [], [], 0
            for b in batches:
                for i, size, tokens, weights, family in zip(*(b[c].to_pylist() for c in ("id", "size", "tokens", "weights", "family"))):
                    found, ranks = _ranked(expand(tokens), expand(weights), size, plan.frequent, t)
                    if len(found):
                        keys.append(found)
                        before.append(ranks)
                        ids.append(i)
                        sizes.append(size)
                        families.append(i if family is None else family)
                        held += len(found)
                    if held >= plan.flush:
                        yield flush(keys, before, ids, sizes, families)
                        keys, before, ids, sizes, families, held = [], [], [], [], [], 0
            if held:
                yield flush(keys, before, ids, sizes, families)

    return run


# -- verification


def _verify(t: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["tokens"].notna()]
        sets = [expand(x) for x in own["tokens"]]
        held = np.array([len(x) for x in sets])
        size = own["size"].to_numpy(np.int64)
        # tokens as places among those of the task, so that an overlap is looked up and not searched for
        known, code = np.unique(np.concatenate(sets), return_inverse=True)
        code, start = code.astype(np.int32), np.append(0, np.cumsum(held))
        del sets
        pairs = rows.loc[rows["a"].notna(), ["a", "b"]].astype(np.int64).sort_values("a", kind="stable")
        ids = own["id"].to_numpy(np.int64)
        order = np.argsort(ids)
        x, y = (order[np.searchsorted(ids[order], pairs[c].to_numpy())] for c in ("a", "b"))
        mark, out = np.zeros(len(known), np.int64), np.zeros(len(x), np.float64)
        edge = np.append(np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)]), len(x))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            mine = code[start[x[i]] : start[x[i] + 1]]
            mark[mine] = 1
            for k in range(i, j, 256):
                bs = y[k : min(k + 256, j)]
                both = np.add.reduceat(mark[np.concatenate([code[start[b] : start[b + 1]] for b in bs])], np.cumsum(held[bs]) - held[bs])
                out[k : k + len(bs)] = both / (size[x[i]] + size[bs] - both)
            mark[mine] = 0
        return pairs.assign(jaccard=out)[out >= t]

    return run


def _verified(candidates: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(a, b, jaccard) of the candidates that are similar, materialised.

    A pair is verified where the hub of its first end is, so that a set travels once or a few times and
    not once a pair. A hub's pairs are laid on a grid of parts by their ends; a task has parts of about
    ``TASK_PAIRS`` pairs together.
    """
    ends = candidates.union(candidates.select("b", "a"))
    hubs = ends.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("hub"))
    placed = candidates.join(hubs, "a")
    load = placed.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TASK_PAIRS).cast("long").alias("parts"), F.approx_count_distinct("a").alias("na"), F.approx_count_distinct("b").alias("nb"))
    # few first ends, or few second ones: the cuts fall on the others
    side = F.ceil(F.sqrt("parts"))
    load = load.withColumn("rows", F.when(F.col("na") < side, F.col("na")).when(F.col("nb") < side, F.ceil(F.col("parts") / F.col("nb"))).otherwise(side))
    load = load.select("hub", F.greatest(F.col("rows"), F.lit(1)).cast("long").alias("rows"), "parts").withColumn("columns", F.expr("(parts + rows - 1) div rows"))
    at = F.pmod(F.xxhash64("a"), "rows") * F.col("columns") + F.pmod(F.xxhash64("b"), "columns")
    tasks = max(1, -(-candidates.count() // TASK_PAIRS))
    placed = cut(placed.join(load, "hub").select(F.pmod(F.xxhash64("hub", at), F.lit(tasks)).alias("task"), "a", "b"))
    members = placed.select("task", F.explode(F.array("a", "b")).alias("id")).distinct()
    none = F.lit(None)
    work = members.join(sets.select("id", "size", "tokens"), "id").select("task", "id", "size", "tokens", none.cast("long").alias("a"), none.cast("long").alias("b"))
    work = work.union(placed.select("task", none.cast("long"), none.cast("long"), none.cast("binary"), "a", "b"))
    return cut(work.groupBy("task").applyInPandas(_verify(t), "a long, b long, jaccard double"))


# -- families


def _families(reps: DataFrame, t: float, plan: Plan) -> DataFrame | None:
    """(id, family), materialised: the sets that are similar to the hub of a family of at least ``plan.family``, and the hub; None if there are none."""
    votes = cut(reps.select("id", "size", "cold", F.explode("voters").alias("voter")))
    heard = votes.groupBy("voter").agg(F.min(F.struct("cold", "id", "size")).alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= plan.family)
    heard = cut(heard.select("voter", F.col("hub.id").alias("hub"), F.col("hub.cold").alias("hub_cold"), F.col("hub.size").alias("hub_size")))
    if heard.isEmpty():
        return None
    cast = votes.join(maybe_broadcast(heard), "voter").where((F.col("id") != F.col("hub")) & (F.least("size", "hub_size") >= F.greatest("size", "hub_size") * F.lit(t)))
    cast = cast.groupBy("id", "hub", "hub_cold").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= VOTES)
    choice = cast.groupBy("id").agg(F.min(F.struct("hub_cold", -F.col("n"), "hub")).alias("best")).select("id", F.col("best.hub").alias("hub"))
    choice = cut(choice)
    hubs = cut(choice.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= plan.family - 1).select("hub"))
    if hubs.isEmpty():
        return None
    hubs = maybe_broadcast(hubs)
    asked = choice.join(hubs, "hub").join(hubs.select(F.col("hub").alias("id")), "id", "left_anti")
    found = _verified(cut(asked.select(F.col("hub").alias("a"), F.col("id").alias("b"))), reps, t)
    kept = cut(found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= plan.family - 1).select("a"))
    if kept.isEmpty():
        return None
    members = found.join(maybe_broadcast(kept), "a").select(F.col("b").alias("id"), F.col("a").alias("family"))
    return cut(members.union(kept.select(F.col("a").alias("id"), F.col("a").alias("family"))))


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of ``x`` has in common with each of ``y``."""
    code = np.unique(np.concatenate([*x, *y]), return_inverse=True)[1]
    code, known = code.astype(np.int64), int(code.max()) + 1
    row, column = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y))
    cx, cy = code[: len(row)], code[len(row) :]
    nx, ny = np.bincount(cx, minlength=known), np.bincount(cy, minlength=known)
    out = np.zeros((len(x), len(y)), np.int32)
    # tokens of many: products of 0 and 1, exact in floats as a block has few tokens
    wide = np.flatnonzero(nx * ny * 16 > len(x) * len(y))
    for k in range(0, len(wide), 1024):
        place = np.full(known, -1)
        place[wide[k : k + 1024]] = np.arange(len(wide[k : k + 1024]))
        side = []
        for n, at, c in ((len(x), row, cx), (len(y), column, cy)):
            m = np.zeros((n, len(wide[k : k + 1024])), np.float32)
            held = place[c] >= 0
            m[at[held], place[c[held]]] = 1
            side.append(m)
        out += (side[0] @ side[1].T).astype(np.int32)
    # tokens of few: one by one
    thin = (nx > 0) & (ny > 0)
    thin[wide] = False
    row, cx = row[thin[cx]], cx[thin[cx]]
    order = np.argsort(cy, kind="stable")
    column, first = column[order], np.cumsum(ny) - ny
    total = np.cumsum(ny[cx])
    for i, j in _pieces(total, postings.PIECE):
        n = ny[cx[i:j]]
        of = np.repeat(first[cx[i:j]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(out, (np.repeat(row[i:j], n), column[of]), 1)
    return out


def _pieces(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of what ``total`` sums up, of about ``most`` together."""
    i = 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _relatives(t: float, listed: bool):
    """Of two parts of a family, or of one: the similar pairs, or for each set their number and the greatest similarity."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        left, right = (rows[rows["part"] == rows[c].iloc[0]] for c in ("i", "j"))
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), ("b" if listed else "links"): np.zeros(0, np.int64), ("jaccard" if listed else "closest"): np.zeros(0)})
        sets = [[expand(v) for v in side["tokens"]] for side in (left, right)]
        (a, sa), (b, sb) = ((side["id"].to_numpy(np.int64), side["size"].to_numpy(np.int64)) for side in (left, right))
        both = _overlaps(*sets)
        out, links, best = [], np.zeros(len(b), np.int64), np.zeros(len(b))
        for k in range(0, len(a), 256):
            o = both[k : k + 256].astype(np.int64)
            near = o / (sa[k : k + 256, None] + sb - o)
            near[near < t] = 0
            if same:
                near[np.arange(len(o)), k + np.arange(len(o))] = 0
            if listed:
                i, j = np.nonzero(near)
                x, y = a[k + i], b[j]
                first = (x < y) | (not same)
                out.append(pd.DataFrame({"a": np.minimum(x, y)[first], "b": np.maximum(x, y)[first], "jaccard": near[i, j][first]}))
                continue
            out.append(pd.DataFrame({"a": a[k : k + 256], "links": (near > 0).sum(1), "closest": near.max(1)}))
            links += (near > 0).sum(0)
            best = np.maximum(best, near.max(0))
        if not listed and not same:
            out.append(pd.DataFrame({"a": b, "links": links, "closest": best}))
        return pd.concat(out)

    return run


def _within(families: DataFrame, sets: DataFrame, t: float, plan: Plan, listed: bool) -> DataFrame:
    """Pairs within families: (a, b, jaccard) of the similar ones if ``listed``, else rows (a, links, closest) to be summed up by set."""
    members = cut(families.join(sets.select("id", "size", "tokens"), "id"))
    load = members.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / plan.members, F.sum("size") / plan.member_tokens)).cast("long").alias("parts"))
    placed = members.join(load, "family").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = placed.select("family", "id", "size", "tokens", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return placed.groupBy("family", "i", "j").applyInPandas(_relatives(t, listed), "a long, b long, jaccard double" if listed else "a long, links long, closest double")


# -- the join


@dataclass(frozen=True)
class _Joined:
    """``groups``: (id, rep) of every document with words, rep being the least with the same set. ``pairs``: (a, b, jaccard) of different sets' reps, but for those within one of ``families``: (id, family), None without any. ``reps``: their sets."""

    groups: DataFrame
    pairs: DataFrame
    names: DataFrame | None
    families: DataFrame | None
    reps: DataFrame


def _group_pairs(docs: DataFrame, id_col: str, text_col: str, n: int, t: float, plan: Plan) -> _Joined:
    rows, size, names = one_row_per_id(docs, id_col, text_col)
    spark = docs.sparkSession
    buckets = postings.buckets_for(size // BYTES_A_TOKEN, max(1, shuffle_partitions(spark) // 2), plan.bucket)
    step = postings.first_step(buckets, plan.fan)
    sent = rows.mapInArrow(_token_map(n, plan, buckets), _TOKENS_SQL)
    sent = postings.fan_out(sent, buckets, _respread(buckets, False), plan.fan)
    weighed = sent.groupBy("bucket").applyInPandas(_weigh(buckets, step), _TOKENS_SQL)
    weighed = postings.fan_out(weighed, buckets, _respread(buckets, True), plan.fan)
    sets = cut(weighed.where(F.col("kind") >= _HOME).groupBy("bucket").applyInPandas(_gather(plan.hot, t), "id long, size long, d1 long, d2 long, tokens binary, weights binary, cold long, voters array<int>"))

    keyed = sets.select("id", "size", "d1", "d2")
    least = keyed.groupBy("d1", "d2", "size").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = cut(keyed.join(least.where("n > 1"), ["d1", "d2", "size"]).where("id != rep").select("id", "rep"))
    gone = maybe_broadcast(copies)
    groups = keyed.select("id").join(gone, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    reps = sets.where("tokens is not null").select("id", "size", "tokens", "weights", "cold", "voters").join(gone.select("id"), "id", "left_anti")
    families = _families(reps, t, plan)
    placed = reps.withColumn("family", F.lit(None).cast("long")) if families is None else reps.join(maybe_broadcast(families), "id", "left")

    total = sets.agg(F.sum("size")).first()[0] or 0
    wide = postings.buckets_for(total // 4, max(1, shuffle_partitions(spark) // 2), plan.bucket)
    index = placed.select("id", "size", "tokens", "weights", "family").mapInArrow(_index_map(plan, t, wide), postings.INDEX)
    candidates = cut(postings.joined_lists(index, wide, t, plan.list_block, plan.part, plan.fan, ranked=True).select("a", "b"))
    return _Joined(groups, _verified(candidates, reps, t), names, families, reps)


def _plan(frequent: int, plan: Plan | None) -> Plan:
    return plan or Plan(frequent=frequent)


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, frequent: int = FREQUENT, plan: Plan | None = None) -> DataFrame:
    """(doc_a, doc_b, jaccard): every pair of documents whose n-gram sets have at least that Jaccard similarity, doc_a < doc_b.

    Copies are listed against each other, so use ``near_groups`` where they may be many. Exact, up to
    48-bit hashes of n-grams. Rows without identifier or text, and texts without a word, are in no
    pair. Distinct texts of a repeated identifier count as one text of several lines. Identifiers may
    be of any type; those that aren't whole numbers come back, and are ordered, as strings. Texts are
    read whole whatever their length; ties can't occur; other columns aren't read; an empty table gives
    no pairs.
    """
    plan = _plan(frequent, plan)
    found = _group_pairs(docs, id_col, text_col, n, threshold, plan)
    groups, pairs, names = found.groups, found.pairs, found.names
    if found.families is not None:
        pairs = pairs.union(_within(found.families, found.reps, threshold, plan, True))
    left = groups.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    right = groups.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    within = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return renamed(across.union(within), names, "doc_a", "doc_b")


def _edges(found: _Joined) -> DataFrame:
    """(a, b) with the components of all similar pairs: a family is linked through its hub."""
    edges = found.pairs.select("a", "b")
    return edges if found.families is None else edges.union(found.families.where("id != family").select("family", "id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, frequent: int = FREQUENT, plan: Plan | None = None) -> DataFrame:
    """(doc_id, class_id, copies, links, closest), one row for each identifier of a row that has a text.

    ``class_id`` is the smallest identifier of all that are linked with the document, over any number of
    steps, by ``similar_pairs``. ``copies`` counts the other documents with the same set, ``links`` the
    different sets that are similar to it, each once however many documents have it; ``closest`` is the
    greatest similarity to another document, 0 where there is none. No pair is lost: only copies aren't
    expanded. Edge cases are those of ``similar_pairs``; a text without words is a class of its own.
    """
    plan = _plan(frequent, plan)
    found = _group_pairs(docs, id_col, text_col, n, threshold, plan)
    groups, pairs, names = cut(found.groups), found.pairs, found.names
    classes_ = connected_components(_edges(found))
    one = F.lit(1).cast("long").alias("links")
    each = pairs.select("a", one, F.col("jaccard").alias("closest")).union(pairs.select("b", one, "jaccard"))
    if found.families is not None:
        each = each.union(_within(found.families, found.reps, threshold, plan, False))
    both = each.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"), F.max("closest").alias("closest"))
    of_rep = groups.groupBy("rep").agg((F.count(F.lit(1)) - 1).alias("copies"))
    of_rep = of_rep.join(both, "rep", "left").join(classes_.withColumnRenamed("node", "rep"), "rep", "left")
    rows, renames = numbered_ids(docs, id_col, text_col, names)
    out = rows.join(groups, "id", "left").join(of_rep, "rep", "left")
    out = out.select(
        F.col("id").alias("doc_id"), F.coalesce("component", "rep", "id").alias("class_id"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.when(F.col("copies") > 0, 1.0).otherwise(F.coalesce("closest", F.lit(0.0))).alias("closest"),
    )
    return renamed(out, renames, "doc_id", "class_id")


def numbered_ids(docs: DataFrame, id_col: str, text_col: str, names: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(id,) once for each identifier of a row that has a text, as numbers where they have ``names``."""
    if names is not None:
        return names.select(F.col("__number").alias("id")), names
    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct(), None


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, frequent: int = FREQUENT, plan: Plan | None = None) -> DataFrame:
    """``docs`` with one document, that of the smallest identifier, of each group linked by ``similar_pairs``; all columns.

    Rows without identifier, text or words stay, and so do all rows of an identifier that stays, equal
    or not. Edge cases are those of ``similar_pairs``; an empty table gives an empty one.
    """
    found = _group_pairs(docs, id_col, text_col, n, threshold, _plan(frequent, plan))
    groups, names = found.groups, found.names
    edges = cut(_edges(found).union(groups.where("id != rep").select("rep", "id")))
    gone = cut(renamed(connected_components(edges).where("node != component").select(F.col("node").alias("__gone")), names, "__gone"))
    key = docs[id_col].cast("long" if names is None else "string")
    return docs.join(maybe_broadcast(gone), (key == gone["__gone"]) & docs[text_col].isNotNull(), "left_anti")
