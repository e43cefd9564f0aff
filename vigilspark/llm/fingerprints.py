"""Context-triggered piecewise hashes of documents, and documents whose hashes are alike.

A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever its low bits are all ones, so
boundaries follow content and an edit only disturbs the chunks around it. Block size 2^k asks for k
bits, hence the boundaries of 2^(k+1) are among those of 2^k. A document's block size is the least
for which the whole text has at most ``LENGTH`` chunks; a chunk gives one character, and the
fingerprint has the signatures for 2^k and 2^(k+1). Runs of a character are cut to ``RUN``, as
repeated content says little. Signatures of one block size are compared by edit distance if they
have ``COMMON`` characters in a row in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import spans, utf8
from .common import cut, renamed, shuffle_partitions
from .ngram_join import one_row_per_id
from .ngrams import mix
from .postings import INDEX, INDEX_ARROW, PART_POSTINGS, PairSet, buckets_for, cross_left, cross_pairs, first_step, index_rows, list_members

WINDOW, LEAST_BITS, LENGTH, RUN = 7, 3, 64, 3
#: Characters in a row that two signatures have in common to be compared.
COMMON = 7
#: Least score of a match: 100 times 1 - distance / longer signature.
MIN_SCORE = 60
BLOCK_BYTES, BUCKET_POSTINGS = 1 << 20, 1_500_000
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_CODE = np.zeros(256, np.uint64)
_CODE[ALPHABET] = np.arange(64)
_TABLE = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes up to each position; before the first byte there are zeros."""
    q, q2, q4, q6 = (np.uint32(pow(0x01000193, k, 1 << 32)) for k in (1, 2, 4, 6))
    pad = np.concatenate([np.zeros(WINDOW - 1, np.uint8), data])
    one = _TABLE[pad]
    two = one[1:] + q * one[:-1]
    four = two[2:] + q2 * two[:-2]
    r = four[3:] + q4 * two[1:-4] + q6 * one[:-6]
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x2C1B3C6D)
    r ^= r >> np.uint32(12)
    r *= np.uint32(0x297A2D39)
    r ^= r >> np.uint32(15)
    return r


def trailing_ones(r: np.ndarray) -> np.ndarray:
    flipped = ~r
    low = (flipped & (~flipped + np.uint32(1))).astype(np.float64)
    return np.where(low > 0, np.frexp(low)[1] - 1, 32).astype(np.int64)


def _signature(total: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all signatures in a row, and how many each text has. total: running sums; chunks are (ends[i - 1], ends[i]] of text doc[i]."""
    if not len(ends):
        return np.zeros(0, np.uint8), np.zeros(n, np.int64)
    chars = ALPHABET[(mix(np.diff(total[ends + 1], prepend=total[0])) >> np.uint64(58)).astype(np.int64)]
    same = np.zeros(len(chars), np.int64)
    for back in range(1, RUN + 1):
        same[back:] += (same[back:] == back - 1) & (chars[back:] == chars[:-back]) & (doc[back:] == doc[:-back])
    keep = same < RUN
    return chars[keep], np.bincount(doc[keep], minlength=n)


def fingerprints(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(bits, [(characters, lengths) of the signature, of the one for doubled blocks]) of texts; an empty one has empty signatures."""
    data, offsets = utf8(column)
    bits, chars, lengths = [], ([], []), ([], [])
    with np.errstate(over="ignore"):
        for i, j in spans(offsets, BLOCK_BYTES):
            k, found = _block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            bits.append(k)
            for s in (0, 1):
                chars[s].append(found[s][0])
                lengths[s].append(found[s][1])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(bits, np.int64), [(join(chars[s], np.uint8), join(lengths[s], np.int64)) for s in (0, 1)]


def _block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list]:
    n, size = len(offsets) - 1, np.diff(offsets)
    r = rolling(data)
    for i in np.flatnonzero(size):  # the first bytes of a text don't see the text before
        a, b = offsets[i], min(offsets[i] + WINDOW - 1, offsets[i + 1])
        r[a:b] = rolling(data[a:b])
    at = np.flatnonzero((r & np.uint32((1 << LEAST_BITS) - 1)) == (1 << LEAST_BITS) - 1)
    at = at[~np.isin(at, offsets[1:] - 1)]  # the end of a text ends a chunk anyway
    level, doc = trailing_ones(r[at]), np.searchsorted(offsets, at, "right") - 1
    counted = np.bincount(doc * 34 + level, minlength=34 * n).reshape(n, 34)
    reach = counted[:, ::-1].cumsum(1)[:, ::-1]  # boundaries of at least so many bits
    k = LEAST_BITS + (reach[:, LEAST_BITS:] <= LENGTH - 1).argmax(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(r.astype(np.uint64)), dtype=np.uint64)])
    last = (offsets[1:] - 1)[size > 0]
    out = []
    for more in (0, 1):
        own = at[level >= k[doc] + more]
        ends = np.sort(np.concatenate([own, last]))
        out.append(_signature(total, ends, np.searchsorted(offsets, ends, "right") - 1, n))
    return k, out


def _strings(chars: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(chars.tobytes()))


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits, (one, two) = fingerprints(b["body"])
        yield pa.RecordBatch.from_arrays([b["id"].cast(pa.int64()), pa.array(bits), _strings(*one), _strings(*two)], names=["id", "bits", "one", "two"])


def _grams(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of signatures one after the other: every run of ``COMMON`` characters as a number, its signature, and the character before it, 64 at the beginning."""
    grams = np.zeros(max(0, len(code) - COMMON + 1), np.uint64)
    for k in range(COMMON):
        grams = grams * np.uint64(64) + code[k : k + len(grams)]
    owner = np.repeat(np.arange(len(size)), size)[: len(grams)]
    place = np.arange(len(grams)) - (np.cumsum(size) - size)[owner]
    before = np.concatenate([[64], code[:-1].astype(np.int64)])[: len(grams)] if len(grams) else np.zeros(0, np.int64)
    whole = place + COMMON <= size[owner]
    return grams[whole], owner[whole], np.where(place == 0, 64, before)[whole].astype(np.uint8)


def _post(buckets: int, step: int):
    """Postings of the runs of every signature."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        ids, bits = table["id"].to_numpy(), table["bits"].to_numpy()
        data, offsets = utf8(table["sig"])
        size = np.diff(offsets)
        grams, owner, before = _grams(_CODE[data], size)
        # 40 bits of the hash: what a chance meeting costs is one more comparison
        keys = mix(grams * np.uint64(64) + bits[owner].astype(np.uint64)) >> np.uint64(24) << np.uint64(8)
        return pa.RecordBatch.from_pylist(list(index_rows(keys, owner, ids, size, bits, buckets, step, before)), INDEX_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= 50_000:
                    yield flush(held)
                    held, n = [], 0
            if n:
                yield flush(held)

    return run


def _codes(packed: np.ndarray) -> np.ndarray:
    """Rows of six-bit characters, ``LENGTH`` in each, of byte strings of up to three quarters of that."""
    data = np.frombuffer(b"".join(x.ljust(LENGTH * 3 // 4, b"\0") for x in packed), np.uint8).reshape(len(packed), -1, 3).astype(np.uint32)
    word = data[:, :, 0] << 16 | data[:, :, 1] << 8 | data[:, :, 2]
    return np.stack([(word >> s & 63).astype(np.uint8) for s in (18, 12, 6, 0)], 2).reshape(len(packed), LENGTH)


def _bags(code: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each signature: sets of the characters it has at least once, twice and so on, as bits; and how many characters those leave out."""
    here = np.arange(LENGTH) < size[:, None]
    flat = (np.arange(len(code))[:, None] * 64 + code)[here]
    count = np.bincount(flat, minlength=64 * len(code)).reshape(len(code), 64)
    sets = [np.packbits(count > k, axis=1).view(np.uint64).ravel() for k in range(4)]
    return sets, np.maximum(count - 4, 0).sum(1)


def edit_distances(code: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the rows ``a`` and ``b`` of ``code``, of ``size`` characters from 1 to 64, a bit for each (Myers, 1999; Hyyrö, 2003)."""
    rows, at = np.unique(a, return_inverse=True)
    where = np.zeros((len(rows), 64), np.uint64)
    for k in range(int(size[rows].max())):
        has = np.flatnonzero(size[rows] > k)
        where[has, code[rows[has], k]] |= np.uint64(1 << k)
    where, at = where.ravel(), at * 64
    one, top, end = np.uint64(1), (size[a] - 1).astype(np.uint64), size[b]
    up, down, score = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64), size[a].astype(np.int64)
    out = np.zeros(len(a), np.int64)
    for k in range(int(end.max())):
        eq = where[at + code[b, k]]
        x = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(x | up), up & x
        score += (plus >> top & one).astype(np.int64) - (minus >> top & one).astype(np.int64)
        plus, minus, eq = plus << one | one, minus << one, eq | down
        up, down = minus | ~(eq | plus), plus & eq
        out[end == k + 1] = score[end == k + 1]
    return out


def _meet(min_score: int, step: int = 50_000):
    """(a, b, score) of the members of lists, or of two blocks of one list, that score at least ``min_score``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        across = bool(rows["i"].iloc[0] != rows["j"].iloc[0])
        ids, tag, block = (rows[c].to_numpy(np.int64) for c in ("id", "tag", "block"))
        order = np.lexsort((tag, ids))
        new = np.r_[True, (ids[order][1:] != ids[order][:-1]) | (tag[order][1:] != tag[order][:-1])]
        first, own = order[new], np.empty(len(ids), np.int64)
        own[order] = np.cumsum(new) - 1
        size = rows["n"].to_numpy(np.int64)[first]
        code = _codes(rows["sig"].to_numpy()[first])
        (sets, rest), doc = _bags(code, size), ids[first]
        lists, before = rows["list"].to_numpy(np.int64), rows["before"].to_numpy(np.int64)
        before = np.where(before == 64, 64 + np.arange(len(before)), before)
        order = np.lexsort((before, lists))
        own, block, tag = own[order], block[order], tag[order]
        pairs = PairSet()
        for i, j in cross_pairs(*cross_left(lists[order], before[order])):
            a, b = own[i], own[j]
            most = np.maximum(size[a], size[b])
            fits = (doc[a] != doc[b]) & (tag[i] == tag[j]) & (np.minimum(size[a], size[b]) * 100 >= min_score * most)
            if across:
                fits &= block[i] != block[j]
            a, b, most = a[fits], b[fits], most[fits]
            # no alignment keeps more characters than the two have in common
            common = np.minimum(rest[a], rest[b])
            for s in sets:
                common += np.bitwise_count(s[a] & s[b])
            fits = common * 100 >= min_score * most
            a, b = a[fits], b[fits]
            swap = doc[a] > doc[b]
            pairs.add(np.where(swap, b, a).astype(np.uint64) << np.uint64(32) | np.where(swap, a, b).astype(np.uint64))
        codes = pairs.settle()
        a, b = (codes >> np.uint64(32)).astype(np.int64), (codes & np.uint64(0xFFFFFFFF)).astype(np.int64)
        score = np.zeros(len(a), np.int64)
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            most = np.maximum(size[x], size[y])
            score[k : k + step] = 100 * (most - edit_distances(code, size, x, y)) // most
        good = score >= min_score
        return pd.DataFrame({"a": doc[a[good]], "b": doc[b[good]], "score": score[good].astype(np.int32)})

    return run


def _matches(reps: DataFrame, min_score: int, block: int = 2048, part_postings: int = PART_POSTINGS) -> DataFrame:
    """(a, b, score) of different fingerprints, a < b.

    Signatures go to the lists of the runs that they share, and pairs are compared where they meet:
    only those that match leave a task, so that a line which many texts have costs no shuffle of its pairs.
    """
    sigs = cut(reps.select("id", F.explode(F.array(F.struct("bits", F.col("one").alias("sig")), F.struct((F.col("bits") + 1).alias("bits"), F.col("two").alias("sig")))).alias("s")).select("id", "s.*"))
    count = sigs.agg(F.sum(F.length("sig"))).first()[0] or 0
    buckets = buckets_for(count, max(1, shuffle_partitions(reps.sparkSession) // 4), BUCKET_POSTINGS)
    members = cut(list_members(sigs.mapInArrow(_post(buckets, first_step(buckets)), INDEX), buckets, block, part_postings))
    packed = F.unbase64(F.expr("rpad(sig, (length(sig) + 3) div 4 * 4, 'A')"))  # six bits a character
    rows = members.join(sigs.select("id", F.col("bits").alias("tag"), packed.alias("sig"), F.length("sig").alias("n")), ["id", "tag"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # the lists of a bucket together, those of several blocks by two blocks each
    rows = rows.select(F.when(F.col("blocks") > 1, F.col("list")).otherwise(-1 - F.col("bucket")).alias("at"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "list", "id", "tag", "before", "block", "sig", "n")
    hot = members.where("blocks > 1").select("list", "blocks").distinct().agg(F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()[0] or 0
    tasks = min(100_000, 2 * (buckets + hot))
    found = rows.repartition(tasks, "at", "i", "j").groupBy("at", "i", "j").applyInPandas(_meet(min_score), "a long, b long, score int")
    return found.groupBy("a", "b").agg(F.max("score").alias("score"))


def _compared(docs: DataFrame, id_col: str, text_col: str, min_score: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(id, bits, one, two) of documents; (id, same_as); (a, b, score) of different fingerprints; names."""
    rows, _, names = one_row_per_id(docs, id_col, text_col)
    prints = cut(rows.mapInArrow(_map, "id long, bits long, one string, two string"))
    # equal fingerprints meet by 128 bits of hash: the signatures themselves aren't shuffled for it
    keyed = prints.select("id", F.xxhash64("bits", "one", "two").alias("h1"), F.xxhash64(F.lit("second half"), "two", "one", "bits").alias("h2"))
    groups = keyed.groupBy("h1", "h2").agg(F.min("id").alias("same_as"))
    same = cut(keyed.join(groups, ["h1", "h2"]).select("id", "same_as"))
    reps = prints.where("length(one) > 0").join(same.where("id = same_as"), "id", "left_semi")
    return prints, same, cut(_matches(reps, min_score)), names


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: int = MIN_SCORE) -> DataFrame:
    """(doc_a, doc_b, score): documents of different fingerprints that score at least ``min_score``, each fingerprint by its smallest identifier, doc_a < doc_b; edge cases as in ``similar_fingerprints``."""
    _, _, pairs, names = _compared(docs, id_col, text_col, min_score)
    return renamed(pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "score"), names, "doc_a", "doc_b")


def similar_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: int = MIN_SCORE) -> DataFrame:
    """(doc_id, block_size, signature, signature_double, same_as, links, best_score), one row for each document.

    ``same_as``, the document's class, is the smallest identifier with the same fingerprint. ``links``
    counts the different fingerprints that score at least ``min_score`` with it, ``best_score`` is the
    greatest of their scores (null without any); ``fingerprint_pairs`` has the links themselves. The
    score is the best over the block sizes that two fingerprints have in common (equal, or one the
    double of the other).

    Rows without identifier or text are left out; the distinct texts of a repeated identifier count as
    one text of several lines. Identifiers may be of any type; those that aren't whole numbers come
    back, and are ordered, as strings. Empty texts have empty signatures, the same as each other, and
    match nothing else; texts too short for ``COMMON`` chunks only match their like. Other columns
    aren't read; an empty table gives no rows.
    """
    prints, same, pairs, names = _compared(docs, id_col, text_col, min_score)
    both = pairs.union(pairs.select("b", "a", "score")).groupBy(F.col("a").alias("same_as")).agg(F.count(F.lit(1)).alias("links"), F.max("score").alias("best_score"))
    out = prints.join(same.join(both, "same_as", "left"), "id").select(
        F.col("id").alias("doc_id"), F.pow(F.lit(2), "bits").cast("long").alias("block_size"), F.col("one").alias("signature"), F.col("two").alias("signature_double"),
        "same_as", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "best_score",
    )
    return renamed(out, names, "doc_id", "same_as")
