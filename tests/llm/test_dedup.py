"""Exact dedup, fingerprints and the n-gram join against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import fingerprints, lsm_dedup, ngram_join, postings
from vigilspark.llm.blobs import expand, squeeze

from .conftest import FOX, rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# -- exact dedup


def test_groups_on_messy_rows(messy):
    got = rows_of(lsm_dedup.exact_groups(messy))
    want = [(1, 1, False), (2, 1, True), (2, 1, True), (3, 3, False), (4, 4, False), (5, 4, True), (6, 6, False), (7, 7, False), (8, 8, False), (9, 9, False), (10, 10, False)]
    assert got == sorted(want, key=repr)


def test_one_row_of_every_text_stays(messy):
    kept = lsm_dedup.drop_copies(messy)
    assert kept.columns == messy.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert ids == [(False, i) for i in (1, 3, 4, 6, 7, 8, 9, 10)] + [(True, 0)] * 2


def test_a_repeated_row_stays_once(spark):
    d = spark.createDataFrame([(5, "a", "p"), (5, "a", "q"), (6, "b", None), (6, "c", None)], "doc_id long, text string, extra string")
    assert sorted((r["doc_id"], r["text"]) for r in lsm_dedup.drop_copies(d).collect()) == [(5, "a"), (6, "b"), (6, "c")]


def test_empty_tables(none):
    assert lsm_dedup.exact_groups(none).count() == lsm_dedup.drop_copies(none).count() == 0
    assert fingerprints.similar_fingerprints(none).count() == 0
    assert ngram_join.similar_pairs(none).count() == ngram_join.near_groups(none).count() == ngram_join.drop_near_copies(none).count() == 0


def test_small_memtables_give_the_same(docs):
    few = lsm_dedup.find_copies(docs, memtable_rows=3).groupBy("id").agg(F.min("keep").alias("keep"))
    least = {}
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        least[r["text"]] = min(least.get(r["text"], r["doc_id"]), r["doc_id"])
    assert sorted(map(tuple, few.collect())) == sorted((r["doc_id"], least[r["text"]]) for r in rows if least[r["text"]] != r["doc_id"])


def test_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    real = lsm_dedup.with_digests
    same = lambda d, i, t: real(d, i, t).withColumn("d1", F.lit(1).cast("long")).withColumn("d2", F.lit(2).cast("long"))
    monkeypatch.setattr(lsm_dedup, "with_digests", same)
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c")], "doc_id long, text string")
    assert sorted((r["id"], r["keep"]) for r in lsm_dedup.find_copies(d).collect()) == [(3, 1), (4, 2)]
    assert rows_of(lsm_dedup.exact_groups(d)) == [(1, 1, False), (2, 2, False), (3, 1, True), (4, 2, True), (5, 5, False)]


def test_index_keeps_the_smallest_identifier():
    rng = np.random.default_rng(1)
    index, least, count = lsm_dedup.Index(fanout=3), {}, {}
    for _ in range(20):
        d1, ids = rng.integers(-50, 50, 40), rng.integers(0, 1000, 40)
        for a, i in zip(d1.tolist(), ids.tolist()):
            least[a], count[a] = min(least.get(a, i), i), count.get(a, 0) + 1
        index.insert(d1, d1 * 7, ids, np.ones(40, np.int64))
    tables = index.tables()
    got = [(a, i, n) for t in tables for a, i, n in zip(t.d1.tolist(), t.ids.tolist(), t.n.tolist())]
    assert sorted(got) == sorted((a, least[a], count[a]) for a in least)
    assert all((np.diff(t.d1) > 0).all() for t in tables) and len(index.tiers) > 1


def test_filters_spare_searches():
    rng = np.random.default_rng(4)
    index = lsm_dedup.Index()
    for _ in range(10):
        index.insert(*rng.integers(-(2**62), 2**62, (2, 1000)), rng.integers(0, 1000, 1000), np.ones(1000, np.int64))
    assert index.asked > 10_000 and index.searched < 0.02 * index.asked
    before = index.searched
    old = index.tables()[0]
    index.insert(old.d1[:10].copy(), old.d2[:10].copy(), np.full(10, -1), np.ones(10, np.int64))
    assert index.searched - before >= 10 and (old.ids[:10] == -1).all() and (old.n[:10] == 2).all()


def test_a_later_batch_probes_the_stored_index(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one, two, three = make([(5, "a"), (6, "b"), (7, "a")]), make([(8, "b"), (9, "c"), (3, "a")]), make([(10, "d"), (11, "c")])
    path = str(tmp_path / "index")
    found = lambda d, known: sorted((r["id"], r["keep"]) for r in lsm_dedup.find_copies(d, index=path, known=known, memtable_rows=2).collect())
    assert found(one, None) == [(7, 5)]
    assert found(two, one) == [(8, 6)]
    assert found(three, one.union(two)) == [(11, 9)]
    tables = spark.read.parquet(f"{path}/version-3").collect()
    rows = sorted((i, n) for t in tables for i, n in zip(*np.frombuffer(t["rows"], np.int64).reshape(4, -1)[2:].tolist()))
    assert rows == [(3, 3), (6, 2), (9, 2), (10, 1)]


def test_dedup_takes_strings_as_identifiers(spark):
    d = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y"), ("d", None), (None, "x"), ("c", "y")], "doc_id string, text string")
    assert rows_of(lsm_dedup.exact_groups(d)) == [("a", "a", False), ("b", "a", True), ("c", "c", False), ("c", "c", False), ("d", "d", False)]
    assert rows_of(lsm_dedup.drop_copies(d).select("doc_id")) == [("a",), ("c",), ("d",), (None,)]


def test_repeated_rows_are_settled_by_their_hash(spark):
    rows = [(5, "a", c) for c in "pqrstuvw"]
    kept = {tuple(map(tuple, lsm_dedup.drop_copies(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, extra string").repartition(k + 1)).collect())) for k in range(3)}
    assert len(kept) == 1


def test_filter_has_no_false_negative():
    d = np.random.default_rng(2).integers(-(2**62), 2**62, (2, 5000))
    bloom = lsm_dedup.make_bloom(*d)
    assert lsm_dedup.in_bloom(bloom, *d).all()
    other = np.random.default_rng(3).integers(-(2**62), 2**62, (2, 5000))
    assert lsm_dedup.in_bloom(bloom, *other).mean() < 0.05


# -- fingerprints


def _signature(raw: bytes, bits: int) -> str:
    """Chunk by chunk."""
    r = fingerprints.rolling(np.frombuffer(raw, np.uint8))
    out, total = [], np.uint64(0)
    with np.errstate(over="ignore"):
        for i in range(len(raw)):
            total += fingerprints.mix(r[i : i + 1].astype(np.uint64))[0]
            if int(r[i]) & ((1 << bits) - 1) == (1 << bits) - 1 or i == len(raw) - 1:
                out.append(chr(fingerprints.ALPHABET[int(fingerprints.mix(np.array([total]))[0]) >> 58]))
                total = np.uint64(0)
    return re.sub(r"(.)\1{3,}", r"\1\1\1", "".join(out))


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _score(a: dict, b: dict, gate: bool = True) -> int:
    best = 0
    for k1, s1 in a.items():
        s2 = b.get(k1, "")
        run = fingerprints.COMMON
        if s1 and s2 and (not gate or any(s1[i : i + run] in s2 for i in range(len(s1) - run + 1))):
            longer = max(len(s1), len(s2))
            best = max(best, 100 * (longer - _levenshtein(s1, s2)) // longer)
    return best


def test_fingerprints_against_every_pair(spark, docs):
    rows = {r["doc_id"]: r for r in fingerprints.similar_fingerprints(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows.keys() == texts.keys()
    sigs = {}
    for i, r in rows.items():
        k = r["block_size"].bit_length() - 1
        sigs[i] = {k: r["signature"], k + 1: r["signature_double"]}
    for i in list(texts)[:25]:
        raw, k = texts[i].encode(), rows[i]["block_size"].bit_length() - 1
        assert (rows[i]["signature"], rows[i]["signature_double"]) == (_signature(raw, k), _signature(raw, k + 1))
    groups = {}
    for i in sorted(rows):
        groups.setdefault(tuple(sorted(sigs[i].items())), i)
    assert all(r["same_as"] == groups[tuple(sorted(sigs[i].items()))] for i, r in rows.items())
    reps = sorted(set(groups.values()))
    scores = {(i, j): s for i in reps for j in reps if i < j and (s := _score(sigs[i], sigs[j])) >= fingerprints.MIN_SCORE}
    assert {(r["doc_a"], r["doc_b"]): r["score"] for r in fingerprints.fingerprint_pairs(docs).collect()} == scores
    free = {(i, j) for i in reps for j in reps if i < j and _score(sigs[i], sigs[j], False) >= fingerprints.MIN_SCORE}
    assert len(scores) >= 0.9 * len(free)
    for i, r in rows.items():
        own = [s for pair, s in scores.items() if r["same_as"] in pair]
        assert (r["links"], r["best_score"]) == (len(own), max(own, default=None))


def test_fingerprints_on_messy_rows(messy):
    rows = {r["doc_id"]: r for r in fingerprints.similar_fingerprints(messy).collect()}
    assert sorted(rows) == [1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert rows[2]["same_as"] == 1 and rows[5]["same_as"] == 4 and rows[4]["signature"] == ""
    assert rows[6]["links"] == 1 or rows[7]["same_as"] == 6
    assert len(rows[6]["signature"]) <= fingerprints.LENGTH


def test_edit_distances_by_bits():
    rng = np.random.default_rng(5)
    size, code = np.r_[[1, 64, 64], rng.integers(1, 65, 57)], rng.integers(0, 6, (60, 64)).astype(np.uint8)
    code[30:] = rng.integers(0, 64, (30, 64))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    text = ["".join(chr(97 + c) for c in row[:n]) for row, n in zip(code, size)]
    want = np.array([_levenshtein(text[i], text[j]) for i, j in zip(a, b)])
    assert (fingerprints.edit_distances(code, size, a, b) == want).all()
    sets, rest = fingerprints._bags(code, size)
    common = np.minimum(rest[a], rest[b]) + sum(np.bitwise_count(s[a] & s[b]).astype(int) for s in sets)
    assert (np.maximum(size[a], size[b]) - common <= want).all()


@pytest.mark.parametrize("block,part", [(2048, 3_000_000), (16, 3_000_000), (16, 50)])
def test_a_line_of_many_texts_costs_no_pairs(spark, block, part, monkeypatch):
    """Texts that share a line meet in one list; what leaves the comparison are matches, and their number doesn't depend on how lists are cut."""
    rng, shared = random.Random(3), "the one line that every text has at its beginning, whatever comes after it in the text itself"
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    texts = [shared + " " + " ".join(word() for _ in range(rng.randint(30, 45))) for _ in range(120)]
    texts += [t.replace(t.split()[-9], "changed") for t in texts[:30]]
    prints = spark.createDataFrame(list(enumerate(texts)), "id long, body string").mapInArrow(fingerprints._map, "id long, bits long, one string, two string").collect()
    sigs = {r["id"]: {r["bits"]: r["one"], r["bits"] + 1: r["two"]} for r in prints}
    want = {(i, j): s for i in sigs for j in sigs if i < j and (s := _score(sigs[i], sigs[j])) >= fingerprints.MIN_SCORE}
    met = sum(1 for i in sigs for j in sigs if i < j and _score(sigs[i], sigs[j]) > 0)
    seen = []
    cut = fingerprints.cut
    monkeypatch.setattr(fingerprints, "cut", lambda df: (seen.append(r := cut(df)), r)[1])
    got = fingerprints._matches(spark.createDataFrame(prints), fingerprints.MIN_SCORE, block, part).collect()
    assert {(r["a"], r["b"]): r["score"] for r in got} == want
    assert len(want) >= 25 and met > 10 * len(want)
    assert max(df.count() for df in seen) < met / 2, "nothing that is stored has a row for each pair"


# -- n-gram join


def _grams(text: str, n: int = 3) -> set:
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def _pairs(texts: dict, t: float) -> set:
    sets, out = {i: _grams(x) for i, x in texts.items()}, set()
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= t:
                    out.add((a, b))
    return out


@pytest.mark.parametrize(("seed", "words", "size", "frequent"), [(1, 3, 12, 2), (2, 4, 40, 1), (3, 12, 200, 3), (4, 2, 5, 64)])
def test_join_against_every_pair(spark, seed, words, size, frequent):
    rng = random.Random(seed)
    vocabulary, texts = [f"w{i}" for i in range(words)], {}
    for i in range(60):
        if texts and rng.random() < 0.5:
            own = rng.choice(list(texts.values())).split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        else:
            own = rng.choices(vocabulary, k=rng.randint(1, size))
        texts[i] = " ".join(own)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    # tiny blocks, lists, parts and ranges of buckets: every way to cut the work gives the same
    tiny = ngram_join.Plan(frequent=frequent, flush=200, bucket=150, dense=3, counters=50, list_block=4, part=60, fan=3)
    for t, plan in ((0.5, None), (0.8, None), (0.5, tiny)):
        got = ngram_join.similar_pairs(d, threshold=t, frequent=frequent, plan=plan).collect()
        assert len(got) == len({(r["doc_a"], r["doc_b"]) for r in got})
        assert {(r["doc_a"], r["doc_b"]) for r in got} == _pairs(texts, t)


def test_frequent_tokens_are_indexed_as_combinations():
    rng = np.random.default_rng(5)
    tokens = np.unique(rng.integers(0, 1 << 48, 300).astype(np.uint64))
    weights = np.full(len(tokens), 1000, np.uint32)
    keys = ngram_join.signatures(tokens, weights, len(tokens), 64, 0.5)
    singles = set(ngram_join.mix(tokens ^ ngram_join._RARE).tolist())
    assert len(keys) > 100 and not singles & set(keys.tolist())
    assert len(keys) < 4 * len(tokens)
    # half of the tokens and two more are in common: some combination is too
    for _ in range(50):
        keep = rng.permutation(len(tokens))
        other = np.unique(np.concatenate([tokens[keep[:201]], rng.integers(0, 1 << 48, 99).astype(np.uint64)]))
        w = np.where(np.isin(other, tokens), 1000, 70).astype(np.uint32)
        mine = ngram_join.signatures(other, w, len(other), 64, 0.5)
        assert set(mine.tolist()) & set(keys.tolist())


def test_near_groups_are_components_of_the_pairs(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets, least = {i: _grams(x) for i, x in texts.items()}, {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]) or i, i)
    rep = {i: least[frozenset(sets[i]) or i] for i in sets}
    pairs = _pairs(texts, 0.5)
    group = {i: i for i in texts}
    for _ in texts:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    for r in ngram_join.near_groups(docs).collect():
        i = r["doc_id"]
        linked = {rep[b if a == rep[i] else a] for a, b in pairs if rep[i] in (a, b)} - {rep[i]}
        assert (r["class_id"], r["copies"], r["links"]) == (group[i], sum(rep[j] == rep[i] for j in rep) - 1, len(linked)), i


def _edited(rng, words: list, edits: int) -> str:
    own = list(words)
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"e{rng.randrange(10_000)}"
    return " ".join(own)


def _copies(seed: int, texts: int, each: int) -> dict:
    """Near copies of some texts, each with up to ten words of a hundred changed."""
    rng = random.Random(seed)
    out = [_edited(rng, [f"w{k}x{i}" for i in range(100)], rng.randint(0, 10)) for k in range(texts) for _ in range(each)]
    rng.shuffle(out)
    return dict(enumerate(out))


def _linked(texts: dict, t: float = 0.5) -> tuple[dict, dict]:
    """For each text, the different sets similar to its own, and the greatest similarity to another text."""
    sets = {i: frozenset(_grams(x)) for i, x in texts.items()}
    links, closest = {}, {}
    for i, a in sets.items():
        near = {b: len(a & b) / len(a | b) for b in set(sets.values()) - {a}}
        links[i] = sum(x >= t for x in near.values())
        closest[i] = 1.0 if sum(b == a for b in sets.values()) > 1 else max((x for x in near.values() if x >= t), default=0.0)
    return links, closest


@pytest.mark.parametrize("blocks", [{}, {"members": 7, "list_block": 4, "part": 60, "fan": 3, "bucket": 150, "flush": 200}, {"member_tokens": 700}])
def test_families_lose_no_link(spark, monkeypatch, blocks):
    texts = {**_copies(1, 3, 20), **{100 + i: t for i, t in _copies(2, 4, 3).items()}, 200: "w0x1 w0x2 w0x3 w0x4", 201: "alone"}
    want = _pairs(texts, 0.5)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    plan, joined, found = ngram_join.Plan(frequent=4, hot=2, family=5, **blocks), ngram_join._group_pairs, []
    monkeypatch.setattr(ngram_join, "_group_pairs", lambda *x: found.append(joined(*x)) or found[-1])
    got = [(r["doc_a"], r["doc_b"]) for r in ngram_join.similar_pairs(d, frequent=4, plan=plan).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert found[0].families.count() >= 40 and found[0].families.select("family").distinct().count() >= 3
    assert found[0].pairs.count() < len(want) / 2
    links, closest = _linked(texts)
    assert {r["doc_id"]: (r["links"], round(r["closest"], 9)) for r in ngram_join.near_groups(d, frequent=4, plan=plan).collect()} == {i: (links[i], round(closest[i], 9)) for i in texts}


def test_a_family_is_not_compared_pair_by_pair(spark, monkeypatch):
    """op4_ngram_join and the pipeline's stage 3 compared each near copy with each, so their time grew as the square."""
    texts = _copies(3, 1, 120)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    candidates, plain = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda c, s, t: candidates.append(c.count()) or plain(c, s, t))
    rows = {r["doc_id"]: r for r in ngram_join.near_groups(d).collect()}
    links, closest = _linked(texts)
    assert {r["class_id"] for r in rows.values()} == {0} and sum(links.values()) > 20 * len(texts)
    assert {i: (r["links"], round(r["closest"], 9)) for i, r in rows.items()} == {i: (links[i], round(closest[i], 9)) for i in texts}
    assert sum(candidates) < 10 * len(texts)


@pytest.mark.parametrize("frequent", [0, 2, 64])
def test_a_similar_pair_has_a_key_that_leaves_enough(frequent):
    """Sets of a small vocabulary, so that all tokens are in common with others and most keys are met by chance."""
    rng = np.random.default_rng(frequent)
    vocabulary = rng.integers(1, 1 << 48, 400, dtype=np.uint64)
    weight = dict(zip(vocabulary.tolist(), rng.integers(2, 100, 400).tolist()))
    sets = [np.unique(rng.choice(vocabulary, n)) for n in rng.integers(1, 200, 40)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) < 0.8], rng.choice(vocabulary, len(s) // 8)])) for s in sets for _ in range(3)]
    keys = []
    for s in (s for s in sets if len(s)):
        w = np.array([weight[x] for x in s.tolist()])
        with np.errstate(over="ignore"):
            keys.append((set(s.tolist()), dict(zip(*(x.tolist() for x in ngram_join._ranked(s, w, len(s), frequent, 0.5))))))
    met = kept = similar = 0
    for i, (a, ka) in enumerate(keys):
        for b, kb in keys[:i]:
            enough = any(3 * min(len(a) - ka[k], len(b) - kb[k]) >= len(a) + len(b) for k in ka.keys() & kb.keys())
            near = 2 * len(a & b) >= len(a | b)
            assert enough or not near
            met, kept, similar = met + bool(ka.keys() & kb.keys()), kept + enough, similar + near
    assert similar > 100 and kept < met


def test_unrelated_texts_of_common_phrases_are_no_candidates(spark, monkeypatch):
    """pipeline's stage 3 compared nearly all texts that have one phrase of a prefix in common, so its time outgrew the table."""
    rng = random.Random(5)
    phrases = [" ".join(f"p{k}w{i}" for i in range(6)) for k in range(150)]
    texts = {i: " ".join(rng.sample(phrases, 30)) + " " + " ".join(f"own{i}x{k}" for k in range(15)) for i in range(120)}
    texts |= {200 + i: texts[i] + " more" for i in range(10)}
    want = _pairs(texts, 0.5)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    candidates, plain = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda c, s, t: candidates.append(c.count()) or plain(c, s, t))
    assert {(r["doc_a"], r["doc_b"]) for r in ngram_join.similar_pairs(d).collect()} == want and len(want) >= 10
    assert sum(candidates) <= 10 * len(want)


def test_the_text_that_was_copied_is_the_hub(spark):
    """The least identifier was the hub however much of its text was changed; copies that weren't similar to it met all others in the index."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(100)]
    texts = {i: _edited(rng, words, 10) for i in range(149)} | {149: " ".join(words)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = ngram_join._group_pairs(d, "doc_id", "text", 3, 0.5, ngram_join.Plan())
    assert {r["family"] for r in found.families.collect()} == {149} and found.families.count() > 140
    assert {r["doc_id"] for r in ngram_join.drop_near_copies(d).collect()} == {0}


def test_pairs_between_families_are_met_once():
    rng = np.random.default_rng(1)
    key, family = rng.integers(0, 6, 60), rng.integers(0, 5, 60)
    order = np.lexsort((family, key))
    key, family = key[order], family[order]
    met = [(a, b) for i, j in postings.cross_pairs(*postings.cross_left(key, family)) for a, b in zip(i.tolist(), j.tolist())]
    assert sorted(met) == [(a, b) for a in range(60) for b in range(a + 1, 60) if key[a] == key[b] and family[a] != family[b]]


def test_identifiers_may_be_strings(spark, docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("d-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")))
    back = lambda x: int(x[2:]) if x else x
    same = lambda f: sorted((back(a), back(b), *c) for a, b, *c in f(named).collect()) == sorted(map(tuple, f(docs).collect()))
    assert same(ngram_join.similar_pairs) and same(ngram_join.near_groups)
    assert sorted(back(r[0]) for r in ngram_join.drop_near_copies(named).select("doc_id").collect()) == sorted(r[0] for r in ngram_join.drop_near_copies(docs).select("doc_id").collect())


def test_join_on_messy_rows(messy):
    assert [(a, b) for a, b, _ in rows_of(ngram_join.similar_pairs(messy))] == [(1, 2), (6, 7)]
    kept = ngram_join.drop_near_copies(messy)
    assert kept.columns == messy.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert ids == [(False, i) for i in (1, 3, 4, 5, 6, 8, 9, 10)] + [(True, 0)] * 2


def test_join_keeps_the_smallest_of_a_chain(spark):
    words = [f"a{i}" for i in range(60)]
    chain = [(i, " ".join(words[k : k + 40])) for i, k in ((9, 0), (4, 6), (7, 12))]
    d = spark.createDataFrame([*chain, (1, FOX)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.drop_near_copies(d).collect()) == [1, 4]


def test_blobs_round_trip():
    rng = np.random.default_rng(0)
    for kind in (np.int64, np.uint32, np.uint64):
        for n in (0, 1, 1000):
            x = rng.integers(0, 2**31, n).astype(kind)
            for delta in (False, True):
                y = expand(squeeze(x, delta))
                assert y.dtype == x.dtype and (x == y).all()
