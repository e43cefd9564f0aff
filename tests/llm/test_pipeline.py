"""The pipeline and the registered queries."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SMALL, table
from vigilspark.llm import fingerprints, language_id, lsm_dedup, mixing, ngram_join, packing, pseudonyms, shards
from vigilspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, duck, name):
    assert table(QUERIES[name](spark, SMALL).toPandas()) == table(duck.execute(ORACLES[name]).df())


def test_ten_queries_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def _grams(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = language_id.fit(docs)
    rows = docs.select("doc_id", "text").collect()
    lang, confidence, _ = language_id.identify(net, pa.array([r["text"] for r in rows], pa.string()))
    known = {r["doc_id"]: r["text"] for r, k, c in zip(rows, lang, confidence) if k and c >= language_id.MIN_CONFIDENCE and not (k == language_id.NOISE and c >= language_id.NOISE_CONFIDENCE)}
    once, seen = {}, set()
    for i in sorted(known):
        if known[i] not in seen:
            seen.add(known[i])
            once[i] = known[i]
    grams, group = {i: _grams(t) for i, t in once.items()}, {i: i for i in once}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in once:
        for b in once:
            if a < b and grams[a] and grams[b]:
                both = len(grams[a] & grams[b])
                if both >= 0.5 * (len(grams[a]) + len(grams[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    group[y] = x
    far = {i for i in once if root(i) == i or not grams[i]}
    want = [set(known), set(once), far]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        last, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < 3:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want[k], name
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    mixed = last.select("doc_id", "text").collect()
    assert {r["doc_id"] for r in mixed} == {r["id"] for r in mixing.schedule(spark.read.parquet(str(tmp_path / "ngram_jaccard_join"))).collect()}
    packed = docs.groupBy().sum("tokens").first()[0]
    assert packed == sum(len(r["text"].split()) for r in mixed)


def test_each_stage_runs_once(spark, monkeypatch):
    """A counter in front of the network, and one in the check of candidate pairs."""
    seen = spark.sparkContext.accumulator(0)
    pairs = spark.sparkContext.accumulator(0)
    real = ngram_join._verify

    def counted(t):
        verify = real(t)

        def run(rows):
            pairs.add(int(rows["a"].notna().sum()))
            return verify(rows)

        return run

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    (name, first), *rest = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda s, d, x: first(s, d, x).mapInPandas(count, d.schema)), *rest])
    candidates = []
    plain = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda c, s, t: candidates.append(c.count()) or plain(c, s, t))
    monkeypatch.setattr(ngram_join, "_verify", counted)
    corpus_pipeline.run(spark, SMALL).collect()
    kept = language_id.keep_identified(spark.read.parquet(f"{SMALL}/documents.parquet")).count()
    assert seen.value == kept and pairs.value == sum(candidates) > 0


def test_stages_take_messy_and_empty_tables(spark, messy, none):
    for d in (messy, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SMALL)
            rows = out.collect()
            ids = Counter(r["doc_id"] for r in rows)
            assert name == "packing" or out.columns == d.columns
            if d is none:
                assert not rows
            elif name == "language_id":
                assert not {3, 4, 5} & set(ids) and {6, 7} <= set(ids) and ids[2] in (0, 2)
            elif name == "exact_dedup":
                assert ids == Counter([1, 3, 4, 6, 7, 8, 9, 10, None, None])
            elif name == "ngram_jaccard_join":
                assert ids == Counter([1, 3, 4, 5, 6, 8, 9, 10, None, None])
            elif name == "mixing":
                assert {1, 2, 4, 5, 6, 7, 8, 9, 10, None} <= set(ids)
            else:
                assert set(ids) == {1, 2, 6, 7, 8, 10, None}


def test_every_operator_takes_names_for_identifiers(messy):
    """The messy table once more, with texts for identifiers: the same results under other names."""
    named = messy.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")))
    back = lambda x: int(x[1:]) if isinstance(x, str) and re.fullmatch(r"d\d{3}", x) else x
    runs = {
        "fingerprints": lambda d: fingerprints.similar_fingerprints(d), "shards": lambda d: shards.kd_shards(d, numbers=("n_chars",), target_bytes=100), "join": lambda d: ngram_join.near_groups(d), "pairs": lambda d: ngram_join.similar_pairs(d),
        "languages": lambda d: language_id.identify_languages(d).select("doc_id", "windows"), "mixing": lambda d: mixing.mixed_order(d).select("doc_id", "source", "tokens").distinct(),
        "pseudonyms": lambda d: pseudonyms.pseudonymize(d, "k"), "dedup": lambda d: lsm_dedup.exact_groups(d), "packing": lambda d: packing.pack_documents(d).groupBy("doc_id").sum("tokens"),
        "dropped": lambda d: ngram_join.drop_near_copies(lsm_dedup.drop_copies(d)).select("doc_id"),
    }
    for name, run in runs.items():
        got = sorted((tuple(map(back, r)) for r in run(named).collect()), key=repr)
        assert got == sorted(map(tuple, run(messy).collect()), key=repr), name
