"""URL filter, k-d shards, mixing and packing."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vigilspark.llm import mixing, packing, shards, url_filter

from .conftest import rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# -- URLs

CANON = '<link rel="canonical" href="{}">'


def _decide(spark, rows, **more):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    return {r["page_id"]: r["decision"] for r in url_filter.filter_urls(d, **more).collect()}


def test_blocks_spread_over_chains_and_rings(spark):
    rows = [("http://a.com/1", CANON.format("http://b.com/2")), ("http://b.com/2", '<meta http-equiv="refresh" content="0; url=http://big-casino.com/x">'), ("http://big-casino.com/x", None), ("http://fine.com/", ""), ("http://c.com/", CANON.format("http://c.com/")), (None, None), ("", "x")]
    assert _decide(spark, rows) == {0: "block", 1: "block", 2: "block", 3: "pass", 4: "pass", 5: "pass", 6: "pass"}
    ring = [(f"http://r{i}.com/", CANON.format(f"http://r{(i + 1) % 30}.com/")) for i in range(30)] + [("http://x-casino.com/", CANON.format("http://r7.com/"))]
    assert set(_decide(spark, ring).values()) == {"block"}


def test_allow_wins_and_does_not_spread(spark):
    rows = [("http://adult-education.example.org/a", CANON.format("http://z.com/")), ("http://z.com/", ""), ("http://other-adult.com/", CANON.format("http://adult-education.example.org/b")), ("http://adult-education.example.org/b", "")]
    assert _decide(spark, rows) == {0: "allow", 1: "pass", 2: "block", 3: "allow"}


def test_forms_of_one_url_are_one_resource(spark):
    same = ["http://www.A.com/p/", "https://a.com:443/p?utm_source=x", "a.com/p#top", "http://m.a.com/p/index.html", "http://u@a.com/p.html"]
    d = spark.createDataFrame([(i, u, None) for i, u in enumerate(same)], "page_id long, url string, html string")
    assert len({r["resource"] for r in url_filter.filter_urls(d).collect()}) == 1


def test_links_resolve_in_every_form(spark):
    page = "http://h.com/a/b/page.html?q=1"
    links = {
        "../x/c.html": "http://h.com/a/x/c", "page2.html": "http://h.com/a/b/page2", "./y": "http://h.com/a/b/y", "../../../up": "http://h.com/up", "/root": "http://h.com/root", "?p=1": "http://h.com/a/b/page.html?p=1",
        "//other.com/z": "http://other.com/z", "https://o.org/k?a=1&amp;b=2": "http://o.org/k?a=1&b=2", "/s?u=1&#38;v=2": "http://h.com/s?u=1&v=2",
    }
    tags = ('<link rel="canonical" href="{}">', "<LINK HREF='{}' REL=CANONical>", '<link rel="alternate canonical" type=x href={} />', '<meta content="0; url={}" http-equiv="Refresh">', "<META HTTP-EQUIV='REFRESH' CONTENT='5;URL={}'>")
    for tag in tags:
        for k, (link, target) in enumerate(links.items()):
            d = spark.createDataFrame([(page, "<html><head>" + tag.format(link))], "url string, html string")
            want = spark.createDataFrame([(target,)], "u string").select(url_filter.normal_form(F.col("u"))).first()[0]
            if tag is tags[k % len(tags)]:
                assert [r["b"] for r in url_filter.page_edges(d).collect()] == [want], (tag, link)
    no = "".join(f'<link rel="canonical" href="{x}">' for x in ("#top", "mailto:a@b.c", "javascript:x()", "")) + '<link rel="stylesheet" href="/s.css"><link rel="canonical" data-href="/no">'
    assert url_filter.page_edges(spark.createDataFrame([(page, no), (page, None), (None, CANON.format("/x"))], "url string, html string")).count() == 0


def test_all_links_of_a_long_page_count(spark):
    pad = "<p>words and words</p>" * 20_000
    rows = [("http://far.com/d/p", pad + CANON.format("http://one.com/") + pad + '<Link Rel="CANONical" href="../x/c.html">'), ("http://far.com/x/c.html", '<meta http-equiv=refresh content="0;url=http://free-bets.org">'), ("http://one.com", "")]
    assert set(_decide(spark, rows).values()) == {"block"}


def test_rules_are_tables(spark):
    d = spark.createDataFrame([(1, "http://a.b.bad.com/x"), (2, "http://notbad.com/"), (3, "http://good.bad.com/"), (4, "http://q.com/one"), (5, "http://q.com/two"), (6, "http://xwordy.net")], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    block = spark.createDataFrame([("host", "bad.com"), ("url", "q.com/one"), ("word", "word"), ("host", None), ("host", "bad.com")], "kind string, value string")
    allow = spark.createDataFrame([("host", "good.bad.com")], "kind string, value string")
    got = {r["page_id"]: r["decision"] for r in url_filter.filter_urls(d, None, block, allow).collect()}
    assert got == {1: "block", 2: "pass", 3: "allow", 4: "block", 5: "pass", 6: "block"}
    assert set(r["decision"] for r in url_filter.filter_urls(d, None, (), ()).collect()) == {"pass"}


def test_urls_of_messy_rows(messy, none):
    d = messy.withColumnRenamed("text", "html").withColumnRenamed("source", "url").withColumnRenamed("doc_id", "page_id")
    got = url_filter.filter_urls(d)
    assert got.count() == messy.count() and {r["decision"] for r in got.collect()} == {"pass"}
    e = none.withColumnRenamed("text", "html").withColumnRenamed("source", "url").withColumnRenamed("doc_id", "page_id")
    assert url_filter.filter_urls(e).count() == 0


def test_redirect_table_repeated_rows_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "http://q.com", None, "x"), (1, "http://q.com", None, "y")], "page_id long, url string, html string, node string")
    more = spark.createDataFrame([("http://q.com/", "http://spam.com/"), (None, "http://q.com"), ("http://q.com", "http://q.com")], "source string, target string")
    assert [r["decision"] for r in url_filter.filter_urls(d, more).collect()] == ["block", "block"]
    assert url_filter.filter_urls(d.limit(0)).count() == 0


# -- shards


def _tree(rows, target):
    """Recursion over lists; rows are (id, weight, dims)."""
    spans = [max(d) - min(d) if rows else 0 for d in zip(*[r[2] for r in rows])]
    out = []

    def split(part, cell):
        share = [(max(d) - min(d)) / s if s else 0 for d, s in zip(zip(*[r[2] for r in part]), spans)]
        if sum(r[1] for r in part) <= target or max(share) <= 0:
            out.extend((r[0], r[1], cell) for r in part)
            return
        k = share.index(max(share))
        total, seen, ordered = sum(r[1] for r in part), 0, sorted(part, key=lambda r: r[2][k])
        for r in ordered:
            seen += r[1]
            if 2 * seen >= total:
                at = r[2][k]
                break
        top = ordered[-1][2][k]
        if at == top:
            at = max(r[2][k] for r in part if r[2][k] < top)
        split([r for r in part if r[2][k] <= at], 2 * cell)
        split([r for r in part if r[2][k] > at], 2 * cell + 1)

    if rows:
        split(rows, 1)
    return sorted(out)


@pytest.mark.parametrize(("bins", "local"), [(3, 0), (4096, 0), (4096, 40), (4096, 10**6)])
def test_shards_against_the_recursion(docs, bins, local):
    import hashlib

    code = lambda s: -1 if s is None else int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    rows = [(r["doc_id"], len(r["text"].encode()), (r["n_chars"], r["doc_id"], code(r["source"]), code(r["lang"]))) for r in docs.collect()]
    got = shards.kd_shards(docs, target_bytes=30_000, bins=bins, local_rows=local)
    assert sorted(map(tuple, got.collect())) == _tree(rows, 30_000)


def test_shards_on_messy_rows(messy, none):
    got = shards.kd_shards(messy, target_bytes=100).collect()
    assert len(got) == messy.count()
    assert rows_of(shards.kd_shards(messy, target_bytes=100, local_rows=1)) == sorted(map(tuple, got), key=repr)
    named = messy.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert shards.kd_shards(named, target_bytes=100).count() == messy.count()
    size, members = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["bytes"]
        members[r["shard"]].append(r["doc_id"])
    assert all(size[s] <= 100 or len(set(m)) == 1 for s, m in members.items())
    assert shards.kd_shards(none).count() == 0


# -- mixing


@pytest.mark.parametrize("target", [{"a": 0.9, "b": 0.05, "c": 0.05}, {"a": 0.6, "b": 0.3, "c": 0.1}])
def test_tokens_meet_the_targets(spark, target):
    d = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    plan = mixing.schedule(d, target, block=50).collect()
    tokens = Counter()
    for r in plan:
        tokens[r["source"]] += r["tokens"]
    total = sum(tokens.values())
    assert all(abs(tokens[k] / total - t) < 0.01 for k, t in target.items())
    slots = {}
    for r in plan:
        assert slots.setdefault(r["slot"], r["source"]) == r["source"]
    assert set(slots) == set(range(len(slots)))
    # the end of the stream has the weights too
    late = Counter(slots[s] for s in range(len(slots) // 2, len(slots)))
    assert all(abs(late[k] / late.total() - t) < 0.02 for k, t in target.items())


def test_mixing_may_end_with_the_first_source(spark):
    d = spark.createDataFrame([(i, "w " * 50, "ab"[i % 3 == 0]) for i in range(300)], "doc_id long, text string, source string")
    plan = mixing.schedule(d, {"a": 0.5, "b": 0.5}, block=50, until="first").collect()
    used = Counter(r["source"] for r in plan)
    assert {r["epoch"] for r in plan} == {0} and used["b"] == 100 and 95 <= used["a"] <= 105


def test_every_source_is_used_whole_once(docs):
    plan = mixing.schedule(docs, block=500).collect()
    first = Counter(r["id"] for r in plan if r["epoch"] == 0)
    want = {r["doc_id"] for r in docs.collect()}
    assert set(first) == want and set(first.values()) == {1}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_every_document_has_an_epoch_0_by_default(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    plan = mixing.mixed_order(docs).collect()
    first = Counter(r["doc_id"] for r in plan if r["epoch"] == 0)
    want = {r["doc_id"] for r in docs.collect()}
    assert set(first) == want and set(first.values()) == {1}
    assert {r["doc_id"] for r in mixing.mix_documents(docs).select("doc_id").collect()} == want


@pytest.mark.parametrize("small", [100, 500])
def test_schedule_ends_where_the_last_source_is_whole(spark, small):
    from fractions import Fraction

    rows = [(i, "w " * 1000, f"s{i % 9}") for i in range(900)] + [(1000, "w " * small, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = mixing.weighted(mixing.token_rows(d, "doc_id", "text", "source", 1).groupBy("source").agg({"tokens": "sum"}).toDF("source", "total"), None, 8192).collect()
    expected = max(-(-r["blocks"] * r["all"] // r["weight"]) for r in sources)
    left, slot = {r["source"]: r["blocks"] for r in sources}, 0
    while any(v > 0 for v in left.values()) or slot < expected:
        u = (slot + 1) * mixing.GOLDEN % 1.0
        at = Fraction(u) * sources[0]["all"]
        left[next(r["source"] for r in sources if r["low"] <= at < r["high"])] -= 1
        slot += 1
    plan = mixing.schedule(d).collect()
    assert max(r["slot"] for r in plan) == slot - 1
    assert {r["id"] for r in plan} == {r[0] for r in rows}


def test_prefixes_are_close_to_the_weights(spark):
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {"a": 0.5, "b": 0.3, "c": 0.2}
    plan = mixing.schedule(d, target, block=50).collect()
    by = {r["slot"]: r["source"] for r in plan}
    for n in (50, 200, len(by)):
        share = Counter(by[s] for s in range(n))
        assert all(abs(share[k] / n - t) < 0.05 for k, t in target.items())


def test_mixing_on_messy_rows(messy, none):
    got = mixing.mix_documents(messy)
    assert got.columns == messy.columns
    want = {(r["doc_id"], r["text"], r["source"]) for r in messy.collect() if r["source"] is not None or r["text"]}
    assert {(r["doc_id"], r["text"], r["source"]) for r in got.collect()} >= {w for w in want if w[1] and w[1].strip()}
    assert mixing.mixed_order(none).count() == mixing.mix_documents(none).count() == 0


def test_files_in_order_are_the_stream(spark, docs, tmp_path):
    mixing.mix_documents(docs).write.parquet(str(tmp_path / "m"))
    plan = {(r["id"], r["epoch"]): (r["slot"], r["start"]) for r in mixing.schedule(docs).collect()}
    ids = [r["doc_id"] for f in sorted((tmp_path / "m").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    order = [i for _, i in sorted((v, k[0]) for k, v in plan.items())]
    assert ids == order


# -- packing


def _words(text):
    return len([w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" ") if w])


def _check(got, rows, size):
    by, used = defaultdict(Counter), defaultdict(list)
    for r in got:
        for k in range(r["first_token"], r["first_token"] + r["tokens"]):
            by[r["doc_id"]][k] += 1
        used[r["pack_id"]].append((r["place"], r["tokens"]))
    want = defaultdict(Counter)
    for i, text in rows:
        for k in range(_words(text)):
            want[i][k] += 1
    assert by == want
    for parts in used.values():
        end = 0
        for place, n in sorted(parts):
            assert place == end
            end += n
        assert end <= size
    assert sorted(used) == list(range(len(used)))
    return len(used)


def test_packing_against_one_document_at_a_time(docs):
    size, rows = 64, [(r["doc_id"], r["text"]) for r in docs.collect()]
    packs = _check(packing.pack_documents(docs, size).collect(), rows, size)
    rooms, full = [], 0  # longest first, into the open pack of most room
    for n in sorted((_words(t) for _, t in rows), reverse=True):
        full += n // size
    for n in sorted((_words(t) % size for _, t in rows), reverse=True):
        if not n:
            continue
        best = max(range(len(rooms)), key=lambda i: rooms[i], default=None)
        if best is None or rooms[best] < n:
            rooms.append(size - n)
        else:
            rooms[best] -= n
    assert packs == full + len(rooms)


def test_packing_on_messy_rows(messy, none):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    _check(packing.pack_documents(messy).collect(), rows, packing.PACK_TOKENS)
    assert packing.pack_documents(none).count() == 0


def test_patterns_use_every_length():
    histogram = {k: k * 7 % 13 + 1 for k in range(1, 100)}
    found = packing.patterns(histogram, 128)
    used = Counter()
    for p, n in found:
        assert sum(p) <= 128
        for length in p:
            used[length] += n
    assert used == histogram
    waste = 1 - sum(k * v for k, v in histogram.items()) / (128 * sum(n for _, n in found))
    assert waste < 0.25 and math.isfinite(waste)


def test_packing_is_the_same_however_split(docs):
    assert rows_of(packing.pack_documents(docs.repartition(1))) == rows_of(packing.pack_documents(docs.repartition(7)))
