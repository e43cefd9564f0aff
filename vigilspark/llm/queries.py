"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fingerprints, language_id, lsm_dedup, mixing, ngram_join, packing, pseudonyms, shards, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Small, so that the tree has many levels on tables of any size.
SHARD_BYTES = 64 << 10


#: Of the registered query alone; whoever has real data sets ``vigilspark.pseudonym.key``.
SAMPLE_KEY = "no secret: for the given tables only"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.similar_fingerprints(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.kd_shards(_table(spark, sf_dir, "documents"), target_bytes=SHARD_BYTES)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(_table(spark, sf_dir, "documents"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(_table(spark, sf_dir, "documents"), spark.conf.get("vigilspark.pseudonym.key", SAMPLE_KEY))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup.exact_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_fingerprints": op2_fingerprints,
    "op3_sharding": op3_sharding,
    "op4_ngram_join": op4_ngram_join,
    "op5_packing": op5_packing,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_exact_dedup": op10_exact_dedup,
}

_BLOCK = mixing.BLOCK_TOKENS


def _met(rules: tuple[tuple[str, str], ...]) -> str:
    said = {"url": "node = '{0}'", "host": "(host = '{0}' OR host LIKE '%.{0}')", "word": "contains(host, '{0}')"}
    return " OR ".join(said[kind].format(value) for kind, value in rules)


_BLOCKED, _ALLOWED = _met(url_filter.BLOCK), _met(url_filter.ALLOW)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form(url: str) -> str:
    """The normal form of a URL in SQL."""
    u = f"regexp_replace(trim({url}), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    u = f"regexp_replace({u}, '#.*$', '')"
    u = f"regexp_replace({u}, '^[^/?@]*@', '')"
    u = f"regexp_replace({u}, '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\\1', 'g')"
    u = f"regexp_replace({u}, '([?&])&+', '\\1', 'g')"
    u = f"regexp_replace({u}, '[?&]+$', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^([^/?]*)', 1)), '^(www|m)\\.', ''), ':(80|443)$', '')"
    rest = f"regexp_replace(regexp_extract({u}, '^[^/?]*(.*)$', 1), '(/index)?\\.html?(\\?|$)', '\\2', 'g')"
    return f"({host} || regexp_replace({rest}, '/+(\\?|$)', '\\1', 'g'))"


ORACLES: dict[str, str] = {
    "op1_url_filter": rf"""
        WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '{url_filter._TAG}')) AS tag FROM pages WHERE url IS NOT NULL),
        links AS (SELECT url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
                regexp_replace(CASE WHEN regexp_matches(tag, {_quoted(url_filter._CANONICAL)}) THEN regexp_extract(tag, {_quoted(url_filter._HREF)}, 1)
                    WHEN regexp_matches(tag, {_quoted(url_filter._REFRESH)}) THEN regexp_extract(tag, {_quoted(url_filter._TO)}, 1) END, '{url_filter._AND}', '&', 'g') AS target FROM tags),
        based AS (
            SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
                WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(target, '#') OR root = '' THEN NULL
                WHEN starts_with(target, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || target
                WHEN starts_with(target, '/') THEN root || target WHEN starts_with(target, '?') THEN root || path || target
                ELSE root || '/' || regexp_extract(path, '^/?(.*/)?[^/]*$', 1) || target END AS target
            FROM links WHERE target <> ''),
        split AS (SELECT url, target, regexp_extract(target, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root, regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
                regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*(.*)$', 1) AS tail FROM based WHERE target IS NOT NULL),
        whole AS (SELECT url, CASE WHEN contains(path, '/.') THEN root || list_reduce(string_split(path, '/'), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END) || tail ELSE target END AS target FROM split),
        one AS (SELECT {_form("url")} AS a, {_form("target")} AS b FROM whole WHERE target IS NOT NULL AND url IS NOT NULL),
        edges AS (SELECT a, b FROM one WHERE a <> b UNION SELECT b, a FROM one WHERE a <> b),
        nodes AS (SELECT DISTINCT {_form("url")} AS node FROM pages WHERE url IS NOT NULL AND url <> '' UNION SELECT a FROM edges),
        reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
        classes AS (SELECT node, min(other) AS resource FROM reach GROUP BY node),
        known AS (SELECT node, resource, regexp_extract(node, '^([^/?:]*)', 1) AS host FROM classes),
        judged AS (SELECT node, resource, ({_ALLOWED}) AS allowed, ({_BLOCKED}) AND NOT ({_ALLOWED}) AS bad FROM known),
        bad AS (SELECT DISTINCT resource FROM judged WHERE bad)
        SELECT page_id, url, j.resource,
            CASE WHEN j.allowed THEN 'allow' WHEN b.resource IS NOT NULL THEN 'block' ELSE 'pass' END AS decision
        FROM pages p LEFT JOIN judged j ON j.node = {_form("p.url")} LEFT JOIN bad b ON b.resource = j.resource
    """,
    "op3_sharding": f"""
        WITH RECURSIVE base AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(n_chars, -1) AS d0, coalesce(doc_id, -1) AS d1,
                coalesce(CAST('0x' || substr(md5(source), 1, 8) AS BIGINT), -1) AS d2, coalesce(CAST('0x' || substr(md5(lang), 1, 8) AS BIGINT), -1) AS d3,
                CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS w FROM documents),
        span AS (SELECT max(d0) - min(d0) AS s0, max(d1) - min(d1) AS s1, max(d2) - min(d2) AS s2, max(d3) - min(d3) AS s3 FROM base),
        t AS (
            SELECT r, doc_id, d0, d1, d2, d3, w, CAST(1 AS BIGINT) AS cell FROM base
            UNION ALL
            SELECT r, doc_id, d0, d1, d2, d3, w, CASE WHEN v <= edge THEN 2 * cell ELSE 2 * cell + 1 END FROM (
                SELECT *, CASE WHEN middle = top THEN max(CASE WHEN v < top THEN v END) OVER (PARTITION BY cell) ELSE middle END AS edge FROM (
                    SELECT *, min(CASE WHEN 2 * upto >= total THEN v END) OVER (PARTITION BY cell) AS middle, max(v) OVER (PARTITION BY cell) AS top FROM (
                        SELECT *, sum(w) OVER (PARTITION BY cell ORDER BY v) AS upto FROM (
                            SELECT *, CASE greatest(r0, r1, r2, r3) WHEN r0 THEN d0 WHEN r1 THEN d1 WHEN r2 THEN d2 ELSE d3 END AS v FROM (
                                SELECT t.*, sum(w) OVER c AS total,
                                    coalesce((max(d0) OVER c - min(d0) OVER c) / nullif(CAST(s0 AS DOUBLE), 0), 0) AS r0, coalesce((max(d1) OVER c - min(d1) OVER c) / nullif(CAST(s1 AS DOUBLE), 0), 0) AS r1,
                                    coalesce((max(d2) OVER c - min(d2) OVER c) / nullif(CAST(s2 AS DOUBLE), 0), 0) AS r2, coalesce((max(d3) OVER c - min(d3) OVER c) / nullif(CAST(s3 AS DOUBLE), 0), 0) AS r3
                                FROM t, span WINDOW c AS (PARTITION BY cell))
                            WHERE total > {SHARD_BYTES} AND greatest(r0, r1, r2, r3) > 0))))
        )
        SELECT doc_id, w AS bytes, max(cell) AS shard FROM t GROUP BY r, doc_id, w
    """,
    "op4_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS gram
              FROM w WHERE len(words) > 0),
        n AS (SELECT doc_id, size, min(doc_id) OVER (PARTITION BY whole) AS rep, count(*) OVER (PARTITION BY whole) - 1 AS copies
              FROM (SELECT doc_id, count(*) AS size, string_agg(gram, '|' ORDER BY gram) AS whole FROM g GROUP BY 1)),
        r AS (SELECT g.doc_id, gram, size FROM g JOIN n USING (doc_id) WHERE n.doc_id = rep),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.size) + any_value(b.size) - count(*)) AS jaccard
              FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        p AS (SELECT a, b, jaccard FROM c WHERE jaccard >= {ngram_join.THRESHOLD}),
        l AS (SELECT a, count(*) AS links, max(jaccard) AS closest FROM p GROUP BY a),
        reach(node, other) AS (SELECT a, a FROM l UNION SELECT reach.node, p.b FROM reach JOIN p ON reach.other = p.a),
        k AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(k.class_id, n.rep, d.doc_id) AS class_id, coalesce(n.copies, 0) AS copies, coalesce(l.links, 0) AS links,
            CASE WHEN n.copies > 0 THEN 1.0 ELSE coalesce(l.closest, 0.0) END AS closest
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d
        LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN l ON l.a = n.rep LEFT JOIN k ON k.node = n.rep
    """,
    "op6_chat_format": """
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, CASE WHEN bool_or(turn IS NULL) THEN 'turn missing' WHEN bool_or(role IS NULL) THEN 'role missing' WHEN bool_or(text IS NULL) THEN 'text missing'
                WHEN count(DISTINCT turn) < count(*) THEN 'turn repeated' WHEN bool_or(role NOT IN ('system', 'user', 'assistant')) THEN 'role unknown'
                WHEN NOT regexp_matches(string_agg(role, ',' ORDER BY turn), '^(system,)?user,assistant(,user,assistant)*$') THEN 'order' END AS error
            FROM t GROUP BY conv_id),
        g AS (SELECT t.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t JOIN c USING (conv_id) WHERE error IS NULL)
        SELECT conv_id, CAST(3 * k AS INTEGER) AS segment, role, '<|' || role || '|>' || chr(10) AS text, CAST(0 AS INTEGER) AS loss, CAST(NULL AS VARCHAR) AS error FROM g
        UNION ALL SELECT conv_id, CAST(3 * k + 1 AS INTEGER), role, text, CASE role WHEN 'assistant' THEN 1 ELSE 0 END, NULL FROM g
        UNION ALL SELECT conv_id, CAST(3 * k + 2 AS INTEGER), role, '<|end|>' || chr(10), CASE role WHEN 'assistant' THEN 1 ELSE 0 END, NULL FROM g
        UNION ALL SELECT conv_id, CAST(3 * n AS INTEGER), NULL, '<|done|>', 1, NULL FROM g WHERE k = 0
        UNION ALL SELECT conv_id, -1, NULL, NULL, NULL, error FROM c WHERE error IS NOT NULL
    """,
    "op8_mixing": rf"""
        WITH t AS (SELECT DISTINCT doc_id, hash(text) AS h, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0) AS tokens,
                md5('{mixing.SEED}-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents),
        s AS (SELECT source, sum(tokens) AS total FROM t GROUP BY 1 HAVING sum(tokens) > 0),
        z AS (SELECT source, CAST((total + {_BLOCK - 1}) // {_BLOCK} AS BIGINT) AS blocks FROM s),
        w AS (SELECT source, blocks, greatest(1, CAST(floor(pow(blocks, {mixing.POWER}) / sum(pow(blocks, {mixing.POWER})) OVER () * {mixing.UNIT}) AS BIGINT)) AS weight FROM z),
        c AS (SELECT *, sum(weight) OVER (ORDER BY source) AS high, sum(weight) OVER () AS every FROM w),
        i AS (SELECT unnest(range(CAST((SELECT max(((blocks + 16) * every + weight - 1) // weight) FROM c) AS BIGINT))) AS slot),
        p AS (SELECT slot, (slot + 1) * CAST({mixing.GOLDEN} AS DOUBLE) - floor((slot + 1) * CAST({mixing.GOLDEN} AS DOUBLE)) AS u FROM i),
        more AS (SELECT source, blocks, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
              FROM p JOIN c ON p.u * CAST(c.every AS DOUBLE) >= c.high - c.weight AND p.u * CAST(c.every AS DOUBLE) < c.high),
        k AS (SELECT * FROM more WHERE slot < greatest((SELECT max((blocks * every + weight - 1) // weight) FROM c), (SELECT max(slot) + 1 FROM more WHERE rank = blocks - 1))),
        b AS (SELECT doc_id, source, tokens,
                coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY shuffle, doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t)
        SELECT b.doc_id, b.source, CAST(b.tokens AS BIGINT) AS tokens, k.slot, CAST(k.rank // k.blocks AS BIGINT) AS epoch, CAST(b.start AS BIGINT) AS start
        FROM b JOIN k ON b.source = k.source AND least(b.start // {_BLOCK}, k.blocks - 1) = k.rank % k.blocks
    """,
    "op10_exact_dedup": """
        SELECT doc_id, keep_id, keep_id <> doc_id AS is_copy
        FROM (SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id
              FROM documents WHERE doc_id IS NOT NULL)
    """,
}
