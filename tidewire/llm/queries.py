"""Registered queries of the corpus operators and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tidewire.llm import (exact_dedup, html_text, jaccard_join, mixing, packing, periodic_runs, pii, prefix_trie,
                          pseudo_likelihood, quality, sharding, substring_dedup, training_order)
from tidewire.llm.common import documents
from tidewire.plans.registry import Query

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return register


@query("op1_min_cost_reshard")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_documents(documents(spark, sf_dir))


@query("op2_large_item_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@query("op3_training_order")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise_order(documents(spark, sf_dir))[0]


@query("op4_sainte_lague_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "times", "shard")


@query("op5_masked_pseudo_likelihood")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_corpus(documents(spark, sf_dir))


@query("op6_risk_controlled_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_verdicts(documents(spark, sf_dir), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_content_sort", r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


@query("op8_semi_markov_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find_spans(docs, pii.fit(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query("op9_signature_tree_join", r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
            THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
    FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op10_recompression", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
    h AS (SELECT x.doc_id, i, md5(array_to_string(d.w[i:i + 49], ' ')) AS h FROM x JOIN d USING (doc_id)),
    f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN f USING (h) WHERE doc_id > first),
    k AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
        sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(
            list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


#: Unsigned crc32 of a string of ASCII letters, in SQL.
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(string_split({0}, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: list_reduce(
    list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))))"""


@query("op11_periodic_runs", rf"""
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS o,
            ({_CRC.format("doc_id::VARCHAR")})::BIGINT AS h FROM documents),
    a AS (SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS planted, h // 10 AS g,
            CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM t),
    d AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i
            ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE o END AS w FROM a),
    -- A run of three periods q holds two equal neighbouring blocks of q words, one of which starts at a multiple of q.
    b AS (SELECT doc_id, w, n, q, unnest(range(0, n - 2 * q + 1, q)) AS i
          FROM (SELECT doc_id, w, n, unnest(range(1, n // 3 + 1)) AS q FROM d WHERE n >= 24)),
    p AS (SELECT DISTINCT doc_id, q FROM b WHERE w[i + 1] = w[i + q + 1] AND w[i + 1:i + q] = w[i + q + 1:i + 2 * q]),
    e AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island
          FROM (SELECT doc_id, q, w, unnest(range(0, n - q)) AS i FROM p JOIN d USING (doc_id)) WHERE w[i + 1] = w[i + q + 1]),
    s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM e GROUP BY doc_id, q, island
          HAVING count(*) + q >= greatest(24, 3 * q)),
    r AS (SELECT * FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.doc_id = x.doc_id AND y.q < x.q
          AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
    m AS (SELECT doc_id, count(*) AS n_runs, arg_max({{'s': s, 'l': l, 'q': q}}, (l::DOUBLE / q, -s, -q)) AS best,
            string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY doc_id),
    x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
    g AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period,
        (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
        sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(n),
            lambda j: NOT list_contains(gone, j)), lambda j: w[j + 1]) END, ' ')) AS collapsed_sha256
    FROM d LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(periodic_runs.plant_periods(documents(spark, sf_dir)))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = found.select("doc_id", "runs", "collapsed", periodic_runs.strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(line, lambda r: F.concat(r, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_text_tag_ratio", r"""
    -- The pages of the given tables: one article element, its blocks are headings and paragraphs.
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS t FROM pages),
    l AS (SELECT page_id, url, string_split(regexp_replace(replace(t, '<br>', ' '), '</?(h1|p)>', chr(10), 'g'), chr(10)) AS l
          FROM a),
    c AS (SELECT page_id, url, list_transform(l, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(
            regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS l FROM l),
    j AS (SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) AS text FROM c)
    SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM j""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn(
        "n_chars", F.length("text").cast("long"))


@query("op13_prefix_trie", rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS w
          FROM t GROUP BY conv_id),
    h AS (SELECT conv_id, w, ({_CRC.format("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM o),
    f AS (SELECT h.conv_id, list_concat(coalesce(l.w[1:h.h], []), h.w[h.h + 1:]) AS w
          FROM h LEFT JOIN o l ON l.conv_id = h.conv_id - h.conv_id % 100),
    p AS (SELECT conv_id, depth, w[depth].t AS last, len(w) AS n, md5(array_to_string(list_transform(w[1:depth],
            lambda x: length(x.r) || ':' || length(x.t) || ':' || x.r || x.t), ',')) AS k,
            md5(array_to_string(list_transform(w[1:depth - 1],
            lambda x: length(x.r) || ':' || length(x.t) || ':' || x.r || x.t), ',')) AS up
          FROM (SELECT conv_id, w, unnest(range(len(w) + 1)) AS depth FROM f)),
    n AS (SELECT k, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
            (count(*) - 1) * coalesce(any_value(length(last)), 0) AS saved,
            sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
          FROM p GROUP BY k, depth),
    c AS (SELECT a.*, b.conv_id AS parent_conv_id FROM n a LEFT JOIN n b ON b.k = a.up AND b.depth = a.depth - 1),
    m AS (SELECT a.k, a.depth, count(b.k) AS n_children FROM n a LEFT JOIN n b ON b.up = a.k AND b.depth = a.depth + 1
          GROUP BY a.k, a.depth),
    s AS (SELECT p.k, p.depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
          FROM n JOIN m USING (k, depth) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.k, p.depth)
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
        saved_tokens::BIGINT AS saved_tokens, ends_sha256
    FROM c JOIN m USING (k, depth) JOIN s USING (k, depth)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(prefix_trie.share_first_turns(turns))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
