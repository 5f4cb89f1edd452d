"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import (binary_codes, byte_bpe, filter_audit, hard_negatives, html_extract, license_scan, lsh_forest,
                         ngram_join, packing, quality_classifier, rule_ledger, substring_dedup, token_counts)

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}

#: The words of every document in DuckDB.
WORDS_SQL = """
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text,
                 list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM texts)"""


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_curve_packing")
def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_ngram_forest", f"""
WITH RECURSIVE {WORDS_SQL},
grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(
    CASE WHEN len(words) >= 5 THEN list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1:i + 5], ' '))
         WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM words)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
           GROUP BY ALL),
links AS (SELECT a, b, x.k <> y.k AS other, y.k FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
          WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n, count(DISTINCT CASE WHEN other THEN k END) AS t,
                  count(CASE WHEN NOT other THEN 1 END) + 1 AS copies FROM links GROUP BY a)
SELECT w.doc_id, least(w.doc_id, coalesce(l.b, w.doc_id)) AS class_id, coalesce(c.n, 0)::BIGINT AS n_links,
       coalesce(c.t, 0)::BIGINT AS n_text_links, coalesce(c.copies, 1)::BIGINT AS copies
FROM words w LEFT JOIN lowest l ON l.a = w.doc_id LEFT JOIN counts c ON c.a = w.doc_id
""")
def op2(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query("op3_rotated_codes")
def op3(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return binary_codes.search(vectors, vectors.where("vec_id % 100 = 0"))


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


@query("op5_html_extract")
def op5(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


#: All measurements of the rule ledger in DuckDB.
MEASURED_SQL = f"""{WORDS_SQL},
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)),
                                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM words),
runs AS (SELECT doc_id, s, array_to_string(words[s + 1:s + 3], ' ') AS k
         FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 2, 0))) AS s FROM words)),
again AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM runs) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT s + i) AS n FROM again, range(3) AS t(i) GROUP BY doc_id),
measured AS (
    SELECT w.doc_id, len(words)::BIGINT AS n_words,
           length(array_to_string(words, ''))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words,
           length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) AS n_upper,
           length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS n_letters
    FROM words w JOIN lines l ON w.doc_id = l.doc_id LEFT JOIN covered c ON w.doc_id = c.doc_id)"""


@query("op6_rule_ledger", f"""
WITH {MEASURED_SQL},
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_upper > word_chars) AS kept
FROM judged
""")
def op6(spark, sf_dir):
    entries = rule_ledger.store(table(spark, sf_dir, "documents"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (~rule_ledger.passes("base")).alias("base_failed"),
                          rule_ledger.passes("v1").alias("kept"))


@query("rule_ablation", f"""
WITH {MEASURED_SQL},
failed AS (SELECT unnest(['few_words', 'repeated_words', 'symbols', 'repeated_lines', 'short_words', 'long_words',
                          'upper_case', 'few_letters']) AS rule,
                  unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words,
                          10 * n_dup_lines > 3 * n_lines, word_chars < 2 * n_words, word_chars > 20 * n_words,
                          2 * n_upper > word_chars, 2 * n_letters < word_chars]) AS fails, doc_id FROM measured),
others AS (SELECT *, (sum(fails::INT) OVER (PARTITION BY doc_id) - fails::INT) AS other FROM failed)
SELECT rule, count(CASE WHEN fails THEN 1 END) AS failed, count(CASE WHEN fails AND other = 0 THEN 1 END) AS alone,
       count(CASE WHEN other = 0 THEN 1 END) AS kept FROM others GROUP BY rule
""")
def ablation_of_rules(spark, sf_dir):
    return rule_ledger.ablation(rule_ledger.store(table(spark, sf_dir, "documents")), "v3")


@query("op7_token_counts")
def op7(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_license_scan")
def op8(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op9_byte_bpe")
def op9(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op10_substring_dedup", f"""
WITH {WORDS_SQL},
windows AS (SELECT doc_id, s, md5(array_to_string(words[s + 1:s + 20], ' ')) AS k
            FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 19, 0))) AS s FROM words)),
repeated AS (SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, s + i AS p FROM repeated, range(20) AS t(i)),
each_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS p FROM words),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS kept
         FROM each_word e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
""")
def op10(spark, sf_dir):
    return (substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


@query("op11_hard_negatives", """
WITH usable AS (
    SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.uid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
           list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM usable a JOIN usable r ON a.uid <> r.uid WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS k
                   FROM scores WHERE same) WHERE k <= 5),
negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
           n.score AS negative_score,
           row_number() OVER (PARTITION BY p.uid, p.k ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scores n ON p.uid = n.uid AND NOT n.same
     AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
""")
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op12_filter_audit", f"""
WITH {WORDS_SQL},
judged AS (
    SELECT w.doc_id, coalesce(d.lang, '') AS part, w.text, [
        len(words) < 200,
        100 * len(list_distinct(words)) < 50 * len(words),
        100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text),
        regexp_matches(w.text, '[#$%&*|]'),
        coalesce(min(w.doc_id) OVER (PARTITION BY w.text) < w.doc_id, false)] AS fails
    FROM words w JOIN documents d ON w.doc_id = d.doc_id),
flags AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic
          FROM labels GROUP BY doc_id),
docs AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
         FROM judged LEFT JOIN flags USING (doc_id) GROUP BY ALL),
filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest(range(1, 6)) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o, a.f || b.f || c.f || d.f || e.f AS filter_order
           FROM filters a, filters b, filters c, filters d, filters e
           WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, filter_order, s AS step, o[s] AS k FROM orders, range(1, 6) AS t(s)),
counted AS (
    SELECT part, filter_order, step, k,
           sum(CASE WHEN NOT list_bool_or(list_transform(o[1:step], lambda j: fails[j])) THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN first THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN fails[k] AND NOT first THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails[k] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN first AND good THEN n ELSE 0 END) AS good_lost,
           sum(CASE WHEN first AND toxic THEN n ELSE 0 END) AS toxic_lost
    FROM (SELECT *, fails[k] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda j: fails[j])), false)
                 AS first FROM docs, steps)
    GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM counted
""")
def op12(spark, sf_dir):
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_lsh_forest", f"""
WITH RECURSIVE {WORDS_SQL},
lowered AS (SELECT doc_id, list_transform(words, lambda w:
    translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM words),
shingles AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(
    CASE WHEN len(words) >= 4 THEN list_transform(range(len(words) - 3), lambda i: array_to_string(words[i + 1:i + 4], ' '))
         WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM lowered)),
sets AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
           FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(l.b, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.a = d.doc_id
""")
def op13(spark, sf_dir):
    return lsh_forest.components(table(spark, sf_dir, "documents"))
