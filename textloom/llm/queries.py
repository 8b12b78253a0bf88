"""One thin query for each operator over its whole table, and SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import binary_ids, filter_audit, line_dedup, merkle, mixing, packing, periodic_runs, quality, simhash, substring_dedup, token_counts, url_filters, warc
from textloom.llm.runtime import default_tokenizer, scratch, table

#: Shares of tokens that a mix aims at.
MIX_WEIGHTS = {"clean": 0.97, "junk": 0.02, "toxic": 0.01}


def label_domain():
    """The domain of a row of `labels`."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "junk")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), default_tokenizer(), max_tokens=1024)


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pages bear no dates: made of the ids, so that captures of one URL key are not in the order of their ids.
    date = F.date_format(F.timestamp_seconds(1_500_000_000 + F.pmod(F.xxhash64("page_id"), F.lit(100_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return warc.capture_index(table(spark, sf_dir, "pages"), date=date).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(table(spark, sf_dir, "documents"), stats=True).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), size=2048, end_id=0)


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    binary_ids.write_shards(table(spark, sf_dir, "documents"), path, default_tokenizer(), end_id=2)
    return binary_ids.read_shards(spark, path, with_ids=False)


def op8_target_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_domain(), MIX_WEIGHTS, default_tokenizer())


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), labels)


#: Rules of the query on pages: host, path, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


def planted_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth (by a hash of the id) repeats words from a place on; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words")
    period = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    repeated = F.transform(F.sequence("a", n - 1), lambda i: F.element_at("words", (1 + F.col("a") + (i - F.col("a")) % period).cast("int")))
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    return rows.select("doc_id", F.when(n > 0, F.concat_ws(" ", F.slice("words", 1, F.col("a")), repeated)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start, -r.period)))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), (F.concat(r.period.cast("string"), F.lit("\n"))))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("b.col2"), F.col("b.length"), -F.col("b.col3")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict:
    ops = (op1_token_counts, op2_warc_index_merge, op3_quality_rules, op4_line_dedup, op5_substring_dedup, op6_best_fit_packing, op7_token_id_output, op8_target_mixing, op9_merkle_fingerprints, op10_simhash_near_dedup,
           op11_filter_audit, op12_url_filters, op13_periodic_runs)
    return {f.__name__: f for f in ops}


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, upper(sha1(payload)) AS hex FROM p
), g AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i::INT, 5))::INT >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
         max(page_id) OVER (PARTITION BY hex) AS last_id
  FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM g
"""

OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.pos, k.line, s.first_id IS NOT NULL AND k.doc_id <> s.first_id AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT doc_id, text, w, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
    SELECT doc_id, unnest(range(1, n_words - 1)) AS i, w[unnest(range(1, n_words - 1))] AS a, w[unnest(range(2, n_words))] AS b, w[unnest(range(3, n_words + 1))] AS c FROM b WHERE n_words >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
), s AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered,
         len(list_filter(w, lambda x: octet_length(encode(x)) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_capitals
  FROM b LEFT JOIN r ON b.doc_id = r.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_words > 100000 OR NOT word_chars BETWEEN 3 * n_words AND 10 * n_words OR 10 * n_symbols > n_words
            OR (n_lines >= 6 AND 10 * n_dup_lines > 4 * n_lines) OR 100 * n_lettered < 80 * n_words OR 100 * n_capitals > 30 * n_words) AS kept
FROM f
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20
), k AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) > 1 AS again FROM v
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM k WHERE again
), p AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), m AS (
  SELECT p.doc_id, count(*) AS n_words, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE c.p IS NULL) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN m ON d.doc_id = m.doc_id
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), e AS (
  SELECT text, min(doc_id) AS first_id FROM d GROUP BY text
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text))::INT
         + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first_id, false)::INT AS mask
  FROM d JOIN e ON d.text = e.text LEFT JOIN l ON d.doc_id = l.doc_id
), g AS (
  SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL
), b AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM b v, b w, b x, b y, b z WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND v.bit | w.bit | x.bit | y.bit | z.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS step)
), r AS (
  SELECT part, filter_order, step, any_value(s.bit) AS bit,
         sum(n) FILTER (WHERE mask & (earlier | s.bit) = 0) AS kept, sum(n) FILTER (WHERE mask & s.bit > 0 AND mask & earlier = 0) AS removed,
         sum(n) FILTER (WHERE mask & s.bit > 0 AND mask & earlier > 0) AS redundant, sum(n) FILTER (WHERE mask = s.bit) AS unique_fails,
         sum(n) FILTER (WHERE mask & s.bit > 0 AND mask & earlier = 0 AND good) AS good_lost, sum(n) FILTER (WHERE mask & s.bit > 0 AND mask & earlier = 0 AND toxic) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""

OP12_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), l AS (
  SELECT unnest(['com', 'example.com', 'www.example.com', 'net', 'net']) AS h, unnest(['/', '/en/', '/en/', '/es/', '/fr/']) AS p, unnest(['allow', 'block', 'allow', 'block', 'block']) AS v
), f AS (
  SELECT host AS fit_host, path AS fit_path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN l ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f ON host = fit_host AND path = fit_path
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_index_merge": OP2_SQL, "op3_quality_rules": OP3_SQL, "op4_line_dedup": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op11_filter_audit": OP11_SQL, "op12_url_filters": OP12_SQL}
