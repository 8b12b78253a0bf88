"""Aggregates, windows and ranked choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import aggregates, topk, windows
from textloom.plans.base import Plans, read

plans = Plans()

WORDS = "words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


def words_of(spark, sf):
    """(doc_id, word) for each run of a-z in lower case."""
    return read(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


@plans.add(f"WITH {WORDS}, d AS (SELECT word, count(*) AS postings FROM words GROUP BY 1) SELECT word, postings, round(ln(1 + (SELECT count(*) FROM words) / postings), 9) AS idf FROM d")
def a1_word_rarity(spark, sf):
    return aggregates.rarity(words_of(spark, sf), "word").select("word", "postings", F.round("idf", 9).alias("idf"))


@plans.add("""
WITH v AS (SELECT user_id, epoch_us(ts) // 3600000000 AS cell, event_type, max(round(value)) AS w FROM events GROUP BY ALL) SELECT user_id, cell, sum(w) AS votes FROM v GROUP BY ALL""")
def a2_bucket_votes(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("cell"), "event_type", F.round("value").alias("w"))
    return aggregates.bucket_votes(e, ["user_id"], "cell", "event_type", "w")


COUNTS = """c AS (SELECT l_suppkey, l_quantity::BIGINT AS ref_words, (l_linenumber % 3) AS substitutions, (l_partkey % 4) AS deletions, (l_orderkey % 2) AS insertions, (l_quantity::BIGINT - l_partkey % 4 + l_orderkey % 2) AS hyp_words FROM lineitem)"""


def _counts(spark, sf):
    words = F.col("l_quantity").cast("long")
    return read(spark, sf, "lineitem").select("l_suppkey", words.alias("ref_words"), (F.col("l_linenumber") % 3).alias("substitutions"), (F.col("l_partkey") % 4).alias("deletions"), (F.col("l_orderkey") % 2).alias("insertions"), (words - F.col("l_partkey") % 4 + F.col("l_orderkey") % 2).alias("hyp_words"))


RATES = """count(*) AS rows, sum(ref_words)::BIGINT AS words, round(sum(substitutions + deletions + insertions) / sum(ref_words), 9) AS wer, round(sum(deletions) / sum(ref_words), 9) AS deletion_rate,
round(avg((substitutions + deletions + insertions = 0)::INT), 9) AS exact, round(avg((deletions > 0)::INT), 9) AS with_omission"""


def _rated(df):
    return df.select(*[c for c in df.columns if c in ("l_suppkey", "stratum")], "rows", "words", *[F.round(c, 9).alias(c) for c in ("wer", "deletion_rate", "exact", "with_omission")])


@plans.add(f"WITH {COUNTS} SELECT {RATES} FROM c")
def a3_error_rates(spark, sf):
    return _rated(_counts(spark, sf).agg(*aggregates.error_rates()))


@plans.add(f"WITH {COUNTS}, g AS (SELECT l_suppkey, sum(substitutions + deletions + insertions) / sum(ref_words) AS wer FROM c GROUP BY 1) SELECT round(avg(wer), 9) AS macro, round(max(wer), 9) AS worst, round(min(wer), 9) AS best, round(max(wer) - min(wer), 9) AS gap, count(*) AS groups FROM g")
def a4_group_spread(spark, sf):
    out = aggregates.spread(_counts(spark, sf).groupBy("l_suppkey").agg(*aggregates.error_rates()), "wer")
    return out.select(*[F.round(c, 9).alias(c) for c in ("macro", "worst", "best", "gap")], "groups")


@plans.add(f"""WITH {COUNTS}, s AS (SELECT *, unnest(list_filter([CASE WHEN ref_words <= 5 THEN 'short' END, CASE WHEN ref_words BETWEEN 5 AND 15 THEN 'middle' END, CASE WHEN ref_words > 15 THEN 'long' END, CASE WHEN l_suppkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS stratum FROM c) SELECT stratum, {RATES} FROM s GROUP BY 1""")
def a5_overlapping_strata(spark, sf):
    n = F.col("ref_words")
    strata = F.array_compact(F.array(F.when(n <= 5, "short"), F.when(n.between(5, 15), "middle"), F.when(n > 15, "long"), F.when(F.col("l_suppkey") % 2 == 0, "even")))
    return _rated(_counts(spark, sf).withColumn("stratum", F.explode(strata)).groupBy("stratum").agg(*aggregates.error_rates()))


def drawn_sql(groups: str, order: str, columns: str, repetitions: int = 500, seed: int = 42) -> str:
    """Common tables of a bootstrap: groups numbered, draws by MD5, sums of each repetition in `drawn`."""
    sums = ", ".join(f"sum({c}) AS {c}" for c in columns.split(", "))
    return f"""numbered AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS k, {columns} FROM {groups}), size AS (SELECT count(*) AS n FROM {groups}),
draws AS (SELECT repetition, ('0x' || substr(md5('{seed}:' || repetition || ':' || s), 1, 8))::BIGINT % n AS k FROM (SELECT n, repetition, unnest(range(1, n + 1)) AS s FROM (SELECT n, unnest(range(1, {repetitions} + 1)) AS repetition FROM size))),
drawn AS (SELECT repetition, {sums} FROM draws JOIN numbered USING (k) GROUP BY 1)"""


@plans.add(f"""WITH {COUNTS}, g AS (SELECT l_suppkey, sum(substitutions + deletions + insertions) AS errors, sum(ref_words) AS words FROM c GROUP BY 1), {drawn_sql("g", "l_suppkey", "errors, words")}
SELECT (SELECT count(*) FROM g) AS groups, round((SELECT sum(errors) / sum(words) FROM g), 9) AS rate, round(quantile_cont(errors / words, 0.025), 9) AS low, round(quantile_cont(errors / words, 0.975), 9) AS high FROM drawn""")
def a6_cluster_bootstrap(spark, sf):
    groups = _counts(spark, sf).groupBy("l_suppkey").agg(F.sum(F.expr("substitutions + deletions + insertions")).alias("errors"), F.sum("ref_words").alias("words"))
    out = aggregates.cluster_bootstrap(groups, ["l_suppkey"], "errors", "words")
    return out.select("groups", *[F.round(c, 9).alias(c) for c in ("rate", "low", "high")])


@plans.add(f"""WITH {COUNTS}, g AS (SELECT l_suppkey, sum(substitutions + deletions + insertions) AS old, sum(substitutions + insertions) AS new, sum(ref_words) AS words FROM c GROUP BY 1), {drawn_sql("g", "l_suppkey", "old, new, words")}
SELECT (SELECT count(*) FROM g) AS groups, round((SELECT (sum(new) - sum(old)) / sum(words) FROM g), 9) AS difference, round(quantile_cont((new - old) / words, 0.025), 9) AS low, round(quantile_cont((new - old) / words, 0.975), 9) AS high FROM drawn""")
def a7_paired_bootstrap(spark, sf):
    sums = {"old": "substitutions + deletions + insertions", "new": "substitutions + insertions", "words": "ref_words"}
    groups = _counts(spark, sf).groupBy("l_suppkey").agg(*[F.sum(F.expr(x)).alias(n) for n, x in sums.items()])
    out = aggregates.paired_bootstrap(groups, ["l_suppkey"], "old", "new", "words")
    return out.select("groups", *[F.round(c, 9).alias(c) for c in ("difference", "low", "high")])


@plans.add(f"WITH {COUNTS} SELECT l_suppkey, round(sum(least(ref_words, substitutions + deletions + insertions)) / sum(ref_words), 9) AS capped FROM c GROUP BY 1")
def a8_capped_rate(spark, sf):
    return _counts(spark, sf).groupBy("l_suppkey").agg(F.round(aggregates.capped_rate(), 9).alias("capped"))


@plans.add("""
WITH x AS (SELECT l_orderkey, list(DISTINCT l_returnflag) FILTER (WHERE l_linenumber <= 2) AS a, list(DISTINCT l_returnflag) FILTER (WHERE l_linenumber > 2) AS b FROM lineitem GROUP BY 1),
l AS (SELECT a, b, unnest(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS label FROM x),
s AS (SELECT label, sum((list_contains(a, label) AND list_contains(b, label))::INT) AS tp, sum((list_contains(b, label) AND NOT coalesce(list_contains(a, label), false))::INT) AS fp, sum((list_contains(a, label) AND NOT coalesce(list_contains(b, label), false))::INT) AS fn FROM l GROUP BY 1)
SELECT label, coalesce(tp, 0)::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s""")
def a9_label_scores(spark, sf):
    half = lambda c: F.collect_set(F.when(c, F.col("l_returnflag")))
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(half(F.col("l_linenumber") <= 2).alias("a"), half(F.col("l_linenumber") > 2).alias("b"))
    return aggregates.label_scores(rows, "a", "b").select("label", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@plans.add("""
WITH r AS (SELECT p_type, p_partkey, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)
SELECT p_type, count(*) AS total, array_to_string(list(p_name ORDER BY n) FILTER (WHERE n <= 3), '|') AS examples FROM r GROUP BY 1""")
def a11_counts_with_examples(spark, sf):
    part = read(spark, sf, "part")
    some = topk.top_k(part, ["p_type"], [F.col("p_partkey")], 3, "n").groupBy("p_type").agg(F.array_sort(F.collect_list(F.struct("n", "p_name"))).alias("x"))
    return part.groupBy("p_type").agg(F.count("*").alias("total")).join(some, "p_type").select("p_type", "total", F.array_join(F.col("x.p_name"), "|").alias("examples"))


@plans.add("""
WITH m AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'assistant' AND p IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS number
  FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations))
SELECT conv_id, number::BIGINT AS number, string_agg(text, ' ' ORDER BY turn) AS text, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS members FROM m GROUP BY ALL""")
def a12_merge_and_renumber(spark, sf):
    c = read(spark, sf, "conversations").withColumns({"first_turn": F.col("turn"), "last_turn": F.col("turn")})
    return windows.merge_groups(c, ["conv_id"], "turn", F.col("role") == "assistant", "text", "first_turn", "last_turn")


@plans.add("""
SELECT r_name, n_name, count(DISTINCT c_custkey) AS expected, count(DISTINCT o_custkey) AS found, round(100.0 * count(DISTINCT o_custkey) / count(DISTINCT c_custkey), 6) AS percent
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1994-01-01') ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name)""")
def a13_coverage_rollup(spark, sf):
    n, r, c = (read(spark, sf, t) for t in ("nation", "region", "customer"))
    early = read(spark, sf, "orders").filter("o_orderdate < timestamp_ntz'1994-01-01'").select("o_custkey").distinct()
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(early, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.rollup("r_name", "n_name").agg(F.count("c_custkey").alias("expected"), F.count("o_custkey").alias("found"), F.round(100.0 * F.count("o_custkey") / F.count("c_custkey"), 6).alias("percent"))


@plans.add("""
SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) <> 1""")
def a14_repeated_keys(spark, sf):
    return read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).filter("n <> 1")


@plans.add("""
WITH f AS (SELECT l_partkey, l_suppkey, l_discount > 0.05 AS flag FROM lineitem) SELECT l_partkey, sum(flag::INT)::BIGINT AS votes, count(*) AS voters, sum(flag::INT) >= 2 AS flagged FROM f GROUP BY 1""")
def a15_votes(spark, sf):
    return aggregates.votes(read(spark, sf, "lineitem"), ["l_partkey"], F.col("l_discount") > 0.05, 2)


@plans.add("""
WITH n AS (SELECT doc_id, lower(trim(unnest(string_split(text, chr(10))))) AS line FROM documents) SELECT line, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS docs FROM n WHERE length(line) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def a16_first_seen(spark, sf):
    lines = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", F.lower(F.trim("line")).alias("line")).filter("char_length(line) >= 10")
    return lines.groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.count_distinct("doc_id").alias("docs")).filter("docs > 1")


@plans.add("""
WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings), s AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY 1),
z AS (SELECT vec_id, d, CASE WHEN s.s > 0 THEN (x - m) / s.s ELSE 0 END AS z FROM l JOIN s USING (d)), n AS (SELECT vec_id, sqrt(sum(z * z)) AS n FROM z GROUP BY 1)
SELECT vec_id, round(sum(z / n.n * (d + 1)), 6) AS checksum FROM z JOIN n USING (vec_id) GROUP BY 1""")
def a18_standardised_vectors(spark, sf):
    out = aggregates.standardised(read(spark, sf, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", F.round(F.expr("aggregate(transform(embedding, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x)"), 6).alias("checksum"))


@plans.add("SELECT l_shipdate::DATE::VARCHAR AS day, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, max(l_extendedprice) AS worst FROM lineitem GROUP BY 1")
def a21_latency(spark, sf):
    out = read(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(*aggregates.latency("l_extendedprice"))
    return out.select("day", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "worst")


@plans.add("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, count(DISTINCT event_type) AS variants FROM events GROUP BY 1")
def a22_first_wins(spark, sf):
    return aggregates.first_wins(read(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@plans.add("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def a23_best_candidate(spark, sf):
    return topk.best(read(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@plans.add("SELECT p_name, count(DISTINCT p_brand) = 1 AS one_origin FROM part GROUP BY 1")
def a26_single_origin(spark, sf):
    part = read(spark, sf, "part")
    return part.groupBy("p_name").agg((F.count_distinct("p_brand") == 1).alias("one_origin"))


@plans.add("""
WITH v AS (SELECT user_id, cell, sum(w) AS votes FROM (SELECT user_id, epoch_us(ts) // 3600000000 AS cell, round(value) AS w FROM events) GROUP BY ALL)
SELECT user_id, cell, votes, sum(votes) OVER w AS near, votes >= max(votes) OVER w AS is_peak FROM v WINDOW w AS (PARTITION BY user_id ORDER BY cell RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def w2_dense_peaks(spark, sf):
    v = read(spark, sf, "events").groupBy("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("cell")).agg(F.sum(F.round("value")).alias("votes"))
    return windows.dense_peaks(v, ["user_id"], "cell", "votes")


@plans.add("""
WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d)
SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY user_id, g HAVING count(*) >= 2""")
def w3_islands(spark, sf):
    days = read(spark, sf, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("day"))
    return windows.islands(days, ["user_id"], "day", 2)


@plans.add("""
WITH m AS (SELECT user_id, ts, event_id, (value > 50)::INT AS f FROM events), b AS (SELECT *, CASE WHEN f = 1 AND coalesce(lag(f) OVER w, 0) = 0 THEN 1 ELSE 0 END AS s FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b) SELECT user_id, run::BIGINT AS run, count(*) AS n FROM r WHERE f = 1 GROUP BY ALL""")
def w4_true_runs(spark, sf):
    return windows.true_runs(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 50)


@plans.add("""
SELECT event_id, round(CASE WHEN row_number() OVER w >= 4 THEN sqrt(avg(value * value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) END, 6) AS rms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w5_moving_rms(spark, sf):
    return windows.moving_rms(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 4).select("event_id", F.round("rms", 6).alias("rms"))


@plans.add("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS occurrence, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
def w7_w8_occurrence_and_bounds(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("occurrence"), F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@plans.add("""
WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2.0 AS b FROM lineitem)
SELECT l_suppkey, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def w9_rank_correlation(spark, sf):
    from textloom.operators.retrieval import spearman, with_ranks

    ranked = with_ranks(read(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount")
    return ranked.groupBy("l_suppkey").agg(F.round(spearman(ranked, "l_quantity", "l_discount"), 6).alias("rho"))


@plans.add("""
WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS n FROM part)
SELECT p_brand, p_partkey, CASE WHEN n < 6 THEN 'hard' WHEN n < 20 THEN 'medium' WHEN n < 60 THEN 'easy' END AS band FROM r""")
def w10_rank_bands(spark, sf):
    bands = {"hard": (0, 6), "medium": (6, 20), "easy": (20, 60)}
    return windows.band(read(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], bands).select("p_brand", "p_partkey", "band")


@plans.add("SELECT event_id, round(avg((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 9) AS share FROM events")
def w11_recent_share(spark, sf):
    return read(spark, sf, "events").select("event_id", F.round(windows.recent_share(["user_id"], ["ts", "event_id"], F.col("value") > 50, 12), 9).alias("share"))


@plans.add("""
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), t AS (SELECT max(day) AS today FROM d), g AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS g FROM d), r AS (SELECT user_id, max(day) AS last, count(*) AS n FROM g GROUP BY user_id, g)
SELECT user_id, max(CASE WHEN today - last BETWEEN 0 AND 1 THEN n ELSE 0 END) AS streak FROM r, t GROUP BY 1""")
def w12_day_streaks(spark, sf):
    days = read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    today = days.agg(F.max("day").alias("today")).first().today
    return windows.streaks(days, ["user_id"], "day", F.lit(today))


@plans.add("""
WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS n, count(*) OVER (PARTITION BY p_brand) AS m FROM part)
SELECT p_partkey, CASE WHEN n < m // 3 THEN 0 WHEN n < 2 * m // 3 THEN 1 ELSE 2 END AS third FROM r""")
def w14_thirds(spark, sf):
    return read(spark, sf, "part").select("p_partkey", windows.thirds(["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")]).alias("third"))


@plans.add()
def k1_spaced_peaks(spark, sf):
    v = w2_dense_peaks(spark, sf).filter("is_peak")
    return topk.spaced_top_k(v, ["user_id"], "cell", "near", 24, 2)


@plans.add("SELECT l_suppkey, l_orderkey, l_linenumber, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 30")
def k3_top_per_group(spark, sf):
    out = topk.top_k(read(spark, sf, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 30)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@plans.add("SELECT p_brand, p_partkey, n AS turn FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) ORDER BY n, p_brand LIMIT 60")
def k6_round_robin(spark, sf):
    return topk.round_robin(read(spark, sf, "part").select("p_brand", "p_partkey"), "p_brand", [F.col("p_partkey")], 60)


@plans.add("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('7:' || c_custkey)) AS place FROM customer")
def k7_seeded_shuffle(spark, sf):
    from pyspark.sql import Window

    return read(spark, sf, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(topk.seeded_order("7", F.col("c_custkey")))).alias("place"))
