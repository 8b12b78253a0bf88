"""Splits, leakage, quarantine, audits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from textloom.operators import splits, topk
from textloom.plans.base import Plans, read

plans = Plans()
UNIT = "('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"


@plans.add(f"""
WITH u AS (SELECT doc_id, source, {UNIT.format("'42:' || CASE WHEN source = 'src1' THEN 'together' ELSE doc_id::VARCHAR END")} AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM u""")
def sp1_hash_split(spark, sf):
    return read(spark, sf, "documents").select("doc_id", splits.hash_split(F.col("doc_id"), "42", together=F.col("source") == "src1").alias("split"))


@plans.add("""
WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256('9:' || source)) AS n, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM documents))
SELECT source, CASE WHEN n <= greatest(2, round_even(m * 0.15, 0)) THEN 'validation' WHEN n <= 2 * greatest(2, round_even(m * 0.15, 0)) THEN 'test' ELSE 'train' END AS split FROM g""")
def sp2_grouped_split(spark, sf):
    return splits.grouped_split(read(spark, sf, "documents"), "source", "9")


@plans.add(f"""
WITH s AS (SELECT sha256(text) AS digest, CASE WHEN {UNIT.format("'42:' || doc_id")} < 0.8 THEN 'train' WHEN {UNIT.format("'42:' || doc_id")} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM documents)
SELECT digest, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def u3_split_leaks(spark, sf):
    rows = read(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), splits.hash_split(F.col("doc_id"), "42").alias("split"))
    return splits.leaks(rows, "digest", "split").select("digest", F.array_join("splits", ",").alias("splits"))


@plans.add("""
WITH r AS (SELECT doc_id, sha256(text) AS digest, CASE WHEN source IN ('src1', 'src2') THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT doc_id, digest IN (SELECT digest FROM r WHERE split = 'train') AS text_seen FROM r WHERE split = 'test'""")
def sp3_text_seen(spark, sf):
    split = F.when(F.col("source").isin("src1", "src2"), "test").otherwise("train")
    rows = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), split.alias("split"))
    return splits.seen_in(rows, "digest", "split").filter("split = 'test'").select("doc_id", "text_seen")


@plans.add(f"""
SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45 AND {UNIT.format("'3:' || l_partkey")} >= 0.2 AND {UNIT.format("'3:' || l_suppkey")} >= 0.2""")
def sp4_held_out_pairs(spark, sf):
    return splits.held_out_pairs(read(spark, sf, "lineitem").filter("l_quantity > 45").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", "3", 0.2)


@plans.add("SELECT doc_id, source FROM documents WHERE doc_id % 50 <> 3")
def sp5_quarantine(spark, sf):
    docs = read(spark, sf, "documents").withColumn("digest", F.sha2("text", 256))
    listed = docs.filter("doc_id % 50 = 3").select("doc_id", "digest")
    return splits.quarantine(docs, listed, "doc_id", "digest").select("doc_id", "source")


@plans.add("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE lang END AS lang, doc_id % 7 = 0 AS changed FROM documents")
def sp6_label_overlay(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    return splits.overlay(docs, docs.filter("doc_id % 7 = 0").select("doc_id", F.lit("new").alias("lang")), "doc_id", "lang")


@plans.add("""
SELECT lang, count(*) AS n FROM (SELECT lang, row_number() OVER (PARTITION BY lang) AS n FROM documents) WHERE n <= 20 GROUP BY 1""")
def sp7_weighted_sample(spark, sf):
    some = topk.weighted_sample(read(spark, sf, "documents"), ["lang"], "doc_id", F.greatest(F.col("n_chars"), F.lit(1)), 20, "5")
    return some.groupBy("lang").agg(F.count("*").alias("n"))


@plans.add("""
SELECT user_id, event_id, coalesce(lag(value) OVER w > 90, false) OR value > 90 AS excluded FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def au5_one_step_quarantine(spark, sf):
    e = read(spark, sf, "events").withColumn("failed", F.col("value") > 90).withColumn("order", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return splits.propagate_failure(e, ["user_id"], "order", "failed").select("user_id", "event_id", "excluded")


@plans.add("""
SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'no order' END AS reason FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def au6_coverage_manifest(spark, sf):
    first = read(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return read(spark, sf, "customer").join(first, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey", F.when(F.col("o_orderkey").isNull(), "no order").alias("reason"))


@plans.add("""
SELECT l_partkey, min(l_discount) <= 0.02 AND max(l_discount) <= 0.09 AND bool_and(l_tax > 0) AND bool_and(l_quantity BETWEEN 1 AND 48) AS agreed FROM lineitem GROUP BY 1""")
def au10_agreement_gate(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_partkey").agg(((F.min("l_discount") <= 0.02) & (F.max("l_discount") <= 0.09) & F.bool_and(F.col("l_tax") > 0) & F.bool_and(F.col("l_quantity").between(1, 48))).alias("agreed"))


@plans.add("""
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS before FROM lineitem)
SELECT l_suppkey, count(*) FILTER (WHERE before IS NOT NULL AND l_shipdate - before > INTERVAL 3 DAY) AS gaps FROM r GROUP BY 1""")
def au4_boundary_gaps(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    rows = read(spark, sf, "lineitem").withColumn("before", F.lag("l_shipdate").over(w))
    return rows.groupBy("l_suppkey").agg(F.count_if(F.expr("l_shipdate - before > interval 3 days")).alias("gaps"))


@plans.add("""
WITH s AS (SELECT sum(l_quantity) AS stored FROM lineitem) SELECT l_returnflag, abs(sum(l_quantity) - sum(l_quantity)) <= 1e-12 AS verified FROM lineitem GROUP BY 1""")
def au9_stored_metric_check(spark, sf):
    sums = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("again"))
    kept = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("stored"))
    return sums.join(kept, "l_returnflag").select("l_returnflag", (F.abs(F.col("again") - F.col("stored")) <= 1e-12).alias("verified"))


@plans.add("""
SELECT nation.n_nationkey AS key, n_name FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 5, 'ADDED' ORDER BY key""")
def mi2_insert_if_absent(spark, sf):
    n = read(spark, sf, "nation").filter("n_nationkey <> 5").select(F.col("n_nationkey").alias("key"), "n_name")
    new = spark.createDataFrame([(5, "ADDED"), (6, "IGNORED")], "key int, n_name string")
    return n.unionByName(new.join(n, "key", "left_anti")).orderBy("key")


@plans.add("""
SELECT coalesce(s_nationkey, -1) AS nation, CASE WHEN grouping(s_nationkey) = 1 THEN 'all' ELSE 'one' END AS level, count(*) AS suppliers FROM supplier GROUP BY ROLLUP (s_nationkey)""")
def mi8_rollup_inventory(spark, sf):
    return read(spark, sf, "supplier").rollup("s_nationkey").agg(F.count("*").alias("suppliers"), F.when(F.grouping("s_nationkey") == 1, "all").otherwise("one").alias("level")).select(F.coalesce("s_nationkey", F.lit(-1)).alias("nation"), "level", "suppliers")


@plans.add("""
WITH d AS (SELECT doc_id, lang, -ln((('0x' || substr(sha256('5:' || doc_id), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0) / greatest(n_chars, 1) AS draw FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY draw, doc_id) AS n FROM d) SELECT lang, doc_id FROM r WHERE n <= 20""")
def sp7_sampled_ids(spark, sf):
    """Which documents a weighted sample takes: its draws are hashes, so SQL takes the same."""
    return topk.weighted_sample(read(spark, sf, "documents"), ["lang"], "doc_id", F.greatest(F.col("n_chars"), F.lit(1)), 20, "5").select("lang", "doc_id")


@plans.add("""
WITH r AS (SELECT l_partkey, sum(l_quantity) AS stored, sum(l_quantity + CASE WHEN l_partkey % 10 = 3 THEN 1e-6 ELSE 0 END) AS again FROM lineitem GROUP BY 1)
SELECT l_partkey, abs(again - stored) <= 1e-12 AS verified FROM r""")
def au9_metrics_that_moved(spark, sf):
    """Stored sums against sums made again from rows of which some have changed a little since."""
    rows = read(spark, sf, "lineitem")
    moved = rows.withColumn("l_quantity", F.when(F.col("l_partkey") % 10 == 3, F.col("l_quantity") + 1e-6).otherwise(F.col("l_quantity")))
    stored, again = (df.groupBy("l_partkey").agg(F.sum("l_quantity").alias(n)) for df, n in ((rows, "stored"), (moved, "again")))
    return again.join(stored, "l_partkey", "left").select("l_partkey", F.coalesce(F.abs(F.col("again") - F.col("stored")) <= 1e-12, F.lit(False)).alias("verified"))
