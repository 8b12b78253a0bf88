"""Filters, joins and set operations on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import issues, key_of
from textloom.operators import joins, windows
from textloom.plans.base import Plans, read

plans = Plans()
DAY = 86_400


@plans.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 1 OR o_orderkey BETWEEN 78 AND 114")
def pf1_scope_filter(spark, sf):
    return read(spark, sf, "orders").filter("o_orderkey = 1 or o_orderkey between 78 and 114").select("o_orderkey", "o_custkey")


@plans.add("""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity > 0 AND l_quantity <= 30 THEN 'kept' ELSE 'rejected' END AS route FROM lineitem""")
def pf3_duration_route(spark, sf):
    route = F.when((F.col("l_quantity") > 0) & (F.col("l_quantity") <= 30), "kept").otherwise("rejected")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", route.alias("route"))


@plans.add("""
SELECT o_orderkey, o_orderstatus = 'F' AND o_totalprice > 1000 AND c_acctbal >= 0 AND c_mktsegment <> 'HOUSEHOLD' AND coalesce(n, 0) BETWEEN 1 AND 6 AS admitted
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def pf4_admission_gate(spark, sf):
    from textloom.operators.splits import admit

    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    checks = {"status": F.col("o_orderstatus") == "F", "price": F.col("o_totalprice") > 1000, "balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "HOUSEHOLD", "lines": F.coalesce("n", F.lit(0)).between(1, 6)}
    return admit(rows, checks).select("o_orderkey", "admitted")


@plans.add("""
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([
  CASE WHEN l_quantity > 45 THEN 'long' END, CASE WHEN l_discount > 0.08 THEN 'discounted' END, CASE WHEN l_tax = 0 THEN 'untaxed' END], lambda x: x IS NOT NULL), ',') AS issues FROM lineitem""")
def pf7_issue_list(spark, sf):
    found = issues(("long", F.col("l_quantity") > 45), ("discounted", F.col("l_discount") > 0.08), ("untaxed", F.col("l_tax") == 0))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(found, ",").alias("issues"))


@plans.add("""
SELECT c_custkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) AS runs FROM (
  SELECT c_custkey, min(m) AS a, max(m) AS b FROM (
    SELECT c_custkey, m, m - row_number() OVER (PARTITION BY c_custkey ORDER BY m) AS g FROM (
      SELECT DISTINCT o_custkey AS c_custkey, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS m FROM orders)) GROUP BY c_custkey, g) GROUP BY c_custkey""")
def pf11_run_text(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")).alias("m"))
    return windows.format_runs(rows, ["c_custkey"], "m")


@plans.add("""
SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_totalprice > 100000""")
def j1_lookup_join(spark, sf):
    o, c, n, r = (read(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    return o.filter("o_totalprice > 100000").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@plans.add("""
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' WHEN b.n > 1 THEN 'repeated' ELSE 'present' END AS status, coalesce(b.n, 0)::BIGINT AS n
FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k""")
def j3_coverage(spark, sf):
    expected = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return joins.coverage(expected, read(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@plans.add("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT' AND o_orderdate < l_shipdate)""")
def j4_semi_join(spark, sf):
    urgent = read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    line = read(spark, sf, "lineitem")
    return line.join(urgent, (line.l_orderkey == urgent.o_orderkey) & (urgent.o_orderdate < line.l_shipdate), "left_semi").select("l_orderkey", "l_linenumber")


@plans.add("""
SELECT o_orderkey, o_totalprice AS base_o_totalprice, o_totalprice * 2 AS cand_o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def j5_paired_runs(spark, sf):
    base = read(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return joins.paired(base, base.withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"], ["o_totalprice"])


@plans.add("""
WITH a AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber < 9 GROUP BY 1)
SELECT l_orderkey, a.n AS base_n, a.q AS base_q, b.n AS cand_n, b.q AS cand_q FROM a JOIN b USING (l_orderkey)""")
def j5_two_counts_of_orders(spark, sf):
    """Two ways to count orders' lines, paired where both have the order."""
    line = read(spark, sf, "lineitem")
    count = lambda df: df.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    base, cand = count(line.filter("l_returnflag <> 'R'")), count(line.filter("l_linenumber < 9"))
    return joins.paired(base, cand.join(base.select("l_orderkey"), "l_orderkey", "left_semi"), ["l_orderkey"], ["n", "q"])


@plans.add("""
WITH a AS (SELECT l_suppkey, l_partkey, min(l_discount) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey, min(l_discount) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
q AS (SELECT p_partkey AS l_partkey, p_partkey % 50 AS l_suppkey FROM part)
SELECT q.l_partkey, q.l_suppkey, coalesce(a.v, b.v, -1) AS discount, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 END AS found_by
FROM q LEFT JOIN a USING (l_suppkey, l_partkey) LEFT JOIN b USING (l_partkey)""")
def j6_prioritised_lookup(spark, sf):
    line = read(spark, sf, "lineitem").withColumnRenamed("l_discount", "discount")
    asked = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 50).alias("l_suppkey"))
    out = joins.prioritised_lookup(asked, [(line, ["l_suppkey", "l_partkey"]), (line.filter("l_returnflag = 'A'"), ["l_partkey"])], "discount", F.lit(-1.0))
    return out.select("l_partkey", "l_suppkey", "discount", "found_by")


@plans.add("""
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey, a.l_linenumber, b.p AS next_1, c.p AS next_2 FROM l a
LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
LEFT JOIN l c ON c.l_orderkey = a.l_orderkey AND c.l_linenumber = a.l_linenumber + 2""")
def j8_successors(spark, sf):
    line = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return joins.successor_join(line, ["l_orderkey"], "l_linenumber", (1, 2), "l_partkey").select("l_orderkey", "l_linenumber", "next_1", "next_2")


@plans.add("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value FROM events), p AS (SELECT user_id, t, max(value) AS value FROM e WHERE event_type = 'purchase' GROUP BY ALL)
SELECT v.event_id, p.value AS last_value FROM (SELECT * FROM e WHERE event_type <> 'purchase') v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.t >= p.t""")
def j9_asof_join(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value")
    right = e.filter("event_type = 'purchase'").select("user_id", "t", F.col("value").alias("last_value"))
    return joins.asof_join(e.filter("event_type <> 'purchase'"), right, ["user_id"], "t", "t", ["last_value"]).select("event_id", "last_value")


@plans.add(f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events), s AS (SELECT event_id AS span_id, user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + {DAY} AS b FROM events WHERE event_type = 'purchase')
SELECT e.event_id, s.span_id FROM e LEFT JOIN s ON e.user_id = s.user_id AND t >= a AND t < b""")
def j10_point_in_interval(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    spans = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("span_id"), "user_id", F.col("t").alias("a"), (F.col("t") + DAY).alias("b"))
    return joins.interval_join(e.drop("event_type"), spans, ["user_id"], "t", "a", "b", DAY).select("event_id", "span_id")


OVERLAP = """
WITH s AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + 1 + o_orderkey % 90 AS b FROM orders)
"""


def _spans(spark, sf):
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / DAY)
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", day.alias("a"), (day + 1 + F.col("o_orderkey") % 90).alias("b"))


@plans.add(OVERLAP + "SELECT x.o_custkey, x.o_orderkey AS first, y.o_orderkey AS second, least(x.b, y.b) - greatest(x.a, y.a) AS shared FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a < y.b AND y.a < x.b")
def j11_overlap_pairs(spark, sf):
    return joins.overlap_pairs(_spans(spark, sf), ["o_custkey"], "o_orderkey", "a", "b", 30)


@plans.add(OVERLAP + "SELECT o_custkey, o_orderkey, coalesce(max(b) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > a, false) AS overlaps FROM s")
def w6_overlap_sweep(spark, sf):
    return joins.overlaps_before(_spans(spark, sf), ["o_custkey"], "a", "b", ["o_orderkey"]).select("o_custkey", "o_orderkey", "overlaps")


@plans.add(OVERLAP + "SELECT x.o_orderkey, count(y.o_orderkey) AS inside FROM s x LEFT JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey AND y.a >= x.a AND y.b <= x.b GROUP BY 1")
def j13_contained_intervals(spark, sf):
    s = _spans(spark, sf)
    pairs = joins.overlap_pairs(s, ["o_custkey"], "o_orderkey", "a", "b", 30)
    x, y = s.select(F.col("o_orderkey").alias("first"), F.col("a").alias("a1"), F.col("b").alias("b1")), s.select(F.col("o_orderkey").alias("second"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    both = pairs.join(x, "first").join(y, "second")
    held = both.filter("a2 >= a1 and b2 <= b1").select(F.col("first").alias("o_orderkey")).unionAll(both.filter("a1 >= a2 and b1 <= b2").select(F.col("second").alias("o_orderkey")))
    n = held.groupBy("o_orderkey").agg(F.count("*").alias("inside"))
    return s.select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("inside", F.lit(0)).alias("inside"))


@plans.add("""
SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY sha256(l_shipdate::DATE::VARCHAR || l_quantity::BIGINT::VARCHAR)) > 1 AS repeated FROM lineitem""")
def j18_repeated_content(spark, sf):
    line = read(spark, sf, "lineitem").withColumn("digest", F.sha2(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_quantity").cast("long").cast("string")), 256))
    n = line.groupBy("digest").agg(F.count("*").alias("n"))
    return line.join(n, "digest").select("l_orderkey", "l_linenumber", (F.col("n") > 1).alias("repeated"))


@plans.add("""
WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type FROM e WHERE n > 3 EXCEPT SELECT user_id, event_type FROM e WHERE n > 6""")
def u1_set_difference(spark, sf):
    n = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.filter("n > 3").select("user_id", "event_type").subtract(n.filter("n > 6").select("user_id", "event_type"))


@plans.add("""
SELECT DISTINCT a, b FROM (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 49)""")
def u5_symmetric_edges(spark, sf):
    from textloom.operators.topk import symmetric

    return symmetric(read(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")), "a", "b")


@plans.add("""
WITH x AS (SELECT l_orderkey, list(DISTINCT l_returnflag) FILTER (WHERE l_linenumber <= 2) AS a, list(DISTINCT l_returnflag) FILTER (WHERE l_linenumber > 2) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_filter(coalesce(a, []), lambda f: list_contains(coalesce(b, []), f))), ',') AS shared,
       array_to_string(list_sort(list_filter(coalesce(a, []), lambda f: NOT list_contains(coalesce(b, []), f))), ',') AS lost FROM x""")
def u6_array_sets(spark, sf):
    half = lambda c: F.collect_set(F.when(c, F.col("l_returnflag")))
    x = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(half(F.col("l_linenumber") <= 2).alias("a"), half(F.col("l_linenumber") > 2).alias("b"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return x.select("l_orderkey", text(F.array_intersect("a", "b")).alias("shared"), text(F.array_except("a", "b")).alias("lost"))


@plans.add("SELECT s_suppkey, lpad(s_nationkey::VARCHAR, 3, '0') || lpad(s_suppkey::VARCHAR, 6, '0') AS key FROM supplier")
def t31_padded_key(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", key_of((F.col("s_nationkey"), 3), (F.col("s_suppkey"), 6)).alias("key"))
