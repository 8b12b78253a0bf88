"""Records over the star schema: selections, promotions, verified joins, merges."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from textloom.functions import math as M, text as T
from textloom.operators import records as R
from textloom.plans.base import Plans, read

plans = Plans()


@plans.add("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AND c_mktsegment NOT IN ('MACHINERY')")
def pf2_named_selection(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return R.select_named(c, "c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"], ["MACHINERY"])


@plans.add("SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey AS region, n_regionkey * 10 AS n_regionkey FROM nation")
def pf5_projection_override(spark, sf):
    return read(spark, sf, "nation").withColumns({"n_name": F.lower("n_name"), "region": F.col("n_regionkey"), "n_regionkey": F.col("n_regionkey") * 10})


@plans.add("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 45 AND l_linenumber >= 3 THEN 'high' WHEN l_quantity >= 30 AND l_linenumber >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem""")
def pf6_case_chain(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when((q >= 45) & (n >= 3), "high").when((q >= 30) & (n >= 2), "medium").otherwise("low").alias("confidence"))


@plans.add("SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS only_order FROM orders GROUP BY 1")
def pf8_single_promotion(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("orders"))
    return o.select("o_custkey", R.only(F.col("orders")).alias("only_order"))


PATHS = "p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS a, CASE page_id % 5 WHEN 0 THEN '../' WHEN 1 THEN '/' WHEN 2 THEN 'x/../' WHEN 3 THEN 'c:' ELSE '' END || regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)"


@plans.add(f"WITH {PATHS} SELECT page_id, path <> '' AND NOT regexp_matches(path, '^/|^[A-Za-z]:|\\\\|(^|/)\\.\\.(/|$)') AS safe FROM p")
def pf9_safe_paths(spark, sf):
    tail = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    front = F.element_at(F.array(*map(F.lit, ("../", "/", "x/../", "c:", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    return read(spark, sf, "pages").select("page_id", R.safe_path(F.concat(front, tail)).alias("safe"))


RULES = "VALUES ('R', 'return', true, 2), ('A', 'accept', true, 1), ('N', 'none', false, 3)"


@plans.add(f"""WITH g(rule, "group", core, place) AS ({RULES}), x AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce((SELECT string_agg(rule, ',' ORDER BY place) FROM g WHERE "group" <> 'return' AND list_contains(f, rule)), '') AS shown, (SELECT string_agg(rule, ',' ORDER BY place) FROM g WHERE list_contains(f, rule)) AS ordered FROM x""")
def pf10_k8_visible_rules(spark, sf):
    g = spark.createDataFrame([("R", "return", True, 2), ("A", "accept", True, 1), ("N", "none", False, 3)], "rule string, group string, core boolean, place int")
    x = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return x.select("l_orderkey", F.array_join(R.visible(F.col("f"), g, ["return"], True), ",").alias("shown"), F.array_join(R.by_priority(F.col("f"), ["A", "R", "N"]), ",").alias("ordered"))


@plans.add("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT o.o_orderkey, o.o_orderstatus FROM orders o JOIN t ON o.o_orderkey = t.o_orderkey WHERE o.o_orderstatus = t.o_orderstatus""")
def j2_verified_join(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.verified(o, o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus"))), ["o_orderkey"], "o_orderstatus")


@plans.add("""WITH b AS (SELECT DISTINCT conv_id, turn, conv_id AS new_conv, turn // 2 AS new_turn FROM conversations)
SELECT new_conv, new_turn, min(c.turn * 1000) AS starts, max(c.turn * 1000 + length(text)) AS ends, string_agg(text, ' ' ORDER BY c.turn) AS text, count(*) AS members FROM conversations c JOIN b ON c.conv_id = b.conv_id AND c.turn = b.turn GROUP BY ALL""")
def j16_bridge_join(spark, sf):
    c = read(spark, sf, "conversations")
    bridge = c.select("conv_id", "turn", F.col("conv_id").alias("new_conv"), F.floor(F.col("turn") / 2).alias("new_turn")).distinct()
    rows = c.select("conv_id", "turn", (F.col("turn") * 1000).alias("starts"), (F.col("turn") * 1000 + F.char_length("text")).alias("ends"), "text")
    return R.through_bridge(rows, bridge, ["conv_id", "turn"], ["new_conv", "new_turn"], "starts", "ends", "text", "turn")


@plans.add("""WITH t AS (SELECT l_orderkey, list_distinct(list(l_suppkey ORDER BY l_linenumber)) AS s, list(l_suppkey ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1),
u AS (SELECT l_orderkey, unnest(s) AS s_suppkey FROM t WHERE len(s) BETWEEN 1 AND 3) SELECT l_orderkey, u.s_suppkey, s_name FROM u JOIN supplier ON supplier.s_suppkey = u.s_suppkey""")
def j17_fan_out_join(spark, sf):
    t = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("s"))
    return R.fan_out(t, "l_orderkey", "s", read(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 3).drop("place")


@plans.add()
def j12_interval_matches(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 50).alias("clip"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("value") % 30).alias("start"), "value")
    spans = e.withColumn("end", F.col("start") + 1 + F.col("value") % 3)
    return R.match_intervals(spans.filter("id % 2 = 0"), spans.filter("id % 2 = 1"), "clip")


@plans.add("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def u2_not_a_subset(spark, sf):
    part = read(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"))
    return R.missing_from(part, read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("custkey")), ["custkey"])


@plans.add("""WITH p AS (SELECT p_brand, p_partkey, 0 AS pool, p_size AS w FROM part WHERE p_size > 40 UNION ALL SELECT p_brand, p_partkey, 1, p_size FROM part WHERE p_size > 20 UNION ALL SELECT p_brand, p_partkey, 2, p_size FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_partkey ORDER BY pool, w) AS n FROM p), r AS (SELECT p_brand, p_partkey, pool, row_number() OVER (PARTITION BY p_brand ORDER BY pool, w, p_partkey) AS rank FROM f WHERE n = 1)
SELECT p_brand, p_partkey, pool, rank::INT AS rank FROM r WHERE rank <= 5""")
def u4_ch4_pools(spark, sf):
    p = read(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    return R.pooled([p.filter("p_size > 40"), p.filter("p_size > 20"), p], "p_partkey", F.col("p_size"), ["p_brand"], 5).select("p_brand", "p_partkey", "pool", "rank")


@plans.add("""WITH a AS (SELECT o_orderkey, o_orderstatus AS l FROM orders WHERE o_totalprice > 50000), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS r FROM orders WHERE o_totalprice < 400000)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, l AS "left", r AS "right" FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE l IS DISTINCT FROM r""")
def u7_inventory_difference(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    b = o.filter("o_totalprice < 400000").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    return R.inventory_difference(o.filter("o_totalprice > 50000"), b, "o_orderkey", "o_orderstatus")


@plans.add("""WITH s AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderkey % 3 AS source FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, source DESC, o_orderkey DESC) AS n FROM s)
SELECT o_custkey, max(o_orderdate) AS newest, count(DISTINCT source) AS sources FROM r GROUP BY 1""")
def mi7_mi8_merged_sources(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").alias("newest"), "o_orderkey")
    parts = [o.filter(F.col("o_orderkey") % 3 == k) for k in range(3)]
    return R.merge_sources(parts, ["o_custkey"], "newest").select("o_custkey", "newest", "sources")


@plans.add("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'SHIFTED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def mi6_mi18_enriched(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    facts = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "SHIFTED").alias("c_mktsegment"))
    return R.enriched(c, facts, ["c_custkey"], ["c_mktsegment"])


@plans.add("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 > 0 THEN l_quantity END AS length, CASE WHEN l_suppkey % 7 > 0 THEN l_linenumber * 8 - 12 END AS a, l_linenumber * 8 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(0, a)::INT AS clip_start, least(length, b)::DOUBLE AS clip_end, CASE WHEN length IS NULL THEN 'no recording' WHEN a IS NULL THEN 'no timing' WHEN greatest(0, a) >= least(length, b) THEN 'empty clip' END AS reason FROM c""")
def mi3_clipped_spans(spark, sf):
    c = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity")).alias("length"), F.when(F.col("l_suppkey") % 7 > 0, F.col("l_linenumber") * 8 - 12).alias("a"), (F.col("l_linenumber") * 8).alias("b"))
    return R.clipped(c, "length", "a", "b").select("l_orderkey", "l_linenumber", "clip_start", "clip_end", "reason")


@plans.add("""WITH s AS (SELECT l_orderkey, l_suppkey % 3 AS kind, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, string_agg(kind || ':' || l_linenumber, ',' ORDER BY l_linenumber, kind) AS kept FROM s WHERE n = 1 GROUP BY 1""")
def r9_dedupe_structs(spark, sf):
    item = F.struct("l_linenumber", (F.col("l_suppkey") % 3).alias("kind"))
    g = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform(R.dedupe_by(F.col("x"), "kind"), lambda x: F.concat_ws(":", x["kind"], x["l_linenumber"])), ",").alias("kept"))


@plans.add("""WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = lag(l_returnflag) OVER w THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag)),
g AS (SELECT l_orderkey, l_linenumber, l_returnflag, sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag ROWS UNBOUNDED PRECEDING) AS run FROM s), m AS (SELECT l_orderkey, run, l_returnflag, string_agg(l_linenumber, '' ORDER BY l_linenumber) AS t FROM g GROUP BY ALL)
SELECT l_orderkey, string_agg(t || l_returnflag, ' ' ORDER BY run) AS segments FROM m GROUP BY 1""")
def r5_merged_segments(spark, sf):
    item = F.struct("l_linenumber", F.col("l_linenumber").cast("string").alias("t"), F.col("l_returnflag").alias("k"))
    g = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(item)).alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform(R.merge_equal(F.col("x"), "t", "k"), lambda x: F.concat(x["text"], x["key"])), " ").alias("segments"))


@plans.add("""SELECT n_nationkey, '{"n":"' || n_name || '","r":"' || n_regionkey || '"}' AS shown, n_name AS back FROM nation""")
def r6_r7_r8_json_and_maps(spark, sf):
    n = read(spark, sf, "nation")
    both = F.map_concat(F.create_map(F.lit("_id"), F.col("n_nationkey").cast("string")), F.create_map(F.lit("n"), F.col("n_name"), F.lit("r"), F.col("n_regionkey").cast("string")))
    return n.select("n_nationkey", R.public_fields(F.to_json(both)).alias("shown"), F.from_json(F.to_json(both), "n string")["n"].alias("back"))


@plans.add("""WITH x AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(list_zip(p, s), lambda z: z[1] || '/' || z[2]), ' ') AS pairs, coalesce(list_position(p, p[3]) - 1, NULL)::INT AS third, len(list_filter(range(1, least(len(p), len(s)) + 1), lambda i: p[1:i] = s[1:i]))::INT AS prefix FROM x""")
def r2_r3_w13_arrays(spark, sf):
    take = lambda c: F.transform(F.col("x"), lambda v: v[c])
    g = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x")).select("l_orderkey", take("l_partkey").alias("p"), take("l_suppkey").alias("s"))
    third = F.when(F.size("p") >= 3, T.first_place(F.col("p"), F.slice("p", 3, 1)))
    return g.select("l_orderkey", F.array_join(F.transform(F.arrays_zip("p", "s"), lambda z: F.concat_ws("/", z["p"], z["s"])), " ").alias("pairs"), third.alias("third"), T.common_prefix(F.col("p"), F.col("s")).alias("prefix"))


@plans.add("""SELECT r_name, string_agg(x, '|' ORDER BY n_nationkey, i) AS points FROM (SELECT r_name, n_nationkey, unnest([n_name, lower(n_name)]) AS x, unnest([0, 1]) AS i FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY 1""")
def r4_flattened_points(spark, sf):
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    g = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array("n_name", F.lower("n_name")).alias("x")))).alias("s"))
    return g.select("r_name", F.array_join(F.flatten(F.transform("s", lambda t: t["x"])), "|").alias("points"))


@plans.add("""WITH l AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_orderkey END AS v FROM orders)
SELECT o_custkey, o_orderkey, first_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following,
last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l""")
def w1_neighbours_kept(spark, sf):
    out = R.next_kept(read(spark, sf, "orders").withColumn("v", F.col("o_orderkey")), ["o_custkey"], "o_orderkey", "v", F.col("o_totalprice") > 100000)
    return out.select("o_custkey", "o_orderkey", "following", "before")


@plans.add("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127.0::DOUBLE AS scale FROM v),
q AS (SELECT vec_id, scale, list_transform(v, lambda x: round_even(x / scale, 0)) AS q FROM s)
SELECT a.vec_id, round(list_dot_product(a.q, b.q) * a.scale * b.scale, 6) AS cosine, round(least(a.scale, b.scale) / greatest(a.scale, b.scale), 9) AS near FROM q a JOIN q b ON b.vec_id = a.vec_id + 1""")
def m4_m6_mi15_rebuilt_cosine(spark, sf):
    q = read(spark, sf, "embeddings").select("vec_id", M.quantise(F.col("embedding")).alias("q"))
    b = q.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("r"))
    return q.join(b, "vec_id").select("vec_id", F.round(M.quantised_dot(F.col("q"), F.col("r")), 6).alias("cosine"), F.round(M.duration_likeness(F.col("q.scale"), F.col("r.scale")), 9).alias("near"))


@plans.add("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT vec_id, list_transform(range(0, len(v) // 8), lambda i: sqrt(list_sum(list_transform(v[i * 8 + 1 : i * 8 + 8], lambda x: x * x)) / 8)) AS r FROM v)
SELECT vec_id, list_max(r) < 0.2 AS silent FROM f""")
def m3_silence(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", M.is_silent(F.transform("embedding", lambda x: x.cast("double")), 8, 0.2).alias("silent"))


@plans.add("SELECT l_orderkey, l_linenumber, round_even(l_quantity * 0.5::DOUBLE, 0) AS even, floor(l_quantity * 0.5::DOUBLE + 0.5::DOUBLE) AS up FROM lineitem")
def m8_rounding(spark, sf):
    half = F.col("l_quantity") * 0.5
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", M.round_even(half).alias("even"), M.round_up(half).alias("up"))


@plans.add("SELECT unnest(list_concat([1], range(78, 115)))::INT AS chapter")
def mi5_scope(spark, sf):
    return spark.range(1).select(F.explode(F.concat(F.array(F.lit(1)), F.sequence(F.lit(78), F.lit(114)))).alias("chapter"))


@plans.add("""WITH b AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n, count(*) OVER (PARTITION BY n_regionkey) AS last FROM nation)
SELECT n_regionkey, least(n, last - 1) AS number, string_agg(n_name, ' ' ORDER BY n) AS text FROM b GROUP BY ALL""")
def mi4_shifted_texts(spark, sf):
    w = Window.partitionBy("n_regionkey")
    b = read(spark, sf, "nation").select("n_regionkey", "n_name", F.row_number().over(w.orderBy("n_nationkey")).cast("long").alias("n"), F.count("*").over(w).alias("last"))
    rows = b.withColumns({"starts": F.col("n"), "ends": F.col("n")})
    bridge = b.select("n_regionkey", "n", F.least("n", F.col("last") - 1).alias("number"))
    return R.through_bridge(rows, bridge, ["n_regionkey", "n"], ["n_regionkey", "number"], "starts", "ends", "n_name", "n").select("n_regionkey", "number", F.col("n_name").alias("text"))


@plans.add("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderpriority <> '1-URGENT') SELECT o_custkey, o_orderkey, o_totalprice FROM o WHERE n = 1""")
def mi9_mi29_first_occurrences(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderpriority <> '1-URGENT'")
    return o.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("x")).select("o_custkey", "x.*")


@plans.add("""SELECT l_suppkey, count(*) FILTER (WHERE l_discount <= 0.05) AS kept, count(*) AS total, round(avg(l_discount) FILTER (WHERE l_discount <= 0.05), 9) AS mean_kept, round(avg(l_discount), 9) AS mean FROM lineitem GROUP BY 1""")
def mi10_mi11_kept_summary(spark, sf):
    ok = F.col("l_discount") <= 0.05
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(ok).alias("kept"), F.count("*").alias("total"), F.round(F.avg(F.when(ok, F.col("l_discount"))), 9).alias("mean_kept"), F.round(F.avg("l_discount"), 9).alias("mean"))


@plans.add("SELECT item_id, text, NULL::VARCHAR AS label, NULL::VARCHAR AS reviewer FROM benchmark")
def mi13_blank_manifest(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", "text", *[F.lit(None).cast("string").alias(c) for c in ("label", "reviewer")])


@plans.add("""SELECT d.doc_id, coalesce(nullif(trim(split_part(text, chr(10), 1)), ''), lang) AS shown FROM documents d""")
def mi16_display_fallback(spark, sf):
    first = F.nullif(F.trim(F.split("text", "\n", -1)[0]), F.lit(""))
    return read(spark, sf, "documents").select("doc_id", F.coalesce(first, F.col("lang")).alias("shown"))


@plans.add("""WITH p AS (SELECT source, doc_id, sha256(text) AS a, CASE WHEN doc_id % 50 = 0 THEN 'x' ELSE sha256(text) END AS b FROM documents) SELECT source, bool_and(a = b) AS identical, count(*) FILTER (WHERE a <> b) AS different FROM p GROUP BY 1""")
def mi20_byte_identity(spark, sf):
    d = read(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("a"))
    published = d.select("doc_id", F.when(F.col("doc_id") % 50 == 0, "x").otherwise(F.col("a")).alias("b"))
    return d.join(published, "doc_id").groupBy("source").agg(F.bool_and(F.col("a") == F.col("b")).alias("identical"), F.count_if(F.col("a") != F.col("b")).alias("different"))


@plans.add("""SELECT r_regionkey AS chapter, unnest(CASE WHEN r_regionkey = 3 THEN [-2] ELSE [-2, -1] END) AS number, NULL AS text FROM region UNION ALL SELECT n_regionkey, n_nationkey, n_name FROM nation""")
def mi25_reference_list(spark, sf):
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("chapter"), F.explode(F.when(F.col("r_regionkey") == 3, F.array(F.lit(-2))).otherwise(F.array(F.lit(-2), F.lit(-1)))).alias("number"), F.lit(None).cast("string").alias("text"))
    return r.unionByName(read(spark, sf, "nation").select(F.col("n_regionkey").alias("chapter"), F.col("n_nationkey").alias("number"), F.col("n_name").alias("text")))


@plans.add("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, lag(o_orderkey) OVER w AS previous, lag(o_totalprice) OVER w AS price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, previous, price > 1000 AND o_totalprice > 1000 AND o_orderkey - previous < 5000 AS evident FROM o WHERE previous IS NOT NULL""")
def mi26_predecessor_evidence(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    ids = o.withColumn("previous", F.lag("o_orderkey").over(w)).filter("previous is not null")
    before = o.select(F.col("o_orderkey").alias("previous"), F.col("o_totalprice").alias("price"))
    return ids.join(before, "previous").select("o_orderkey", "previous", ((F.col("price") > 1000) & (F.col("o_totalprice") > 1000) & (F.col("o_orderkey") - F.col("previous") < 5000)).alias("evident"))


@plans.add("""SELECT doc_id, len(w)::INT AS words, list_contains(w[1:15], 'the') OR list_contains(w[1:15], 'und') AS opening FROM (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)""")
def mi27_mi28_words_and_openings(spark, sf):
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " "), lambda x: x != "")
    first = F.slice("w", 1, 15)
    return read(spark, sf, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("words"), F.arrays_overlap(first, F.array(F.lit("the"), F.lit("und"))).alias("opening"))


@plans.add("""WITH o AS (SELECT o_orderkey, o_orderstatus AS saved, o_orderstatus AS now, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders), f AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, CASE WHEN o_orderkey % 997 = 0 THEN '?' ELSE o_orderstatus END AS frozen FROM orders)
SELECT count(*) AS rows, count(*) FILTER (WHERE saved <> frozen) AS different, bool_and(saved = frozen) AS verified FROM o JOIN f USING (n)""")
def mi33_positional_check(spark, sf):
    o = read(spark, sf, "orders")
    frozen = o.select("o_orderkey", F.when(F.col("o_orderkey") % 997 == 0, "?").otherwise(F.col("o_orderstatus")).alias("frozen"))
    both = o.select("o_orderkey", "o_orderstatus").join(frozen, "o_orderkey")  # positions are the order of one key
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") != F.col("frozen")).alias("different"), F.bool_and(F.col("o_orderstatus") == F.col("frozen")).alias("verified"))


@plans.add("SELECT c_nationkey, min(n_name) AS label FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def mi34_canonical_targets(spark, sf):
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_nationkey", F.col("n_name").alias("label"))
    return R.conflict_free(c, ["c_nationkey"], "label")


@plans.add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 0 AND NOT (l_returnflag = 'N' AND l_suppkey % 10 < 8) AND l_suppkey <> 1")
def mi35_evaluation_rows(spark, sf):
    plain, train = F.col("l_returnflag") == "N", F.col("l_suppkey") % 10 < 8
    return read(spark, sf, "lineitem").filter((F.col("l_linenumber") > 0) & ~(plain & train) & (F.col("l_suppkey") != 1)).select("l_orderkey", "l_linenumber")


@plans.add("""WITH s AS (SELECT source, sha256(text) AS h, doc_id FROM documents), d AS (SELECT h, min(doc_id) AS doc_id, count(*) AS copies FROM s GROUP BY 1) SELECT s.source, s.doc_id, copies, d.doc_id = s.doc_id AS admitted FROM s JOIN d ON s.h = d.h""")
def mi42_mi40_decisions(spark, sf):
    s = read(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    d = s.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    return s.join(d, "h").select("source", "doc_id", "copies", (F.col("first") == F.col("doc_id")).alias("admitted"))
