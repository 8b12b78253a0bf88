"""Audits over the tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from textloom.operators import audits as A
from textloom.plans.base import Plans, read

plans = Plans()


@plans.add("""WITH e AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), f AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT * FROM (SELECT coalesce(e.k, f.k) AS k, CASE WHEN f.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' END AS state FROM e FULL JOIN f ON e.k = f.k) WHERE state IS NOT NULL""")
def au3_coverage(spark, sf):
    e = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return A.coverage(e, read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), ["k"])


#: Short texts of nations by region, and what was observed of each.
OBSERVED = """c AS (SELECT n_regionkey AS s, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS a, replace(n_name, '_', ' ') || ' of the region ' || n_nationkey AS t FROM nation),
o AS (SELECT s, a, t, CASE (s * 3 + a) % 8 WHEN 0 THEN t WHEN 1 THEN '' WHEN 2 THEN 'of the region' WHEN 3 THEN lead(t) OVER w WHEN 4 THEN t || ' ' || lead(t) OVER w WHEN 5 THEN 'x of the region y' WHEN 6 THEN lag(t, 2) OVER w || ' ' || lag(t) OVER w || ' ' || t ELSE 'quite another' END AS observed FROM c WINDOW w AS (PARTITION BY s ORDER BY a))"""


@plans.add(f"""WITH {OBSERVED}, r AS (SELECT s, a AS first, 1 AS n, t FROM c UNION ALL SELECT x.s, x.a, 2, x.t || ' ' || y.t FROM c x JOIN c y ON y.s = x.s AND y.a = x.a + 1 UNION ALL SELECT x.s, x.a, 3, x.t || ' ' || y.t || ' ' || z.t FROM c x JOIN c y ON y.s = x.s AND y.a = x.a + 1 JOIN c z ON z.s = x.s AND z.a = x.a + 2),
h AS (SELECT o.s, o.a, string_agg(first, ',' ORDER BY first) FILTER (WHERE n = 1 AND first <> a) AS others, bool_or(n > 1 AND first BETWEEN greatest(1, a - 2) AND a + 1) AS merged FROM o JOIN r ON r.s = o.s AND r.t = observed GROUP BY ALL)
SELECT o.s, o.a, CASE WHEN observed = t THEN 'exact' WHEN coalesce(observed, '') = '' THEN 'empty' WHEN len(string_split(observed, ' ')) < len(string_split(t, ' ')) AND contains(' ' || t || ' ', ' ' || observed || ' ') THEN 'partial' WHEN others IS NOT NULL THEN 'another:' || others
WHEN coalesce(merged, false) THEN 'merged' WHEN len(string_split(observed, ' ')) = len(string_split(t, ' ')) THEN 'same_count' ELSE 'different' END AS content FROM o LEFT JOIN h ON h.s = o.s AND h.a = o.a""")
def au2_content_classes(spark, sf):
    w = Window.partitionBy("s").orderBy("a")
    c = read(spark, sf, "nation").select(F.col("n_regionkey").alias("s"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("long").alias("a"), F.concat(F.regexp_replace("n_name", "_", " "), F.lit(" of the region "), F.col("n_nationkey")).alias("t"))
    lead, lag = lambda k: F.lead("t", k).over(w), lambda k: F.lag("t", k).over(w)
    kinds = [F.col("t"), F.lit(""), F.lit("of the region"), lead(1), F.concat(F.col("t"), F.lit(" "), lead(1)), F.lit("x of the region y"), F.concat(lag(2), F.lit(" "), lag(1), F.lit(" "), F.col("t")), F.lit("quite another")]
    o = c.withColumn("observed", F.element_at(F.array(*kinds), ((F.col("s") * 3 + F.col("a")) % 8 + 1).cast("int")))
    return A.content_class(o.select("s", "a", "observed"), c, "s", "a", "t", "observed").select("s", "a", "content")


@plans.add("""WITH l AS (SELECT o_custkey AS rec, o_orderkey % 40 AS n, o_orderkey % 1000 AS a, o_orderkey % 1000 + o_orderkey % 300 AS b, o_orderkey AS id FROM orders),
x AS (SELECT *, count(*) OVER (PARTITION BY rec, n) AS times, lag(b) OVER (PARTITION BY rec ORDER BY n, a, b) AS before FROM l)
SELECT id, CASE WHEN NOT n < 38 THEN 'unknown' WHEN times > 1 THEN 'repeated' WHEN NOT id % 11 > 0 THEN 'other recording' WHEN NOT (a >= 0 AND a < b AND b <= 1200) THEN 'out of range' WHEN a < before THEN 'overlapping' WHEN NOT id % 7 > 0 THEN 'not reviewed' END AS issue FROM x""")
def au7_override_issues(spark, sf):
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("rec"), (k % 40).alias("n"), (k % 1000).alias("a"), (k % 1000 + k % 300).alias("b"), k.alias("id"))
    return rows.select("id", A.override_issue(["rec"], "n", "a", "b", F.lit(1200), F.col("n") < 38, F.col("id") % 11 > 0, F.col("id") % 7 > 0).alias("issue"))


@plans.add("""SELECT c_custkey, sha256(c_name) AS h, 'r' || c_nationkey AS reviewer, '2020-01-01' AS reviewed_at FROM customer WHERE c_acctbal > 0 AND c_nationkey % 3 > 0 AND c_custkey % 5 > 0""")
def au8_approvals(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.sha2("c_name", 256).alias("h"), "c_nationkey", "c_acctbal")
    flag = lambda x: F.when(x, " True ").otherwise("false")
    d = c.filter("c_acctbal > 0").select("c_custkey", "h", flag(F.col("c_nationkey") % 3 > 0).alias("listening"), flag(F.col("c_custkey") % 5 > 0).alias("boundary"), F.concat(F.lit("r"), F.col("c_nationkey")).alias("reviewer"), F.lit("2020-01-01").alias("reviewed_at"))
    return A.approved(c.select("c_custkey", "h"), d, ["c_custkey"], "h")


@plans.add("""WITH w AS (SELECT o_custkey AS clip, o_orderkey AS id, o_orderstatus AS word, CASE WHEN o_orderkey % 41 = 0 THEN 'X' ELSE o_orderstatus END AS token, o_orderkey / 100.0::DOUBLE AS a, o_orderkey / 100.0::DOUBLE + 0.5::DOUBLE AS b FROM orders),
x AS (SELECT clip, id, word = token AND a < b AND b <= 1e9::DOUBLE AND a >= coalesce(lag(b) OVER (PARTITION BY clip ORDER BY id), 0) AS ok FROM w) SELECT clip, CASE WHEN bool_and(ok) THEN count(*)::INT END AS words FROM x GROUP BY 1""")
def al16_checked_timings(spark, sf):
    k = F.col("o_orderkey")
    item = F.struct(k.alias("id"), F.col("o_orderstatus").alias("word"), (k / 100).alias("start"), (k / 100 + 0.5).alias("end"), F.when(k % 41 == 0, "X").otherwise(F.col("o_orderstatus")).alias("token"))
    g = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("clip")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    words = F.transform("x", lambda v: F.struct(v["word"].alias("word"), v["start"].alias("start"), v["end"].alias("end")))
    good = A.checked_timings(words, F.transform("x", lambda v: v["token"]), F.lit(1e9))
    return g.select("clip", F.when(good.isNotNull(), F.size(good)).alias("words"))


@plans.add("""WITH v AS (SELECT vec_id, list_transform(embedding[1:3]::DOUBLE[], lambda x: exp(8 * x)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p, vec_id % 3 AS target FROM v),
b AS (SELECT *, list_position(p, list_max(p)) - 1 AS best, CASE WHEN vec_id % 4 = 0 THEN 'b c' ELSE 'z' END AS spoken FROM p)
SELECT vec_id, CASE WHEN best <> target THEN 'other' WHEN p[target + 1] >= 0.6::DOUBLE AND NOT (spoken = 'b c' AND target <> 1) THEN 'correct' ELSE 'close' END AS verdict FROM b""")
def al13_m1_sound_verdicts(spark, sf):
    from textloom.functions.math import softmax

    e = read(spark, sf, "embeddings").select("vec_id", softmax(F.transform(F.slice("embedding", 1, 3), lambda x: 8 * x.cast("double"))).alias("p"))
    spoken = F.when(F.col("vec_id") % 4 == 0, "b c").otherwise("z")
    return e.select("vec_id", A.sound_verdict(F.col("p"), (F.col("vec_id") % 3).cast("int"), spoken, F.array(F.lit("a"), F.lit("bc"), F.lit("d"))).alias("verdict"))


@plans.add("""SELECT l_suppkey, count(*) AS rows, count(*) FILTER (WHERE l_quantity > 45 OR l_discount > 0.08 OR l_tax = 0) AS quarantined, count(*) FILTER (WHERE l_tax = 0) AS untaxed FROM lineitem GROUP BY 1""")
def mi30_quarantine_manifest(spark, sf):
    why = A.reasons({"long": F.col("l_quantity") > 45, "discounted": F.col("l_discount") > 0.08, "untaxed": F.col("l_tax") == 0})
    rows = read(spark, sf, "lineitem").withColumn("reasons", why)
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("rows"), F.count("reasons").alias("quarantined"), F.count_if(F.contains("reasons", F.lit("untaxed"))).alias("untaxed"))


@plans.add("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) / 100.0::DOUBLE AS s FROM conversations), g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM t),
r AS (SELECT conv_id, g, min(turn) AS a, max(turn) AS b FROM g GROUP BY ALL HAVING count(*) >= 2), d AS (SELECT conv_id, turn, ('0x' || substr(md5('s:' || conv_id || ':' || turn), 1, 8))::BIGINT AS h FROM t),
p AS (SELECT r.conv_id, r.b, r.a + h % 2 AS first FROM r JOIN d ON d.conv_id = r.conv_id AND d.turn = r.a UNION ALL SELECT p.conv_id, p.b, p.first + 2 + h % 3 FROM p JOIN d ON d.conv_id = p.conv_id AND d.turn = p.first WHERE p.first + 2 + h % 3 <= p.b),
m AS (SELECT p.conv_id, p.first, least(p.b, p.first + 1 + h % 3) AS last FROM p JOIN d ON d.conv_id = p.conv_id AND d.turn = p.first)
SELECT m.conv_id, m.first, count(*)::INT AS members FROM m JOIN t ON t.conv_id = m.conv_id AND t.turn BETWEEN m.first AND m.last GROUP BY ALL HAVING count(*) >= 2 AND sum(s) <= 25""")
def sp8_grouped_runs(spark, sf):
    t = read(spark, sf, "conversations").select("conv_id", "turn", (F.char_length("text") / 100).alias("s"))
    return A.grouped_runs(t, ["conv_id"], "turn", "s", "s")


@plans.add()
def al12_omissions(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    t = read(spark, sf, "conversations").withColumn("b", F.lead("text").over(w)).filter("b is not null")
    return t.select("conv_id", "turn", A.omissions_of(words(F.col("text")), words(F.col("b"))).alias("o")).select("conv_id", "turn", "o.*")


@plans.add()
def al11_best_matches(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    return A.best_matches(p, p.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("asked"), F.reverse("p_name").alias("p_name")), "p_partkey", "p_name", "asked")


@plans.add("""SELECT page_id, CASE WHEN html IS NULL THEN 0 ELSE len(regexp_extract_all(html, '(?i)<a\\s[^>]*href="[^"]*"')) END::INT AS links FROM pages""")
def src9_page_links(spark, sf):
    from textloom.sources.files import links

    return read(spark, sf, "pages").select("page_id", F.size(links(F.col("html"), "href")).alias("links"))


@plans.add("""WITH w AS (SELECT c_custkey, unnest(range(0, greatest(1, ceil(c_acctbal / 240.0)::BIGINT))) * 240 AS a, c_acctbal AS b FROM customer WHERE c_acctbal > 0) SELECT c_custkey, a::DOUBLE AS start, least(b, a + 280)::DOUBLE AS "end" FROM w WHERE a < b""")
def sg8_gap_windows(spark, sf):
    from textloom.operators.sound import gap_windows

    c = read(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", F.lit(0.0).alias("a"), F.col("c_acctbal").alias("b"))
    return c.select("c_custkey", F.explode(gap_windows(F.col("a"), F.col("b"), 280.0, 240.0)).alias("w")).select("c_custkey", "w.start", "w.end")
