"""Measures over the tables: neighbouring turns as references and what was heard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from textloom.operators import alignment, measures, spectral
from textloom.plans.base import Plans, read, spread

plans = Plans()

HALF = "list_distinct(string_split(lower(regexp_replace({x}, '[^A-Za-z ]', '', 'g')), ' '))"
LINES = """r AS (SELECT l_suppkey, l_orderkey, l_linenumber, list_filter([CASE WHEN l_discount > 0.05 THEN 'low' END, CASE WHEN l_tax > 0.04 THEN 'tax' END, CASE WHEN l_quantity > 25 THEN 'big' END], lambda x: x IS NOT NULL) AS wanted,
list_filter([CASE WHEN l_discount > 0.03 THEN 'low' END, CASE WHEN l_tax > 0.05 THEN 'tax' END, CASE WHEN l_returnflag = 'R' THEN 'back' END], lambda x: x IS NOT NULL) AS heard FROM lineitem)"""


def _rules(spark, sf):
    some = lambda *c: F.array_compact(F.array(*[F.when(x, n) for n, x in c]))
    d, t = F.col("l_discount"), F.col("l_tax")
    return read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", some(("low", d > 0.05), ("tax", t > 0.04), ("big", F.col("l_quantity") > 25)).alias("wanted"), some(("low", d > 0.03), ("tax", t > 0.05), ("back", F.col("l_returnflag") == "R")).alias("heard"))


@plans.add(f"""WITH {LINES}, x AS (SELECT l_suppkey, wanted, heard, unnest(list_distinct(list_concat(wanted, heard))) AS rule FROM r),
g AS (SELECT l_suppkey, rule, sum(list_contains(wanted, rule)::INT) AS e, sum((list_contains(wanted, rule) AND list_contains(heard, rule))::INT) AS a, sum((NOT list_contains(wanted, rule))::INT) AS o FROM x GROUP BY ALL)
SELECT l_suppkey, rule, e::BIGINT AS expected, a::BIGINT AS applied, o::BIGINT AS extra, round(a / nullif(e, 0), 9) AS recall, round(a / nullif(a + o, 0), 9) AS precision FROM g""")
def a10_mi12_rule_scores(spark, sf):
    out = measures.rule_scores(_rules(spark, sf), ["l_suppkey"], "wanted", "heard")
    return out.select("l_suppkey", "rule", "expected", "applied", "extra", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@plans.add(f"WITH {LINES} SELECT l_orderkey, l_linenumber, rule FROM (SELECT l_orderkey, l_linenumber, heard, unnest(wanted) AS rule FROM r) WHERE NOT list_contains(heard, rule)")
def a10_mistakes(spark, sf):
    return measures.mistakes(_rules(spark, sf), ["l_orderkey", "l_linenumber"], "wanted", "heard")


@plans.add("""WITH c(scope, own, other) AS (VALUES ('AUTOMOBILE', 'O', 'F'), ('BUILDING', 'F', 'P')),
o AS (SELECT c_mktsegment AS scope, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS word, CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END END AS observed FROM orders JOIN customer ON c_custkey = o_custkey),
x AS (SELECT o.scope, CASE WHEN observed = own THEN 'own' WHEN observed = other THEN 'other' ELSE 'neither' END AS outcome FROM o JOIN c ON o.scope = c.scope AND word = own)
SELECT scope, count(*) AS eligible, count(*) FILTER (WHERE outcome = 'own') AS own_form, count(*) FILTER (WHERE outcome = 'other') AS other_form, round(avg((outcome = 'own')::INT), 9) AS fidelity FROM x GROUP BY 1""")
def a19_al15_lexical_fidelity(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    aligned = o.select(F.col("c_mktsegment").alias("scope"), F.when(key % 5 == 0, "P").otherwise(F.col("o_orderstatus")).alias("word"), F.when(key % 7 > 0, F.when(key % 3 == 0, "F").otherwise(F.col("o_orderstatus"))).alias("observed"))
    contrasts = spark.createDataFrame([("AUTOMOBILE", "O", "F"), ("BUILDING", "F", "P")], "scope string, own string, other string")
    x = measures.contrast_outcomes(aligned, contrasts, "scope", "word", "observed")
    hit = lambda k: F.count_if(F.col("outcome") == k)
    return x.groupBy("scope").agg(F.count("*").alias("eligible"), hit("own").alias("own_form"), hit("other").alias("other_form"), F.round(F.avg((F.col("outcome") == "own").cast("double")), 9).alias("fidelity"))


@plans.add("""SELECT user_id, count(*) FILTER (WHERE NOT (value > 20)) AS flagged, round(avg((NOT (value > 20))::INT), 9) AS flag_rate, round(avg((value > 20)::INT), 9) AS coverage, count(*) FILTER (WHERE NOT (event_id % 9 > 0)) AS unended,
count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS "view" FROM events GROUP BY 1""")
def a20_decoding_safety(spark, sf):
    e = read(spark, sf, "events").withColumn("flags", F.array("event_type"))
    cols = measures.safety("flags", F.col("value") > 20, F.col("event_id") % 9 > 0, ["click", "view"])
    out = e.groupBy("user_id").agg(*cols)
    return out.withColumns({c: F.round(c, 9) for c in ("flag_rate", "coverage")})


@plans.add("""SELECT l_orderkey, min(l_shipdate) AS start, max(l_shipdate + to_days(l_linenumber)) AS "end", round(avg(l_quantity), 9) AS score, array_to_string(list(l_quantity::INT ORDER BY l_shipdate, l_shipdate + to_days(l_linenumber), l_quantity), ',') AS scores FROM lineitem GROUP BY 1""")
def a24_span_summary(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", F.expr("l_shipdate + make_dt_interval(l_linenumber)").alias("until"), "l_quantity")
    out = rows.groupBy("l_orderkey").agg(*measures.span_summary(["l_orderkey"], "l_shipdate", "until", "l_quantity"))
    return out.select("l_orderkey", "start", "end", F.round("score", 9).alias("score"), F.array_join(F.transform("scores", lambda x: x.cast("int").cast("string")), ",").alias("scores"))


@plans.add("""WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size > 2 THEN p_retailprice END AS region FROM part),
o AS (SELECT p_brand, max(n) AS most FROM (SELECT p_brand, region, count(DISTINCT p_partkey) AS n FROM p WHERE region IS NOT NULL GROUP BY ALL) GROUP BY 1), u AS (SELECT p_brand, min((region IS NOT NULL)::INT) AS least FROM p GROUP BY 1)
SELECT u.p_brand, least > 0 AND coalesce(most = 1, false) AS precise FROM u LEFT JOIN o ON u.p_brand = o.p_brand""")
def a28_precise_geometry(spark, sf):
    p = read(spark, sf, "part").withColumn("region", F.when(F.col("p_size") > 2, F.col("p_retailprice")))
    return measures.precise(p, "p_brand", "p_partkey", "region")


def _turns(spark, sf):
    """(conv_id, turn, ref, hyp): words of a turn, and of it with every fifth word gone, as what was heard."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " "), lambda w: w != "")
    heard = F.filter(F.transform(F.col("ref"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["i"] + F.col("turn")) % 5 != 4)
    return spread(read(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", words.alias("ref")).withColumn("hyp", F.transform(heard, lambda x: x["w"]))


TURNS = """t AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda w: w <> '') AS ref FROM conversations),
h AS (SELECT conv_id, turn, ref, list_filter(list_transform(range(len(ref)), lambda i: CASE WHEN (i + turn) % 5 <> 4 THEN ref[i + 1] END), lambda w: w IS NOT NULL) AS hyp FROM t)"""


@plans.add(f"""WITH {TURNS}, e AS (SELECT conv_id, len(ref) AS n, len(hyp) AS m, len(ref) - len(hyp) AS d, levenshtein(array_to_string(ref, ' '), array_to_string(hyp, ' ')) AS ce, length(array_to_string(ref, ' ')) AS c, ref = hyp AS same, coalesce(ref[-1] = hyp[-1], len(ref) = len(hyp)) AS ends FROM h)
SELECT conv_id % 10 AS "group", count(*) AS samples, sum(n)::BIGINT AS words, round(sum(d) / greatest(1, sum(n)), 9) AS wer, round(sum(ce) / greatest(1, sum(c)), 9) AS cer, round(sum(d) / greatest(1, sum(n)), 9) AS deletion_rate,
round(avg(same::INT), 9) AS exact, round(avg((d > 0)::INT), 9) AS omission, round(avg((m = 0)::INT), 9) AS empty, round(avg((m = 0 OR NOT ends)::INT), 9) AS terminal_mismatch FROM e GROUP BY 1""")
def a3_mi19_full_report(spark, sf):
    rows = _turns(spark, sf).withColumn("e", alignment.edit_counts_of("ref", "hyp")).select("conv_id", "ref", "hyp", "e.*")
    text = lambda c: F.array_join(c, " ")
    rows = rows.withColumns({"char_errors": F.levenshtein(text("ref"), text("hyp")), "ref_chars": F.char_length(text("ref"))})
    out = rows.groupBy((F.col("conv_id") % 10).alias("group")).agg(*measures.report())
    return out.select("group", "samples", "words", *[F.round(c, 9).alias(c) for c in ("wer", "cer", "deletion_rate", "exact", "omission", "empty", "terminal_mismatch")])


@plans.add(f"""WITH {TURNS} SELECT conv_id % 10 AS reader, count(*) AS samples, round(sum(len(ref) - len(hyp)) / sum(len(ref)), 9) AS wer, round(sum(levenshtein(array_to_string(ref, ' '), array_to_string(hyp, ' '))) / sum(length(array_to_string(ref, ' '))), 9) AS cer FROM h GROUP BY 1""")
def a27_mi36_rates_by_reader(spark, sf):
    text = lambda c: F.array_join(c, " ")
    rows = _turns(spark, sf).withColumn("e", alignment.edit_counts_of("ref", "hyp"))
    errors = F.expr("e.substitutions + e.deletions + e.insertions")
    return rows.groupBy((F.col("conv_id") % 10).alias("reader")).agg(F.count("*").alias("samples"), F.round(F.sum(errors) / F.sum(F.size("ref")), 9).alias("wer"), F.round(F.sum(F.levenshtein(text("ref"), text("hyp"))) / F.sum(F.char_length(text("ref"))), 9).alias("cer"))


@plans.add(f"""WITH {TURNS}, s AS (SELECT conv_id, turn, ref, hyp, lead(turn, 1) OVER w = turn + 1 AND lead(turn, 2) OVER w = turn + 2 AS ok, lead(ref, 1) OVER w AS middle, lead(ref, 2) OVER w AS last FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT conv_id, turn, list_filter(list_distinct(middle), lambda x: NOT list_contains(ref, x) AND NOT list_contains(last, x)) AS x FROM s WHERE ok)
SELECT conv_id, turn, len(x)::INT AS distinctive FROM d WHERE len(x) >= 2""")
def j19_sp9_skip_probes(spark, sf):
    out = measures.skip_probes(_turns(spark, sf), ["conv_id"], "turn", "ref")
    return out.select("conv_id", "turn", F.size("distinctive").alias("distinctive"))


@plans.add(f"""WITH {TURNS}, d AS (SELECT conv_id, turn, list_distinct(ref) AS r, list_distinct(hyp) AS y, ref, hyp FROM h WHERE len(ref) > 0)
SELECT conv_id, turn, len(list_intersect(r, y)) / len(r) >= 0.5 AS invented, len(hyp) > 0 AND coalesce(hyp[-1] = ref[-1], false) AS finished FROM d""")
def mi31_invented_and_finished(spark, sf):
    t = _turns(spark, sf).filter("size(ref) > 0")
    return t.select("conv_id", "turn", measures.invented(F.array_distinct("ref"), F.col("hyp")).alias("invented"), measures.finished(F.col("ref"), F.col("hyp")).alias("finished"))


@plans.add(f"""WITH {TURNS}, s AS (SELECT conv_id, turn, ' ' || array_to_string(ref, ' ') || ' ' AS r, ' ' || array_to_string(hyp, ' ') || ' ' AS y, ' ' || array_to_string((lead(ref) OVER (PARTITION BY conv_id ORDER BY turn))[1:3], ' ') || ' ' AS skipped, lead(ref) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM h)
SELECT conv_id, turn, CASE WHEN NOT contains(r, skipped) THEN contains(y, skipped) END AS completed FROM s WHERE len(nx) >= 3""")
def a19_skip_completion(spark, sf):
    t = _turns(spark, sf).withColumn("next", F.lead("ref").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("size(next) >= 3")
    return t.select("conv_id", "turn", measures.completed_skip(F.slice("next", 1, 3), F.col("ref"), F.col("hyp")).alias("completed"))


@plans.add(f"""WITH {TURNS} SELECT conv_id, round(avg((len(hyp) > 0)::INT), 9) AS non_empty_rate, sum(len(hyp))::BIGINT AS generated_words FROM h GROUP BY 1""")
def mi41_silence_rates(spark, sf):
    out = _turns(spark, sf).groupBy("conv_id").agg(*measures.silence_rates(F.col("hyp")))
    return out.select("conv_id", F.round("non_empty_rate", 9).alias("non_empty_rate"), "generated_words")


@plans.add(f"""WITH {TURNS}, c AS (SELECT conv_id, turn, hyp, ref[2:9] AS context, ref[1] AS word, [ref[2] || 'x', ref[10]] AS others FROM h WHERE len(ref) >= 10)
SELECT conv_id, turn, CASE WHEN len(list_filter(context, lambda w: list_contains(hyp, w))) < 0.6::DOUBLE * len(context) THEN 'unusable' WHEN list_contains(hyp, word) THEN 'own' WHEN len(list_intersect(hyp, others)) > 0 THEN 'other' ELSE 'neither' END AS verdict FROM c""")
def al14_word_form(spark, sf):
    t = _turns(spark, sf).filter("size(ref) >= 10")
    ref = F.col("ref")
    return t.select("conv_id", "turn", measures.judge_form(F.col("hyp"), F.slice(ref, 2, 8), ref[0], F.array(F.concat(ref[1], F.lit("x")), ref[9])).alias("verdict"))


def byte_sound(text: bytes) -> np.ndarray:
    """Bytes as samples between -0.5 and 0.5."""
    return (np.frombuffer(text, np.uint8).astype(np.float32) - 128) / 256


def _told_of_sound(docs, tell, schema: str):
    """What `tell(doc_id, samples)` says of each document's sound: one sound at a time, so that a batch holds texts and results but no samples."""
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}"
    given = docs.sparkSession.createDataFrame([], kind).toArrow().schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [tell(i, byte_sound(b.as_py())) for i, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * (len(given) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, f.type) for x, f in zip(columns, list(given)[1:], strict=True)]], schema=given)

    return docs.mapInArrow(run, kind)


def _changes(doc_id: int, sound: np.ndarray) -> tuple:
    """Samples, frames of noise and whether it was reduced, samples when cleaned and when changed, and steps of the change."""
    cleaned, how = spectral.cleaned(sound) if len(sound) else (None, {})
    changed, steps = spectral.augmented(sound, int(doc_id))
    return len(sound), how.get("noise_frames"), how.get("reduced"), None if cleaned is None else len(cleaned), len(changed), len(steps)


@plans.add()
def sg5_sg6_sg7_text_sound(spark, sf):
    """Every document's text as sound (its bytes are samples): cleaned, changed by a seed of its id, and its cepstra against those of all."""
    docs = spread(read(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b")))
    told = _told_of_sound(docs, _changes, "n int, noise_frames int, reduced boolean, n_cleaned int, n_changed int, steps int")
    summaries = _told_of_sound(docs, lambda _, sound: (spectral.cepstral_summary(sound),), "f array<double>")
    scaled = spectral.standardised(summaries, "f").select("doc_id", F.round(F.get("f", F.lit(0)), 6).alias("first_mean"))
    return told.join(scaled, "doc_id", "left")
