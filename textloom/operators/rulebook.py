"""The rules of recitation as a table, what of them a letter shows, and texts with tags of those that are heard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions.arabic import asr_form, bare_letters
from textloom.operators.letters import LETTER, annotated, letters
from textloom.operators.recitation import ALLAH, recited, script, spoken

#: Fixed values: (rule, group, level, counts, tag), the first shown where a letter has several.
RULES = (
    ("madd_lazim", "madd_necessary", "core", (6,), "mad"), ("madd_lazim_harfi", "madd_necessary", "core", (6,), "mad"), ("madd_ayn", "madd_permitted", "core", (6, 4), "mad"),
    ("madd_muttasil_waqf", "madd_connected", "core", (4, 6), "mad"), ("madd_muttasil", "madd_connected", "core", (4,), "mad"), ("madd_changed_hamza", "madd_permitted", "core", (4, 2), None),
    ("madd_munfasil", "madd_permitted", "core", (2, 4), None), ("tasheel", "riwaya", "core", (), "tasheel"), ("isqat", "riwaya", "core", (), None), ("ibdal", "riwaya", "core", (), None),
    ("naql", "riwaya", "core", (), None), ("imala", "riwaya", "core", (), None), ("ishmam", "riwaya", "core", (), None), ("ikhtilas", "riwaya", "core", (), None), ("hadhf", "riwaya", "core", (), None),
    ("ya_zaida", "riwaya", "core", (), None), ("idgham_ghunna", "nasal", "core", (2,), "idgham_ghunna"), ("iqlab", "nasal", "core", (2,), "m_ikhfa"), ("ikhfa", "nasal", "core", (2,), "n_ikhfa"),
    ("ikhfa_shafawi", "nasal", "core", (2,), "m_ikhfa"), ("idgham_shafawi", "nasal", "core", (2,), None), ("ghunna", "nasal", "core", (2,), "n_ghunna"), ("idgham_no_ghunna", "merge", "core", (), None),
    ("idgham_harf", "merge", "core", (), None), ("madd_arid", "madd_permitted", "core", (2, 4, 6), None), ("madd_lin", "madd_permitted", "core", (2, 4, 6), None), ("madd_silah", "madd_natural", "core", (2,), "silah"),
    ("mim_jam", "riwaya", "detail", (), None), ("ha_kinaya_qasr", "riwaya", "core", (), None), ("ha_kinaya_both", "riwaya", "core", (), None), ("ha_sukun", "riwaya", "core", (), None),
    ("ya_idafa", "riwaya", "core", (), None), ("taqlil", "riwaya", "core", (), None), ("idgham_riwaya", "riwaya", "core", (), None), ("no_sakt", "riwaya", "core", (), None), ("riwaya_diff", "riwaya", "core", (), None),
    ("qalqala", "qalqala", "core", (), "qalqala"), ("qalqala_waqf", "qalqala", "core", (), "qalqala"), ("hamzat_wasl", "merge", "core", (), None), ("idgham_shamsi", "merge", "core", (), None),
    ("silent", "merge", "core", (), None), ("wasl_drop", "merge", "core", (), None), ("ra_both", "heavy", "core", (), None), ("ra_tafkhim", "heavy", "core", (), None), ("lam_tafkhim", "heavy", "core", (), None),
    ("madd_badal", "madd_natural", "detail", (2,), None), ("madd_iwad", "madd_natural", "detail", (2,), None), ("madd_tabii", "madd_natural", "detail", (2,), None), ("madd_harfi_tabii", "madd_natural", "detail", (2,), None),
    ("tafkhim_letter", "heavy", "detail", (), None), ("ra_tarqiq", "light", "detail", (), None), ("lam_tarqiq", "light", "detail", (), None), ("izhar_halqi", "clear", "detail", (), None),
    ("izhar_mutlaq", "clear", "detail", (), None), ("izhar_shafawi", "clear", "detail", (), None), ("izhar_qamari", "clear", "detail", (), None),
)
#: Names of the letter rules in the book.
BOOK_NAMES = {"silent_wasl": "hamzat_wasl", "silent_letter": "silent", "silent_shamsi": "idgham_shamsi", "tafkhim": "tafkhim_letter", "idgham_same": "idgham_harf", "idgham_kin": "idgham_harf", "idgham_near": "idgham_harf"}


def rulebook(spark: SparkSession) -> DataFrame:
    """(rule, priority, group, level, counts, tag)."""
    return spark.createDataFrame([(r, k, g, v, list(c), t) for k, (r, g, v, c, t) in enumerate(RULES)], "rule string, priority int, `group` string, level string, counts array<int>, tag string")


def all_rules(verses: DataFrame, by: list[str], chapter: str, verse: str, text: str) -> DataFrame:
    """(by, word, index, end, rule): the rules of letters and of verses by their names in the book; words of opening letters have those of their names only."""
    own = recited(verses, by, chapter, verse, text)
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in BOOK_NAMES.items() for x in p]), F.col("rule")), F.col("rule"))
    plain = annotated(verses.withColumn(text, script(F.col(text))), by, text).select(*by, "word", "index", F.col("index").alias("end"), named.alias("rule"))
    opening = own.filter(F.col("rule").isin("madd_lazim_harfi", "madd_harfi_tabii", "madd_ayn")).select(*by, "word").distinct()
    return own.union(plain.join(opening, [*by, "word"], "left_anti")).distinct()


def rules_at(rules: DataFrame, by: list[str]) -> DataFrame:
    """(by, word, index, rules): what holds of each letter, first the rule that is shown; letters without rules give no row.

    Rules that the book does not have come last, by name.
    """
    ranked = rules.join(F.broadcast(rulebook(rules.sparkSession).select("rule", "priority")), "rule", "left")
    each = ranked.select(*by, "word", F.explode(F.sequence("index", "end")).alias("index"), F.struct(F.coalesce("priority", F.lit(len(RULES))).alias("p"), "rule").alias("r"))
    return each.groupBy(*by, "word", "index").agg(F.transform(F.array_sort(F.collect_set("r")), lambda r: r["rule"]).alias("rules"))


def segments(verses: DataFrame, rules: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, word, segments: array<struct<text, rules>>): each word in pieces of letters with the same rules.

    A lam and the alif behind it are one piece, as are the letters of Allah from the first
    lam on; a piece has the rules of all its letters.
    """
    none = F.array().cast("array<string>")
    own = letters(verses.withColumn(text, script(F.col(text))), by, text).select(*by, "word", "index", "letter", F.concat("base", "marks").alias("c"))
    each = own.join(rules_at(rules, by), [*by, "word", "index"], "left").withColumn("rules", F.coalesce("rules", none))
    words = each.groupBy(*by, "word").agg(F.array_sort(F.collect_list(F.struct("index", "letter", "c", "rules"))).alias("l"))
    allah = bare_letters(F.array_join(F.transform("l", lambda x: x["c"]), "")).rlike(ALLAH)
    order = F.array(*[F.lit(r[0]) for r in RULES])

    def step(state: Column, x: Column) -> Column:
        tail = F.try_element_at(state, F.lit(-1))
        bound = F.coalesce((tail["last"] == "ل") & ((x["letter"] == "ا") | (F.col("allah") & x["letter"].isin("ل", "ه"))), F.lit(False))
        joins = F.coalesce(bound | (tail["rules"] == x["rules"]), F.lit(False))
        united = F.array_union(tail["rules"], x["rules"])
        by_rank = F.concat(F.filter(order, lambda r: F.array_contains(united, r)), F.array_sort(F.array_except(united, order)))
        merged = F.when(tail["rules"] == x["rules"], x["rules"]).otherwise(by_rank)
        alone = F.struct(x["c"].alias("text"), x["rules"].alias("rules"), x["letter"].alias("last"))
        grown = F.struct(F.concat(tail["text"], x["c"]).alias("text"), merged.alias("rules"), x["letter"].alias("last"))
        return F.when(joins, F.concat(F.slice(state, 1, F.greatest(F.size(state) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(state, F.array(alone)))

    start = F.array().cast("array<struct<text: string, rules: array<string>, last: string>>")
    folded = words.withColumn("allah", allah).select(*by, "word", F.aggregate("l", start, step).alias("s"))
    return folded.select(*by, "word", F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["rules"].alias("rules"))).alias("segments"))


def tagged_words(verses: DataFrame, rules: DataFrame, by: list[str], text: str, plain: Column | None = None) -> DataFrame:
    """(by, word, spoken, tags): words in the form of recognisers, and tags of the rules that are heard in them, by place, each once.

    ghunna is one of nun or of mim; a nun that merges wholly into nun or mim has no tag, as
    the doubled letter has.  Words without a normal form are left out.  Where `plain` holds
    a verse is read without rules, and has no tags.
    """
    book = rulebook(verses.sparkSession).filter("tag is not null").select("rule", "priority", "tag")
    at = spoken(verses.select(*by, text), by, text).select(*by, "word", "index", "letter", F.col("after.letter").alias("then"))
    heard = rules.join(F.broadcast(book), "rule").select(*by, "word", "index", "rule", "priority", "tag").join(at, [*by, "word", "index"])
    merged = (F.col("rule") == "idgham_ghunna") & F.coalesce(F.col("then").isin("ن", "م"), F.lit(False))
    tag = F.when(merged, None).when((F.col("rule") == "ghunna") & (F.col("letter") == "م"), "m_ghunna").otherwise(F.col("tag"))
    found = heard.select(*by, "word", F.struct("index", "priority", tag.alias("tag")).alias("t")).groupBy(*by, "word").agg(F.array_sort(F.collect_set("t")).alias("t"))
    found = found.select(*by, "word", F.array_distinct(F.array_compact(F.transform("t", lambda x: x["tag"]))).alias("tags"))
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w.rlike(LETTER))
    flag = F.coalesce(plain, F.lit(False)) if plain is not None else F.lit(False)
    words = verses.select(*by, flag.alias("_plain"), F.posexplode(tokens).alias("word", "w")).select(*by, "_plain", "word", asr_form(F.col("w")).alias("spoken")).filter("spoken <> ''")
    none = F.array().cast("array<string>")
    return words.join(found, [*by, "word"], "left").select(*by, "word", "spoken", F.when(F.col("_plain") | F.col("tags").isNull(), none).otherwise(F.col("tags")).alias("tags"))


def tagged_targets(words: DataFrame, by: list[str]) -> DataFrame:
    """(by, target): the words of `tagged_words` in order, each with its tags; without them it is the form of recognisers."""
    item = F.concat("spoken", F.array_join(F.transform("tags", lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ""))
    return words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("word", item.alias("x")))).alias("x")).select(*by, F.array_join(F.transform("x", lambda x: x["x"]), " ").alias("target"))


def labels(verses: DataFrame, clips: DataFrame) -> DataFrame:
    """(chapter, verse, reader, path, text): a target for every verse, and one for every clip that is not just its verse.

    `verses` is (chapter, verse, text), `clips` (reader, path, chapter, verse, text, plain,
    n_verses).  A clip has its own target if it is read without rules, spans several verses,
    has another text than its verse in the form of recognisers, or no verse; clips without a
    text have none.  Verses with the same numbers are one, with the smallest text.
    """
    one = verses.groupBy("chapter", "verse").agg(F.min("text").alias("text"))

    def targets(df: DataFrame, by: list[str], plain: Column | None = None) -> DataFrame:
        rules = all_rules(df, by, "chapter", "verse", "text")
        return tagged_targets(tagged_words(df, rules, by, "text", plain), by)

    own = targets(one, ["chapter", "verse"]).select("chapter", "verse", F.lit(None).cast("string").alias("reader"), F.lit(None).cast("string").alias("path"), F.col("target").alias("text"))
    cached = one.select(F.col("chapter").alias("_c"), F.col("verse").alias("_v"), F.col("text").alias("_text"))
    met = clips.filter("text is not null").join(cached, (F.col("chapter") == F.col("_c")) & (F.col("verse") == F.col("_v")), "left")
    same = ~F.coalesce("plain", F.lit(False)) & (F.coalesce("n_verses", F.lit(1)) == 1) & F.coalesce(asr_form(F.col("text")) == asr_form(F.col("_text")), F.lit(False))
    odd = met.filter(~same).select("reader", "path", "chapter", "verse", "text", F.coalesce("plain", F.lit(False)).alias("plain"))
    told = targets(odd, ["reader", "path"], F.col("plain"))
    return own.union(told.select(F.lit(None).cast("int"), F.lit(None).cast("int"), "reader", "path", F.col("target")))
