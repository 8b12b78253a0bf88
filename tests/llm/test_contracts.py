"""Each query against plain Python, over all documents of the smallest tables and over a fixture of odd texts."""

import pytest
from brute import ids, op1, op2, op3, op4, op5, op6_pieces, op7, op9, op10

from pyspark.sql import functions as F

from textloom.llm import binary_ids, line_dedup, merkle, packing, quality, queries, simhash, substring_dedup, token_counts, warc
from textloom.llm.runtime import default_tokenizer, scratch

LONG = " ".join(f"w{i % 700}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\r\x0b\x0c "),
    (4, "one"),
    (5, "one two"),
    (6, "  double  spaces \n\n and blank\tlines\n \nend "),
    (7, "non breaking   wide　 spaces\x1f \x85 here"),
    (8, "special <|endoftext|> token <|endoftext|>"),
    (9, "a " * 400),
    (10, "ABC def GHI jkl MNO pqr"),
    (11, "abc DEF ghi JKL mno PQR"),
    (12, PASSAGE),
    (13, "before " + PASSAGE + " after"),
    (14, " ".join(PASSAGE.split()[:30]) + " cut " + " ".join(PASSAGE.split()[25:])),
    (15, PASSAGE + " " + PASSAGE),
    (16, "A line that many share\nown line sixteen\n  a LINE that many share  \nshort"),
    (17, "a line that many share\nshort\nown line seventeen"),
    (18, LONG),
    (19, LONG + " x"),
    (20, "Ünïcödé ÄÖ straße 漢字 🙂 é " * 9),
    (21, "it's we'll 123 456,789 don't!!! #*$%&|<>"),
    (22, "repeat\nrepeat\n\nrepeat\nother line here\n"),
]


@pytest.fixture(scope="module", params=["odd", "table"])
def rows(request, spark, sf):
    if request.param == "odd":
        return ODD
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def docs(rows, spark):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # Names that clash with those in use inside.
    for c in ("id", "n", "fp", "anchor", "tokens", "_id", "value", "length", "h", "bucket"):
        df = df.withColumn(c, df.text)
    return df


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_token_counts(docs, rows):
    assert got(token_counts.token_counts(docs, default_tokenizer()), "doc_id", "n_bytes", "n_tokens", "over_limit") == op1(rows)


def test_token_cache_is_reused(spark, rows, docs):
    cache = scratch(spark, "cache")
    first = got(token_counts.token_counts(docs, default_tokenizer(), cache), "doc_id", "n_tokens")
    n = spark.read.parquet(cache).count()
    assert n == len({t or "" for _, t in rows})
    assert got(token_counts.token_counts(docs, default_tokenizer(), cache), "doc_id", "n_tokens") == first
    assert spark.read.parquet(cache).count() == n


def test_warc(spark, rows):
    pages = [(p, f"http://www.example.com/{p % 3}", h) for p, h in rows] + [(900, "https://b.example.org/#x", "same\r\n\r\npage"), (901, None, "same\r\n\r\npage")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", queries.F.lit(1))
    date = queries.F.concat(queries.F.lit("20"), (99 - queries.F.pmod("page_id", queries.F.lit(90))).cast("string"), queries.F.lit("-01-01T00:00:00Z"))
    path = scratch(spark, "warc")
    out = warc.capture_index(df, path, archive_bytes=4_000, date=date)
    assert sorted(map(tuple, out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == op2([(p, h) for p, _, h in pages])
    found = out.collect()
    order = [(r.url_key, r.timestamp, r.page_id) for r in found]
    assert order == sorted(order) and len({r.timestamp for r in found}) > 5
    texts = {p: h for p, _, h in pages}
    assert len({r.archive for r in found}) > 5
    for r in found[::7]:
        with open(f"{path.removeprefix('file://')}/{r.archive}", "rb") as f:
            f.seek(r.offset)
            record = warc.read_record(f.read(r.length), 0, r.length)
        assert (record["page_id"], record["timestamp"], record["record_type"]) == (r.page_id, r.timestamp, r.record_type)
        assert r.record_type == "revisit" or record["payload"].decode() == (texts[r.page_id] or "")


def test_archive_is_plain_gzip(spark):
    """Any reader of gzip reads whole archives; a record of more than 16 MB has an empty member behind it."""
    import glob
    import gzip

    path = scratch(spark, "warc")
    df = spark.createDataFrame([(1, "http://a.b/", "é" * 9_000_000), (2, "http://a.b/", None), (3, None, "<p>x</p>")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, path)
    (name,) = glob.glob(f"{path.removeprefix('file://')}/*/*.txt")
    with gzip.open(name) as f:
        plain = f.read()
    assert plain.count(b"WARC/1.0\r\n") == 3 and plain.endswith(b"\r\n\r\n")
    rows = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert {p: r.payload_bytes for p, r in rows.items()} == {1: 18_000_000, 2: 0, 3: 8}
    with open(name, "rb") as f:
        data = f.read()
    for r in rows.values():
        assert warc.read_record(data, r.offset, r.length)["page_id"] == r.page_id


def test_quality(docs, rows):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality.quality_cascade(docs, stats=True)
    assert got(out, *cols) == op3(rows)
    assert out.filter("base_failed and kept").count() == 0
    kept = got(out.filter("kept"), "doc_id")
    assert got(quality.drop_low_quality(docs), "doc_id") == kept
    shown = {r.name: quality.Rule(r.name, r.rejects) for r in quality.BASE_RULES + quality.WEB_RULES}
    plain = [(d,) for d, t in rows if not any(r.rejects(quality.TextView(t)) for r in shown.values())]
    assert kept == sorted(plain)


def test_line_dedup(docs, rows):
    out = line_dedup.dedup_lines(docs).withColumn("kept", queries.F.sha2("text", 256))
    assert got(out, "doc_id", "n_lines", "n_dropped", "kept") == op4(rows)


def test_substring_dedup(docs, rows):
    out = substring_dedup.dedup_substrings(docs).withColumn("kept", queries.F.sha2("kept_text", 256))
    assert got(out, "doc_id", "n_words", "n_removed", "kept") == op5(rows)


def test_maximal_repeats(docs, rows):
    words = {d: (t or "").encode().split() for d, t in rows}
    seen, last = {}, None
    for r in substring_dedup.maximal_repeats(docs).orderBy("id", "source_id", F.col("source_start") - F.col("start"), "start").collect():
        n = r.end - r.start
        assert n >= 20 and (r.source_id, r.source_start) < (r.id, r.start)
        assert words[r.id][r.start : r.end] == words[r.source_id][r.source_start : r.source_start + n]
        key = (r.id, r.source_id, r.source_start - r.start)
        assert last is None or last[0] != key or last[1] < r.start  # neighbours have become one
        last = (key, r.end)
        seen.setdefault(r.id, set()).update(range(r.start, r.end))
    assert {d: len(x) for d, x in seen.items()} == {d: gone for d, _, gone, _ in op5(rows) if gone}
    with pytest.raises(ValueError):
        substring_dedup.matches(docs, size=5_000)


def test_packing(docs, rows):
    out = packing.pack_documents(docs, default_tokenizer())
    assert got(out, "doc_id", "piece", "start", "length", "ids_crc32") == op6_pieces(rows)
    held = {}
    for r in out.collect():
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for p in held.values() for _, n in p)
    assert len(held) <= 1.05 * -(-total // 2048) + 1


def test_token_id_output(spark, docs, rows):
    path = scratch(spark, "shards")
    binary_ids.write_shards(docs, path, default_tokenizer(), shard_ids=20_000)
    out = binary_ids.read_shards(spark, path)
    assert got(out, "doc_id", "start", "n_tokens", "ids_crc32") == op7(rows)
    some = {r.doc_id: r.ids for r in out.collect()}
    assert all(some[d] == [*ids(t), 2] for d, t in rows[:40])
    grammars = {(r.part, r.shard): binary_ids.Grammar(r.data) for r in spark.read.parquet(path).filter("row = 0").collect()}
    for r in spark.read.parquet(path).filter("row > 0").limit(10).collect():
        grammar = grammars[r.part, r.shard]
        assert grammar.ids(r.data).tolist() == some[r.doc_id]
        assert [grammar.token(r.data, i) for i in range(min(40, len(some[r.doc_id])))] == some[r.doc_id][:40]
    few = [d for d, _ in rows[3:6]]
    assert binary_ids.read_documents(spark, path, few) == {d: [some[d]] for d in few}


def test_edit_report(docs, rows):
    out = merkle.edit_report(docs)
    assert got(out, "doc_id", "n_chars", "edited_sha256") == op9(rows)
    texts = dict(rows)
    seen = {}
    for r in out.collect():
        assert seen.setdefault(r.fingerprint, texts[r.doc_id] or "") == (texts[r.doc_id] or "")
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (r.edit_at is None)
        assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint)
    order = sorted(out.collect(), key=lambda r: r.doc_id)
    for r, after in zip(order, [*order[1:], order[0]]):
        assert r.near_next == merkle.likeness(r.fingerprint, after.fingerprint)
        words = len(texts[r.doc_id] or "")
        if words > 1000 and r.fingerprint != r.edited_fingerprint:
            # Three quarters of the text stay, but for the leaf at the cut; what is put in may be like what went.
            assert 0.70 - merkle.MOST_BYTES / words <= r.near_edited <= 1 and r.edit_at >= words // 2


def plain_tree(text):
    """Leaf hashes below each paragraph, by the documented rules, line by line."""
    import hashlib
    import re

    out = []
    for line in re.findall(rb"[^\n]*\n|[^\n]+$", (text or "").encode()):
        clauses = [x for x in re.split(rb"(?<=[.!?;,:] )", line) if x]
        parts = []
        for c in clauses:
            start = 0
            if len(c) > merkle.LEAF_BYTES:
                at = (text or "").encode().index(line) + line.index(c)
                whole = (text or "").encode()
                for k in range(1, len(c)):
                    w = whole[max(0, at + k - 4) : at + k]
                    if len(w) == 4 and len(set(w)) > 1 and (int.from_bytes(w, "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 27 == 0:
                        parts.append(c[start:k])
                        start = k
            parts.append(c[start:])
        parts = [x[k : k + merkle.MOST_BYTES] for x in parts for k in range(0, len(x), merkle.MOST_BYTES)]
        out.append([hashlib.blake2b(x, digest_size=6).digest() for x in parts])
    return out


@pytest.mark.parametrize("text", ["", "one", "a, b. c\n\nd", "x" * 500, "\n".join(f"line {i}, with some words; and {i * 7919} more of them without any mark at all up to the end" for i in range(40))])
def test_tree_is_rebuilt_plainly(text):
    tree = merkle.Tree.of(text)
    paragraphs = plain_tree(text)
    assert tree.hashes[0] == [h for p in paragraphs for h in p]
    assert len(tree.hashes) < 2 or len(tree.hashes[1]) == len(paragraphs)
    again = merkle.Tree.parse(tree.fingerprint())
    assert again.hashes == tree.hashes and again.weights == tree.weights and again.root == tree.root
    assert sum(tree.weights[0]) == len(text.encode())


def test_simhash(docs, rows):
    assert got(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == op10(rows)
    kept = {d for d, _, c in op10(rows) if d == c}
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == kept
