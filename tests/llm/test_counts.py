"""Token counts without ids, and buckets of a text's words."""

import tracemalloc
from zlib import crc32

import pyarrow as pa

from textloom.llm import bpe, mixing
from textloom.llm.runtime import default_tokenizer


def peak(run):
    tracemalloc.start()
    got = run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return got, most


def test_counts_do_not_put_ids_together():
    own = bpe.Encoder(default_tokenizer())
    texts = pa.array([("qzxjkvwq" * 7 + " ") * 20_000, None, "", "a b\n c <|endoftext|> d", "é 字" * 50])
    with_ids, whole = peak(lambda: [n for _, ids, counts in own.chunks(texts) for n in counts.tolist()])
    counts, least = peak(lambda: own.counts(texts).tolist())
    assert counts == with_ids == [len(own.encode(t or "")) // 4 for t in texts.to_pylist()] and counts[1:3] == [0, 0]
    assert 2 * least < whole


def test_buckets_are_those_of_each_word_alone():
    text = "The STONE, (stone) x y X été! a|b\n\n #1 A\n"
    words = {w.strip(b".,;:!?\"'()[]*#%&$|") for w in text.encode().lower().split()}
    found = mixing.features(text).tolist()
    assert {crc32(w) % mixing.BUCKETS for w in words} <= set(found) and len(set(found) - {crc32(w) % mixing.BUCKETS for w in words}) <= 5
    assert mixing.features("").tolist() == [crc32(f"\0{k}:0".encode()) % mixing.BUCKETS for k in ("capitals", "symbols", "distinct", "lines", "length")]
