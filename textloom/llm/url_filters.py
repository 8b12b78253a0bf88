"""URL filters from lists of any length: sorted arrays of digests, mapped into memory.

A list of rules (host, path, verdict) is sorted by the 64-bit xxHash of its keys and written
once, by Spark, as files that are arrays as they lie: digests, places of strings, strings,
values.  Every executor fetches the files and maps them, so that a list costs address space
and page cache instead of heap, and URLs are judged without a shuffle.  Keys of a batch are
probed by one vectorised binary search; a hit counts only if the stored string is the key,
and of keys with equal digests each is looked at.

A host has an entry of its own, with the lengths of the paths that its rules have.  A URL's
host and parent hosts are looked up first; only where one is known are its paths tried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.runtime import scratch

SEED = 42
#: Rows of a file of the list, which are sorted in one task's memory.
FILE_ROWS = 1 << 20
HEAD = 4
VERDICTS = ("allow", "block")
#: A host's entry and a rule's entry; keys of the one are never keys of the other.
HOST, RULE = b"h", b"r"


def host_of(url: Column) -> Column:
    """From behind the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` and of null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host to `?`, `#` or the end; empty without `://` and of null."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(key: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key, SEED)


class DigestArray:
    """One file of a list: sorted digests, with the strings and values that they stand for.

    The file is HEAD numbers of 64 bits (rows, bytes of strings), digests, places of the
    strings (one more than rows), places of the values (the same), then strings and values.
    """

    def __init__(self, path: str):
        import numpy as np

        data = np.memmap(path, np.uint8, "r")
        rows, size = (int(x) for x in data[:16].view("<u8"))
        at = 8 * HEAD
        self.digests, self.places, self.value_places = (data[at + 8 * a : at + 8 * b].view("<u8") for a, b in ((0, rows), (rows, 2 * rows + 1), (2 * rows + 1, 3 * rows + 2)))
        at += 8 * (3 * rows + 2)
        self.strings, self.values = data[at : at + size], data[at + size :]

    @staticmethod
    def pack(rows: list[tuple[int, bytes, bytes]]) -> bytes:
        import numpy as np

        rows = sorted(rows)
        ends = lambda k: np.concatenate([[0], np.cumsum([len(r[k]) for r in rows], dtype=np.uint64)]).astype("<u8")
        strings = b"".join(r[1] for r in rows)
        head = np.array([len(rows), len(strings)] + [0] * (HEAD - 2), "<u8")
        return b"".join([head.tobytes(), np.array([r[0] for r in rows], "<u8").tobytes(), ends(1).tobytes(), ends(2).tobytes(), strings, *[r[2] for r in rows]])

    def probe(self, digests, keys: list[bytes]) -> list[bytes | None]:
        """The value of each key, null where the list has none; `digests` are those of the keys."""
        import numpy as np

        out: list[bytes | None] = [None] * len(keys)
        at = np.searchsorted(self.digests, digests)
        live = np.arange(len(keys))
        while len(live):
            live = live[at[live] < len(self.digests)]
            live = live[self.digests[at[live]] == digests[live]]
            confirmed = np.zeros(len(live), bool)
            for n, i in enumerate(live):
                k = int(at[i])
                if self.strings[int(self.places[k]) : int(self.places[k + 1])].tobytes() == keys[i]:
                    out[i] = self.values[int(self.value_places[k]) : int(self.value_places[k + 1])].tobytes()
                    confirmed[n] = True
            live = live[~confirmed]
            at[live] += 1  # another string with the same digest
        return out


class UrlList:
    """All files of a list; they share out the digests by ranges."""

    def __init__(self, paths: list[str], hashed: Callable[[bytes], int] = digest):
        import numpy as np

        self.files = sorted((f for f in map(DigestArray, paths) if len(f.digests)), key=lambda f: int(f.digests[0]))
        self.lasts = np.array([f.digests[-1] for f in self.files], np.uint64)
        self.hashed = hashed

    def look_up(self, keys: list[bytes]) -> list[bytes | None]:
        import numpy as np

        out: list[bytes | None] = [None] * len(keys)
        if not keys:
            return out
        digests = np.fromiter(map(self.hashed, keys), np.uint64, len(keys))
        owner = np.searchsorted(self.lasts, digests)
        for k in np.unique(owner[owner < len(self.files)]):
            mine = np.flatnonzero(owner == k)
            for i, value in zip(mine, self.files[k].probe(digests[mine], [keys[i] for i in mine]), strict=True):
                out[i] = value
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of each URL: of all rules that fit, the one with the most characters; of two, that of the longer host."""
        suffixes: dict[str, list[bytes]] = {}
        for h in set(hosts):
            parts = h.split(".")
            suffixes[h] = [".".join(parts[i:]).encode() for i in range(len(parts))]
        asked = sorted({s for own in suffixes.values() for s in own})
        lengths = {s: [int(x) for x in v.split(b",")] for s, v in zip(asked, self.look_up([HOST + s for s in asked]), strict=True) if v is not None}
        known = {h: [s for s in own if s in lengths] for h, own in suffixes.items()}
        urls = sorted({(h, p) for h, p in zip(hosts, paths, strict=True) if known[h]})
        tries = {(s, p[:n].encode()) for h, p in urls for s in known[h] for n in lengths[s] if n <= len(p)}
        keys = sorted(tries)
        fits = {k: VERDICTS[v[0]] for k, v in zip(keys, self.look_up([RULE + s + b"\0" + p for s, p in keys]), strict=True) if v is not None}
        best = {}
        for h, p in urls:
            own = [(len(s.decode()) + n, len(s), s, p[:n]) for s in known[h] for n in lengths[s] if n <= len(p) and (s, p[:n].encode()) in fits]
            if own:
                _, _, s, path = max(own)
                best[h, p] = (s.decode() + path, fits[s, path.encode()])
        return [best.get(x, (None, None)) for x in zip(hosts, paths, strict=True)]


def write_list(rules: DataFrame, path: str, file_rows: int = FILE_ROWS, hashed: Callable[[bytes], int] = digest) -> None:
    """Write `rules` (host, path, verdict) as a list's files below `path`.

    Hosts are lower-cased (A-Z).  A null path is empty; a rule without a host or with another
    verdict than allow or block is dropped.  Of rules with the same host and path and
    different verdicts, block holds; repeated rules are one.  Without rules there is no file
    with entries.  Other columns do not matter.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = rules.select(F.translate("host", upper, upper.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")).alias("v"))
    rows = rows.filter("host is not null and v > 0").groupBy("host", "path").agg((F.max("v") - 1).cast("int").alias("v"))
    zero = F.lit(b"\0")
    of_rules = rows.select(F.concat(F.lit(RULE), F.col("host").cast("binary"), zero, F.col("path").cast("binary")).alias("key"), F.unhex(F.format_string("%02x", "v")).alias("value"))
    of_hosts = rows.groupBy("host").agg(F.array_join(F.sort_array(F.collect_set(F.length("path"))).cast("array<string>"), ",").alias("n"))
    of_hosts = of_hosts.select(F.concat(F.lit(HOST), F.col("host").cast("binary")).alias("key"), F.col("n").cast("binary").alias("value"))

    def with_digests(batches):
        import pyarrow as pa

        for batch in batches:
            # Ordered like unsigned numbers.
            codes = pa.array([hashed(k.as_py()) - (1 << 63) for k in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([codes, *batch.columns], names=["code", "key", "value"])

    def packed(batches):
        import pyarrow as pa

        own = [(c + (1 << 63), k, v) for b in batches for c, k, v in zip(*(x.to_pylist() for x in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([DigestArray.pack(own)], pa.binary())], names=["data"])

    entries = of_rules.union(of_hosts).mapInArrow(with_digests, "code long, key binary, value binary")
    files = max(1, -(-2 * rules.count() // file_rows))
    # Equal digests are in one file.  The text writer puts a binary's bytes out as they are.
    entries.repartitionByRange(files, "code").mapInArrow(packed, "data binary").select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def shared_list(spark, path: str) -> list[str]:
    """Let every executor fetch the files of a list; returns the names under which tasks find them."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = [str(f.getPath().toString()) for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p) if f.getPath().getName().startswith("part-")]
    for f in found:
        spark.sparkContext.addFile(f)
    return [f.rpartition("/")[2] for f in found]


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", file_rows: int = FILE_ROWS, hashed: Callable[[bytes], int] = digest) -> DataFrame:
    """(id, host, path, rule, verdict) of each row, without a shuffle of `pages`.

    A rule fits its host and all hosts below it, if the URL's path begins with the rule's.  Of
    rules that fit, the longest holds; without one the rule is null and the verdict `default`.
    A null URL, and one without `://`, has an empty host and path, which only a rule with an
    empty host fits.  Rows with null or repeated ids each give a row; other columns are not
    carried.  An empty table gives an empty result, an empty list the default for all rows.
    Executors hold a list on disk, about 100 bytes a rule, and map it; `rules` are written as
    `write_list` says when this is called.
    """
    spark = pages.sparkSession
    path = scratch(spark, "url-list")
    write_list(rules, path, file_rows, hashed)
    names = shared_list(spark, path)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import SparkFiles

        known = UrlList([SparkFiles.get(n) for n in names], hashed)
        for batch in batches:
            found = known.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            columns = [pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["id", "host", "path", "rule", "verdict"])

    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
