"""WARC archives, and capture indexes by external merge.

Each record is a gzip member of its own, so that an index entry's offset and length in
the archive are enough to read it.  `write_archives` lets Spark's own text writer put the
members one after the other: a member of less than 16 MB ends in a zero byte (a longer
one is given an empty member behind it), so a zero is the writer's line separator, and
its commit protocol makes the archives whole under lost executors, in any store.
`index_runs` reads archives and writes locally sorted runs of index entries.
`merge_runs` deals the runs out by key range and merges the slices of each range with a
loser tree over one reader a run, so that ranges in order hold all captures in order of
URL key and timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.runtime import partitions, scratch, stored

END = "\r\n"
B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
ENTRY = "url_key string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, length long"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string in base32: five hex digits are four base32 digits."""
    digits = F.sha1(F.encode(payload, "UTF-8"))
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), *B32)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, without scheme, `www`, port 80/443, user or fragment, in lower case."""
    low = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""))
    rest = F.regexp_replace(low, "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), "^.*@|:(80|443)$", "")
    host = F.regexp_replace(host, r"^www\d*\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, "^[^/?]*", ""))


def _identity(page: Column) -> Column:
    return F.concat(F.lit("<urn:textloom:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _members(archive_bytes: int):
    """Records as gzip members without their last byte, a zero; archives of a task are numbered by the bytes before."""

    def run(batches):
        import zlib

        import pyarrow as pa

        written = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # bounded output for long records
                out, numbers, held = [], [], 0
                while at < batch.num_rows and held < 1 << 24:
                    own = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = own.compress(batch.column(0)[at].as_buffer()) + own.flush()
                    if member[-1]:
                        own = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member += own.compress(b"") + own.flush()
                    out.append(member[:-1])
                    numbers.append(written // archive_bytes)
                    written += len(member)
                    held += len(member)
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(numbers, pa.int32())], names=["member", "archive"])

    return run, "member binary, archive int"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | Column = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0, archive_bytes: int = 64 << 20) -> None:
    """Write one record for each row, in archives that end with the record that reaches `archive_bytes`.

    Of rows with equal payloads (by SHA-1) of at least `min_revisit_bytes`, that with the
    largest id is a response and the others are revisits of it; smaller payloads are all
    responses.  A null payload is empty.  A null id takes part as the smallest; rows that
    repeat the largest id are all responses.  A null URL is written as an empty one.
    Other columns are not carried.  Without rows no archive is written.
    """
    date = F.lit(date) if isinstance(date, str) else date
    base = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"), date.alias("date")
    )
    base = base.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload").cast("long")})
    # Written first, so that the join's sides are plain shuffles and Spark splits the rows of a payload that very many pages share.
    largest = stored(base.select("id", "digest").groupBy("digest").agg(F.max("id").alias("to")).filter("`to` is not null"), "largest")
    rows = base.join(largest, "digest", "left")
    again = (F.col("size") >= min_revisit_bytes) & F.col("to").isNotNull() & ~F.col("id").eqNullSafe(F.col("to"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit(f"WARC/1.0{END}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "), _identity(F.col("id")),
        F.lit(f"{END}WARC-Date: "), F.col("date"),
        F.lit(f"{END}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "),
        F.when(again, F.concat(F.lit(f"{END}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{END}WARC-Refers-To: "), _identity(F.col("to")))).otherwise(""),
        F.lit(f"{END}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END),
    )
    members = rows.select(F.concat(head, block, F.lit(END + END)).cast("binary").alias("record")).mapInArrow(*_members(archive_bytes))
    # A cast keeps a binary's bytes as they are, and the writer puts them out as they are.
    members.select("archive", F.col("member").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\0").text(path)


def parse_record(data: bytes, where: str = "") -> dict:
    """Fields of one record (uncompressed), its payload checked against its digest."""
    import base64
    import hashlib

    split = data.find(b"\r\n\r\n")
    lines = data[:split].decode("utf-8", "replace").split(END)
    if lines[0] != "WARC/1.0":
        raise ValueError(f"no record at {where}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    page = lambda x: None if (n := x.strip("<>").rpartition(":")[2]) == "none" else int(n)
    start, end = split + 4, split + 4 + int(fields["content-length"])
    body = data.index(b"\r\n\r\n", start) + 4
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        payload = data[body:end]
        n = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload at {where} has another digest")
    else:
        payload, n = None, int(data[start:body].lower().split(b"content-length: ")[1].split(b"\r")[0])
    return {
        "timestamp": fields["warc-date"], "page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "record_type": kind,
        "refers_to": page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload_digest": digest, "payload_bytes": n, "payload": payload,
    }


def read_record(data, offset: int, length: int) -> dict:
    """The record that an index entry names, from an archive's bytes (or a slice of them from `offset` 0)."""
    import gzip

    return parse_record(gzip.decompress(bytes(data[offset : offset + length])), f"offset {offset}")


def _records(data):
    """(offset, length, record) for each record of an archive: a member, or a member and the empty one behind it; one record is held at a time."""
    import zlib

    view, at, start, held = memoryview(data), 0, 0, b""
    while at < len(view):
        own, parts = zlib.decompressobj(31), []
        begin = at
        while not own.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            step = view[at : at + (1 << 16)]
            parts.append(own.decompress(step))
            at += len(step) - len(own.unused_data)
        record = b"".join(parts)
        if held and record:
            yield start, begin - start, held
            held = b""
        if record:
            start, held = begin, record
    if held:
        yield start, len(view) - start, held


def read_archives(spark, path: str) -> DataFrame:
    """One row for each record; offsets and lengths count in the archive as it is stored."""
    fields = ENTRY.split(", ", 1)[1]
    names = [c.split()[0] for c in fields.split(", ")]

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(k, pa.int64() if t == "long" else pa.string()) for k, t in (c.split() for c in fields.split(", "))])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = "/".join(name.as_py().split("/")[-2:])
                rows = {k: [] for k in names}
                for offset, length, record in _records(content.as_buffer()):
                    entry = parse_record(record, f"{archive}:{offset}") | {"archive": archive, "offset": offset, "length": length}
                    for k, column in rows.items():
                        column.append(entry[k])
                    if len(rows["offset"]) >= 10_000:
                        yield pa.RecordBatch.from_pydict(rows, schema=schema)
                        rows = {k: [] for k in names}
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    found = files.mapInArrow(run, fields)
    return found.select(url_key(F.col("url")).alias("url_key"), *names)


ORDER = ["url_key", "timestamp", "page_id", "archive", "offset"]


def index_runs(entries: DataFrame) -> DataFrame:
    """Sort each partition's entries (an archive's, or several archives') locally and keep them as runs."""
    return stored(entries.sortWithinPartitions(*ORDER), "capture-runs")


class LoserTree:
    """k-way merge: a tree of the losers of all matches, the winner on top.

    Each step replays only the path of the run that gave the last winner.
    """

    def __init__(self, runs: list, key):
        self._runs, self._key, self._at = runs, key, [0] * len(runs)
        self._size = 1
        while self._size < max(1, len(runs)):
            self._size *= 2
        self._losers = [-1] * self._size
        self._keys = [self._next_key(i) for i in range(self._size)]
        self._winner = self._play(1)

    def _next_key(self, i: int):
        """None sorts last: the run has ended."""
        if i < len(self._runs) and self._at[i] < len(self._runs[i]):
            return self._key(self._runs[i][self._at[i]])
        return None

    def _before(self, i: int, j: int) -> bool:
        a, b = self._keys[i], self._keys[j]
        return b is None or (a is not None and (a, i) <= (b, j))

    def _play(self, node: int) -> int:
        if node >= self._size:
            return node - self._size
        left, right = self._play(2 * node), self._play(2 * node + 1)
        if self._before(left, right):
            self._losers[node] = right
            return left
        self._losers[node] = left
        return right

    def __iter__(self):
        while self._keys[w := self._winner] is not None:
            yield self._runs[w][self._at[w]]
            self._at[w] += 1
            self._keys[w] = self._next_key(w)
            node = (w + self._size) // 2
            while node:
                if not self._before(w, self._losers[node]):
                    w, self._losers[node] = self._losers[node], w
                node //= 2
            self._winner = w


class Run:
    """A sorted slice of a run, in Arrow; its keys are made a block at a time as a reader goes on."""

    BLOCK = 4_096

    def __init__(self, rows, offset: int):
        self._rows, self._offset, self._block, self._keys = rows, offset, -1, []

    def __len__(self) -> int:
        return self._rows.num_rows

    def __getitem__(self, i: int) -> tuple:
        """(key, place among all rows)"""
        block, k = divmod(i, self.BLOCK)
        if block != self._block:
            self._block, self._keys = block, _keys(self._rows.slice(block * self.BLOCK, self.BLOCK))
        return self._keys[k], self._offset + i


def _keys(rows) -> list[tuple]:
    """Sort keys in Python's order: nulls first, strings by their bytes as Spark sorts them."""
    cols = [[v.encode() if isinstance(v, str) else v for v in rows.column(c).to_pylist()] for c in ORDER]
    return [tuple((v is not None, v) for v in k) for k in zip(*cols, strict=True)]


def _merge(batches):
    """Merge what arrives: each maximal ascending stretch is a slice of a run.

    A range's entries are held in Arrow; keys only for a block of each run.
    """
    from itertools import islice

    import pyarrow as pa

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    starts, last = [0], None
    for at in range(0, rows.num_rows, Run.BLOCK):
        keys = _keys(rows.slice(at, Run.BLOCK))
        before = [last, *keys[:-1]] if at else [keys[0], *keys[:-1]]
        starts += [at + i for i, (a, b) in enumerate(zip(before, keys, strict=True)) if b < a]
        last = keys[-1]
    runs = [Run(rows.slice(a, b - a), a) for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True)]
    merged = iter(LoserTree(runs, lambda x: x[0]))
    while at := [place for _, place in islice(merged, 10_000)]:
        yield from rows.take(pa.array(at)).combine_chunks().to_batches()


def merge_runs(runs: DataFrame, ranges: int | None = None, range_entries: int = 1_000_000) -> DataFrame:
    """All entries in order of URL key, timestamp, page and place, range by range.

    Ranges are cut by the whole sort key, so that a URL with very many captures spans
    several, and there are so many of them that one holds about `range_entries` entries
    at most: the bound of a task's memory.  Nulls come first.
    """
    ranges = ranges or max(partitions(runs.sparkSession), -(-runs.count() // range_entries))
    cols = [runs[c.split()[0]] for c in ENTRY.split(", ")]
    dealt = runs.select(*cols).repartitionByRange(ranges, *ORDER)
    return dealt.mapInArrow(_merge, ENTRY)


def capture_index(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write archives of `pages`, read them back and return their merged capture index."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path, **options)
    return merge_runs(index_runs(read_archives(spark, path)))
