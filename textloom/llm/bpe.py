"""Exact byte-level BPE ids from the tokenizers library, by the distinct units of a batch.

The byte-level pre-tokenizer always begins a new piece at a lone space or line feed that
stands right before a character that is not white space: white space before it is a piece
that ends there, and the space goes to the word behind it.  It also begins one at an ASCII
mark (but the apostrophe) right behind an ASCII letter.  So a text may be cut at such
places and each unit encoded by itself.  Arrow tells the distinct units of a batch, the
library (or the memo) their ids, and one gather puts the ids of all texts together.  A
text with a special token's string is given to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from textloom.llm.runtime import one_thread

#: Bytes of one id in the packed form (unsigned, little-endian).
ID_BYTES = 4
#: Bytes of text that are encoded together, and units in one call of the library.
CHUNK, CALL = 1 << 22, 256
#: Lead bytes under which white space outside ASCII may hide: texts are not cut before them.
DOUBTFUL = (0xC2, 0xE1, 0xE2, 0xE3)


class Encoder:
    """Ids (unsigned 32-bit) of texts.

    The memo holds about `max_units` units of at most `max_bytes` bytes and begins anew
    when it is full, so its memory has a bound.
    """

    def __init__(self, path: str, max_units: int = 700_000, max_bytes: int = 64):
        one_thread()
        import json

        import numpy as np
        from tokenizers import Tokenizer

        self._np = np
        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self._cuts = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
        )
        #: Ids are below this.
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._memo: dict[bytes, bytes] = {}
        self._max_units, self._max_bytes = max_units, max_bytes
        before, mark, letter = np.zeros((3, 256), bool)
        before[33:] = True
        before[list(DOUBTFUL)] = False
        mark[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
        letter[[*range(65, 91), *range(97, 123)]] = True
        if self._cuts:
            known = self._tokenizer.get_vocab()
            space, feed = (self._tokenizer.encode(x, add_special_tokens=False).tokens[0] for x in (" ", "\n"))
            self._spaced = np.zeros(max(known.values()) + 1, bool)
            self._spaced[[i for token, i in known.items() if token.startswith(space)]] = True
            self._feed_id = known[feed]
        #: Bytes before which a space or a line feed begins a piece; marks but the apostrophe; letters.
        self._before, self._mark, self._letter = before, mark, letter

    def _ask(self, units: list[bytes], spaced: bool) -> list[bytes]:
        """Packed ids of units that begin with the only space (or line feed) in them, or with a word, many in a call of the library.

        The first id of a unit is then the only one that begins with a space; in the other
        case each unit stands behind a line feed, and the ids of line feeds tell them apart.
        """
        np, out = self._np, []
        own = units if spaced else [b"\n" + u.removeprefix(b"\n") for u in units]
        calls = [b"".join(own[i : i + CALL]).decode("utf-8", "replace") for i in range(0, len(own), CALL)]
        for k, e in enumerate(self._tokenizer.encode_batch_fast(calls, add_special_tokens=False)):
            ids = np.asarray(e.ids, dtype="<u4")
            starts = np.flatnonzero(self._spaced[ids] if spaced else ids == self._feed_id)
            raw, ends = ids.tobytes(), (ID_BYTES * np.append(starts[1:], len(ids))).tolist()
            some = units[k * CALL : (k + 1) * CALL]
            if len(starts) != len(some):
                raise ValueError("the library joined words across white space")
            starts = (ID_BYTES * starts).tolist()
            if spaced:
                out += [raw[a:b] for a, b in zip(starts, ends, strict=True)]
            else:  # a line feed that was put before a unit is not the unit's
                out += [raw[a if u[:1] == b"\n" else a + ID_BYTES : b] for u, a, b in zip(some, starts, ends, strict=True)]
        return out

    def _packed(self, distinct) -> list[bytes]:
        """Packed ids of distinct units (an Arrow binary array)."""
        np, units = self._np, distinct.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each first
        if len(self._memo) > self._max_units:
            self._memo = {}
        memo = self._memo
        out = list(map(memo.get, units))
        missing = np.array([k for k, ids in enumerate(out) if ids is None], np.int64)
        if not len(missing):
            return out
        bounds = np.frombuffer(distinct.buffers()[1], np.int32, len(units) + 1)
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        blanks = np.concatenate(([0], np.cumsum(data <= 32)))
        one, size = blanks[bounds[1:]] - blanks[bounds[:-1]], np.diff(bounds)
        first, second = data[bounds[:-1]], data[np.minimum(bounds[:-1] + 1, len(data) - 1)]
        led = (one == 1) & (size > 1) & self._before[second] & self._cuts
        spaced = led & (first == 32)
        fed = (led & (first == 10)) | ((one == 0) & self._before[first] & self._cuts)
        for together, which in ((spaced, True), (fed, False)):
            some = missing[together[missing]].tolist()
            for k, ids in zip(some, self._ask([units[k] for k in some], which), strict=True):
                out[k] = ids
        alone = missing[~(spaced | fed)[missing]].tolist()
        found = self._tokenizer.encode_batch_fast([units[k].decode("utf-8", "replace") for k in alone], add_special_tokens=False)
        for k, e in zip(alone, found, strict=True):
            out[k] = np.asarray(e.ids, dtype="<u4").tobytes()
        memo.update((units[k], out[k]) for k in missing[size[missing] <= self._max_bytes].tolist())
        return out

    def _units(self, data, offsets):
        """(packed ids of distinct units, the number of each unit in turn, how many ids come before each, which unit begins each text) of the texts that `offsets` cut out of `data`."""
        import pyarrow as pa

        np = self._np
        offsets = offsets - offsets[0]
        starts, ends = offsets[:-1], offsets[1:]
        filled = ends > starts
        if not len(data):
            return [], np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
        mark = np.zeros(len(data), bool)
        if self._cuts:
            gap = (data == 32) | (data == 10)
            np.logical_and(gap[:-1], self._before[data[1:]], out=mark[:-1])
            mark[1:] |= self._letter[data[:-1]] & self._mark[data[1:]]
            whole = data.tobytes()
            for s in self._special:
                at = whole.find(s)
                while at >= 0:  # no cut in a text that holds it
                    k = int(np.searchsorted(starts, at, side="right")) - 1
                    while ends[k] <= at:
                        k += 1
                    mark[starts[k] : ends[k]] = False
                    at = whole.find(s, int(ends[k]))
        mark[ends[filled] - 1] = False
        mark[starts[filled]] = True
        cuts = np.flatnonzero(mark)
        bounds = np.append(cuts, len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        packed = self._packed(units.dictionary)
        number = units.indices.to_numpy()
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // ID_BYTES
        total = np.concatenate(([0], np.cumsum(sizes[number])))
        return packed, number, total, np.searchsorted(cuts, offsets)

    def _chunk(self, data, offsets):
        """(ids, how many each text has) of the texts that `offsets` cut out of `data`."""
        np = self._np
        packed, number, total, first = self._units(data, offsets)
        ids = np.zeros(0, "<u4")
        if packed:
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // ID_BYTES
            where = np.cumsum(sizes) - sizes
            pool = np.frombuffer(b"".join(packed), "<u4")
            ids = pool[np.repeat(where[number] - total[:-1], np.diff(total)) + np.arange(total[-1])]
        return ids, np.diff(total[first])

    def chunks(self, texts) -> Iterator[tuple]:
        """(first, ids, counts) for runs of the rows of an Arrow string array from row `first` on.

        `ids` are the ids of the run's texts one after the other, `counts` how many each
        has; a null text has none.  Runs hold about CHUNK bytes, or one longer text.
        """
        for first, *run in self._runs(texts):
            yield first, *self._chunk(*run)

    def _runs(self, texts) -> Iterator[tuple]:
        """(first, data, offsets) of the runs."""
        import pyarrow as pa

        np = self._np
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
            yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1]
            first = last

    def counts(self, texts):
        """How many ids each row of an Arrow string array has."""
        np = self._np
        found = (self._units(*run) for _, *run in self._runs(texts))  # ids need not be put together
        return np.concatenate([np.zeros(0, np.int64), *[np.diff(total[first]) for _, _, total, first in found]])

    def encode(self, text: str) -> bytes:
        """Packed ids of one text."""
        import pyarrow as pa

        return b"".join(ids.astype("<u4").tobytes() for _, ids, _ in self.chunks(pa.array([text], pa.string())))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
