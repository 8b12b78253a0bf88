"""Plain Python statements of what the operators return."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def packed(values):
    import numpy as np

    return np.asarray(values, "<u4").tobytes()


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op1(rows):
    return sorted((d, len((t or "").encode()), n := len(ids(t)), n > 1024) for d, t in rows)


def op2(rows):
    last = defaultdict(int)
    for p, h in rows:
        last[h or ""] = max(last[h or ""], p)
    out = []
    for p, h in rows:
        h = h or ""
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        again = p != last[h]
        out.append((p, len(h.encode()), digest, "revisit" if again else "response", last[h] if again else None))
    return sorted(out, key=str)


def op3(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    return sorted(out)


def op4(rows):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(space).translate(lower)
    where = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                where[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(w := where.get(key(x), ())) >= 2 and min(w) != d)]
        out.append((d, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return sorted(out)


def op5(rows, size=20):
    first = {}
    for d, t in sorted(rows):
        w = words(t)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (d, i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (d, i):
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def op6_pieces(rows, size=2048):
    out = []
    for d, t in rows:
        v = [*ids(t), 0]
        n = len(v) % size or size
        cuts = [(0, min(n, len(v)))] + [(a, size) for a in range(n, len(v), size)]
        out += [(d, k, a, m, zlib.crc32(packed(v[a : a + m]))) for k, (a, m) in enumerate(cuts)]
    return sorted(out)


def op7(rows):
    out, at = [], 0
    for d, t in sorted(rows):
        v = [*ids(t), 2]
        out.append((d, at, len(v), zlib.crc32(packed(v))))
        at += len(v)
    return sorted(out)


def op9(rows):
    rows = sorted(rows)
    out = []
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        out.append((d, len(t), sha(t[: len(t) - n] + after[:n])))
    return out


def fingerprint(text):
    import xxhash

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = words((text or "").translate(lower))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def op10(rows, within=3):
    fps = [(d, fingerprint(t)) for d, t in rows]
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= within:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, f"{fp:016x}", find(d)) for d, fp in fps)
