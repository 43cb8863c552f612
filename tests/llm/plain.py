"""Plain forms of the text operators, for small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return ALNUM.findall((text or "").translate(LOW))


def decontaminated(docs, bench, window=10):
    """(id, n_words, n_hit, n_items, items_sha256, contaminated)"""
    found = {}
    for i, t in bench:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            found.setdefault(tuple(w[a : a + k]), set()).add("" if i is None else str(i))
    sizes = {len(k) for k in found}
    for i, t in docs:
        w = words(t)
        hit, items = [0] * len(w), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                x = found.get(tuple(w[a : a + k]))
                if x:
                    items |= x
                    hit[a : a + k] = [1] * k
        yield i, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), sum(hit) > 0


def simhash(text, shingle):
    w = SPACED.findall((text or "").translate(LOW))
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else ([" ".join(w)] if w else [])
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(docs, shingle, bits=3):
    """{id: (fingerprint, smallest id of its group)}"""
    prints = {i: simhash(t, shingle) for i, t in docs}
    ids = sorted(prints)
    group = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= bits])
    return {i: (prints[i], group[i]) for i in ids}


def suffix_dedup(docs, length=50):
    """(id, n_bytes, n_removed, n_spans, kept_sha256)"""
    least = {}
    for i, t in docs:
        b = (t or "").encode()
        if i is not None:
            for o in range(len(b) - length + 1):
                k = b[o : o + length]
                least[k] = min(least.get(k, i), i)
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for o in range(len(b) - length + 1):
                if least[b[o : o + length]] < i:
                    gone[o : o + length] = True
        starts = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        yield i, len(b), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def repetition(text, min_words=8):
    w = SPACED.findall(text or "")
    n = len(w)

    def covered(k):
        seen, out = Counter(tuple(w[i : i + k]) for i in range(n - k + 1)), [0] * n
        for i in range(n - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                out[i : i + k] = [1] * k
        return sum(out)

    longest, k = 0, 1
    while any(v > 1 for v in Counter(tuple(w[i : i + k]) for i in range(n - k + 1)).values()):
        longest, k = k, k + 1
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            dup += line in lines
            lines.add(line)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup, "n_repeat_words": covered(3), "n_covered": covered(min_words), "longest_repeat": longest}


def levenshtein(a, b):
    """Bit-parallel over whole numbers: bit i of up and down says how row i differs from the row above it."""
    if not a or not b:
        return len(a) + len(b)
    at = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, top, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0
    for c in b:
        same = at.get(c, 0)
        level = ((same & up) + up ^ up) | same
        right, left = (down | every & ~(level | up)) & every, up & level
        distance += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down = (left | every & ~(same | down | right)) & every, right & (same | down)
    return distance
