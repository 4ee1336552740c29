"""Plain versions of the operators for small tables, from their contracts alone."""

import hashlib
import re

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WHITE.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def substring(rows, window=50):
    """{doc_id: (n_words, n_removed, kept_sha256)} of (doc_id, text)."""
    least = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(i, least.get(k, i))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def suffix(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} of (doc_id, text)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            if k in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(k)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def near(rows, width=3):
    """{doc_id: (n_shingles, component_id, kept)} of (doc_id, text)."""
    sets, seen = {}, {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sorted(sets.items()):
        shared = {}
        for g in s:
            for k in seen.get(g, ()):
                shared[k] = shared.get(k, 0) + 1
            seen.setdefault(g, []).append(i)
        for k, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(sets[k]) - n):
                a, b = sorted((find(i), find(k)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(rows, items, window=10):
    """{doc_id: (n_words, places of hit words, items)} of (doc_id, text) and (item_id, text)."""
    tests = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            tests.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in rows:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in tests}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in tests:
                    hit.update(range(k, k + n))
                    found |= tests[tuple(w[k : k + n])]
        out[i] = (len(w), sorted(hit), sorted(found))
    return out
