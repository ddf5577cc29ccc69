"""Plain Python versions of the operators, used to check them on small tables."""

import hashlib
import re
from collections import Counter

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK_WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def licenses(text):
    words = WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    spans.sort()
    n = Counter(k for *_, k in spans)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    return n["assign"], n["access"], n["hex"], sha(joined), joined


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2)))


def components(texts):
    """Smallest position reachable by links of Jaccard similarity of at least 0.9."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= 90 * (len(a) + len(b) - shared):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def repeats(texts, width):
    """Per text: bytes, removed bytes, removed runs, SHA-256 of what is left."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = [True] * width
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def contaminated(text, items, width=13):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, phrase in items:
        p = WORD.findall(lower(phrase))
        n = min(width, len(p))
        for k in range(len(p) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i:i + n] == p[k:k + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    ids = sorted(map(str, found))
    return (len(words), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(words))


def shared_windows(rows, width=13):
    """Per (doc_id, text): doc_id, words, removed words, SHA-256 of the kept ones."""
    first = {}
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out
