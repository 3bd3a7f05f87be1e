"""Plain versions of what the operators compute."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = words(lower(text))
    return set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else ({tuple(w)} if w else set())


def components(sets, percent=80):
    """Smallest index reachable, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(x) for x in range(len(sets))]


def removed(texts, length=100):
    """For each text the flags of its removed bytes."""
    seen, out = set(), []
    for raw in [(t or "").encode() for t in texts]:
        flags = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                flags[p : p + length] = b"\1" * length
            else:
                seen.add(raw[p : p + length])
        out.append(flags)
    return out


def counts(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    often, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if often[x] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]
