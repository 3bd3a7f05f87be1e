"""The pre-tokens of byte-level BPE, found with array operations.

The split pattern is
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Every character is a letter, a number, white space or something else.  Runs of one
class are tokens, with four rules: a blank just before a run of another class joins it;
of white space before other text the last character stands alone unless it joins;
white space at the end is one token; an apostrophe that stands alone, not after a
blank, takes the letters s, t, m, d, re, ve or ll that follow it.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

from . import textbytes as tb

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Bytes of text whose pre-tokens are brought together, and that are split at a time.
CHUNK, PART = 8 << 20, 1 << 20


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    everything = "".join(map(chr, points))
    for pattern, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, everything):
            a, b = m.span()
            table[points[a] : points[b - 1] + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def split(data: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) in bytes of every pre-token of a batch of texts.

    special: a string that is one token wherever it stands, cutting the text around it."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    raw = data.tobytes()
    marks = []
    if special:
        at = raw.find(special)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, side="right"))
            whole = at + len(special) <= offsets[k]
            if whole:
                marks.append(at)
            at = raw.find(special, at + (len(special) if whole else 1))
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    kind = _classes()[points]
    n = len(points)
    ends = np.concatenate([offsets, marks, np.array(marks, np.int64) + len(special)]) if marks else offsets
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(byte_at, ends)] = True
    new = edge[:n].copy()
    new[0] = True
    new[1:] |= kind[1:] != kind[:-1]
    s = np.flatnonzero(new)
    e = np.append(s[1:], n)
    k = kind[s]
    size = e - s
    follows = ~edge[s]  # the run before it belongs to the same text
    space_before = np.zeros(len(s), bool)
    space_before[1:] = follows[1:] & (k[:-1] == SPACE) & (points[s[1:] - 1] == 0x20)
    begins = np.zeros(n + 1, bool)
    text = k != SPACE
    begins[s[text] - space_before[text]] = True
    last = np.append(~follows[1:], True)  # nothing of the same text comes after
    blank = ~text
    begins[s[blank & (last | (size > 1))]] = True
    alone = blank & ~last & (points[e - 1] != 0x20)
    begins[e[alone] - 1] = True

    quote = np.flatnonzero((k == OTHER) & (size == 1) & (points[s] == 0x27) & ~space_before & ~last)
    quote = quote[k[quote + 1] == LETTER] if len(quote) else quote
    if len(quote):
        at, room = s[quote], size[quote + 1]
        one = points[at + 1]
        two = np.where(room > 1, points[np.minimum(at + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ~single & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for hit, width in ((single, 1), (double, 2)):
            begins[at[hit] + 1] = False
            longer = hit & (room > width)
            begins[at[longer] + 1 + width] = True
    for m in marks:
        c = int(np.searchsorted(byte_at, m))
        begins[c : c + len(special)] = False
        begins[c] = True
    start = np.flatnonzero(begins[:n])
    stop = np.append(start[1:], n)
    start, stop = byte_at[start], byte_at[stop]
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def distinct(column, size: int = CHUNK, special: bytes = b""):
    """For every chunk of a column of texts: (first, last text, bytes, start and end of the different pre-tokens
    in the order of their hashes, those hashes, pre-tokens of each text, number of each pre-token).

    Parts of a chunk are reduced to their different pre-tokens one by one, so that only four
    bytes of each pre-token are held for a whole chunk."""
    everything, all_offsets = tb.buffers(column)
    for f, to in tb.chunks(all_offsets, size):
        data, offsets = everything[all_offsets[f] : all_offsets[to]], all_offsets[f : to + 1] - all_offsets[f]
        found, which, counts = [], [], []
        for a, b in tb.chunks(offsets, PART):
            base = offsets[a]
            part = data[base : offsets[b]]
            start, end, doc = split(part, offsets[a : b + 1] - base, special)
            hashes, one, number = np.unique(tb.slice_hashes(tb.prefix_hashes(tb.byte_values(part)), start, end), return_index=True, return_inverse=True)
            found.append((hashes, start[one] + base, end[one] + base))
            which.append(number.astype(np.int32))
            counts.append(np.bincount(doc, minlength=b - a))
        hashes, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        hashes, one, number = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = np.cumsum([0] + [len(x[0]) for x in found])
        which = np.concatenate([number[m : m + len(x[0])].astype(np.int32)[w] for m, x, w in zip(sizes.tolist(), found, which, strict=False)])
        yield f, to, data, start[one], end[one], hashes, np.concatenate(counts), which


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def encoder(path: str, pattern: str):
    """word -> ids, for words that are one pre-token."""
    import tiktoken

    made = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return made._core_bpe.encode_ordinary if hasattr(made, "_core_bpe") else made.encode_ordinary


def spread(flat: np.ndarray, at: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[at[w] : at[w] + size[w]] for each w of which, joined; and where each ends."""
    n = size[which]
    ends = np.cumsum(n)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[which] - (ends - n), n)
    return flat[index], ends


@lru_cache(2)
def id_type(path: str) -> type:
    """The narrowest unsigned integer that holds every id of a vocabulary."""
    return np.uint16 if max(read_ranks(path).values()) < 1 << 16 else np.uint32
