import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritab.llm import bpe, packing, pretokens


def split(texts):
    raw = [t.encode() for t in texts]
    start, end, owner = pretokens.split(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    joined, out = b"".join(raw), [[] for _ in texts]
    for a, b, k in zip(start, end, owner, strict=True):
        out[k].append(joined[a:b].decode())
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'stmdrevl  \n\t1²٣é!?漢😀\x85"), st.characters(exclude_categories=["Cs", "Cn"]))), max_size=4))
def test_pretokens_are_those_of_the_pattern(texts):
    assert split(texts) == [regex.findall(public.PATTERN, t) for t in texts]


def reference():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=pretokens.read_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_encoding_and_decoding(docs, texts, empty):
    found = {r.doc_id: r for r in bpe.op8_bpe(docs).collect()}
    for k, t in enumerate(texts):
        ids = reference().encode_ordinary(t or "")
        assert (found[k].n_tokens, found[k].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert found[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert not bpe.op8_bpe(empty).collect()
    assert bpe.op8_bpe(docs.limit(3).union(docs.limit(3))).count() == 6


def check_packing(rows, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[k])) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or s == max(by_sequence)


def test_packing(docs, texts, empty):
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}
    check_packing(packing.op9_packing(docs).collect(), ids)
    assert not packing.op9_packing(empty).collect()
    assert sum(r.length for r in packing.op9_packing(docs.union(docs)).collect()) == 2 * sum(map(len, ids.values()))


def test_hilbert_neighbours_are_neighbours():
    rng = random.Random(0)
    points = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)]) * (1 << (packing.BITS - 3))
    order = np.argsort(packing.hilbert(points))
    assert len(set(packing.hilbert(points).tolist())) == len(points)
    steps = np.abs(np.diff(points[order], axis=0)).sum(axis=1) >> (packing.BITS - 3)
    assert (steps == 1).all() and rng
