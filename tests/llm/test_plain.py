"""Training steps and the whole pipeline against plain versions that go document by document."""

import math
import os
import random
import sys
from collections import Counter

import brute
import numpy as np
import public_tokenizers as public
import pytest
from test_tokens import check_packing
from tokenizers import Tokenizer

from veritab.llm import language_id, queries
from veritab.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"
TOP = os.path.join(os.path.dirname(queries.__file__), "..", "..")


def plain_posteriors(documents, rounds):
    """The probability of class good of each document, a tuple of votes."""
    p = [0.2 if qc.BAD in v else 0.95 if qc.GOOD in v else 0.5 for v in documents]
    n = len(documents)
    for _ in range(rounds):
        share = (sum(p) + 9) / (n + 10)
        tables = []
        for k, name in enumerate(qc.LABELLERS):
            table = [[1 + qc.PRIOR[c][v] * qc.PRIOR_WEIGHT * n for v in range(3)] for c in (0, 1)]
            for votes, good in zip(documents, p, strict=True):
                table[0][votes[k]] += 1 - good
                table[1][votes[k]] += good
            tables.append(qc.ANCHORED.get(name) or [[x / sum(row) for x in row] for row in table])
        was, p = p, []
        for votes in documents:
            odds = math.log(share / (1 - share))
            for k, v in enumerate(votes):
                odds += math.log(max(tables[k][1][v], 1e-12)) - math.log(max(tables[k][0][v], 1e-12))
            p.append(1 / (1 + math.exp(-max(-50, min(50, odds)))))
        if max(abs(a - b) for a, b in zip(was, p, strict=True)) < 1e-9:
            break
    return p


def test_expectation_maximisation_is_the_plain_one():
    rng = random.Random(4)
    documents = []
    for _ in range(400):
        bad = rng.random() < 0.2
        documents.append(tuple(rng.choices((qc.BAD, qc.GOOD, qc.NOTHING), (0.4, 0.3, 0.3) if bad else (0.03, 0.8, 0.17))[0] for _ in qc.LABELLERS))
    code = lambda votes: sum(v * 3**k for k, v in enumerate(votes))
    found = qc.expectation_maximisation(Counter(map(code, documents)))
    assert np.allclose([found[code(v)] for v in documents], plain_posteriors(documents, 100), atol=1e-7)


def plain_ftrl(examples, languages):
    """Weights after follow-the-regularised-leader with elastic net, one coordinate at a time; examples: (features, language)."""
    z, n = Counter(), Counter()

    def weight(key):
        if abs(z[key]) <= language_id.L1:
            return 0.0
        return -(z[key] - math.copysign(language_id.L1, z[key])) / ((language_id.BETA + math.sqrt(n[key])) / language_id.ALPHA + language_id.L2)

    rng = np.random.default_rng(9)
    for _ in range(language_id.ROUNDS):
        for k in rng.permutation(len(examples)).tolist():
            features, truth = examples[k]
            old = {(f, c): weight((f, c)) for f in features for c in range(languages)}
            power = [math.exp(sum(x * old[f, c] for f, x in features.items())) for c in range(languages)]
            for (f, c), w in old.items():
                g = (power[c] / sum(power) - (c == truth)) * features[f]
                z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / language_id.ALPHA * w
                n[f, c] += g * g
    return weight


def test_language_model_is_the_plain_one():
    rng = random.Random(6)
    idf, rows, examples = np.linspace(1, 3, language_id.WIDTH), [], []
    for k in range(60):
        lang = k % 3
        counts = Counter(rng.randrange(40 * lang, 40 * lang + 80) for _ in range(50))
        used = sorted(counts)
        rows.append({"lang": "abc"[lang], "slots": np.array(used, np.uint16).tobytes(), "counts": np.array([counts[u] for u in used], np.uint16).tobytes()})
        values = {u: math.log1p(counts[u]) * idf[u] for u in used}
        norm = math.sqrt(sum(x * x for x in values.values()))
        examples.append(({**{u: x / norm for u, x in values.items()}, language_id.WIDTH: 1.0}, lang))
    model = language_id.Model(rows, idf)
    weight = plain_ftrl([e for k, e in enumerate(examples) if k % 5], 3)
    plain = np.array([[weight((f, c)) for c in range(3)] for f in [*range(160), language_id.WIDTH]])
    assert np.allclose(model.weights[[*range(160), language_id.WIDTH]], plain, atol=1e-5) and (plain == 0).any()
    assert not model.weights[160 : language_id.WIDTH].any()

    def loss(t):
        total = 0.0
        for features, truth in examples[::5]:
            logits = [sum(x * weight((f, c)) for f, x in features.items()) / t for c in range(3)]
            total += math.log(sum(math.exp(x) for x in logits)) - logits[truth]
        return total

    assert loss(model.temperature) <= min(map(loss, np.geomspace(0.05, 10, 60))) + 1e-3


def plain_good(text, weights, stems):
    """The linear scorer on one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not brute.words(text):
        return False
    votes, _, words = qc.look(raw, np.array([0, len(raw)]), stems)
    values = {b: 1 + math.log(n) for b, n in Counter(int(w) % qc.WIDTH for w in words).items()}
    norm = math.sqrt(sum(x * x for x in values.values()))
    score = sum(x / norm * weights[b] for b, x in values.items()) + weights[-1]
    score += sum(weights[qc.WIDTH + 3 * k + int(v[0])] for k, v in enumerate(votes))
    return score >= math.log(qc.THRESHOLD / (1 - qc.THRESHOLD))


def plain_known(text, model, least=0.5):
    raw = np.frombuffer(text.encode(), np.uint8)
    ((counts, letters),) = language_id._ngrams(raw, np.array([0, len(raw)]))
    if not letters:
        return False
    x = {int(k): math.log1p(counts[k]) * model.idf[k] for k in np.flatnonzero(counts)}
    norm = math.sqrt(sum(v * v for v in x.values()))
    logits = sum(v / norm * model.weights[k].astype(float) for k, v in x.items()) + model.weights[language_id.WIDTH]
    power = np.exp((logits - logits.max()) / model.temperature)
    return power.max() / power.sum() >= least


@pytest.mark.skipif(not os.path.exists(os.path.join(TOP, "corpus_pipeline.py")), reason="no pipeline here")
def test_pipeline_is_the_plain_one(spark):
    """run() against plain decisions of all five stages; the models are the operators' own, their training is tested above."""
    sys.path.insert(0, TOP)
    import corpus_pipeline

    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = {r.doc_id: r for r in table.collect()}
    weights, _, stems = qc._fitted(table.select("doc_id", "text"), labels)
    good = [k for k in sorted(docs) if plain_good(docs[k].text or "", weights.value, stems)]
    model = language_id.fit(table.where(table.doc_id.isin(good)).where(~language_id.held_out()))
    known = [k for k in good if plain_known(docs[k].text, model)]
    roots = brute.components([brute.shingles(docs[k].text, 5) for k in known])
    kept = [k for at, k in enumerate(known) if roots[at] == at]
    assert len(docs) > len(good) >= len(known) > len(kept) > 500
    texts = {}
    for k, flags in zip(kept, brute.removed([docs[k].text for k in kept]), strict=True):
        raw = docs[k].text.encode()
        texts[k] = bytes(b for b, gone in zip(raw, flags, strict=True) if not gone).decode(errors="ignore")
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids + [0] for k, t in texts.items()}
    check_packing(corpus_pipeline.run(spark, SF).collect(), ids)
    assert any(texts[k] != docs[k].text for k in kept)
