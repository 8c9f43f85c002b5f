"""Scores and choices of the fitted models against their formulas, written out."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import language_id, lm_scoring


def test_scores_are_the_models_log_probabilities(spark, monkeypatch):
    """Softmax over all entries written out, and the share of a word within its class; null ids and unknown words too."""
    g = random.Random(9)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(1, 4)))
    common = [word() for _ in range(150)]
    rows = [(i, " ".join(g.choice(common) if g.random() < 0.5 else word() for _ in range(g.randint(0, 90)))) for i in range(260)]
    rows += [(None, "Only HELD out words qqqq " + common[0]), (500, None), (501, ""), (7, rows[7][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, score int").repartition(3)
    held = {}
    plain = lm_scoring.train_model
    monkeypatch.setattr(lm_scoring, "train_model", lambda *a: held.setdefault("model", plain(*a)))
    got = Counter((r.doc_id, r.held_out, r.n_tokens, round(r.score, 2)) for r in lm_scoring.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect())

    trained = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 != 2
    words = lambda t: [w.encode() for w in (t or "").lower().split()]
    counts = Counter(w for d, t in rows if trained(d) for w in words(t))
    top = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm_scoring.WORDS])}
    assert len(counts) > lm_scoring.WORDS
    tokens, kinds = Counter(), Counter()
    for w, n in counts.items():
        if w not in top:
            tokens[zlib.crc32(w[-2:]) % lm_scoring.CLASSES] += n
            kinds[zlib.crc32(w[-2:]) % lm_scoring.CLASSES] += 1
    m = held["model"]
    r, c, q, b = (x.astype(float) for x in m.arrays())
    want = Counter()
    for d, t in rows:
        before, total = [lm_scoring.END, lm_scoring.END], 0.0
        for w in [*words(t), None]:
            k = None if w in top or w is None else zlib.crc32(w[-2:]) % lm_scoring.CLASSES
            entry = lm_scoring.END if w is None else top[w] if w in top else lm_scoring.WORDS + k
            logits = (r[before[1]] * c[0] + r[before[0]] * c[1]) @ q.T + b
            total += (logits[entry] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / np.log(10)
            if k is not None:
                total += np.log10((counts[w] + 1) / (tokens[k] + kinds[k] + 1))
            before = [before[1], entry]
        want[(d, not trained(d), len(words(t)) + 1, round(total, 2))] += 1
    near = lambda x: sorted((repr(k[:3]), k[3]) for k, n in x.items() for _ in range(n))
    assert [k for k, _ in near(got)] == [k for k, _ in near(want)]
    assert np.allclose([s for _, s in near(got)], [s for _, s in near(want)], atol=0.03)


@pytest.mark.parametrize("parts", [("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "c"), ("a", "b", "c")])
def test_the_chosen_languages_are_the_best_of_all_sets(parts):
    g = random.Random(10)
    syllables = {"a": ["ra", "to", "mi", "ne"], "b": ["sku", "brel", "ont", "wig"], "c": ["xao", "quy", "eei", "zha"]}
    text = lambda k, n: " ".join("".join(g.choice(syllables[k]) for _ in range(g.randint(1, 3))) for _ in range(n))
    counts = np.stack([np.bincount(language_id.ngram_buckets(text(k, 4000)), minlength=language_id.BUCKETS) for k in "abc"]).astype(float)
    m = language_id.MixtureModel(["a", "b", "c"], counts, 3.0, 200)
    for n in (40, 150):
        mixed = " ".join(text(k, n) for k in parts)
        log = m.segments(language_id.ngram_buckets(mixed)).astype(float)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        value = {own: m._em(like, list(own))[0] - len(own) * 3.0 * np.log(len(log) + 1.0) for size in (1, 2, 3) for own in combinations(range(3), size)}
        best = max(value, key=value.get)
        found = m.infer(mixed)
        assert {k for k, _ in found} == {"abc"[i] for i in best} == set(parts)
        assert [p for _, p in found] == pytest.approx([1 / len(parts)] * len(parts), abs=0.15) and sum(p for _, p in found) == pytest.approx(1)
