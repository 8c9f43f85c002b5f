"""Sets of tokens are moved only for pairs that need them, and wide signatures keep pairs of large sets apart."""

import numpy as np
from pyspark.sql import functions as F

from strideframe.llm import jaccard_join, substring_dedup
from strideframe.llm.jaccard_join import parity_signature


def table_of(spark, sets):
    rows = [(i, len(s), s, [1], parity_signature(np.array(s, np.uint64), 4).tolist(), parity_signature(np.array(s, np.uint64), 32).tolist() if len(s) > 64 else []) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "node long, n long, tokens array<long>, p1 array<long>, sign array<long>, wide array<long>")


def test_large_sets_are_told_apart_before_they_are_shuffled(spark, monkeypatch):
    counts, plain = {}, jaccard_join.settle

    def kept(df, label):
        out = plain(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "settle", kept)
    sets = [list(range(0, 1000)), list(range(450, 1450)), list(range(50, 1050)), list(range(5000, 5020)), list(range(5001, 5021))]
    table = plain(table_of(spark, sets), "sets")
    whole = plain(table.select("node", "tokens").union(table.select("node", "tokens")), "whole")  # a node may come twice
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (3, 4), (2, 3)], "a long, b long")
    links = jaccard_join._verified(pairs, table.drop("tokens"), 80, whole)
    assert sorted((r.a, r.b) for r in links.collect()) == [(0, 2), (3, 4)]
    assert counts["near"] == 2  # 256 bits alone let the pairs of 1000 tokens with half in common through


def test_signatures_and_sets_of_units():
    words = [f"w{i % 9}" for i in range(40)] + [f"x{i}" for i in range(90)]
    u = substring_dedup.Units([" ".join(words).encode(), b"a " * 30], 5, 25, 80, 3, 1)
    at = np.arange(len(u.at))
    sizes, tokens, signs, wide = u.shingle_sets(at)
    each = [np.unique(u.tokens[a : a + s - 4]) for a, s in zip(u.at.tolist(), u.size.tolist(), strict=True)]
    assert sizes.tolist() == [len(x) for x in each] and tokens.tolist() == np.concatenate(each).tolist()
    assert signs.reshape(-1, 4).tolist() == [parity_signature(x, 4).tolist() for x in each]
    assert wide.reshape(-1, 32).tolist() == [parity_signature(x, 32).tolist() for x in each if len(x) > 64] and len(wide)


def test_first_round_leaves_only_sets_that_may_still_meet(spark, monkeypatch):
    seen, plain = [], jaccard_join.settle

    def kept(df, label):
        out = plain(df, label)
        seen.append((label, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "settle", kept)
    g = np.random.default_rng(5)
    base = [sorted(g.choice(10_000, 30, False).tolist()) for _ in range(12)]
    sets = base + [b[1:] + [20_000 + i] for i, b in enumerate(base)] + [sorted([90_000, *g.choice(10_000, 20, False).tolist()]) for _ in range(20)]
    table = table_of(spark, sets)
    entries = [(i, len(s), t) for i, s in enumerate(sets) for t in s]
    found = jaccard_join.link_entries(spark.createDataFrame(entries, "node long, n long, token long"), plain(table.drop("tokens"), "sets"), 80, whole=plain(table.select("node", "tokens"), "whole"))
    assert sorted((r.node, r.component) for r in found.collect()) == [(12 + i, i) for i in range(12)]
    assert [n for label, n in seen if label == "whole"] and all(n < len(sets) for label, n in seen if label == "whole")


def test_cross_pairs_use_wide_signatures(spark):
    sets = [list(range(450 * i, 450 * i + 1000)) for i in range(8)] + [list(range(50, 1050))]
    table = table_of(spark, sets)
    entries = spark.createDataFrame([(1, i, 1000, i) for i in range(len(sets))], "token long, node long, n long, label long")
    pairs = sorted((min(r.a, r.b), max(r.a, r.b)) for r in jaccard_join._cross_pairs(entries, table, 80).collect())
    assert pairs == [(0, 8)]


def test_windows_of_a_text_do_not_depend_on_its_neighbours():
    text = " ".join(f"w{i * i % 97}" for i in range(120)).encode()
    alone = substring_dedup.Units([text], 5, 25, 80, 3, 1)
    for before in (b"It ends.", b"a line\n", b"goes on"):
        u = substring_dedup.Units([before, text], 5, 25, 80, 3, 1)
        assert u.first[u.text == 1].tolist() == alone.first.tolist()
