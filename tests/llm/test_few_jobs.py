"""How many tables and jobs the links of a small input take, which the driver's memory follows; and that none is lost."""

import random

import numpy as np

from strideframe.llm import components, jaccard_join


def _labels(edges):
    label = {}
    for a, b in edges:
        if a != b:
            x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
            if x is not y:
                x |= y
                for node in y:
                    label[node] = x
    return {node: min(own) for node, own in label.items() if node != min(own)}


def test_components_of_one_stretch_take_two_tables(spark, monkeypatch):
    tables, plain = [], components.settle
    monkeypatch.setattr(components, "settle", lambda df, label: tables.append(label) or plain(df, label))
    chain = [(i, i + 1) for i in range(200)] + [(300, 301), (7, 7), (1, 0)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == _labels(chain)
    assert len(tables) == 2


def test_components_of_many_stretches(spark, monkeypatch):
    g = random.Random(5)
    edges = [(g.randrange(400), g.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    monkeypatch.setattr(components, "STRETCH", 16)
    found = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()
    got = {r.node: r.component for r in found}
    assert len(found) == len(got) and got == _labels(edges)


def test_links_of_few_sets_take_few_tables(spark, monkeypatch):
    """Ten sets under one token, of which two are similar: hubs once, then all pairs that are left."""
    tables, plain = [], jaccard_join.settle
    monkeypatch.setattr(jaccard_join, "settle", lambda df, label: tables.append(label) or plain(df, label))
    rows = []
    for i in range(10):
        tokens = [1, *(range(100, 109) if i in (3, 8) else range(1000 * i + 200, 1000 * i + 209))]
        rows.append((i, 10, tokens, [1], jaccard_join.parity_signature(np.array(tokens, np.uint64)).tolist()))
    sets = plain(spark.createDataFrame(rows, "node long, n long, tokens array<long>, p1 array<long>, sign array<long>"), "sets")
    entries = spark.createDataFrame([(i, 10, 1) for i in range(10)], "node long, n long, token long")
    found = jaccard_join.link_entries(entries, sets, 80)
    assert [(r.node, r.component) for r in found.collect()] == [(8, 3)]
    assert tables.count("hubs") == 1 and tables.count("pairs") == 2
