import random

import pytest

from strideframe.llm import license_scan as L


def brute_spans(templates, labels, ws, min_match, max_gap, min_cover):
    """Each template by itself: all longest common stretches, the best chain to each, and the best of those that overlap."""
    out = []
    for k, t in enumerate(templates):
        n, matches = len(t), []
        for i in range(1, len(ws) + 1):
            for p in range(1, n + 1):
                size = next(x for x in range(max(i, p) + 1) if x in (i, p) or ws[i - 1 - x] != t[p - 1 - x])
                if n < min_match:
                    if size == p == n:
                        matches.append((i - n, i, 0, n))
                elif size >= min_match and (i == len(ws) or p == n or ws[i] != t[p]):
                    matches.append((i - size, i, p - size, p))
        best = {}
        for m in sorted(matches, key=lambda m: m[1]):
            before = [best[c] for c in matches if c in best and c[1] <= m[0] <= c[1] + max_gap and c[3] <= m[2]]
            b = max(before, key=lambda x: (x[2], x[1], x[0]), default=None)
            best[m] = (b[0] if b else m[0], m[1], (b[2] if b else 0) + m[1] - m[0])
        taken = []
        for first, end, covered in sorted((x for x in best.values() if x[2] >= min_cover * n), key=lambda x: (-x[2], x[1] - x[0], x[0])):
            if all(end <= a or b <= first for a, b in taken):
                taken.append((first, end))
                out.append((labels[k], k, first, end, min(1.0, covered / n)))
    return sorted(out, key=lambda x: (x[2], x[3], x[1]))


@pytest.mark.parametrize("seed", range(8))
def test_spans_equal_brute_force(seed):
    """Templates with repeats, shared beginnings and few words; texts with words put in, taken out and repeated."""
    g = random.Random(seed)
    for _ in range(40):
        words = [f"w{i}" for i in range(g.choice([4, 8, 30]))]
        templates = [[g.choice(words) for _ in range(g.choice([1, 2, 3, 6, 12, 30]))] for _ in range(g.randint(1, 4))]
        if len(templates) > 1 and g.random() < 0.5:
            templates[1] = templates[0][: len(templates[0]) // 2] + templates[1]
        labels = [f"l{i}" for i in range(len(templates))]
        scan = L.LicenseScanner(list(zip(labels, map(" ".join, templates), strict=True)), {"x y": "xy"}, 3, 3, 0.6)
        text = []
        for _ in range(g.randint(0, 6)):
            part = list(g.choice(templates))
            for _ in range(g.randint(0, 3)):
                at = g.randrange(len(part) + 1)
                part[at : at + g.randint(0, 1)] = [g.choice([*words, "zz"])] * g.randint(0, 3)
            text += part + ["zz"] * g.randint(0, 5)
        assert scan.spans([w.encode() for w in text]) == brute_spans(templates, labels, text, 3, 3, 0.6)


@pytest.mark.parametrize("repeats", [False, True])
@pytest.mark.parametrize(("put_in", "end"), [(4, 176), (3, 157), (5, None)])
def test_words_put_in_after_every_five(repeats, put_in, end):
    t = [f"t{i}" for i in range(100)]
    if repeats:
        t[10:15] = t[:5]
    scan = L.LicenseScanner([("a", " ".join(t))], {"x y": "xy"}, 5, 4, 0.8)
    text = [w.encode() for i in range(0, 100, 5) for w in t[i : i + 5] + ["z"] * put_in]
    assert [s[2:] for s in scan.spans(text)] == ([(0, end, 1.0)] if end else [])


def test_whole_licences_are_found(spark):
    """Labels and score of mutated paragraphs of the production templates, against brute force."""
    labels, bodies = zip(*L.TEMPLATES, strict=True)
    assert {"apache", "gpl", "lgpl", "mpl", "gfdl", "artistic", "cc0", "cc-by-nc", "mit", "bsd"} <= set(labels) and len(L.TEMPLATES) > 400
    g = random.Random(1)
    number = {}
    templates = [[number.setdefault(w, len(number)) for w in L.license_words(b.encode())] for b in bodies]
    rows = []
    for d in range(200):
        ws = L.license_words(g.choice(bodies).encode())[:120]
        for _ in range(g.randint(0, 6)):
            at = g.randrange(len(ws) + 1)
            ws[at : at + g.randint(0, 2)] = [b"invented"] * g.randint(0, 6)
        rows.append((d, b" ".join([b"some", b"code", *ws, b"more"]).decode()))
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = 0
    for d, text in rows[:40]:
        ws = L.license_words(text.encode())
        near = [k for k, t in enumerate(templates) if len({number.get(w, -1) for w in ws} & set(t)) >= 0.8 * len(set(t))]
        want = brute_spans([templates[k] for k in near], [labels[k] for k in near], [number.get(w, -1 - i) for i, w in enumerate(ws)], 5, 4, 0.8)
        base = {label for phrase, label in L.PHRASES.items() if f" {phrase} " in f" {' '.join(w.decode() for w in ws)} "}
        assert got[d].labels == ",".join(sorted(base | {s[0] for s in want}))
        assert got[d].score == (1.0 if base else max((s[4] for s in want), default=0.0))
        assert [(s.label, s.first_word, s.end_word) for s in got[d].spans] == [(s[0], s[2], s[3]) for s in sorted(((a, near[k], b, c, e) for a, k, b, c, e in want), key=lambda x: (x[2], x[3], x[1]))]
        found += bool(want)
    assert found > 20


def test_no_template_is_a_sentence_of_the_tables():
    known = {"released under the mit license", "licensed under cc by nc 4 0", "licensed under the apache license version 2 0", "this work is licensed under the gnu general public license version 3", "all rights reserved"}
    assert not known & {b" ".join(L.license_words(t.encode())).decode() for _, t in L.TEMPLATES}
