import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import audio, components, jaccard_join, language_id, license_scan, lm_scoring, mixing, packing, quality_rules, substring_dedup, url_filter
from strideframe.llm.common import LOWER_BYTES, WordHashes, text_blocks
from strideframe.llm.queries import URL_RULES, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, size string, _text string, component_id int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), "h", "s", "u", 5) for d, t, lang, s in rows], SCHEMA)


def sentences(g, n):
    syllables = ["ra", "to", "mi", "ne", "su", "ka", "lo", "vi", "pe", "du"]
    out = []
    while len(out) < n:
        k = g.randint(4, 11)
        out += ["".join(g.choice(syllables) for _ in range(g.randint(2, 4))) for _ in range(k)]
        out[-1] += "."
    return out[:n]


@pytest.fixture(scope="module")
def corpus():
    g = random.Random(3)
    rows = []
    base = sentences(g, 200)
    for i in range(30):
        rows.append((i, " ".join(sentences(g, g.randint(30, 150))), "en", f"src{i % 4}"))
    for i in range(30, 60):  # near copies of one text
        w = list(base)
        for _ in range(g.randint(0, 6)):
            w[g.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "src0"))
    passage = " ".join(sentences(g, 60))
    for i in range(60, 66):
        rows.append((i, f"{' '.join(sentences(g, 40))} {passage} {' '.join(sentences(g, 40))}", "fr", None))
    rows += [(66, rows[3][1], "en", "src1"), (66, rows[3][1], "en", "src1"), (67, None, None, None), (68, "", "en", "src2"), (69, " \n\t ", "en", "src2"), (None, "no id here", "en", "src3"), (None, None, None, "src3")]
    rows += [(70, "ÀÉ x\u00a0y ß", "de", "ß"), (71, "one two", "en", "src2"), (72, "ONE Two", "en", "src2"), (73, "word " * 30_000, "en", "src1"), (74, "Licensed under the Apache License, Version 2.0.", "en", "src1")]
    return rows


def ws(text, lower=True):
    raw = (text or "").encode()
    return (raw.translate(LOWER_BYTES) if lower else raw).split()


def brute_components(rows, k, percent):
    sets = []
    for _, t, _, _ in rows:
        w = ws(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    link = list(range(len(rows)))

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                link[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(sets[i]), min(least[find(i)], default=None) if sets[i] else d) for i, (d, _, _, _) in enumerate(rows))


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, corpus, k, percent):
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(frame(spark, corpus), shingle_words=k, percent=percent).collect())
    assert got == brute_components(corpus, k, percent)


def test_prefix_bounds():
    g = np.random.default_rng(0)
    classes = np.zeros(jaccard_join.SKETCH, np.uint8)
    for _ in range(300):
        n = int(g.integers(1, 60))
        a = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
        keep = a[g.random(len(a)) > 0.12]
        b = np.unique(np.concatenate([keep, g.integers(0, 2**63, int(g.integers(0, 4))).astype(np.uint64)]))
        i, u = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if len(b) and 100 * i >= 85 * u:
            for order in (1, 2, 3):
                assert len(np.intersect1d(jaccard_join.prefix(a, classes, order, 85), jaccard_join.prefix(b, classes, order, 85)))
            more = jaccard_join.longer(len(a), 85)
            assert len(np.intersect1d(jaccard_join.prefix(a, classes, 1, 85, more), b)) > more
            apart = np.bitwise_count((jaccard_join.parity_signature(a) ^ jaccard_join.parity_signature(b)).view(np.uint64)).sum()
            assert apart <= len(a) + len(b) - 2 * i


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_least_shared_holds_for_every_size_pair(percent):
    """Worst case of an order: what isn't common comes first in both sets."""
    seen = lambda n: min(n, jaccard_join.prefix_size(n, percent) + jaccard_join.longer(n, percent))
    for n in range(1, 250):
        least = []
        for m in range(1, 100 * n // percent + 1):
            both = next(i for i in range(min(n, m) + 2) if i > min(n, m) or 100 * i >= percent * (n + m - i))
            if both <= min(n, m):
                least.append(max(0, min(seen(n) - (n - both), seen(m) - (m - both))))
        assert jaccard_join.least_shared(n, percent) == min(least) >= 1


@pytest.mark.parametrize("k, percent, sizes", [(4, 85, (9, 10)), (5, 80, (8, 9))])
def test_a_word_before_or_behind_a_short_text_links(spark, k, percent, sizes):
    rows = []
    for i in range(0, 120, 2):
        w = [f"w{i}x{j}" for j in range(sizes[0])]
        rows += [(i, " ".join(w), "en", "s"), (i + 1, " ".join(["more", *w] if i % 4 else [*w, "more"]), "en", "s")]
    got = jaccard_join.jaccard_components(frame(spark, rows), shingle_words=k, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(120)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_substring_repeats(spark, corpus):
    rows = [*corpus, (None, corpus[1][1], "en", "s"), (75, "one two", "en", "s")]
    got = substring_dedup.find_repeats(frame(spark, rows)).collect()
    assert [(r.keep_doc_id, r.n_words) for r in got if r.doc_id is None] == [(1, len(ws(corpus[1][1])))]
    assert [(r.keep_doc_id, r.first_word, r.end_word) for r in got if r.doc_id == 75] == [(71, 0, 2)] and not [r for r in got if r.doc_id == 73]
    rows = [r for r in rows if r[0] is not None]
    got = [r for r in got if r.doc_id is not None]
    words = {d: ws(t) for d, t, _, _ in rows}
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.first_word < r.end_word <= len(words[r.doc_id]) and r.n_words == r.end_word - r.first_word
        by[r.doc_id].append(r)
    assert set(by) >= set(range(61, 66)) and not set(by) & set(range(0, 30)) - {66}
    assert all(any(x.keep_doc_id == 60 and x.n_words >= 40 for x in by[d]) for d in range(61, 66))
    assert any(x.keep_doc_id == 3 and x.n_words == len(words[66]) for x in by[66])
    assert len([d for d in range(31, 60) if by[d]]) == 29
    spans = substring_dedup.find_repeats(frame(spark, rows))
    left = {r.doc_id: r.text for r in substring_dedup.remove_spans(frame(spark, rows), spans).collect()}
    assert left[0] == rows[0][1] and left[67] is None and not ws(left[66])
    again = substring_dedup.find_repeats(frame(spark, [(d, t, None, None) for d, t in left.items()])).collect()
    assert not any(r.doc_id in range(60, 66) for r in again)


def test_similar_windows_meet_wherever_they_stand():
    """Of all pairs of windows of different texts with Jaccard similarity of 0.8 or more, shifted ones too, at least 0.9 meet."""
    g = random.Random(12)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(5))
    passages = [[word() for _ in range(80)] for _ in range(12)]
    texts = []
    for i in range(240):
        w = list(passages[i % 12])
        for _ in range(g.randint(0, 4)):
            at = g.randrange(len(w))
            w[at : at + 1] = g.choice(([word()], [word(), w[at]], []))
        texts.append(" ".join([*[word() for _ in range(g.randint(0, 30))], *w, *[word() for _ in range(g.randint(0, 30))]]).encode())
    u = substring_dedup.Units(texts, 5, 25, 80, *substring_dedup.tune_bands(0.8, 0.99, 3))
    at = np.arange(u.windows)
    unit, token = u.meetings(at, np.ones((len(at), u.bands), bool))
    meets = defaultdict(set)
    for i, t in zip(unit.tolist(), token.tolist(), strict=True):
        meets[i].add(t)
    sets = [frozenset(u.tokens[a : a + 21].tolist()) for a in u.at[: u.windows].tolist()]
    by = defaultdict(list)
    for i, x in enumerate(sets):
        for t in x:
            by[t].append(i)
    pairs = {(i, j) for own in by.values() for i in own for j in own if i < j and u.text[i] != u.text[j] and sets[i] != sets[j]}
    similar = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    found = sum(bool(meets[i] & meets[j]) for i, j in similar)
    far = sum(bool(meets[i] & meets[j]) for i, j in pairs) - found
    print(f"{found} of {len(similar)} similar pairs meet, {far} of {len(pairs) - len(similar)} others")
    assert len(similar) > 300 and found >= 0.97 * len(similar)
    # every passage of window + SPREAD - 1 words has a window at the same words in all of its exact copies
    passage = [word() for _ in range(25 + substring_dedup.SPREAD - 1)]
    for _ in range(50):
        a, b = ([*[word() for _ in range(g.randint(0, 60))], *passage, *[word() for _ in range(g.randint(0, 60))]] for _ in range(2))
        v = substring_dedup.Units([" ".join(a).encode(), " ".join(b).encode()], 5, 25, 80, 3, 1)
        assert set(v.prints[v.text == 0]) & set(v.prints[v.text == 1])


def test_paragraphs_repeat_however_they_are_wrapped(spark):
    """End to end: of wrapped, shifted and edited paragraphs of 0.8 similarity to an earlier one, at least 0.9 are removed whole, and no other words are."""
    g = random.Random(14)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(6))
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, copies = [], []  # of copies: document, first word, end word, whether similar
    originals = [[word() for _ in range(g.randint(45, 90))] for _ in range(72)]
    for i in range(0, 72, 3):
        rows.append((i, "\n\n".join(wrap(w, 12) for w in originals[i : i + 3]), "en", "s"))
    for i, original in enumerate(originals):
        w = list(original)
        for _ in range(g.randint(0, 3)):
            at = g.randrange(len(w))
            w[at : at + 1] = g.choice(([word()], [word(), w[at]], []))
        before, behind = ([word() for _ in range(g.randint(0, 40))] for _ in range(2))
        text = g.choice(("\n\n", "\n \t\n", "\r\n\r\n")).join(wrap(x, g.choice((7, 12, 500))) for x in (before, w, behind) if x)
        rows.append((100 + i, text, "en", "s"))
        a, b = shingles(original), shingles(w)
        copies.append((100 + i, len(before), len(before) + len(w), 100 * len(a & b) >= 80 * len(a | b)))
    gone = defaultdict(set)
    for r in substring_dedup.find_repeats(frame(spark, rows)).collect():
        gone[r.doc_id] |= set(range(r.first_word, r.end_word))
    similar = [c for c in copies if c[3]]
    whole = sum(set(range(a, b)) <= gone[d] for d, a, b, _ in similar)
    print(f"{whole} of {len(similar)} similar paragraphs removed whole")
    assert len(similar) >= 40 and whole >= 0.9 * len(similar)
    assert not any(gone[i] for i in range(72)) and all(gone[d] <= set(range(a - 2, b + 2)) for d, a, b, _ in copies)  # a window of the similarity may begin or end two words outside


def test_rows_of_one_id_and_repeated_rows_keep_their_words(spark):
    g = random.Random(13)
    t, u, v, w = (" ".join(sentences(g, n)) for n in (80, 80, 60, 50))
    rows = [(1, t), (1, t), (1, t), (2, u), (5, t), (5, v), (None, w), (None, w), (None, f"{u} {v}"), (6, None), (6, ""), (7, f"{w} {v}")]
    docs = spark.createDataFrame([(d, x, "a", "b", 3) for d, x in rows], "doc_id bigint, text string, _cut_spans string, key string, at int")
    spans = substring_dedup.find_repeats(docs)
    for most in (200_000, 0):
        left = substring_dedup.remove_spans(docs, spans, max_broadcast_spans=most)
        assert left.columns == docs.columns
        got = Counter((r.doc_id, r.text) for r in left.collect())
        assert got[(1, t)] == 1 and got[(1, "")] == 2 and got[(2, u)] == 1 and got[(5, "")] == 1 and got[(5, v)] == 1 and got[(6, None)] == 1 and got[(6, "")] == 1
        assert sum(got.values()) == len(rows) and sum(n for (d, x), n in got.items() if d is None and x == "") >= 1
    words = Counter(x for r in substring_dedup.remove_spans(docs, spans, drop_emptied=True).collect() for x in set(ws(r.text)))
    assert set(words) == {x for _, y in rows for x in set(ws(y))}


def test_adjoining_passages_keep_their_own_keepers(spark):
    words = lambda name, n: " ".join(f"{name}{j}" + "." * (j == n - 1 or j % 12 == 11) for j in range(n))
    a, b = words("a", 25), words("b", 25)
    rows = [(5, f"{a} {words('p', 30)}", "en", "s"), (9, f"{b} {words('q', 30)}", "en", "s"), (20, f"{a} {b} {words('r', 30)}", "en", "s"), (30, words("c", 40), "en", "s"), (31, words("c", 40), "en", "s")]
    spans = substring_dedup.find_repeats(frame(spark, rows))
    assert sorted((r.doc_id, r.first_word, r.end_word, r.keep_doc_id) for r in spans.collect()) == [(20, 0, 25, 5), (20, 25, 50, 9), (31, 0, 40, 30)]
    left = {r.doc_id: r.text for r in substring_dedup.remove_spans(frame(spark, rows), spans).collect()}
    assert left[20] == words("r", 30) and left[5] == rows[0][1] and left[9] == rows[1][1]
    clusters = defaultdict(set)
    for r in substring_dedup.repeat_members(frame(spark, rows)).collect():
        clusters[r.cluster].add((r.doc_id, r.first_word, r.end_word, r.keep_doc_id, r.kept))
    assert sorted(sorted(x) for x in clusters.values()) == [
        [(5, 0, 25, 5, True), (20, 0, 25, 5, False)], [(9, 0, 25, 9, True), (20, 25, 50, 9, False)], [(30, 0, 40, 30, True), (31, 0, 40, 30, False)],
    ]


def test_cut_words_and_bands():
    span = lambda a, b: {"first_word": a, "end_word": b}
    assert substring_dedup.cut_words(" a bé\nc  d ", [span(1, 2), span(3, 4)]) == " a c  "
    assert substring_dedup.cut_words("a b", [span(0, 2)]) == "" and substring_dedup.cut_words(None, []) is None
    bands, rows = substring_dedup.tune_bands(0.8, 0.99, 3)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands <= 3
    with pytest.raises(ValueError):
        substring_dedup.tune_bands(0.2, 0.999, 2)


def test_packing(spark, corpus):
    got = packing.pack_documents(frame(spark, corpus).repartition(3, "n_chars"), tokenizer_path(), window=256).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d, text, _, _ in corpus:
        want[(d, np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length <= 4 * r.doc_tokens
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    for (d, ids), n in want.items():
        own = pieces[(d, len(ids) // 4)]
        assert sorted(x for x in own if ids[4 * x[0] : 4 * x[0] + len(x[1])] == x[1]) and sum(len(x[1]) for x in own) >= n * len(ids)
    assert sum(len(x[1]) for own in pieces.values() for x in own) == sum(len(ids) * n for (_, ids), n in want.items())
    for own in sequences.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= 256 and (at == 256 or at & (at - 1) == 0) and {x[2] for x in own} == {at}


def test_packer_takes_the_least_change():
    g = np.random.default_rng(5)
    p = packing.SumOfSquaresPacker(32)
    for _ in range(400):
        s = int(g.integers(1, 33))
        before = p.count.copy()
        options = {}
        for h in range(0, 33 - s):
            if s < 32 and (h == 0 or before[h]):
                after = before.copy()
                after[h] -= h > 0
                if h + s < 32:
                    after[h + s] += 1
                options[h] = int((after**2).sum())
        p.place(packing.Piece(0, 0, b"0000" * s, s))
        if s < 32:
            assert int((p.count**2).sum()) == min(options.values())
    assert {w.level for w in list(p.drain())[:-6]} <= {32, 1, 2, 4, 8, 16}


def test_tokenizer_equals_the_library():
    t = packing.ChunkTokenizer(tokenizer_path(), most=50)
    texts = ["It's I'LL ²³ a² İstanbul Σας ñandú! <|endoftext|> ½ x'y don't. a--b ...", "Ça\x1cva bien été", "ĸŉ ſ ÀÉ.,; ''s", "Hello Hello, HELLO! Łódź Σ x İ HELLO", "İzmir. Hello", "", " \n", *[" ".join(sentences(random.Random(i), 80)) for i in range(20)]]
    assert t(texts) == [t.whole(x) for x in texts]


def test_lm_scores(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = lm_scoring.score_texts(frame(spark, rows), train).collect()
    c = Counter()
    for d, t, _, _ in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update([*ws(t), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t, _, _ in rows:
        tokens = [*ws(t), None]
        want[(d, zlib.crc32(str(d).encode()) % 7 == 2, len(tokens), sum(x in c for x in tokens), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in tokens), 3))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert lm_scoring.score_texts(frame(spark, []), train).count() == 0


def test_lm_is_normalised(monkeypatch):
    m = lm_scoring.LogBilinear.fresh(np.log(np.full(lm_scoring.ENTRIES, 1 / lm_scoring.ENTRIES)), 8)
    g = np.random.default_rng(0)
    for _ in range(5):
        u, v, w = g.integers(0, lm_scoring.ENTRIES, (3, 64))
        m.train(u, v, w, g.integers(0, lm_scoring.ENTRIES, 16), np.full(lm_scoring.ENTRIES, -7.6, np.float32), 0.1)
    a1, a2, b, z = m.tables()
    for u, v in [(0, 1), (5, 2000), (2047, 2047)]:
        assert np.exp(a1[u].astype(float) + a2[v] + b - z[u, v]).sum() == pytest.approx(1, abs=1e-4)


def brute_mel(x):
    """Log-mel rows by sums: resampling to half the rate, frames of 256 by 128, DFT, triangles."""
    taps = audio.resampling_phases(16_000, 8_000)[2][0].astype(float)
    centre, m = (len(taps) - 1) // 2, -(-len(x) // 2)
    y = np.array([sum(taps[k] * x[2 * i - k + centre] for k in range(len(taps)) if 0 <= 2 * i - k + centre < len(x)) for i in range(m)])
    n = 1 + max(0, -(-(m - 256) // 128))
    y = np.concatenate([y, np.zeros((n - 1) * 128 + 256 - m)]) if m < (n - 1) * 128 + 256 else y
    wave = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    return np.array([np.log(np.abs(wave @ (y[i * 128 : i * 128 + 256] * np.hanning(256))) ** 2 @ audio.mel_bank(8_000, 256, 16) + 1e-6) for i in range(n)])


def test_audio(spark, corpus):
    got = audio.audio_features(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    texts = defaultdict(set)
    for r in got:
        back, rate = audio.from_wav(r.media)
        assert rate == 16_000 and len(back) == r.payload_bytes and r.payload_bytes % 64 == 0 and hashlib.sha256(back).hexdigest() == r.payload_sha256
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes and zlib.crc32(back[-64:]) == r.tail_crc32
        texts[back].add((r.feature, bytes(r.tensors)))
        import pyarrow as pa

        t = pa.ipc.open_stream(r.tensors).read_all()
        assert t.column("mel").type.shape == [32, 16] and t.num_rows == -(-r.n_frames // 32) == r.n_tensors and hashlib.sha256(r.tensors).hexdigest() == r.tensors_sha256
        if r.n_frames < 200:
            wide = np.asarray(np.frombuffer(back, np.uint8), float) / 128 - 1
            assert np.abs(brute_mel(wide)[: r.n_frames] - np.concatenate(t.column("mel").combine_chunks().to_numpy_ndarray())[: r.n_frames]).max() < 0.05
    assert all(len(x) == 1 for x in texts.values())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for d, t, _, _ in corpus:
        if d is not None:
            raw = (t or "").encode()
            assert by[d].n_bytes == len(raw) and by[d].payload_bytes == max(64, -(-len(raw) // 64) * 64)


def test_resampling_keeps_a_tone_and_blocks_agree():
    x = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000).astype(np.float32)
    y = audio.resample(x, 16_000, 8_000)
    want = np.sin(2 * np.pi * 440 * np.arange(8_000) / 8_000)
    assert np.abs(y[100:-100] - want[100:-100]).max() < 0.05
    up = audio.resample(x, 16_000, 24_000)
    assert len(up) == 24_000 and np.abs(up[200:-200] - np.sin(2 * np.pi * 440 * np.arange(24_000) / 24_000)[200:-200]).max() < 0.05
    raw = np.random.default_rng(0).integers(0, 256, 3 * audio.BLOCK + 777, dtype=np.uint8).tobytes()
    a, b = audio.features(raw, 16_000, 8_000, 256, 128, 16)
    samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    c, d = audio.log_mel(audio.resample(samples, 16_000, 8_000), 8_000, 256, 128, 16)
    assert a.shape == c.shape and np.allclose(a, c, atol=1e-2) and np.allclose(b, d, rtol=1e-2)
    assert audio.hysteresis_segments(np.array([0, 1, 3, 1, 0, 1, 0.0]), 0.6, 2.0) == [(1, 4)]


def test_suffix_automaton_equals_naive():
    g = random.Random(1)
    sequences = [[g.randrange(4) for _ in range(g.randint(3, 12))] for _ in range(6)]
    a = license_scan.SuffixAutomaton(sequences)
    text = [g.randrange(5) for _ in range(300)]
    for i, (length, state) in enumerate(a.statistics(text)):
        best = max((k for k in range(0, min(i + 1, 12) + 1) if k == 0 or any(s[j : j + k] == text[i + 1 - k : i + 1] for s in sequences for j in range(len(s)))), default=0)
        assert length == best
        if best:
            places = {(n, j + best) for n, s in enumerate(sequences) for j in range(len(s) - best + 1) if s[j : j + best] == text[i + 1 - best : i + 1]}
            assert a.where[state] == places


def test_license_scan(spark, corpus):
    rows = [*corpus, (80, "x the MIT-license, cc by; Apache License", "en", "a"), (81, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated docs files (the Software), to deal in the Software without restriction", "en", "a")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, rows)).collect() if r.doc_id is not None}
    assert (got[80].n_words, got[80].n_base, got[80].first_word, got[80].last_word, got[80].base_labels) == (8, 3, 2, 6, "apache,cc-by,mit")
    assert got[81].n_base == 0 and got[81].first_word is None and got[81].labels == "mit" and 0 < got[81].score <= 1
    assert got[74].labels == "apache" and got[74].score == 1.0 and got[67].n_words == 0 and got[67].score == 0.0
    for d, t, _, _ in rows:
        if d is not None:
            assert got[d].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower() if (t or "").isascii() else (t or "").translate({c: c + 32 for c in range(65, 91)})))


def test_license_spans(spark):
    scan = license_scan.LicenseScanner([("one", "lonely"), ("two", "two words"), ("long", " ".join(f"t{i}" for i in range(20)))], {"x y": "xy"}, 5, 4, 0.8)
    spans = lambda text: [(s[0], s[2], s[3], round(s[4], 2)) for s in scan.spans(license_scan.license_words(text.encode()))]
    t = [f"t{i}" for i in range(20)]
    assert spans("a lonely b two words c") == [("one", 1, 2, 1.0), ("two", 3, 5, 1.0)]
    assert spans(" ".join(["a", *t, "b", *t[:15], "c"])) == [("long", 1, 21, 1.0)]
    assert spans(" ".join([*t[:10], "x", "y", *t[10:]])) == [("long", 0, 22, 1.0)]
    assert spans(" ".join([*t[:6], "x", *t[7:20]])) == [("long", 0, 20, 0.95)]
    assert spans(" ".join([*t[:10], *["z"] * 5, *t[10:]])) == [] and spans(" ".join(t[10:] + t[:10])) == [] and spans("") == []
    body = dict(license_scan.TEMPLATES)
    assert set(body) >= {"mit", "bsd", "isc", "agpl", "mpl", "epl", "cc-by-sa"}
    rows = [(i, f"some code {text} and more code", "en", "s") for i, (_, text) in enumerate(license_scan.TEMPLATES)] + [(900, "Licensed under CC BY-SA 3.0", "en", "s"), (901, "", "en", "s")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert all(label in got[i].labels.split(",") for i, (label, _) in enumerate(license_scan.TEMPLATES)) and "cc-by-sa" in got[900].labels and got[901].labels == ""


def test_language_id(spark):
    g = random.Random(2)
    own = {"aa": ["the", "and", "thing", "of", "ing"], "bb": ["der", "und", "schein", "zu", "ung"], "cc": ["les", "que", "eaux", "ment", "où"]}
    text = lambda k, n: " ".join(g.choice(own[k]) + g.choice(own[k]) for _ in range(n))
    rows = [(i, text(k, 60), k, "s") for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    model = language_id.fit_language_model(frame(spark, [*rows, (90, None, "aa", "s"), (91, "x", None, "s")]))
    assert model.langs == ["aa", "bb", "cc"]
    tests = [(i, text(k, 40), k, "s") for i, k in enumerate(["aa", "bb", "cc"] * 10)] + [(100, text("aa", 300) + " " + text("cc", 150), "x", "s"), (101, None, "aa", "s"), (102, "12 !?", "aa", "s"), (103, "é", None, "s"), (104, "½ ² Ⅷ", "aa", "s"), (105, "", "aa", "s"), (106, text("bb", 40_000), "x", "s"), (107, rows[0][1], "x", "s"), (107, rows[0][1], "x", "s")]
    got = {r.doc_id: r for r in language_id.identify_languages(frame(spark, tests), model).collect()}
    assert all(got[d].lang_pred == k for d, _, k, _ in tests[:30])
    assert [x.lang for x in got[100].languages] == ["aa", "cc"] and 0.5 < got[100].score < 0.8
    assert all(got[d].lang_pred == "und" and got[d].score == 0.0 for d in (101, 102, 104, 105)) and got[103].lang_pred in own
    assert got[106].lang_pred == "bb" and got[107].lang_pred == "aa" and len(tests) == language_id.identify_languages(frame(spark, tests), model).count()
    assert language_id.identify_languages(frame(spark, []), model).count() == 0
    none = language_id.fit_language_model(frame(spark, []))
    assert language_id.identify_languages(frame(spark, tests[:1]), none).first().lang_pred == "und"


def test_language_likelihoods_and_mixture_equal_brute_force():
    g = np.random.default_rng(3)
    counts = g.integers(0, 50, (3, language_id.BUCKETS)) * (g.random((3, language_id.BUCKETS)) < 0.2)
    m = language_id.MixtureModel(["a", "b", "c"], counts.astype(float), 3.0, 200)
    text = "Some words, and OTHERS: über 12 more words without an end " * 6
    grams = language_id.ngram_buckets(text).tolist()
    raw = f" {re.sub(r'[^a-zü]+', ' ', text.lower()).strip()} ".encode()
    assert len(grams) == len(raw) - 2 and len({raw[i : i + 3] for i in range(len(raw) - 2)}) >= len(set(grams)) > 40
    p = [[(counts[k, x] + 0.5) / (counts[k].sum() + 0.5 * language_id.BUCKETS) for x in range(language_id.BUCKETS)] for k in range(3)]
    logs = [[sum(np.log(p[k][x]) for x in grams[i : i + language_id.SEGMENT]) / 3 for k in range(3)] for i in range(0, len(grams), language_id.SEGMENT)]
    assert np.allclose(m.segments(np.array(grams)), logs, rtol=1e-4)
    log = np.array(logs)
    like = np.exp(log - log.max(axis=1, keepdims=True))
    value, weight = m._em(like, [0, 1, 2])
    grid = [(np.log(like @ np.array([a, b, 1 - a - b])).sum()) for a in np.linspace(0.001, 0.998, 60) for b in np.linspace(0.001, 0.998, 60) if a + b < 1]
    assert weight.sum() == pytest.approx(1) and value >= max(grid) - 0.05
    sets = {(k,): float(log[:, k].sum() - log.max(axis=1).sum()) - 3 * np.log(len(log) + 1.0) for k in range(3)}
    best = max(sets, key=sets.get)
    found = m.infer(text)
    assert len(found) > 1 or found[0][0] == "abc"[best[0]]


def test_mixing(spark, corpus):
    got = mixing.mix_sources(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    total = sum(len(ws(t)) for _, t, _, _ in corpus)
    sources = sorted({s for _, _, _, s in corpus if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = {s: sum(len(ws(t)) for _, t, _, x in corpus if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    full: set = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: weight[s] * rest / sum(weight[x] for x in sources if x not in full) for s in sources if s not in full}
        more = {s for s in share if share[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    target = {s: 3.0 * sizes[s] if s in full else share[s] for s in sources}
    assert sum(target.values()) == pytest.approx(total)
    taken = Counter()
    key = lambda d: (d is None, d)
    for r, (d, t, _, s) in zip(sorted(got, key=lambda r: (*key(r.doc_id), r.size)), sorted(corpus, key=lambda x: (*key(x[0]), len(ws(x[1])))), strict=True):
        assert (r.doc_id, r.size, r.source_size) == (d, len(ws(t)), sizes[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in sources:
        biggest = max(len(ws(t)) for _, t, _, x in corpus if x == s)
        assert abs(taken[s] - target[s]) <= 2 * biggest + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(frame(spark, corpus).repartition(5)).collect()))
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def brute_quality(rows, min_docs, percent):
    lines = defaultdict(set)
    texts = defaultdict(set)
    norm = lambda line: b" ".join(ws(line))
    for _, t, _, s in rows:
        texts[s].add(t or "")
        for line in (t or "").split("\n"):
            if ws(line):
                lines[(s, norm(line))].add(t)
    out = []
    for d, t, _, s in rows:
        w = ws(t, lower=False)
        own = [x for x in (t or "").split("\n") if ws(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        gone = sum(len(ws(x)) for x in own if min_docs <= len(lines[(s, norm(x))]) and 100 * len(lines[(s, norm(x))]) > percent * len(texts[s]))
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        chars = sum(len(x.decode()) for x in w)
        out.append((d, len(w), chars, sum(c in "#*$%&|<>" for c in t or ""), len(own) - len(set(own)), len(inside), gone, failed, not failed and not (len(w) - gone) * 100.0 < len(w) * 30.0))
    return Counter(out)


def test_quality_rules(spark, corpus):
    g = random.Random(9)
    notice = " ".join(sentences(g, 45))
    rows = [*corpus, *[(200 + i, f"{notice}\n{' '.join(sentences(g, 12))}\n# a|b", "en", "web") for i in range(25)], *[(300 + i, " ".join(sentences(g, 80)) + "\n" + "\n".join(["same line"] * i), "en", "web") for i in range(6)]]
    got = quality_rules.quality_rules(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_quality(rows, 20, 5.0)
    assert not any(r.kept for r in got if r.doc_id in range(200, 225)) and all(r.kept for r in got if r.doc_id in range(300, 306))
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0
    passed = quality_rules.quality_rules(frame(spark, rows[:3]), payload=["text", "host"])
    assert passed.columns[:3] == ["doc_id", "text", "host"] and passed.first().host == "h"


def test_quality_rules_return_the_text_without_heavy_lines(spark):
    g = random.Random(10)
    rows = [(i, f"Share  this PAGE now\n{' '.join(sentences(g, 40))}\n\n share this page NOW \n{' '.join(sentences(g, 40))}\n", "en", "web") for i in range(25)]
    rows += [(100, rows[0][1], "en", "other"), (101, None, "en", "web"), (102, "\n\na\n", "en", "web"), (103, "share this page now", "en", "web")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows), payload=["size"], left_col="text").collect()}
    for d, t, _, s in rows:
        lines = None if t is None else [x for x in t.split("\n") if s == "other" or ws(x) != b"share this page now".split()]
        assert got[d].text == (None if t is None else "\n".join(lines))
    assert got[0].n_line_words == 8 and got[0].kept and got[0].size == "s"
    plain = quality_rules.quality_rules(frame(spark, rows), max_broadcast_rows=1, left_col="left").drop("left")
    assert Counter(tuple(r) for r in plain.collect()) == brute_quality(rows, 20, 5.0)


def test_url_filter(spark):
    urls = ["https://www.Example.com/en/x?q", "http://a.example.com/en/1#t", "http://example.com/e", "http://x.com", "http://x.com/", "ftp://b.net/fr/1", "b.net/fr/1", None, "", "http://net/es/?a", "http://c.org/en/", "x://y://z.com/a", "http://notcom/en/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, URL_RULES).collect()}

    def want(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fit = [(len(h), len(p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return (host, path, best[3] if best else None, best[2] if best else "allow")

    assert got == {i: want(u) for i, u in enumerate(urls)}
    split = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, URL_RULES, max_trie_rules=2).collect()}
    assert split == got
    trie = url_filter.UrlTrie([("block", "a.b", "/x/y"), ("allow", "a.b", "/x/"), ("allow", "a.b", "/x/y")])
    assert trie.find("c.a.b", "/x/yz/1") == ("block", "a.b/x/y") and trie.find("a.b", "/x/q") == ("allow", "a.b/x/") and trie.find("b", "/x/y") is None


def test_url_filter_of_no_rows_and_odd_rows(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id bigint, url string"), URL_RULES).count() == 0
    long = "http://www.example.com/en/" + "x/" * 50_000
    rows = [(None, long), (None, long), (1, None), (1, ""), (2, "no scheme")]
    got = url_filter.filter_urls(spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id bigint, url string, host string, verdict string"), URL_RULES)
    assert Counter((r.page_id, len(r.path), r.rule, r.verdict) for r in got.collect()) == {(None, 100_004, "www.example.com/en/", "allow"): 2, (1, 0, None, "allow"): 2, (2, 0, None, "allow"): 1}


@pytest.mark.parametrize("call", [
    lambda d: jaccard_join.jaccard_components(d), lambda d: substring_dedup.find_repeats(d), lambda d: packing.pack_documents(d, tokenizer_path()), lambda d: audio.audio_features(d), lambda d: license_scan.scan_licenses(d),
])
def test_empty_tables(spark, call):
    assert call(frame(spark, [])).count() == 0


def test_word_hashes_stand_for_words():
    import pyarrow as pa

    texts = [b"", b"a B  c", b" \n", b"x" * 700_000 + b" a", b"b\x0bA ab ba aab \xc3\xa9", b""]
    w = WordHashes(texts)
    words = [x for t in texts for x in t.translate(LOWER_BYTES).split()]
    assert w.sizes.tolist() == [len(t.split()) for t in texts] and len(w.hashes) == len(words)
    assert [w.joined[a : a + len(x)] for a, x in zip(w.starts.tolist(), words, strict=True)] == words
    assert len({(x, h) for x, h in zip(words, w.hashes.tolist(), strict=True)}) == len(set(words)) == len(set(w.hashes.tolist()))
    assert WordHashes([b"q", b"a b"]).hashes[1:].tolist() == w.hashes[:2].tolist() and not len(WordHashes([]).hashes)
    column = pa.array(["ab", None, "", "c" * 50, "d"])
    assert [x for _, raws in text_blocks(column, 10) for x in raws] == [b"ab", b"", b"", b"c" * 50, b"d"]
    assert [at for at, _ in text_blocks(column.slice(1), 10)] == [0, 2, 3]
