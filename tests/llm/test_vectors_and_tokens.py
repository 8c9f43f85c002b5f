import base64
import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strideframe.llm import byte_bpe, token_alignment, vector_codes
from strideframe.llm.queries import QUERIES, tokenizer_path

VECTORS = "vec_id bigint, embedding array<float>, label int, v string, codes string, cell int, error double, _id int"
DOCUMENTS = "doc_id bigint, text string, chunk int, id string, entry int, seq string, ids string, n_docs int"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute_lloyd(rows, parts, entries, rounds, scale):
    """Everything anew in each round, in Python integers."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda: [[min((gap(x[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for x in cut]
    for _ in range(rounds):
        now = near()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, n in zip(cut, now, strict=True) if n[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return Counter((i, tuple(v), tuple(e for _, e in n), sum(d for d, _ in n)) for (i, v), n in zip(kept, near(), strict=True)), books


@pytest.fixture(scope="module")
def vectors():
    g = random.Random(5)
    rows = [(i, [g.choice([-1, 1]) * g.random() ** 3 for _ in range(8)], g.choice([0, 1, None])) for i in range(150)]
    rows += [(3, rows[3][1], 0)] * 3 + [(4, rows[5][1], 1), (None, rows[6][1], None), (None, [0.0] * 8, 1)]  # repeated rows, one id twice, null ids
    rows += [(200, None, 1), (201, [0.1] * 7 + [None], 1), (202, [0.1] * 7 + [float("nan")], 1), (203, [float("inf")] * 8, 1)]
    return rows


@pytest.mark.parametrize("scale", [1024, 1 << 26])  # products of doubles, and of integers
def test_vector_codes_equal_brute_force(spark, vectors, scale):
    df = spark.createDataFrame([(i, v, label, "v", "c", 1, 0.5, 7) for i, v, label in vectors], VECTORS).repartition(3)
    rows, books = vector_codes.compress_vectors(df, parts=4, entries=9, rounds=4, scale=scale, keep=("label", "v"))
    want, want_books = brute_lloyd([(i, v) for i, v, _ in vectors], 4, 9, 4, scale)
    assert books.tolist() == want_books
    assert rows.columns[:3] == ["vec_id", "label", "v"]
    got = [tuple(r) for r in rows.toDF("vec_id", "label", "other", "v", "codes", "error").collect()]
    assert Counter((i, tuple(v), tuple(c), e) for i, _, _, v, c, e in got) == want
    assert len({r[3][0] for r in got}) > 9 and {r[2] for r in got} == {"v"}


def test_vector_changes_add_up_to_the_sums():
    g = np.random.default_rng(1)
    x, books = g.integers(-50, 50, (400, 2, 3)), g.integers(-50, 50, (2, 7, 3))
    before, now = g.integers(0, 7, (400, 2)), g.integers(0, 7, (400, 2))
    whole, moved = vector_codes.Changes(books), vector_codes.Changes(books)
    whole.add(x, None, before)
    moved.add(x[:150], before[:150], now[:150])
    moved.add(x[150:], before[150:], now[150:])
    anew = vector_codes.Changes(books)
    anew.add(x, None, now)
    assert (whole.cells + moved.cells == anew.cells).all()
    same = vector_codes.Changes(books)
    same.add(x, before, before)
    assert len(same.left()[0]) == 0  # nothing is shuffled for what stays


def test_vector_codes_of_few_none_and_wrong_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    rows, books = vector_codes.compress_vectors(make([]))
    assert rows.count() == 0 and books.size == 0
    rows, books = vector_codes.compress_vectors(make([(2, [1.5, -0.0001], 1), (1, [0.0, 1.0], 1)]), parts=2, keep=("label",))
    assert books.tolist() == [[[0], [1536]], [[1024], [-1]]]
    assert sorted(map(tuple, rows.select("vec_id", vector_codes.code_text(F.col("codes")), "error").collect())) == [(1, "0000", 0), (2, "0101", 0)]
    for bad in ([(1, [1.0] * 3, 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress_vectors(make(bad))
    rows, _ = vector_codes.compress_vectors(make([(1, [], 1), (2, [], 1)]), keep=("label",))
    assert [(r.codes, r.error) for r in rows.collect()] == [([0] * 4, 0)] * 2


def test_group_errors(spark):
    rows = spark.createDataFrame([(1, None, 3), (2, None, 4), (3, 1, 5), (4, 2, 6), (5, 1, 7)], "vec_id bigint, label int, error bigint")
    for bound in (10, 0):  # by broadcast, and by shuffle
        got = {r.vec_id: r.label_error for r in vector_codes.with_group_error(rows, "label", max_broadcast_groups=bound).collect()}
        assert got == {1: 7, 2: 7, 3: 12, 4: 6, 5: 12}


TEXTS = [None, "", " ", "\n", "a", "It's we'll  two   blanks\n\nand\tlines.   end ", "漢字かな交じり文 ١٢٣ é é ß \U0001f389\U0001f389", "<|endoftext|> <s> <0x0A> </s>", "has ▁ in it", "x\x00y\x1cz", "1234567890" * 30, "(a);\r\n{b}\r\n  };\r"]


@pytest.fixture(scope="module")
def texts():
    g = random.Random(6)
    words = ["the", "ing", "straw", "Berry", "don't", "x1y2", "ünï", "--", "...", "2024", "zz", "(", ");\r", "\n", "\t", "  ", "qwrtpl"]
    rows = [(i, " ".join(g.choice(words) for _ in range(g.randint(1, 60)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(7, rows[7][1])] * 2 + [(None, rows[8][1]), (None, None), (300, " ".join(g.choice(words) for _ in range(20_000))), (301, "".join(g.choice("abcdef") for _ in range(5000)))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "i", 2, "s", "ids", 3) for d, t in rows], DOCUMENTS).repartition(3)


@pytest.fixture
def small_chunks(monkeypatch):
    """Chunks of some texts each, also in the tasks."""
    from strideframe.llm import text_units

    for module in (byte_bpe, token_alignment):
        monkeypatch.setattr(module, "chunks", lambda batches: text_units.chunks(batches, 3000))


@pytest.mark.parametrize("frequent", [0, 5, 1 << 18])
def test_byte_bpe_equals_the_library(spark, texts, small_chunks, frequent):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.encode_texts(frame(spark, texts), RANKS, public_tokenizers.PATTERN, frequent=frequent, decode=True)
    assert out.where(~F.col("decoded").eqNullSafe(byte_bpe.decoded(F.col("ids"), RANKS))).count() == 0
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.back)) for r in out.withColumnRenamed("decoded", "back").collect())
    assert got == Counter((d, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for d, t in texts)
    assert byte_bpe.encode_texts(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("long_word", [1 << 10, 12])
def test_merge_replay_of_any_vocabulary(seed, long_word, monkeypatch):
    """Tokens in no order of making, so that merges make pairs of lower rank than their own."""
    monkeypatch.setattr(byte_bpe, "LONG_WORD", long_word)
    g = random.Random(seed)
    long = set()
    while len(long) < 50:
        long.add(bytes(g.choice(b"abc") for _ in range(g.randint(2, 6))))
    tokens = [bytes([b]) for b in range(256)] + g.sample(sorted(long), 50)
    ranks = {t: i for i, t in enumerate(tokens)}
    library = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(g.choice("abc") for _ in range(g.randint(1, 40))) for _ in range(200)]
    assert byte_bpe.MergeReplay(ranks).encode([w.encode() for w in words]) == [library.encode_ordinary(w) for w in words]
    assert byte_bpe.MergeReplay(ranks).encode([b"", b"a"]) == [[], [97]]


def test_decoding_refuses_unknown_ids(spark):
    back = lambda ids: spark.createDataFrame([(ids,), (None,), ([],)], "ids array<int>").select(byte_bpe.decoded(F.col("ids"), RANKS)).collect()
    assert [r[0] and bytes(r[0]) for r in back([0, 1])] == [b'!"', None, b""]
    for bad in ([50_256], [None, 1], [-1]):
        with pytest.raises(Exception, match="ids"):
            back(bad)


def test_units_join_to_the_text():
    from strideframe.llm.text_units import WHITE, unit_pattern

    g = random.Random(7)
    for no_cut in ("", "\r", "\r\t"):
        for _ in range(300):
            text = "".join(g.choice("ab \n\r\t　") for _ in range(g.randint(0, 30)))
            units = unit_pattern(no_cut).findall(text)
            assert "".join(units) == text and all(units)
            cuts = set(accumulate(map(len, units)))
            assert cuts - {len(text)} == {i for i in range(1, len(text)) if text[i] in WHITE and text[i] not in no_cut and text[i - 1] not in WHITE}


@pytest.mark.parametrize("spaced", [False, True])
def test_numbers_stand_for_the_text(spaced):
    """Cuts are at spaces, or where white space follows another character; never inside white space that a tokenizer may take as one."""
    from strideframe.llm.text_units import WHITE, Units, numbered, unit_pattern

    g = random.Random(8)
    texts = ["".join(g.choice("ab \n\r\u3000 ab") for _ in range(g.randint(0, 12))) for _ in range(2000)]
    units = Units()
    seq, sizes = numbered(texts[:1000], units, unit_pattern("\r"), spaced)
    more = numbered(texts[1000:], units, unit_pattern("\r"), spaced)
    seq, sizes = np.concatenate([seq, more[0]]), np.concatenate([sizes, more[1]])
    of, at = units.texts(0), 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        whole = f" {text}" if spaced and text else text
        own = [of[k] for k in seq[at : at + n]]
        at += n
        assert "".join(own) == whole and all(own)
        for cut in list(accumulate(map(len, own)))[:-1]:
            before, behind = whole[cut - 1], whole[cut : cut + 2]
            assert behind[0] in WHITE and (before not in WHITE or (behind[0] == " " and len(behind) > 1 and behind[1] not in WHITE and before != " "))
            assert behind[0] != "\r" or before in WHITE


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = {c: byte for byte, c in enumerate([*map(chr, range(256, 289)), *map(chr, range(33, 127)), *map(chr, range(289, 323)), *map(chr, range(161, 173)), chr(323), *map(chr, range(174, 256))])}
    groups, links = [], []
    for _, text in rows:
        own: list = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            p = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
            q = [bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace("▁", " ").encode() for i in y for t in [b.id_to_piece(i)]]
            if b"".join(p) == b"".join(q) == (" " + text).encode():
                ends_a, ends_b = list(accumulate(map(len, p))), list(accumulate(map(len, q)))
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                    own.append((x[i:k], y[j:m]))
                    i, j = k, m
        groups.append(own)
        links.append([(s, t) for g in own for s in g[0] for t in g[1]])
    counts = Counter(pair for own in links for pair in set(own))
    most = defaultdict(int)
    for (s, _), n in counts.items():
        most[s] = max(most[s], n)
    text_of = lambda own: ";".join(f"{','.join(map(str, s))}|{','.join(map(str, t))}" for s, t in own)
    docs = [
        (d, sum(len(s) for s, _ in g), sum(len(t) for _, t in g), len(g), text_of(g), len(own), sum(counts[pair] == most[pair[0]] for pair in own), sum(counts[pair] for pair in own))
        for (d, _), g, own in zip(rows, groups, links, strict=True)
    ]
    return docs, {(s, t, n, n == most[s]) for (s, t), n in counts.items()}


def test_alignment_equals_brute_force(spark, texts, small_chunks):
    short = [r for r in texts if r[0] != 300 and r[0] != 301]
    docs, links = token_alignment.align_tokenizers(frame(spark, short), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    want_docs, want_links = brute_alignment(short)
    assert Counter(map(tuple, docs.collect())) == Counter(want_docs)
    assert {tuple(r) for r in links.collect()} == want_links
    assert any(r[3] for r in want_docs) and any(r[1] == 0 for r in want_docs)


def test_alignment_of_a_long_text_and_of_no_rows(spark, texts):
    rows = [r for r in texts if r[0] in (300, 301)]
    docs, _ = token_alignment.align_tokenizers(frame(spark, rows), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert sorted(map(tuple, docs.collect())) == sorted(brute_alignment(rows)[0])
    docs, links = token_alignment.align_tokenizers(frame(spark, []), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert docs.count() == 0 and links.count() == 0


def test_overcounted_pairs():
    keys = ["1|2", "1,3|2", "1,1|2,4", "5|6"]
    text, group = np.array([0, 0, 0, 1, 1, 2]), np.array([0, 1, 2, 0, 3, 1])
    pair, surplus = token_alignment.overcounted(keys, text, group)
    assert dict(zip(pair.tolist(), surplus.tolist(), strict=True)) == {1 << 32 | 2: 2}


def test_queries_return_digests(spark, tmp_path):
    rows = [(1, "It's a test."), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {tuple(r) for r in QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect()}
    assert got == {(d, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha(t or "")) for d, t in rows}
    got = {(r.doc_id, r.n_groups, r.groups_sha256) for r in QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()}
    assert got == {(d, n, sha(text) if n else "") for d, _, _, n, text, *_ in brute_alignment(rows)[0]}
