"""Which tokens of one tokenizer stand where those of another stand, through a dictionary of groups."""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import settle
from strideframe.llm.text_units import MOST_UNITS, WHITE, Numbers, Units, chunks, lists, numbered, ragged, sums_by, unit_pattern

_BLANK = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each token's bytes start, how many they are, and all bytes."""
    size = np.array([len(t) for t in tokens], np.int64)
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(tokens), np.uint8)


class Pair:
    """Both tokenizers, on units that neither's tokens cross."""

    def __init__(self, a_path: str, b_path: str):
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        a_bytes = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id(_BLANK)
        self.a_table, self.b_table = _table([a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]), _table(b_bytes)
        words = [p for i, p in enumerate(pieces) if len(p) > 1 and not self.b.is_byte(i)]
        if any(_BLANK in p.lstrip(_BLANK) for p in words):
            raise ValueError("the second tokenizer's pieces go on over spaces; texts can't be cut there")
        self.pattern = unit_pattern("".join(c for c in WHITE if c != " " and any(c in p for p in words)))

    def b_ids(self, units: list[str]) -> list[list[int]]:
        """The second tokenizer puts a blank before what it is given: the unit's own space, or one that is taken off again."""
        spaced = [u.startswith(" ") for u in units]
        ids = self.b.encode([u[1:] if s else u for u, s in zip(units, spaced, strict=True)], num_threads=1)
        return [[self.blank] if u == " " else x if s else x[1:] for u, s, x in zip(units, spaced, ids, strict=True)]

    def encode(self, units: list[str]):
        """(ids, number by unit) of A and of B, and whether the bytes of both are the unit's."""
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        sides, raws = [], [u.encode() for u in units]
        size, raw = np.fromiter(map(len, raws), np.int64, len(raws)), np.frombuffer(b"".join(raws), np.uint8)
        fine = np.ones(len(units), bool)
        for ids, (start, length, data) in ((a, self.a_table), (self.b_ids(units), self.b_table)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            held = sums_by(length[flat], n)
            own = data[ragged(start[flat], length[flat])]
            same = held == size
            fine &= same
            both = [x[np.repeat(same, m)] for x, m in ((raw, size), (own, held))]
            fine[same] &= sums_by(both[0] == both[1], size[same]) == size[same]
            sides.append((flat, n))
        return *sides, fine


class Groups:
    """Units by number (``units``), with the groups of each: ``a1,a2|b1`` by number (``keys``)."""

    def __init__(self, both: Pair):
        self.both, self.units, self.keys = both, Units(), Numbers()
        self.n_a = self.n_b = self.n_groups = self.first = self.flat = np.zeros(0, np.int64)
        self.fine = np.zeros(0, bool)

    def catch_up(self) -> None:
        """Encode the units that have come since the last time."""
        new = self.units.texts(len(self.fine))
        for lo in range(0, len(new), 8192):
            self._add(new[lo : lo + 8192])

    def _add(self, units: list[str]) -> None:
        (a, n_a), (b, n_b), fine = self.both.encode(units)
        a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
        n_a, n_b = np.where(fine, n_a, 0), np.where(fine, n_b, 0)
        ends = [np.cumsum(length[ids]) for ids, (_, length, _) in ((a, self.both.a_table), (b, self.both.b_table))]  # both count the bytes of the same units
        common = np.intersect1d(*ends, assume_unique=True)
        upto = [np.searchsorted(x, common, "right") for x in ends]
        size = [np.diff(x, prepend=0) for x in upto]
        number = np.zeros(len(common), np.int64)
        single = (size[0] == 1) & (size[1] == 1)
        code, at = np.unique(a[upto[0][single] - 1] << 32 | b[upto[1][single] - 1], return_inverse=True)
        number[single] = np.array([self.keys[f"{x >> 32}|{x & 0xFFFFFFFF}"] for x in code.tolist()], np.int64)[at]
        many = np.flatnonzero(~single)
        left, right = a.tolist(), b.tolist()
        text = lambda ids, n, stop: ",".join(map(str, ids[stop - n : stop]))
        number[many] = [self.keys[f"{text(left, n, i)}|{text(right, m, j)}"] for n, i, m, j in zip(size[0][many].tolist(), upto[0][many].tolist(), size[1][many].tolist(), upto[1][many].tolist(), strict=True)]
        unit_ends = np.cumsum(n_a)
        n_groups = np.searchsorted(upto[0], unit_ends, "right") - np.searchsorted(upto[0], unit_ends - n_a, "right")
        first = len(self.flat) + np.cumsum(n_groups) - n_groups
        for name, more in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("first", first), ("flat", number), ("fine", fine)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))


@functools.cache
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _distinct_links(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(A id << 32 | B id) of the distinct id pairs of each group, one group after another, and how many each has."""
    out, sizes = [], np.zeros(len(keys), np.int64)
    for g, key in enumerate(keys):
        a, b = (sorted({*map(int, side.split(","))}) for side in key.split("|"))
        out += [x << 32 | y for x in a for y in b]
        sizes[g] = len(a) * len(b)
    return np.array(out, np.int64), sizes


def overcounted(keys: list[str], text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, surplus) of the pairs that texts hold in several groups, for distinct (text, group): the groups' counts of texts have them too often."""
    links, sizes = _distinct_links(keys)
    pair, number, times = np.unique(links, return_inverse=True, return_counts=True)
    several = times[number] > 1  # pairs of one group are counted rightly
    starts, left = np.cumsum(sizes) - sizes, sums_by(several, sizes)
    number, starts = number[several], np.cumsum(left) - left
    at = ragged(starts[group], left[group])
    held, n = np.unique(np.repeat(text, left[group]) * max(1, len(pair)) + number[at], return_counts=True)
    held, n = held[n > 1] % max(1, len(pair)), n[n > 1] - 1
    surplus = np.bincount(held, n, len(pair)).astype(np.int64)
    at = np.flatnonzero(surplus)
    return pair[at], surplus[at]


_CHUNKED = "chunk bigint, id bigint, n_a bigint, n_b bigint, seq array<int>, entry int, group string, n_docs bigint, pair bigint"


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: id, n_a, n_b, n_groups, ``groups``, n_links, n_best, count_sum; links: a, b, n_docs, best).

    A space and the text are encoded by A (a byte-level BPE file of
    ``tokenizers``), the text by B (a SentencePiece BPE model, which puts the
    space there itself), both without special tokens.  Where tokens of both
    end, a group ends; ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of their
    ids.  All A and B tokens of a group are linked.  ``n_docs`` of an id pair
    is the number of documents (rows of the table) that hold it linked; a link
    is ``best`` where that is the highest of its A id.  ``n_links`` and
    ``n_best`` count the document's links, token by token, and ``count_sum``
    adds up their ``n_docs``.

    Groups are interned in chunks of texts (``text_units``) and then over the
    corpus: links are expanded once for each distinct group, and a pair's
    documents are the documents of its groups, less what a document with the
    pair in several groups is counted too often, which the document's chunk
    knows.  What comes of the links is summed up by group and joined back by
    it, one row for each chunk and group.  Pairs are a table; only the best
    counts, one for each A id, are broadcast (bound: A's vocabulary).

    Texts that are null or empty or not rendered byte by byte (as those with
    U+2581 in them) have zeros and empty ``groups``.  Repeated rows are
    documents of their own; null ids pass; texts of any length are worked on
    whole; other columns aren't read; empty tables give empty results.  The
    files must be there on every machine.  B's pieces must not go on over a
    space (checked).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    names = [x.split(" ")[0] for x in _CHUNKED.split(", ")]

    def chunked(batches):
        import pyarrow as pa

        kinds = {n: pa.int64() for n in names} | {"seq": pa.list_(pa.int32()), "entry": pa.int32(), "group": pa.string()}
        known = Groups(_pair(a_path, b_path))

        def batch_of(n: int, chunk: int, columns: dict):
            own = columns | {"chunk": pa.array(np.full(n, chunk, np.int64))}
            return pa.record_batch([pa.array(own[c], kinds[c]) if isinstance(own.get(c), list | np.ndarray) else own.get(c, pa.nulls(n, kinds[c])) for c in names], names=names)

        for chunk, ids, texts in chunks(batches):
            if len(known.fine) > MOST_UNITS:
                known = Groups(known.both)
            seq, sizes = numbered(texts, known.units, known.both.pattern, spaced=True)
            known.catch_up()
            fine = sums_by(~known.fine[seq], sizes) == 0
            seq, sizes = seq[np.repeat(fine, sizes)], np.where(fine, sizes, 0)
            groups, n_groups = known.flat[ragged(known.first[seq], known.n_groups[seq])], sums_by(known.n_groups[seq], sizes)
            yield batch_of(len(texts), chunk, {"id": ids, "n_a": sums_by(known.n_a[seq], sizes), "n_b": sums_by(known.n_b[seq], sizes), "seq": lists(groups.astype(np.int32), n_groups)})
            keys = list(known.keys)
            held = np.unique(np.repeat(np.arange(len(texts)), n_groups) * max(1, len(keys)) + groups)
            text, group = held // max(1, len(keys)), held % max(1, len(keys))
            n_docs = np.bincount(group, minlength=len(keys))
            used = np.flatnonzero(n_docs)
            own = [keys[g] for g in used.tolist()]
            yield batch_of(len(used), chunk, {"entry": used.astype(np.int32), "group": own, "n_docs": n_docs[used]})
            pair, surplus = overcounted(own, text, np.searchsorted(used, group))
            yield batch_of(len(pair), chunk, {"pair": pair, "n_docs": -surplus})

    table = settle(rows.mapInArrow(chunked, _CHUNKED), "groups")
    entries = table.where("entry is not null").select(F.col("chunk").alias("home"), "entry", "group")
    dictionary = settle(table.where("entry is not null").groupBy("group").agg(F.sum("n_docs").alias("n_docs")), "dictionary")
    side = lambda i: F.split(F.get(F.split("group", r"\|"), F.lit(i)), ",").cast("array<bigint>")
    counted = lambda ids: F.transform(F.array_distinct(ids), lambda x: F.struct(x.alias("id"), F.size(F.filter(ids, lambda y: y == x)).cast("bigint").alias("n")))
    links = dictionary.select("group", "n_docs", F.explode(counted(side(0))).alias("x"), side(1).alias("bs")).select("group", "n_docs", "x", F.explode(counted(F.col("bs"))).alias("y"))
    links = links.select("group", "n_docs", F.shiftleft(F.col("x.id"), 32).bitwiseOR(F.col("y.id")).alias("pair"), (F.col("x.n") * F.col("y.n")).alias("n"))
    links = settle(links, "links")
    pairs = links.select("pair", "n_docs").union(table.where("pair is not null").select("pair", "n_docs")).groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))
    pairs = settle(pairs.withColumn("a", F.shiftright("pair", 32)), "pairs")
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row for each A id at most
    pairs = pairs.join(F.broadcast(most), "a").select("pair", "a", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    values = links.select("group", "pair", "n").join(pairs, "pair").groupBy("group").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum")
    )
    own = entries.join(values, "group")

    def joined(texts, entries):
        import pyarrow as pa

        at = entries.column("entry").to_numpy()
        most = int(at.max()) + 1 if len(at) else 0
        seq = texts.column("seq").combine_chunks()
        groups, sizes = seq.flatten().to_numpy(zero_copy_only=False), np.diff(seq.offsets.to_numpy())
        out = {c: texts.column(c) for c in ("id", "n_a", "n_b")} | {"n_groups": pa.array(sizes.astype(np.int64))}
        names = [""] * most
        for i, name in zip(at.tolist(), entries.column("group").to_pylist(), strict=True):
            names[i] = name
        flat, stops = [names[g] for g in groups.tolist()], np.cumsum(sizes)
        out["groups"] = pa.array([";".join(flat[lo:hi]) for lo, hi in zip((stops - sizes).tolist(), stops.tolist(), strict=True)], pa.string())
        for c in ("n_links", "n_best", "count_sum"):
            value = np.zeros(most, np.int64)
            value[at] = entries.column(c).to_numpy()
            out[c] = pa.array(sums_by(value[groups], sizes))
        return pa.table(out)

    texts = table.where("seq is not null").select("chunk", "id", "n_a", "n_b", "seq")
    kinds = "id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, n_links bigint, n_best bigint, count_sum bigint"
    documents = texts.groupBy("chunk").cogroup(own.groupBy("home")).applyInArrow(joined, kinds).withColumnRenamed("id", id_col)
    return documents, pairs.select("a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n_docs", "best")
