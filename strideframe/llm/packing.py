"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, ids binary"


_END_RUN = re.compile("[!-&(-/:-@\\[-`{-~]*$")  # ASCII punctuation but the apostrophe
_PLAIN = "\u0180"  # below it, a letter is its own NFC form
_WIDE = re.compile("[\u0180-\U0010ffff]")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes follow from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(other)) for b in range(256)}


class ChunkTokenizer:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokens hold no white space, so ids of a text are the
    ids of its blank-separated chunks in order; chunks are remembered in a
    bounded memo.  A chunk that is one word of plain letters, with ASCII
    punctuation behind it or not, goes straight to the tokenizer's model; any
    other chunk, and a text that could hold a special token's string, passes
    the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # the same merges, for words that need no more than a split
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.stops = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.stops[i] = token.endswith(suffix)
        self.alphabet = {b: c for b, c in byte_alphabet().items() if b != 32}
        self.memo: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.most = most

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_plain(self, new: list[str], into: dict[str, bytes]) -> None:
        for at in range(0, len(new), 500):
            part = new[at : at + 500]
            mapped = " ".join(part).encode().decode("latin-1").translate(self.alphabet)
            ids = np.array(self.plain.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.stops[ids]) + 1)).tolist()
            data = ids.tobytes()
            into.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))

    def _learn(self, new: set[str]) -> None:
        memo, words, parts = self.memo, [], []
        for chunk in new:
            if chunk != chunk.lower() or not chunk.isascii() and max(chunk) >= _PLAIN:
                memo[chunk] = self.whole(chunk)
            elif chunk.isalpha():
                words.append(chunk)
            elif 0 < (at := _END_RUN.search(chunk).start()) and (word := chunk[:at]).isalpha():
                parts.append((chunk, word, chunk[at:]))
            else:
                memo[chunk] = self.whole(chunk)
        words += [w for w in {w for _, w, _ in parts} if w not in memo and w not in new]
        self._learn_plain(words, memo)
        if len(self.ends) > self.most:
            self.ends.clear()
        self._learn_plain([x for x in {x for _, _, x in parts} if x not in self.ends], self.ends)
        memo.update((chunk, memo[word] + self.ends[rest]) for chunk, word, rest in parts)

    def __call__(self, texts: list[str]) -> list[bytes]:
        narrow = lambda t: t if _WIDE.search(t) or _WIDE.search(low := t.lower()) else low
        split = []
        for t in texts:
            low = narrow(t)
            chunks = low.replace("\n", " ").split(" ")
            split.append(None if "<|" in t else [narrow(c) for c in chunks] if low is t and not t.islower() else chunks)
        if len(self.memo) > self.most:
            self.memo.clear()
        chunks = set(chain.from_iterable(x for x in split if x is not None))
        if new := chunks.difference(self.memo):
            self._learn(new)
        get = self.memo.__getitem__
        return [self.whole(t) if x is None else b"".join(map(get, x)) for t, x in zip(texts, split, strict=True)]


@functools.cache
def tokenizer_at(path: str) -> ChunkTokenizer:
    """One tokenizer for each worker process and path, so that its memo serves all of its tasks."""
    return ChunkTokenizer(path)


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens)


@dataclass
class Win:
    level: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.level += len(piece)


class SumOfSquaresPacker:
    """Places a piece into the fill level that leaves the least sum of squared level counts.

    ``count[h]`` is the number of partially filled windows at level h; moving
    a window from h to h + s changes the sum by 2 (count[h + s] - count[h] + 1),
    opening one by 2 count[s] + 1, completing one by 1 - 2 count[h].
    """

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[Win]] = {}

    def place(self, piece: Piece) -> Win | None:
        """The window if the piece completes it."""
        s, top, n = len(piece), self.window, self.count
        if s == top:
            return Win(top, [piece])
        change = 2 * (n[s:] - n[: top - s + 1] + 1)  # by the level h before
        change[0] = 2 * n[s] + 1
        change[-1] = 1 - 2 * n[top - s] if n[top - s] else np.iinfo(np.int64).max
        change[1:][n[1 : top - s + 1] == 0] = np.iinfo(np.int64).max
        h = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals, the fullest
        if h:
            n[h] -= 1
            w = self.open[h].pop()
        else:
            w = Win()
        w.add(piece)
        if w.level == top:
            return w
        n[w.level] += 1
        self.open.setdefault(w.level, []).append(w)
        return None

    def drain(self):
        """Completes the open windows by cutting; the rest leaves as power-of-two sequences, which need no padding."""
        left = sorted((w for ws in self.open.values() for w in ws), key=lambda w: w.level)
        self.count[:], self.open = 0, {}
        emptiest = 0
        while len(left) > emptiest + 1:
            w = left.pop()
            while w.level < self.window and emptiest < len(left):
                giver = left[emptiest]
                piece = giver.pieces.pop()
                giver.level -= len(piece)
                if len(piece) > (need := self.window - w.level):
                    piece, back = piece.cut(need)
                    giver.add(back)
                w.add(piece)
                if not giver.pieces:
                    emptiest += 1
            if w.level == self.window:
                yield w
            else:
                left.append(w)
        for w in left[emptiest:]:
            pieces = w.pieces[::-1]
            for bit in reversed(range(self.window.bit_length())):
                if w.level >> bit & 1:
                    out = Win()
                    while out.level < 1 << bit:
                        piece = pieces.pop()
                        if len(piece) > (need := (1 << bit) - out.level):
                            piece, back = piece.cut(need)
                            pieces.append(back)
                        out.add(piece)
                    yield out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    window: int = 4096,
    end_id: int = 2,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of ``docs`` packed into sequences of at most ``window`` tokens (a power of two or not).

    Each task packs the documents of its own partition as they stream by, so
    there is no shuffle and memory holds one batch and at most one open window
    per fill level.  Longer documents give whole windows first, their rest is
    placed by the packer.  At the end of a task the open windows complete each
    other by cuts.  Output per piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id (unique over tasks), offset, sequence_tokens and, with
    ``with_ids``, the ids as little-endian unsigned 32-bit bytes.

    Null and empty texts are the end id alone; null ids stay null; repeated
    rows are packed as often as they come; other columns are not read; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tokenize, packer = tokenizer_at(tokenizer_path), SumOfSquaresPacker(window)
        serial = TaskContext.get().partitionId() << 40
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        out: list[tuple] = []

        def emit(w: Win):
            nonlocal serial
            at = 0
            for p in w.pieces:
                out.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, serial, at, w.level, p.ids if with_ids else None))
                at += len(p)
            serial += 1

        def flush():
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            batch = pa.record_batch([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), tokenize(texts), strict=True):
                    ids += end
                    total, start = len(ids) // 4, 0
                    while total - start > window:
                        emit(Win(window, [Piece(doc, start, ids[4 * start : 4 * (start + window)], total)]))
                        start += window
                    if done := packer.place(Piece(doc, start, ids[4 * start :], total)):
                        emit(done)
                if len(out) >= 4096:
                    yield flush()
        for done in packer.drain():
            emit(done)
        yield flush()

    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
