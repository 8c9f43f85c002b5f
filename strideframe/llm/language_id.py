"""Language proportions of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import settle

_PLAIN_LETTER = re.compile("[A-Za-z]")
_OTHER = re.compile(r"[\W\d_]+")
BUCKETS = 1 << 15
SEGMENT = 24  # bytes whose n-grams are taken to be of one language


def ngram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, every run of non-letters made one blank."""
    b = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode(), np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - (buckets - 1).bit_length())


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L."""
    return bool(_PLAIN_LETTER.search(text)) or any(c.isalpha() for c in text)


class MixtureModel:
    """Log-likelihoods of n-gram buckets by language."""

    def __init__(self, langs: list[str], counts: np.ndarray, penalty: float, rounds: int):
        self.langs, self.penalty, self.rounds = langs, penalty, rounds
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        self.logp = np.ascontiguousarray(np.log(p).T.astype(np.float32))

    def segments(self, grams: np.ndarray) -> np.ndarray:
        """Log-likelihood by segment and language; overlapping trigrams count a third each."""
        return np.add.reduceat(self.logp[grams], np.arange(0, len(grams), SEGMENT), axis=0) / 3

    def _em(self, like: np.ndarray, part: list[int]) -> tuple[float, np.ndarray]:
        x = like[:, part]
        weight = np.full(len(part), 1 / len(part))
        if len(part) > 1:
            for _ in range(self.rounds):
                r = x * weight
                r /= r.sum(axis=1, keepdims=True)
                new = r.mean(axis=0)
                if np.abs(new - weight).max() < 1e-4:
                    break
                weight = new
        return float(np.log(np.maximum(x @ weight, 1e-300)).sum()), weight

    def infer(self, text: str) -> list[tuple[str, float]]:
        """Languages of the text with their proportions, largest first.

        Sets grow by the language of the next largest proportion under all
        languages; the set with the greatest likelihood less
        ``penalty * size * log(segments)`` wins, ties to the smaller set and
        the first name.
        """
        if not self.langs or not has_letter(text):
            return []
        log = self.segments(ngram_buckets(text)).astype(np.float64)
        top = log.max(axis=1, keepdims=True)
        like = np.exp(log - top)
        _, weight = self._em(like, list(range(len(self.langs))))
        total = log.sum(axis=0)
        first = int(np.argmax(total))
        order = [first, *[int(i) for i in np.lexsort((np.arange(len(weight)), -weight)) if i != first and weight[i] > 0.02]]
        cost = self.penalty * np.log(len(log) + 1.0)
        best_value, best = float(total[first] - top.sum()) - cost, ([first], np.ones(1))
        for k in range(2, len(order) + 1):
            value, w = self._em(like, order[:k])
            if value - k * cost <= best_value:
                break
            best_value, best = value - k * cost, (order[:k], w)
        return sorted(((self.langs[i], float(p)) for i, p in zip(*best, strict=True)), key=lambda x: (-x[1], x[0]))


def fit_language_model(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", penalty: float = 3.0, rounds: int = 20
) -> MixtureModel:
    """Trigram counts over all rows with a language; tasks add up before the shuffle.

    The model has ``BUCKETS`` numbers a language (128 KB), whatever the size
    of the corpus; the number of labels bounds what reaches the driver and is
    broadcast.  Null languages are left out, null and empty texts add nothing,
    repeated rows count as often as they come, long texts are counted whole,
    other columns aren't read; an empty table gives a model without languages.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))

    def run(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                if text and has_letter(text):
                    own += np.bincount(ngram_buckets(text), minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own) if own.any() else np.zeros(1, np.int64)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    counts = settle(rows.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "langs")
    per = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))  # BUCKETS at most
    rows = {r["lang"]: (r["bucket"], r["n"]) for r in per.toLocalIterator()}
    langs = sorted(rows)
    table = np.zeros((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        bucket, n = rows[lang]
        table[i, bucket] = n
    return MixtureModel(langs, table, penalty, rounds)


def identify_languages(docs: DataFrame, model: MixtureModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages) of every whole text; nothing but the text is looked at.

    ``lang_pred`` has the largest proportion and ``score`` is that proportion;
    a null or empty text, a text without a character of category L, and any
    text under a model without languages give ``und``, 0 and no languages.
    Ties go to the first name; repeated rows give equal rows; null ids come
    out null; long texts are read whole; other columns aren't read; an empty
    table gives an empty result.  No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    def run(batches):
        import pyarrow as pa

        own = held.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("proportion", pa.float64())]))
        for batch in batches:
            out = [own.infer(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([x[0][0] if x else "und" for x in out], pa.string()),
                    pa.array([x[0][1] if x else 0.0 for x in out], pa.float64()),
                    pa.array([[{"lang": a, "proportion": p} for a, p in x] for x in out], kind),
                ],
                names=["doc_id", "lang_pred", "score", "languages"],
            )

    schema = "doc_id bigint, lang_pred string, score double, languages array<struct<lang:string,proportion:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
