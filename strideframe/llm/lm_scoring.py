"""Log-bilinear language model by noise-contrastive estimation, and the scores it gives whole texts."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import LOWER_BYTES, byte_texts, settle

ENTRIES = 2048  # of the model: frequent words, classes of all other words, the end
CLASSES = 256
WORDS = ENTRIES - CLASSES - 1
END = ENTRIES - 1
HELD_WORDS = 1 << 17  # most words whose counts tasks hold; the others meet their counts by a join
FAN = 32


def class_of(word: bytes) -> int:
    """Words outside the vocabulary fall into classes by their last two bytes."""
    return zlib.crc32(word[-2:]) % CLASSES


class LogBilinear:
    """score(w | u, v) = (R[u] * C1 + R[v] * C2) . Q[w] + b[w]: bilinear in the word and each word before it."""

    def __init__(self, r, c, q, b):
        self.r, self.c, self.q, self.b = r, c, q, b
        self.squares: list[np.ndarray] | None = None

    @classmethod
    def fresh(cls, log_unigram: np.ndarray, dim: int, seed: int = 7) -> LogBilinear:
        g = np.random.default_rng(seed)
        draw = lambda *shape: g.normal(0, 0.1, shape).astype(np.float32)
        return cls(draw(ENTRIES, dim), np.ones((2, dim), np.float32), draw(ENTRIES, dim), log_unigram.astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.c, self.q, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def like(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for x in self.arrays():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out)

    def train(self, u, v, w, noise: np.ndarray, log_noise: np.ndarray, rate: float) -> None:
        """One step of noise-contrastive estimation, the sum of log odds ascended: the true words against one set of noise words for the whole batch."""
        k = len(noise)
        context = self.r[u] * self.c[0] + self.r[v] * self.c[1]
        target, other = self.q[w], self.q[noise]
        scale = np.float32(np.log(k))
        true = (context * target).sum(axis=1) + self.b[w] - log_noise[w] - scale
        false = context @ other.T + (self.b[noise] - log_noise[noise] - scale)
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
        d_context = up[:, None] * target + down @ other
        d_words, d_rows = np.zeros_like(self.q), np.zeros_like(self.r)
        _scatter(d_words, w, up[:, None] * context)
        _scatter(d_words, noise, down.T @ context)
        _scatter(d_rows, u, d_context * self.c[0])
        _scatter(d_rows, v, d_context * self.c[1])
        d_positions = np.stack([(d_context * self.r[u]).sum(axis=0), (d_context * self.r[v]).sum(axis=0)])
        d_bias = np.bincount(w, up, ENTRIES) + np.bincount(noise, down.sum(axis=0), ENTRIES)
        if self.squares is None:
            self.squares = [np.full_like(x, 1e-6) for x in self.arrays()]
        for x, g, square in zip(self.arrays(), (d_rows, d_positions, d_words, d_bias), self.squares, strict=True):
            g = g.astype(np.float32)  # steps shrink with the gradients each number has had
            square += g * g
            x += np.float32(rate) * g / np.sqrt(square)

    def tables(self):
        """Per word before: scores of every word; and the logarithm of the sum for all pairs of words before, by one matrix product."""
        a1 = (self.r * self.c[0]) @ self.q.T
        a2 = (self.r * self.c[1]) @ self.q.T
        top1, top2 = a1.max(axis=1, keepdims=True), a2.max(axis=1, keepdims=True)
        after, weight = np.exp(a2 - top2).T, np.exp(self.b - self.b.max())
        log_z = np.empty((ENTRIES, ENTRIES), np.float32)
        for at in range(0, ENTRIES, 256):  # in strips, to hold little at once
            part = slice(at, at + 256)
            log_z[part] = np.log((np.exp(a1[part] - top1[part]) * weight) @ after + 1e-30) + top1[part] + top2.T + self.b.max()
        return a1, a2, self.b, log_z


def _scatter(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """into[at] += rows, with repeats, as sums of sorted stretches."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    into[own[first]] += np.add.reduceat(rows[order], first, axis=0)


class Lexicon:
    """The words that tasks hold: model entry and count of each; counts of word classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, ends: int):
        self.key = uuid.uuid4().hex
        self.words, self.counts = words, counts
        self.class_tokens, self.class_words, self.ends = class_tokens, class_words, ends

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("at", "entry", "log_count")}

    def ready(self) -> Lexicon:
        if not hasattr(self, "at"):
            self.at = {w: i for i, w in enumerate(self.words)}
            n = len(self.words)
            self.entry = np.array([i if i < WORDS else WORDS + class_of(w) for i, w in enumerate(self.words)], np.int32).reshape(n)
            self.log_count = np.log10(self.counts + 1.0)
        return self

    def unigram(self) -> np.ndarray:
        n = np.zeros(ENTRIES)
        n[: min(WORDS, len(self.words))] = self.counts[:WORDS]
        n[WORDS:END] = self.class_tokens
        n[END] = self.ends
        return np.log((n + 0.5) / (n + 0.5).sum())


_held: dict[str, dict] = {}


def _once(key: str, name: str, make):
    """What a worker process derives from a broadcast value, kept for the newest key only."""
    if key not in _held:
        _held.clear()
        _held[key] = {}
    if name not in _held[key]:
        _held[key][name] = make()
    return _held[key][name]


def _counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all rows; tasks add up before the shuffle."""

    def run(batches):
        import pyarrow as pa

        sums: Counter[bytes] = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])
            sums.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for raw in byte_texts(batch.column(1).slice(at, 512)):
                    sums.update(raw.translate(LOWER_BYTES).split())
                if len(sums) > 150_000:
                    yield flush()
        yield flush()

    return settle(rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counts")


def _lexicon_of(counts: DataFrame, ends: int) -> Lexicon:
    """The most frequent words, at most ``HELD_WORDS``: a threshold is found in a histogram of counts, nothing is sorted."""
    most = 1 << 20
    histogram = counts.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    total = histogram["words"].cumsum().to_numpy()
    fit = histogram["n"].to_numpy()[total <= HELD_WORDS]
    least = int(fit[-1]) if len(fit) else most + 1
    held = counts.where(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable")
    words, numbers = [bytes(w) for w in held["word"]], held["n"].to_numpy(np.int64)
    last = F.substring("word", -2, 2)
    rest = counts.select(F.when(F.length("word") < 2, F.col("word")).otherwise(last).alias("tail"), "n").groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for tail, n, k in rest.itertuples(index=False):
        tokens[class_of(bytes(tail))] += n
        kinds[class_of(bytes(tail))] += k
    for w, n in zip(words[:WORDS], numbers[:WORDS], strict=True):
        tokens[class_of(w)] -= n
        kinds[class_of(w)] -= 1
    return Lexicon(words, numbers, tokens, kinds, ends)


def _encode(raw: bytes, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Places in the lexicon (-1: not held), model entries with the end behind, and the words that aren't held."""
    ws = raw.translate(LOWER_BYTES).split()
    get = lex.at.get
    at = np.array([get(w, -1) for w in ws], np.int32)
    entries = np.append(lex.entry[at] if len(lex.words) else np.zeros(len(ws), np.int32), np.int32(END))
    far = np.flatnonzero(at < 0)
    other = [ws[i] for i in far.tolist()]
    if other:
        entries[far] = [WORDS + class_of(w) for w in other]
    return at, entries, other


def _before(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry before each and the one before that; ends stand before the first."""
    padded = np.concatenate([[END, END], entries])
    return padded[1:-1], padded[:-2]


def train_model(rows: DataFrame, lexicon, dim: int, batch_tokens: int, noise_words: int, rate: float) -> LogBilinear:
    """One pass over all training texts: each task trains its own copy, the copies are averaged by tokens in a tree of ``FAN``."""
    start, key = LogBilinear.fresh(lexicon.value.unigram(), dim), lexicon.value.key

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        lex = _once(key, "lexicon", lambda: lexicon.value.ready())
        model, task = start.like(start.flat()), TaskContext.get().partitionId()
        log_noise = lex.unigram()
        share = np.cumsum(np.exp(log_noise))
        log_noise = log_noise.astype(np.float32)
        g = np.random.default_rng(task)
        held, size, tokens = [], 0, 0

        def learn():
            e = np.concatenate([x for x, _, _ in held])
            u, v = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
            order = g.permutation(len(e))
            for at in range(0, len(e), batch_tokens):
                part = order[at : at + batch_tokens]
                noise = np.minimum(np.searchsorted(share, g.random(noise_words)), ENTRIES - 1)
                model.train(u[part], v[part], e[part], noise, log_noise, rate)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for raw in byte_texts(batch.column(1).slice(at, 512)):
                    _, entries, _ = _encode(raw, lex)
                    held.append((entries, *_before(entries)))
                    size += len(entries)
                    tokens += len(entries)
                if size > 200_000:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        if tokens:
            yield pa.record_batch([pa.array([task], pa.int64()), pa.array([float(tokens)]), pa.array([model.flat().tobytes()], pa.binary())], names=["part", "weight", "model"])

    def mean(pdf):
        import pandas as pd

        weight = pdf["weight"].to_numpy()
        total = np.zeros(len(start.flat()))
        for w, m in zip(weight, pdf["model"], strict=True):
            total += w * np.frombuffer(m, np.float32)
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN], "weight": [weight.sum()], "model": [(total / weight.sum()).astype(np.float32).tobytes()]})

    kind = "part bigint, weight double, model binary"
    parts = settle(rows.mapInArrow(run, kind), "models")
    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return start
    while most >= FAN:
        parts = settle(parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(mean, kind), "models")
        most = parts.agg(F.max("part")).first()[0]
    return start.like(np.frombuffer(mean(parts.toPandas())["model"][0], np.float32))


def score_texts(
    docs: DataFrame,
    training,
    *,
    dim: int = 16,
    batch_tokens: int = 4096,
    noise_words: int = 64,
    rate: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Scores of all whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` is a condition on the rows; the model and all counts come
    from the rows that meet it.  A text's tokens are its words (A-Z
    lower-cased) and one end.  ``base_score`` sums log10((c + 1) / (N + V + 1)).

    The model has ``ENTRIES`` entries: the most frequent words, the end, and
    classes for all other words.  It is log-bilinear in an entry and the two
    before it and is fitted by noise-contrastive estimation over all training
    tokens.  Scores of a position come from one product per word before, and
    the normaliser of every pair of words before from a single matrix product,
    so each log-probability is normalised exactly.  A word of a class has the
    class's probability times (c + 1) / (N_class + V_class + 1).

    Counts of the ``HELD_WORDS`` most frequent words are broadcast; other words
    are shuffled to their counts.  Null texts
    are the end alone; null ids come out null; repeated rows are scored alike;
    other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    train = rows.where("train").select("doc_id", "text")
    counts = _counts(train)
    n_docs = train.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = int(sums[0]) + n_docs, int(sums[1]) + (n_docs > 0)
    lexicon = spark.sparkContext.broadcast(_lexicon_of(counts, n_docs))
    model = spark.sparkContext.broadcast(train_model(train, lexicon, dim, batch_tokens, noise_words, rate))
    key = lexicon.value.key
    total = float(np.log10(n + v + 1.0))
    held_least = int(lexicon.value.counts.min()) if lexicon.value.words else None

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        lex = _once(key, "lexicon", lambda: lexicon.value.ready())
        a1, a2, b, log_z = _once(key, "tables", lambda: model.value.tables())
        row = TaskContext.get().partitionId() << 40
        tail_weight = np.zeros(ENTRIES)  # log10 of what turns a class into one of its words, without log10(c + 1)
        tail_weight[WORDS:END] = -np.log10(lex.class_tokens + lex.class_words + 1.0)
        names = ["row", "doc_id", "train", "n_tokens", "n_held", "base", "score", "other"]
        for batch in batches:
            ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for start in range(0, batch.num_rows, 512):
                out = []
                for doc, flag, raw in zip(ids[start : start + 512], flags[start : start + 512], byte_texts(batch.column(1).slice(start, 512)), strict=True):
                    row += 1
                    at, entries, other = _encode(raw, lex)
                    u, w = _before(entries)
                    log = a1[u, entries].astype(np.float64) + a2[w, entries] + b[entries] - log_z[u, w]
                    known = at[at >= 0]
                    counted = lex.log_count[known]
                    end = float(np.log10(lex.ends + 1.0))
                    base = counted.sum() + end - len(entries) * total
                    score = log.sum() / np.log(10) + tail_weight[entries].sum() + counted[known >= WORDS].sum()
                    out.append((row, doc, flag, len(entries), len(known) + (lex.ends > 0), float(base), float(score), other))
                columns = list(zip(*out, strict=True)) or [[]] * 8
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kind = "row bigint, doc_id bigint, train boolean, n_tokens bigint, n_held bigint, base double, score double, other array<binary>"
    scored = settle(rows.select("doc_id", "text", "train").mapInArrow(run, kind), "scores")
    rare = counts if held_least is None else counts.where(F.col("n") < held_least)
    other = scored.select("row", F.explode("other").alias("word"))
    met = other.join(rare, "word").groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1.0)).alias("log"))
    out = scored.drop("other").join(met, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    return out.select(
        F.col("doc_id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("n_held") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score"),
    )
