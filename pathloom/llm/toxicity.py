"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in NumPy.

A word is the bag of its character n-grams of 3 to 5 with word ends marked, hashed into BUCKETS; so a misspelt or inflected word that
was never seen shares vectors with those that were. The vectors of a window of WINDOW words are averaged and go
through a softmax over two classes; a text has the score of its worst window, so the length of a text does not hide a
passage. Vectors and softmax are trained together on labels of whole texts: after a first look at all windows, each text is represented by its
worst window of the moment.

Fitting takes a bounded sample of labelled rows (``per_class`` of each class, texts of up to MAX_CHARS characters, the least hashes of doc_id);
every row is scored. Scoring is one pass without a shuffle: with two classes the vectors and the softmax
fold into one number for each bucket, which is what is broadcast (BUCKETS * 4 bytes).

Defined cases: null and empty texts and texts without words get the score of the bias alone; without labels of both
classes every score is 0; labels with a null doc_id or class are ignored, a doc_id with several labels counts as toxic if one says so;
repeated rows are each scored; extra columns stay in ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pathloom.llm.common import blocks, bounded_sample, give_back, mix, spans

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMENSIONS = 8
WINDOW = 16  # words
SCALE = 32.0  # of an average before the softmax
MAX_CHARS = 6000
PER_CLASS = 4000
THRESHOLD = 0.7
FACTORS = {n: (mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(100 * n)) >> np.uint64(33)).astype(np.uint32) | np.uint32(1) for n in SIZES}


@dataclass
class Grams:
    """N-grams of some texts: bucket and word of each, n-grams of each word, and the first word of each text."""

    bucket: np.ndarray
    word: np.ndarray
    counts: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Grams:
        texts = [t.lower() for t in texts]
        codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        inside = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57)) | (codes >= 128)
        z = np.concatenate([np.zeros(1, np.uint32), codes * inside, np.zeros(max(SIZES), np.uint32)])
        starts, _ = spans(np.append(inside, False))
        word_of = np.cumsum(np.bincount(starts, minlength=len(codes))).astype(np.int32) - 1
        buckets, words = [], []
        filled = inside
        for n in SIZES:
            # an n-gram around place p begins at p - 1 (z is moved by one); its inner characters lie in one word
            if n > 3:
                filled = filled & np.append(inside, np.zeros(n, bool))[n - 3 : n - 3 + len(inside)]
            at = np.flatnonzero(filled)
            h = np.zeros(len(at), np.uint32)
            for k, factor in enumerate(FACTORS[n]):
                h += z[at + k] * factor
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            buckets.append((h >> np.uint32(15)).astype(np.int32))
            words.append(word_of[at])
        word = np.concatenate(words)
        return cls(np.concatenate(buckets), word, np.bincount(word, minlength=len(starts)), np.searchsorted(starts, begins))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and text of the windows of ``size`` words; the last one of a text may be shorter."""
        n = -(-np.diff(self.first) // size)
        text = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        return self.first[text] + at * size, text

    def word_sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values[self.bucket], len(self.counts))


@dataclass
class Model:
    """One number for each bucket, and the bias, in favour of class 1; slope and shift bring logits of texts to scale."""

    values: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        g = Grams.of(texts)
        at, text = g.windows(WINDOW)
        worst = np.zeros(len(texts))
        if len(at):
            means = np.add.reduceat(g.word_sums(self.values), at) / np.add.reduceat(g.counts, at)
            first = np.flatnonzero(np.diff(text, prepend=-1))
            worst[text[first]] = SCALE * np.maximum.reduceat(means, first)
        return worst + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)))


def calibrated(model: Model, texts: list[str], labels: np.ndarray, rounds: int = 50) -> Model:
    """Scale the logits by logistic regression on texts that training did not see (Newton steps, slightly damped)."""
    x = np.clip(np.stack([model.logits(texts), np.ones(len(texts))], 1), -100, 100)
    w, keep = np.array([1.0, 0.0]), np.diag([1e-4, 1e-4]) * len(texts)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + keep
        w = w - np.clip(np.linalg.solve(curve, x.T @ (p - labels) + keep @ (w - [1.0, 0.0])), -1, 1)
    return Model(model.values, model.bias, float(max(w[0], 0.1)), float(w[1]))


def _worst(logits: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The window of the highest logit of each text."""
    order = np.lexsort((logits, text))
    return order[np.append(np.diff(text[order]) > 0, True)]


def fit(texts: list[str], labels: np.ndarray, steps: int = 800, batch: int = 96, rate: float = 0.5, seed: int = 1) -> Model:
    """Train vectors and softmax by stochastic gradients (Adagrad).

    A text counts by its worst window; in the first steps by all its windows. Of a clean text every word is
    clean, so its worst single word counts too: else noise of one word that a text repeats would not average out.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2)
    seen, seen_softmax, seen_bias = np.full(BUCKETS, 1e-10, np.float32), np.full(DIMENSIONS, 1e-10), 1e-10
    labels = np.asarray(labels)
    order = rng.permutation(len(texts))
    parts = [order[i : i + batch] for i in range(0, len(order), batch)]
    prepared = [(Grams.of([texts[i] for i in p]), labels[p]) for p in parts]
    prepared = [(g, y) for g, y in prepared if len(g.counts)]
    turns = [int(k) for _ in range(-(-steps // len(prepared))) for k in rng.permutation(len(prepared))][:steps]
    for t, k in enumerate(turns):
        step = rate * (1 - t / len(turns))
        g, y = prepared[k]
        direction = softmax[:, 1] - softmax[:, 0]
        sums = g.word_sums(vectors @ direction)
        per_word = np.zeros(len(g.counts))  # d loss / d sum of the logit parts of a word's n-grams
        total = 0.0
        for size in (WINDOW, 1):
            at, text = g.windows(size)
            n = np.add.reduceat(g.counts, at)
            logits = SCALE * np.add.reduceat(sums, at) / n + bias[1] - bias[0]
            chosen = np.arange(len(at)) if size > 1 and t < len(turns) // 12 else _worst(logits, text)
            if size == 1:
                chosen = chosen[y[text[chosen]] == 0]
            if not len(chosen):
                continue
            error = 1 / (1 + np.exp(-np.clip(logits[chosen], -40, 40))) - y[text[chosen]]
            error /= len(chosen)
            total += error.sum()
            stop = np.minimum(at[chosen] + size, g.first[text[chosen] + 1])
            change = np.zeros(len(g.counts) + 1)
            np.add.at(change, at[chosen], SCALE * error / n[chosen])
            np.add.at(change, stop, -SCALE * error / n[chosen])
            per_word += np.cumsum(change[:-1])
        per_word[np.abs(per_word) < 1e-12] = 0
        used = per_word[g.word]
        some = np.flatnonzero(used)
        weight = np.bincount(g.bucket[some], used[some], BUCKETS).astype(np.float32)
        hit = np.flatnonzero(weight)
        pull = weight[hit] @ vectors[hit]  # d loss / d (w1 - w0)
        # every bucket, and every part of the softmax, has steps that shrink with its own past gradients
        seen[hit] += weight[hit] ** 2
        vectors[hit] -= step * (weight[hit] / np.sqrt(seen[hit]))[:, None] * direction
        seen_softmax += pull**2
        turn = step * pull / np.sqrt(seen_softmax)
        softmax[:, 1] -= turn
        softmax[:, 0] += turn
        seen_bias += total**2
        bias += 2 * step * total / np.sqrt(seen_bias) * np.array([1, -1])
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit_calibrated(texts: list[str], labels: np.ndarray) -> Model:
    """Fit on four fifths of the texts and bring the logits to scale on the rest."""
    apart = np.zeros(len(texts), bool)
    for k in (0, 1):  # of each class every fifth
        apart[np.flatnonzero(labels == k)[::5]] = True
    if len(set(labels[~apart].tolist())) < 2:
        return fit(texts, labels)
    model = fit([t for t, x in zip(texts, apart) if not x], labels[~apart])
    return calibrated(model, [t for t, x in zip(texts, apart) if x], labels[apart])


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = PER_CLASS) -> Model | None:
    """Fit on a bounded sample of the labelled rows for which ``usable`` (on doc_id) holds; None without both classes."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.filter(usable) if usable is not None else known
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.filter(F.length("text").between(1, MAX_CHARS)).select("doc_id")
    eligible = known.join(short, "doc_id", "left_semi")
    sizes = {r["toxic"]: r["count"] for r in eligible.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    sample = [bounded_sample(eligible.filter(F.col("toxic") == k), F.col("doc_id"), per_class, n) for k, n in sizes.items()]
    ids = F.broadcast(sample[0].unionByName(sample[1]))  # 2 * per_class rows of two numbers
    rows = docs.filter(F.length("text").between(1, MAX_CHARS)).join(ids, "doc_id").select("doc_id", "text", "toxic")
    found = {(r["doc_id"], r["text"]): r["toxic"] for r in rows.collect()}
    model = fit_calibrated([t for _, t in sorted(found)], np.array([found[x] for x in sorted(found)]))
    del found, rows
    give_back()
    return model


def with_scores(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """``docs`` plus the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != column]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            scores = shared.value.scores(texts.to_pylist()) if shared.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores)], names=[*keep, column])

    return docs.mapInArrow(score, StructType([*[docs.schema[c] for c in keep], StructField(column, DoubleType())]))


def held_out() -> Column:
    """A third of all documents by their ids; their labels are never learnt."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels, ~held_out())
    return with_scores(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    model = train(docs, labels, ~held_out())
    return with_scores(docs, model, "_tx_score").filter(F.col("_tx_score") < threshold).select(*docs.columns)
