"""Language identification by unigrams of pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary that are lower-case letters, with or without its word mark; every other
letter is a piece of its own kind, ``unknown``. Each language has one probability for each piece. The probability of a word
under a language is the sum over all its segmentations into pieces of the product of their probabilities; the
forward algorithm gives it position by position, for many words of one length at once, and rescales when the numbers get small. No piece
goes across a word mark, so a text's log probability is the sum of those of its words (runs of letters, lower-cased).
The score is the share of the best language among all, each taken as equally likely before.

Fitting: at most ``rows`` texts of each language (those with the least hash of their id), whole texts. Expected piece counts over
all segmentations (forward and backward) are taken ``rounds`` times. Fitted numbers are one row for each piece.

Words are scored once for a task, in a memory that starts anew when its keys have MEMORY_BYTES. One pass, no shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text where nothing can be learned;
ties go to the language that sorts first; repeated rows and ids give equal results; an empty table gives no row; of extra columns whose
name clashes with an added one, that of the operator wins.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pathloom.llm.common import BASE, blocks, give_back, keep_columns, mix

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_ROWS = 1500  # of each language
ROUNDS = 4
PSEUDO_COUNT = 0.1
MARK = "▁"
MEMORY_BYTES = 64 << 20
WORDS_AT_ONCE = 4096
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
FILTER_BITS = 22
SMALL = 1e-120


def text_words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    found = WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    # \w also holds numbers such as superscripts, which are no letters
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


@dataclass
class Pieces:
    """Hashes of the usable pieces in order; the number behind the last one is the unknown letter."""

    hashes: np.ndarray
    longest: int

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        names = [p for p in names if (p.removeprefix(MARK).isalpha() or p == MARK) and p == p.lower()]
        by_length = defaultdict(list)
        for p in names:
            by_length[len(p)].append(p)
        hashes = [mix(prefix_hashes(codes(v))[:, -1]) for v in by_length.values()]
        return cls(np.unique(np.concatenate(hashes)), max(by_length))

    def __post_init__(self):
        self.seen = np.zeros(1 << FILTER_BITS, bool)  # most substrings are no piece; this tells it without a search
        self.seen[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def lattice(self, words: np.ndarray) -> np.ndarray:
        """Piece that ends behind each place with each length: (words, places, lengths); -1 where there is none."""
        n, width = words.shape
        sums = prefix_hashes(words)
        out = np.full((n, width, self.longest), -1, np.int32)
        for size in range(1, min(self.longest, width) + 1):
            step = np.uint64(pow(int(BASE), size, 1 << 64))
            h = mix(sums[:, size:] - sums[:, :-size] * step)
            row, at = np.nonzero(self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            value = h[row, at]
            place = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
            hit = self.hashes[place] == value
            out[row[hit], at[hit] + size - 1, size - 1] = place[hit]
        single = out[:, :, 0]
        single[single < 0] = len(self.hashes)
        return out


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one word a row."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def prefix_hashes(words: np.ndarray) -> np.ndarray:
    out = np.zeros((words.shape[0], words.shape[1] + 1), np.uint64)
    values = mix(words.astype(np.uint64) + np.uint64(1))
    for i in range(words.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + values[:, i]
    return out


def forward(lattice: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the segmentations of each prefix, and the logarithm of the scale of each: (words, places + 1, languages).

    ``prob`` has a row for each piece, one for the unknown letter and, last, one of zeros for "no piece".
    """
    n, width, longest = lattice.shape
    langs = prob.shape[1]
    sums = np.zeros((n, width + longest, langs))  # ``longest - 1`` empty places before the start
    sums[:, longest - 1] = 1.0
    scale = np.zeros((n, width + 1, langs))
    for i in range(width):
        reach = min(longest, i + 1)
        ring = sums[:, i + longest - reach : i + longest][:, ::-1]  # by piece length, shortest first
        now = np.einsum("nlk,nlk->nk", ring, np.take(prob, lattice[:, i, :reach], axis=0, mode="wrap"))
        low = now < SMALL
        scale[:, i + 1] = scale[:, i]
        if low.any():
            # the places within reach move to a scale of their own
            up = np.where(low, 1.0 / SMALL, 1.0)
            ring *= up[:, None, :]
            now *= up
            scale[:, i + 1] -= np.log(up)
        sums[:, i + longest] = now
    return sums[:, longest - 1 :], scale


def log_probabilities(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language."""
    out = np.zeros((len(words), prob.shape[1]))
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w)].append(i)
    for length, at in by_length.items():
        step = max(1, WORDS_AT_ONCE * 8 // (length + 1))
        for s in range(0, len(at), step):
            part = at[s : s + step]
            sums, scale = forward(pieces.lattice(codes([MARK + words[i] for i in part])), prob)
            out[part] = np.log(sums[:, -1]) + scale[:, -1]
    return out


def expected_counts(words: list[str], weight: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of words with these counts, under one language (``prob`` has one column)."""
    total = np.zeros(len(pieces) + 2)
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        if len(w) <= 64:  # longer runs of letters tell nothing more about pieces, and need no scales here
            by_length[len(w)].append(i)
    for at in by_length.values():
        for s in range(0, len(at), WORDS_AT_ONCE):
            part = at[s : s + WORDS_AT_ONCE]
            table = pieces.lattice(codes([MARK + words[i] for i in part]))
            n, width, longest = table.shape
            p = prob[table, 0]
            before = np.zeros((n, width + longest))
            before[:, longest - 1] = 1.0
            for i in range(width):
                before[:, i + longest] = (before[:, i : i + longest][:, ::-1] * p[:, i]).sum(1)
            after = np.zeros((n, width + 1))
            after[:, width] = 1.0
            for i in range(width - 1, -1, -1):
                # a piece that ends behind place i and has l letters begins at i + 1 - l
                for size in range(1, min(longest, i + 1) + 1):
                    after[:, i + 1 - size] += p[:, i, size - 1] * after[:, i + 1]
            whole = before[:, -1]
            ok = whole > 0
            factor = np.where(ok, weight[part] / np.where(ok, whole, 1.0), 0.0)
            for i in range(width):
                used = before[:, i : i + longest][:, ::-1] * p[:, i] * (after[:, i + 1] * factor)[:, None]
                total += np.bincount(table[:, i].ravel() % len(total), used.ravel(), len(total))
    return total[:-1]


def learn(counts: dict[str, Counter], pieces: Pieces, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the table for ``forward``, from word counts of each language."""
    names = sorted(counts)
    prob = np.zeros((len(pieces) + 2, len(names)))
    for k, name in enumerate(names):
        words = list(counts[name])
        weight = np.array([counts[name][w] for w in words], float)
        p = np.append(np.full(len(pieces) + 1, 1.0 / (len(pieces) + 1)), 0.0)[:, None]
        for _ in range(rounds):
            c = expected_counts(words, weight, pieces, p) + PSEUDO_COUNT
            p[:-1, 0] = c / c.sum()
        prob[:, k] = p[:, 0]
    return names, prob


def sample_texts(docs: DataFrame, learnable: Column, rows: int) -> DataFrame:
    """(lang, text) of at most ``rows`` learnable rows of each language, those with the least hash of the id."""
    wanted = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64(F.lit(12), F.col("doc_id")).alias("h")
    )
    sizes = {r["lang"]: r["n"] for r in wanted.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return wanted.select("lang", "text").limit(0)
    # four times the rows wanted pass a bound on the hash first, so that no language is sorted as a whole
    bounds = [x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(int((min(1.0, 4 * rows / n) * 2 - 1) * 2**63), 2**63 - 1)))]
    few = wanted.filter(F.col("h") <= F.create_map(*bounds)[F.col("lang")])
    w = W.partitionBy("lang").orderBy("h", "text")
    return few.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= rows).select("lang", "text")


def word_counts(texts: DataFrame) -> dict[str, Counter]:
    """Counts of the words of the sample, taken by Spark; what comes back is bounded with the sample."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in blocks(batches):
            seen: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), found.to_pylist()):
                seen.update((lang, w) for w in text_words(text))
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    rows = texts.mapInArrow(cut, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, Counter] = defaultdict(Counter)
    for lang, word, n in zip(*(rows[c].to_pylist() for c in ("lang", "word", "n"))):
        out[lang][word] = n
    return out


class WordScores:
    """Log probabilities of words, remembered up to a number of bytes."""

    def __init__(self, pieces: Pieces, prob: np.ndarray):
        self.pieces, self.prob = pieces, prob
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1, self.prob.shape[1]))
        self.used = self.size = 0

    def add(self, words: set[str]) -> None:
        if self.size > MEMORY_BYTES:
            self.clear()
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if self.used + len(new) > len(self.scores):
            grown = np.zeros((2 * (self.used + len(new)), self.prob.shape[1]))
            grown[: self.used] = self.scores[: self.used]
            self.scores = grown
        self.scores[self.used : self.used + len(new)] = log_probabilities(new, self.pieces, self.prob)
        self.known.update(zip(new, range(self.used, self.used + len(new))))
        self.used += len(new)
        self.size += sum(map(len, new)) + (180 + 16 * self.prob.shape[1]) * len(new)

    def texts(self, rows: list[list[str]]) -> np.ndarray:
        self.add({w for r in rows for w in r})
        get = self.known.__getitem__
        return np.array([self.scores[list(map(get, r))].sum(0) if r else np.zeros(self.prob.shape[1]) for r in rows])


def identify(
    docs: DataFrame,
    learnable: Column,
    vocabulary: str | None = None,
    rows: int = SAMPLE_ROWS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` without ``text`` plus lang_pred and score; fitted on the rows of ``docs`` where ``learnable`` holds."""
    pieces = Pieces.load(vocabulary or public_tokenizers.path(VOCABULARY))
    names, prob = learn(word_counts(sample_texts(docs, learnable, rows)), pieces, rounds)
    give_back()
    added = ("lang_pred", "score")
    keep = keep_columns(docs, "text", *added)
    schema = StructType(
        [*[docs.schema[c] for c in keep], StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast((pieces.hashes, pieces.longest, names, prob))  # some 200 bytes a piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, longest, langs, table = shared.value
        memory = WordScores(Pieces(hashes, longest), table)
        for batch, texts in blocks(batches):
            found = [text_words(t) for t in texts.to_pylist()]
            pred, score = [UNDETERMINED] * len(found), np.zeros(len(found))
            if langs and found:
                total = memory.texts(found)
                best = total.argmax(1)
                share = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                has = np.array([bool(x) for x in found])
                pred = [langs[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist())]
                score = np.where(has, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=[*keep, *added],
            )

    return docs.select(*keep, "text").mapInArrow(run, schema)
