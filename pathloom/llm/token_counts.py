"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of more than CHUNK characters is encoded by the library in chunks that overlap, each with ids and offsets. In the overlap, both encodings
are searched for a common boundary that is proven stable: two tokens on end, with white space between them, that both encodings give
with the same ids and the same offsets. White space is never inside a token and separates what the library encodes
independently, so tokens before such a place do not depend on what follows, nor those behind it on what precedes; a word cut by the edge of a
chunk has other tokens or offsets, or no neighbour in one of them. The left encoding counts up to the boundary, the right one from
there on. Where the overlap holds none, it is doubled until it does; once it reaches the start of the left chunk, the longer encoding
takes the place of the left one, so a text without white space ends as one chunk.

Texts of at most CHUNK characters are counted word by word: the words between white space, each distinct one encoded once for a task, in a
memory that starts anew when it holds MEMORY_BYTES. It is dropped when the task ends.

Defined cases: null and empty texts have 0 tokens; special strings within a text are handled as the
library does by default; rows and extra columns stay, and of clashing names those of the operator win.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from pathloom.llm.common import blocks, keep_columns

CHUNK = 1 << 15  # characters
OVERLAP = 256
MEMORY_BYTES = 64 << 20
ENTRY_BYTES = 160  # of a word in the memory, beside its characters
BLANK = re.compile(r"[ \t-\r]+")
#: white space to str.split that is not ASCII white space to the library, or may not be
ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_words(text: str) -> list[str]:
    """The pieces between ASCII white space."""
    if not text.isascii() or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        if ODD_BLANK.search(text):
            return [w for w in BLANK.split(text) if w]
    return text.split()


class Tokens(NamedTuple):
    """Ids with their character offsets in the whole text."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def behind(self, place: int) -> "Tokens":
        return Tokens(*(x[int(np.searchsorted(self.starts, place)) :] for x in self))


#: text of a chunk to its ids and offsets
Encode = Callable[[str], tuple[list[int], list[tuple[int, int]]]]


def common_boundary(left: Tokens, right: Tokens) -> int | None:
    """The last start of a token that both encodings have, with the same token before it and a gap between the two."""
    if len(left.ids) < 2 or len(right.ids) < 2:
        return None
    _, at, to = np.intersect1d(left.starts[1:], right.starts[1:], assume_unique=False, return_indices=True)
    good = left.ends[at] < left.starts[at + 1]
    for k in (0, 1):  # the token before the boundary and the one behind it
        for a, b in zip(left, right):
            good &= a[at + k] == b[to + k]
    return int(left.starts[at[good][-1] + 1]) if good.any() else None


def count_long(text: str, encode: Encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from overlapping chunks spliced at common boundaries."""

    def tokens(start: int, stop: int) -> Tokens:
        ids, offsets = encode(text[start:stop])
        place = np.array(offsets, np.int64).reshape(-1, 2) + start
        return Tokens(np.array(ids, np.int64), place[:, 0], place[:, 1])

    origin, total, start, stop = 0, 0, 0, min(len(text), chunk)  # origin: where the left encoding begins; start: what is counted so far
    left = tokens(origin, stop)
    while stop < len(text):
        wide = overlap
        while True:
            low = max(origin, stop - wide)
            high = min(len(text), stop + max(chunk, stop - low))
            right = tokens(low, high)
            if low == origin:
                left = right  # the longer encoding of the same beginning
                break
            open_left = left.behind(start)
            place = common_boundary(open_left, right)
            if place is not None:
                total += int(np.searchsorted(open_left.starts, place))
                origin, start, left = low, place, right
                break
            wide *= 2
        stop = high
    return total + len(left.behind(start).ids)


class WordCounter:
    """Encodes with the library and remembers how many tokens a word has; one for a task."""

    def __init__(self, path: str, memory: int = MEMORY_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.memory, self.size = memory, 0
        self.known: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet; afterwards all of ``words`` are."""
        if self.size > self.memory:
            self.known, self.size = {}, 0
        new = [w for w in words if w not in self.known]
        if new:
            encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.known.update(zip(new, map(len, encoded)))
            self.size += ENTRY_BYTES * len(new) + sum(map(len, new))

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return found.ids, found.offsets


def count_tokens(
    docs: DataFrame,
    vocabulary: str | None = None,
    limit: int = 2048,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` without ``text`` plus n_bytes, n_tokens and over_limit. Nothing shuffles."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    added = ("n_bytes", "n_tokens", "over_limit")
    keep = keep_columns(docs, "text", *added)
    fields = [docs.schema[c] for c in keep]
    schema = StructType(
        [*fields, StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordCounter(path)
        for batch, texts in blocks(batches):
            rows, seen = [], set()
            for text in texts.to_pylist():
                words = None if len(text) > chunk else split_words(text)
                if words:
                    seen.update(words)
                rows.append(words if words is not None else text)
            words_of.learn(seen)
            known = words_of.known
            n = [sum(map(known.__getitem__, x)) if isinstance(x, list) else -1 for x in rows]
            n = [count_long(x, words_of.encode, chunk, overlap) if k < 0 else k for k, x in zip(n, rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                names=[*keep, *added],
            )

    return docs.mapInArrow(count, schema)
