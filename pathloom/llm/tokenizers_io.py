"""Ids of whole texts under the public vocabularies, as flat arrays.

``ByteBpe`` gives the ids of ``byte_bpe_50k.json``. Its vocabulary also exists as ranks for a second library that is several times faster and
needs no memory of earlier words; texts made only of characters that every release of Unicode classes alike go there, all others to
the library of the file. Tests hold both against each other.

``PieceBpe`` gives the ids of ``piece_bpe_32k.model``. No piece of it has its space mark behind another character, so
what lies between single spaces is encoded independently; each such stretch is encoded once, in a memory that
starts anew when its keys and ids have MEMORY_BYTES. It lives as long as the encoder, which is made for one task.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers

MEMORY_BYTES = 64 << 20
ENTRY_BYTES = 170  # of the memory, beside key and ids
LONGEST_STRETCH = 64
#: Latin letters and signs, general punctuation but for its spaces and invisible signs; their classes never changed
PLAIN = re.compile("[\x00-\x84\x86-ɏ‐-‧‰-⁞]*")
END_OF_TEXT = "<|endoftext|>"
BETWEEN = re.compile(r"(?<=[^ ])(?= [^ ])")  # one space between other characters


class ByteBpe:
    """byte_bpe_50k. ``specials``: a special token's string in a text is that token; else it is ordinary text."""

    def __init__(self, path: str | None = None, specials: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task for every core
        self.path, self.specials = path or public_tokenizers.path("byte_bpe_50k.json"), specials
        self.fast, self.library = None, None
        ranks = os.path.splitext(self.path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def exact(self, texts: list[str]) -> list[list[int]]:
        """The library of the file."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_padding()
            self.library.no_truncation()
            self.library.encode_special_tokens = not self.specials
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> array:
        if self.fast is None or (self.specials and END_OF_TEXT in text) or PLAIN.fullmatch(text) is None:
            return array("I", self.exact([text])[0])
        return array("I", self.fast.encode_ordinary(text))

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: its entry, byte-level decoded."""
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(self.path).get_vocab(with_added_tokens=False)
        # fixed rule of byte-level vocabularies: printable Latin bytes stand for themselves, the others follow from U+0100
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in shown}
        sign |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        out = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            out[i] = bytes(sign[c] for c in entry) if all(c in sign for c in entry) else entry.encode()
        return out


class _Memory(dict):
    """A dictionary that notes the keys it was asked for and does not have."""

    def __init__(self):
        self.asked: list[str] = []

    def __missing__(self, key: str) -> None:
        self.asked.append(key)


class PieceBpe:
    """piece_bpe_32k; encoding puts a space before the text."""

    def __init__(self, path: str | None = None, memory: int = MEMORY_BYTES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.memory, self.size = memory, 0
        self.long: list[str] = []
        self.known = _Memory()

    @staticmethod
    def stretches(text: str) -> list[str]:
        """Pieces to encode one by one, each without the space before it, which the encoder puts there."""
        if "▁" in text:  # the mark itself is a space to the encoder
            return [text]
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [s[1:] for s in BETWEEN.split(" " + text)]
        return text.split(" ")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.size > self.memory:
            self.known, self.size = _Memory(), 0
        known, out = self.known, []
        for text in texts:
            words = self.stretches(text)
            ids = list(map(known.__getitem__, words))
            if known.asked:
                self.learn(list(set(known.asked)))
                known.asked.clear()
                ids = map(known.__getitem__, words)
            out.append(b"".join(ids))
            if self.long:
                self.forget()
        return out

    def learn(self, words: list[str]) -> None:
        ids = [array("I", e).tobytes() for e in self.model.encode(words, num_threads=1)]
        self.known.update(zip(words, ids))
        self.long = [s for s in words if len(s) > LONGEST_STRETCH]
        self.size += ENTRY_BYTES * len(words) + sum(map(len, words)) + sum(map(len, ids))

    def forget(self) -> None:
        """Very long stretches are not worth their memory."""
        for s in self.long:
            self.size -= ENTRY_BYTES + len(s) + len(self.known.pop(s))
        self.long = []

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: its piece in UTF-8, U+2581 as a space, <0xHH> as that byte."""
        m = self.model
        pieces = (m.id_to_piece(i) for i in range(m.get_piece_size()))
        return [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def byte_table(tokens: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Bytes and lengths by id."""
    return pa.array(tokens, pa.large_binary()), np.array([len(t) for t in tokens], np.int64)


def joined(table: pa.Array, ids: np.ndarray) -> memoryview:
    """The bytes of a sequence of ids, one after the other."""
    out = table.take(pa.array(ids))
    _, ends, data = out.buffers()
    stop = int(np.frombuffer(ends, np.int64)[len(out)]) if len(out) else 0
    return memoryview(data).cast("B")[:stop] if stop else memoryview(b"")  # bytes compare as unsigned
