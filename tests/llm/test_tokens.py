"""Token counts and packing against the libraries, on awkward texts and on the smallest tables."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pathloom.llm import packing, token_counts

ODD = [
    None, "", " ", "\n\n", "a", "  two  spaces ", "tab\tand\nline", "x\x1cy\x1d z", "nbsp\xa0here a b　c", "́ é é",
    "mid<|endoftext|>dle <|startoftext|> end", "it's we'll I'D THEY'RE", "ΣΑΣ ΟΔΟΣ ς", "ẞ straße İstanbul", "日本語の文章です。", "🙂🙂 🙂‍",
    "a" * 500, "ab " * 3000, "no-space-" * 800, " \n x \n\n  y\t\t", "word\u0085next", "12345 678 9,000.5", "\r\n win \r\n", "x  \ny", "…—“q”",
]


def odd_texts():
    r = random.Random(3)
    alphabet = "ab é\n\t  .,'12  Σ\x1c<|>"
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 200))) for _ in range(150)]


@pytest.fixture(scope="module")
def frame(spark, sf):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    return odd.unionByName(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 256), (64, 8), (7, 2)])
def test_counts_are_the_library_s(frame, chunk, overlap):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    got = token_counts.count_tokens(frame, chunk=chunk, overlap=overlap).collect()
    assert len(got) == len(texts)
    for r in got:
        want = len(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert r["n_tokens"] == want, repr(texts[r["doc_id"]][:80])
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (want > 2048)


class Stub:
    """Pairs of characters of every word; the first words of what it is given come out as single characters, with ids of their own for each place."""

    def __init__(self, spoiled):
        self.spoiled, self.seen = spoiled, []

    def __call__(self, text):
        self.seen.append(len(text))
        ids, offsets = [], []
        for i, m in enumerate(re.finditer(r"\S+", text)):
            step = 1 if i < self.spoiled else 2
            for k in range(m.start(), m.end(), step):
                offsets.append((k, min(k + step, m.end())))
                ids.append(hash((text[slice(*offsets[-1])], i if i < self.spoiled else -1)))
        return ids, offsets


@pytest.mark.parametrize("spoiled", [0, 2, 9, 400])
def test_overlap_widens_until_both_agree(spoiled):
    r = random.Random(spoiled)
    text = " ".join("".join(r.choice("abc") for _ in range(r.randint(2, 9))) for _ in range(600))
    stub = Stub(spoiled)
    whole = len(stub(text)[0])
    stub.seen.clear()
    assert token_counts.count_long(text, stub, chunk=200, overlap=16) == whole
    # an overlap that never agrees ends in one encoding of the whole; one that does keeps chunks small
    assert (max(stub.seen) == len(text)) == (spoiled == 400)


def test_text_without_white_space_is_one_chunk():
    stub = Stub(0)
    assert token_counts.count_long("ab" * 5000, stub, chunk=200, overlap=16) == 5000
    assert max(stub.seen) == 10000 and sum(stub.seen) < 12 * 10000


def test_boundary_needs_equal_ids_and_offsets_on_both_sides():
    t = lambda *x: token_counts.Tokens(*(np.array(c) for c in zip(*x)))
    left = t((1, 0, 2), (2, 3, 5), (3, 6, 8), (4, 9, 10))
    assert token_counts.common_boundary(left, t((2, 3, 5), (3, 6, 8), (9, 9, 12))) == 6
    assert token_counts.common_boundary(left, t((7, 3, 5), (3, 6, 8), (9, 9, 12))) is None  # another id before
    assert token_counts.common_boundary(left, t((2, 4, 5), (3, 6, 8), (9, 9, 12))) is None  # another offset before
    assert token_counts.common_boundary(t((2, 3, 6), (3, 6, 8)), t((2, 3, 6), (3, 6, 8))) is None  # no white space between


def test_memory_of_words_starts_anew(frame):
    import public_tokenizers

    words = token_counts.WordCounter(public_tokenizers.path("word_bpe_49k.json"), memory=1000)
    for r in frame.limit(50).collect():
        found = set(token_counts.split_words(r["text"] or ""))
        words.learn(found)
        assert found <= set(words.known)


def test_counts_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "x y", 5), (1, "x y", 5), (None, None, None)], "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(df)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(r["n_tokens"] for r in got.collect()) == [0, 2, 2]
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_packing_is_a_round_trip(frame):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    got = {}
    sequences = set()
    for r in packing.pack(frame, with_ids=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
        sequences.add(r["sequence_id"])
        assert r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        assert r["bucket"] == r["length"].bit_length() - 1
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert len(sequences) == sum(map(len, got.values()))
    assert got.keys() == texts.keys()
    for d, rows in got.items():
        rows.sort(key=lambda r: r["start"])
        ids = [x for r in rows for x in r["ids"]]
        assert ids == t.encode(texts[d], add_special_tokens=False).ids + [1], repr(texts[d][:80])
        assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["length"] for r in rows[:-1]]))
        assert {r["doc_tokens"] for r in rows} == {len(ids)}


def test_packing_of_repeated_and_missing_rows(spark):
    df = spark.createDataFrame([(1, "x y", 5), (1, "x y", 5), (None, None, 1)], "doc_id long, text string, length int")
    rows = packing.pack(df).collect()
    assert sorted(r["length"] for r in rows) == [1, 1, 1, 2, 2]
    assert len({r["sequence_id"] for r in rows}) == 5
    assert packing.pack(df.limit(0)).count() == 0


def test_decompose():
    doc, start, length = packing.decompose(np.array([1, 2048, 4100, 7]), 2048)
    assert doc.tolist() == [0, 1, 2, 2, 2, 3, 3, 3]
    assert length.tolist() == [1, 2048, 2048, 2048, 4, 4, 2, 1]
    assert start.tolist() == [0, 0, 0, 2048, 4096, 0, 4, 6]
