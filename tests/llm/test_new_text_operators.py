"""Tokenizer alignment, language identification and fill-in-middle against plain versions and on odd rows."""

import hashlib
import random
import re
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pathloom.llm import fill_middle, language_id, token_alignment
from pathloom.llm import queries as q
from pathloom.llm.tokenizers_io import ByteBpe, PieceBpe, byte_table, joined

ODD = [
    None, "", " ", "  ", "a  b", " a", "a ", "a  ", " \n x \n\n  y\t\t", "x" * 300, "<|endoftext|> z", "a<|endoftext|>b", "<s> </s> <unk>",
    "word\u0085next", "nbsp\xa0here", "\u3000 x", "a\u2581b \u2581 c", "it's we'll I'D 12345 678 \u2026\u2014\u201cq\u201d", "ab " * 3000,
    "trailing \n", "\x00 a\x00", "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059\u3002", "1234567890" * 50, "\U0001f642\U0001f642 \U0001f642\u200d",
]


def odd_texts(n=200, seed=5):
    r = random.Random(seed)
    letters = "ab \u00e9\n\t  .,'12  \u03a3\x1c<|>\u2581\u65e5\U0001f642"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return odd_texts() + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


# ---------------------------------------------------------------- encoders
@pytest.mark.parametrize("specials", [True, False])
def test_fast_ids_are_the_library_s(texts, specials):
    e = ByteBpe(specials=specials)
    r = random.Random(8)
    signs = [*range(0, 0x85), *range(0x86, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
    many = [t or "" for t in texts] + ["".join(chr(r.choice(signs)) for _ in range(60)) for _ in range(500)]
    for text, want in zip(many, e.exact(many)):
        assert e.encode(text).tolist() == want, repr(text[:80])


@pytest.mark.parametrize("memory", [64 << 20, 2000])
def test_remembered_stretches_are_the_library_s(texts, memory):
    p = PieceBpe(memory=memory)
    many = [t or "" for t in texts]
    want = [array("I", x).tobytes() for x in p.model.encode(many)]
    for _ in range(2):
        assert p.encode_batch(many) == want


def test_token_bytes_make_the_text_again(texts):
    e = ByteBpe(specials=False)
    table, _ = byte_table(e.token_bytes())
    for t in texts:
        assert bytes(joined(table, np.array(e.encode(t or ""), np.uint32))) == (t or "").encode()


# ---------------------------------------------------------------- alignment
def plain_alignment(texts):
    """Everything by definition: merged cuts, all overlapping pairs, counts over all texts."""
    a_of, b_of = ByteBpe(specials=False), PieceBpe()
    bytes_a, bytes_b = a_of.token_bytes(), b_of.token_bytes()
    counts, rows = Counter(), []
    for t in texts:
        a = a_of.exact([" " + t])[0] if t else []
        b = b_of.model.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
            a, b = [], []
        to_a, to_b = np.cumsum([len(bytes_a[i]) for i in a]).tolist(), np.cumsum([len(bytes_b[i]) for i in b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(to_a) & set(to_b)):
            i2, j2 = to_a.index(cut, i) + 1, to_b.index(cut, j) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            for x in range(i, i2):
                for y in range(j, j2):
                    if max(to_a[x] - len(bytes_a[a[x]]), to_b[y] - len(bytes_b[b[y]])) < min(to_a[x], to_b[y]):
                        links.append((a[x], b[y]))
            i, j = i2, j2
        counts.update(links)
        rows.append((len(a), len(b), len(groups), len(links), ";".join(groups), links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(*r[:5], sum(counts[p] == top[p[1]] for p in r[5]), sum(counts[p] for p in r[5])) for r in rows]


@pytest.mark.parametrize("part", [token_alignment.PART_PAIRS, 500])
def test_alignment_by_definition(spark, texts, part):
    some = [t if t is None else t[:2000] for t in texts[:300]]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(5)
    want = plain_alignment(some)
    for r in token_alignment.align_tokenizers(df, part_pairs=part).collect():
        got = tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"))
        assert got == want[r["doc_id"]], repr(some[r["doc_id"]])


def test_alignment_digest_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "x yz", 5), (1, "x yz", 5), (None, None, 7)], "doc_id long, text string, n_links int")
    rows = token_alignment.align_tokenizers(df, digest=True).collect()
    assert len(rows) == 3 and {r["groups_sha256"] for r in rows if r["doc_id"] is None} == {""}
    twice = [r for r in rows if r["doc_id"] == 1]
    assert twice[0] == twice[1] and twice[0]["count_sum"] == 2 * twice[0]["n_links"]
    assert token_alignment.align_tokenizers(df.limit(0)).count() == 0


def test_intervals_without_cuts_and_cuts_at_one_side():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 60)
        a = sorted({*r.sample(range(1, n + 1), r.randint(1, n)), n})
        b = sorted({*r.sample(range(1, n + 1), r.randint(1, n)), n})
        x, y = np.array(a), np.array(b)
        ends_a, ends_b = token_alignment.divide(x, y, *(np.array([v]) for v in (0, len(a), 0, len(b))))
        assert x[ends_a].tolist() == y[ends_b].tolist() == sorted(set(a) & set(b))
        of_a, of_b = token_alignment.overlaps(x, y, ends_a, ends_b)
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max([0, *a][i], [0, *b][j]) < min(a[i], b[j])]
        assert list(zip(of_a.tolist(), of_b.tolist())) == want


# ---------------------------------------------------------------- language
@pytest.fixture(scope="module")
def pieces():
    return language_id.Pieces.load(public_tokenizers.path(language_id.VOCABULARY))


def named_pieces():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(language_id.VOCABULARY))
    return {p for p in map(m.id_to_piece, range(m.get_piece_size())) if (p.removeprefix("\u2581").isalpha() or p == "\u2581") and p == p.lower()}


def plain_sum(word, prob):
    """Sum over all segmentations by recursion; ``prob`` by piece, None for an unknown letter."""
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(max(0, end - 16), end):
            piece = word[begin:end]
            p = prob(piece) if prob(piece) is not None else (prob(None) if end - begin == 1 else None)
            total[end] += total[begin] * p if p is not None else 0.0
    return total[-1]


def test_forward_sums_all_segmentations(pieces):
    names = named_pieces()
    assert len(names) == len(pieces)
    r = np.random.default_rng(1)
    table = np.zeros((len(pieces) + 2, 2))
    table[:-1] = r.random((len(pieces) + 1, 2)) * 1e-3
    at = {p: int(np.searchsorted(pieces.hashes, language_id.mix(language_id.prefix_hashes(language_id.codes([p]))[:, -1])[0])) for p in names}
    words = ["house", "stra\u00dfe", "\u00f1and\u00fa", "a", "zzqx", "\u65e5\u672c", "the" * 12, "x" * 40]
    got = language_id.log_probabilities(words, pieces, table)
    for i, w in enumerate(words):
        for k in range(2):
            value = plain_sum("\u2581" + w, lambda p: table[-2, k] if p is None else table[at[p], k] if p in at else None)
            assert got[i, k] == pytest.approx(np.log(value), rel=1e-9)


def test_very_long_words_keep_their_scale(pieces):
    table = np.zeros((len(pieces) + 2, 1))
    table[:-1] = 1e-5
    one, two = language_id.log_probabilities(["ab" * 2000, "ab" * 4000], pieces, table)[:, 0]
    assert np.isfinite([one, two]).all() and two == pytest.approx(2 * one, rel=1e-3)


def test_expected_counts_add_up(pieces):
    table = np.append(np.full(len(pieces) + 1, 1e-3), 0.0)[:, None]
    c = language_id.expected_counts(["ab"], np.array([2.0]), pieces, table)
    # every segmentation of three signs uses one to three pieces
    assert 2.0 <= c.sum() <= 6.0


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    got = q.op12_language_id(spark, sf).join(docs, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and sum(r["lang_pred"] == r["truth"] for r in held) >= 0.98 * len(held)
    assert all(0.0 <= r["score"] <= 1.0 for r in got)


def test_language_of_odd_rows(spark):
    rows = [(i, "the house and the garden of the man", "en", 1) for i in range(6)]
    rows += [(10 + i, "das haus und der garten des mannes", "de", 1) for i in range(6)]
    rows += [(20, None, "en", 1), (21, "", None, 1), (22, "123 \u00b2\u00bd !?", "de", 1), (23, "THE MAN", None, 1), (23, "THE MAN", None, 1), (None, "der mann", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = language_id.identify(df, F.lit(True)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert len(got) == len(rows) and by[20] == by[21] == by[22] == [("und", 0.0)]
    assert by[23][0] == by[23][1] and by[23][0][0] == "en" and by[None][0][0] == "de"
    assert language_id.identify(df.limit(0), F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df, F.lit(False)).collect()} == {"und"}


# ---------------------------------------------------------------- fill in middle
def plain_fill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_fill_middle_by_definition(spark):
    r = random.Random(1)
    many = ODD + ["<P>", "x<S>y", "<", "<S", "a$1b\\n$", "\n", "ab " * 100000, "a" * 500000]
    many += ["".join(r.choice("ab <PSM>\n$\\\U0001f642\u00e9") for _ in range(r.randint(0, 30))) for _ in range(1500)]
    rows = [(i, t, 1) for i, t in enumerate(many)] + [(None, "hello there", 1), (3, "same", 1), (3, "same", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = Counter(tuple(r) for r in fill_middle.transform(df).collect())
    assert got == Counter((i, *plain_fill(i, t)) for i, t, _ in rows)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(df.limit(0)).count() == 0
