"""Near duplicates against brute force over all pairs of full sets."""

import random
import re

import numpy as np
import pyarrow as pa

from pathloom.llm import near_dedup as nd


def word_sets(texts, words):
    out = []
    for t in texts:
        t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute(rows, words, percent=80):
    """Component of each doc_id by inverted index and union-find."""
    ids = [i for i, _ in rows]
    sets = dict(zip(ids, word_sets([t for _, t in rows], words)))
    by_shingle = {}
    for i in ids:
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {(a, b) for m in by_shingle.values() if len(m) > 1 for a in m for b in m if a < b}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return words


def family_rows():
    r = random.Random(5)
    rows = []
    for _ in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(30, 200))]
        rows.append(" ".join(base))
        for _ in range(r.randrange(1, 40)):
            rows.append(" ".join(edited(r, base, r.randrange(0, 6))))
    chain = [f"c{i}" for i in range(100)]  # each step is near the one before, the ends are far apart
    for k in range(25):
        chain = chain[:k] + [f"d{k}"] + chain[k + 1 :]
        rows.append(" ".join(chain))
    rows += ["", " \n\t ", "One", "one", "two words", "two  WORDS", "É a b c d", "é a b c d", "nul\x00 a b c d e", "nul a b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows, 100))


def check(df, rows, words):
    want = brute(rows, words)
    got = df.collect()
    assert len(got) == len(rows)
    bad = [(r, want[r["doc_id"]]) for r in got if (r["n_shingles"], r["component_id"]) != want[r["doc_id"]]]
    assert not bad, bad[:5]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_families_match_brute_force(spark):
    rows = family_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for words in (4, 5):
        check(nd.near_groups(docs, words), rows, words)


def test_small_table_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check(nd.near_groups(docs, 4), rows, 4)


def test_nulls_repeats_and_extra_columns(spark):
    text = "a b c d e f g h"
    rows = [(1, text, 9), (2, text, 8), (2, text, 8), (None, text, 7), (3, None, 6), (4, "", 5), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_groups(docs).collect()), key=repr)
    assert got == sorted(
        [(1, 1, True), (2, 1, False), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True), (None, None, True)], key=repr
    )
    kept = nd.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert nd.near_groups(docs.limit(0)).count() == 0 and nd.drop_near_copies(docs.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    for shared in (0, 500, 900):
        x = r.integers(0, 2**63, 2000 - shared, dtype=np.uint64)
        a, b = x[:1000], x[1000 - shared :]
        ok, best = nd.may_link(nd.sketch(a)[None], nd.sketch(b)[None], np.array([1000]), np.array([1000]), 0.8)
        assert abs(best[0] - shared / (2000 - shared)) < 0.12
        assert ok[0] == (shared == 900)


def test_sketches_merge():
    x = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (nd.sketch(x) == np.maximum(nd.sketch(x[:1000]), nd.sketch(x[1000:]))).all()


def test_components_of_paths_and_hubs(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_short_texts_are_one_shingle():
    got = [len(s) for s in nd.shingles(pa.array(["a b", "a b c d", "a b c d e", "", "  ", "a a a a a a"]), 4)]
    assert got == [1, 1, 2, 0, 0, 1]
