"""Exact dedup, sharding and decontamination on awkward rows, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import decontaminate as dc
from pathloom.llm import exact_dedup as xd
from pathloom.llm import sharding


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def awkward(spark):
    r = random.Random(1)
    texts = ["Same Text", "same text", "ÉCOLE", "école", "", None, "x" * 5000, "alone"] + [f"t{r.randrange(40)}" for _ in range(120)]
    texts += ["hot"] * 90
    return [(i, t, i % 3) for i, t in enumerate(texts)]


@pytest.mark.parametrize("filter_bytes", [xd.FILTER_BYTES, 1])
def test_exact_groups_against_python(spark, filter_bytes):
    rows = awkward(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(7)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    got = xd.exact_groups(df, filter_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        t = lower(rows[r["doc_id"]][1])
        assert (r["keep_id"], r["group_size"]) == (max(groups[t]), len(groups[t]))
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = xd.deduplicate(df, filter_bytes)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_groups_of_a_hot_text_without_ids_and_a_very_long_one(spark, monkeypatch):
    """A text in far more rows than may share a task, most of them without id; very long texts that differ in case alone."""
    monkeypatch.setattr(xd, "SPLIT_ROWS", 20)
    rows = [(None, "hot")] * 300 + [(k, "HOT") for k in range(50)] + [(90, "x" * 2_000_000), (91, "X" * 2_000_000), (92, "x" * 1_999_999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in xd.exact_groups(df).collect())
    want = Counter({(None, 49, 350, False): 300, (90, 91, 2, False): 1, (91, 91, 2, True): 1, (92, 92, 1, True): 1})
    assert got == want + Counter((k, 49, 350, k == 49) for k in range(50))


def test_exact_groups_of_repeats_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (1, "A"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in xd.exact_groups(df).collect())
    assert got == Counter({(1, 1, 3, True): 2, (None, 1, 3, False): 1, (None, None, 1, True): 1})
    assert xd.deduplicate(df).count() == 2
    assert xd.exact_groups(df.limit(0)).count() == 0 and xd.deduplicate(df.limit(0)).count() == 0


def test_filter_leaves_unique_rows_in_place(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id < 10 THEN 'twice' ELSE cast(id AS string) END AS text")
    hashes = df.selectExpr("doc_id", "text").withColumn("_xd_sha", xd.F.unhex(xd.text_sha()))
    maybe = xd.possibly_repeated(hashes, 3000)(hashes).filter("_xd_maybe")
    ids = {r["doc_id"] for r in maybe.collect()}
    assert set(range(10)) <= ids and len(ids) < 300


def test_buckets_are_shuffled_evenly(spark):
    """Each of the six orders of three rows is about as likely; every bucket keeps its rows, and a second run repeats the order."""
    F = sharding.F
    rows = spark.range(9000).select((F.col("id") % 3000).alias("_sh_bucket"), F.struct(F.expr("id div 3000").alias("k")).alias("_sh_item"))

    def orders(df):
        got = {}
        for r in sharding.fisher_yates(df, 3000, 5).collect():
            got.setdefault(r["_sh_bucket"], {})[r["_sh_at"]] = r["k"]
        return {b: tuple(o[i] for i in range(3)) for b, o in got.items()}

    got = orders(rows)
    assert len(got) == 3000 and all(sorted(o) == [0, 1, 2] for o in got.values())
    n = Counter(got.values())
    assert len(n) == 6 and sum((v - 500) ** 2 / 500 for v in n.values()) < 20.5  # 0.1 % of chi-square with 5 degrees
    assert orders(rows.repartition(3)) == got


def test_repeated_rows_fill_all_buckets(spark):
    """Two thirds of the rows are one row, over several tasks: numbered without gaps, in buckets of like size."""
    F = sharding.F
    rows = spark.range(0, 6000, 1, 7).select(
        F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.lit(9).cast("long").alias("text_crc32")
    )
    rows = sharding.materialize(rows).withColumn("_sh_row", F.monotonically_increasing_id())
    got = sharding.with_occurrence(rows)
    assert sorted(r["_sh_nth"] for r in got.filter("doc_id = 1").collect()) == list(range(1, 4001))
    assert {r["_sh_nth"] for r in got.filter("doc_id <> 1").collect()} == {1}
    placed = sharding.placed(rows.withColumn("size", F.lit(8).cast("long")), 4, bucket_bytes=4800)
    sizes = [r["count"] for r in placed.groupBy("_sh_bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 720 and sum(sizes) == 6000
    assert placed.select("shard", "slot").distinct().count() == 6000


def test_one_very_long_text_among_small_ones(spark):
    rows = [(k, "x" * (3_000_000 if k == 7 else k)) for k in range(50)]
    got = sharding.shard_plan(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, i) for s, n in enumerate((13, 12, 13, 12)) for i in range(n))
    assert max(r["size"] for r in got) == 3_000_008


def test_shards_are_even_gapless_and_repeatable(spark):
    rows = awkward(spark) * 8
    rows = [(k, t, x) for k, (_, t, x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = {r["doc_id"]: r for r in sharding.shard_plan(df).collect()}
    again = {r["doc_id"]: r for r in sharding.shard_plan(df.repartition(3)).collect()}
    assert got == again and len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got.values())
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sizes[s]))
    for k, t, _ in rows:
        b = (t or "").encode()
        assert (got[k]["size"], got[k]["text_crc32"], got[k]["law"], got[k]["grown_shard"]) == (len(b) + 8, zlib.crc32(b), "rows", None)
    order = [r["doc_id"] for r in sorted(got.values(), key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.1


def test_shards_of_few_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    got = sharding.shard_plan(df).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (8, 0), (16, 0)]
    assert sharding.shard_plan(df.limit(0)).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS doc_id", "repeat('x', id % 50) AS text", "'k' AS source")
    sharding.write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and back.select("shard", "slot").distinct().count() == 500 and "source" in back.columns


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def naive(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        have = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in have:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def decon_case():
    r = random.Random(2)
    vocabulary = ["a", "b", "É", "c1", "日本", "d"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 9, 10, 11, 30])))) for k in range(12)]
    items += [(50, "One, two; three-four five six seven eight nine ten!"), (51, ""), (52, None), (53, "..."), (54, items[0][1])]
    docs = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 400))) for _ in range(40)]
    docs += ["x " * 500 + "ONE two three four five six seven eight nine ten " * 3, "one two three four five six seven eight nine", "", None, "\0one\0two"]
    docs += [f"pre {t} post" for _, t in items if t]
    return docs, items


def test_decontamination_against_naive(spark):
    docs, items = decon_case()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for table_bytes in (dc.MAX_TABLE_BYTES, 4000):
        got = dc.occurrences(df, bench, table_bytes=table_bytes).collect()
        for r in got:
            want = naive(docs[r["doc_id"]], items)
            assert (r["n_words"], len(r["hit_words"]), r["hit_items"]) == want, r["doc_id"]
    for r in dc.contamination(df, bench).collect():
        n, hit, found = naive(docs[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    clean = dc.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in enumerate(docs) if not naive(t, items)[1]}


def test_decontamination_without_items_or_documents(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x")], "doc_id long, text string, n_words string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in dc.contamination(df, none).collect()] == [(2, 0, 0)] * 2
    assert dc.decontaminate(df, none).columns == df.columns and dc.decontaminate(df, none).count() == 2
    assert dc.contamination(df.limit(0), none).count() == 0


def test_word_hashes_tell_words_apart():
    t = dc.Texts.of(pa.array(["Ab ab AB", "é e", ""]))
    assert t.first.tolist() == [0, 3, 5, 5] and len(set(t.hashes.tolist())) == 3
