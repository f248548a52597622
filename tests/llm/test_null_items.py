"""Benchmark items without an id are searched like any other."""

import hashlib

from pathloom.llm import decontaminate


def test_items_without_id_are_hits(spark):
    named = "one two three four five six seven eight nine ten"
    nameless = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(10, named), (9, named), (None, nameless), (None, "lone"), (11, None)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"so {nameless} it is"), (2, f"{nameless} and {named}"), (3, "clean words"), (4, "a lone word")], "doc_id long, text string"
    )
    want = {1: (10, 1, ""), 2: (20, 3, "10,9"), 3: (0, 0, ""), 4: (1, 1, "")}
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    for k, (hit, n, names) in want.items():
        assert (got[k]["n_hit"], got[k]["n_items"], got[k]["contaminated"]) == (hit, n, hit > 0)
        assert got[k]["items_sha256"] == hashlib.sha256(names.encode()).hexdigest()
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [3]
    # the same from several parts of the benchmark
    parts = decontaminate.occurrences(docs, items, table_bytes=100).collect()
    assert {r["doc_id"]: len(r["hit_items"]) for r in parts} == {k: n for k, (_, n, _) in want.items()}
