"""Sharding as a two-pass external shuffle: every order of the rows is as likely as any other.

Pass 1 scatters rows uniformly into buckets by a seeded hash; there are as many buckets as BUCKET_BYTES goes into the bytes of all
rows, so a bucket fits in a task's memory. Pass 2 takes each bucket as an array of row ids and shuffles it by Fisher-Yates
(Spark's ``shuffle``, linear in the bucket), one bucket after the other in many tasks. Buckets follow each other; a row's
place in that order gives its shard (law ``rows``: counts at most one apart) and its slot, so a shard is a run of whole buckets but
for its ends and is written from few of them. The order depends on the seed and the rows only: the number of
partitions follows from the bytes, and buckets are sorted in each.

A row that is repeated is hashed with the number of its occurrence, so a third of all rows may be one row and
still fills all buckets alike. Occurrences are numbered within each input task first, then over the tasks that hold the row.

Defined cases: a null text has size 8; a row with a null doc_id is scattered by its text; rows equal in doc_id and text can take
each other's places; an empty table gives an empty result; extra columns stay in what ``write_shards`` writes; names the
operator needs for itself start with ``_sh_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.session import materialize

BUCKET_BYTES = 8 << 20
MAX_TASKS = 1 << 14  # tasks that shuffle buckets
SEED = 20_240_229


def with_occurrence(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_crc32, _sh_row) plus _sh_key and _sh_nth, which counts the rows of one key from 1."""
    keyed = rows.withColumn("_sh_key", F.xxhash64("doc_id", "text_crc32")).withColumn("_sh_part", F.shiftright("_sh_row", 33))
    within = F.row_number().over(W.partitionBy("_sh_key", "_sh_part").orderBy("_sh_row"))
    held = keyed.groupBy("_sh_key", "_sh_part").agg(F.count("*").alias("_sh_n"))
    before = held.select(
        "_sh_key", "_sh_part", (F.sum("_sh_n").over(W.partitionBy("_sh_key").orderBy("_sh_part")) - F.col("_sh_n")).alias("_sh_before")
    ).filter(F.col("_sh_before") > 0)
    return (
        keyed.withColumn("_sh_within", within)
        .join(before, ["_sh_key", "_sh_part"], "left")
        .withColumn("_sh_nth", F.col("_sh_within") + F.coalesce(F.col("_sh_before"), F.lit(0)))
        .drop("_sh_part", "_sh_within", "_sh_before")
    )


def offsets(counts: DataFrame, buckets: int) -> DataFrame:
    """_sh_bucket and the rows of all buckets before it: running sums within stretches of buckets, then over the stretches."""
    wide = max(1, int(buckets**0.5))
    counts = counts.withColumn("_sh_wide", F.expr(f"_sh_bucket div {wide}"))
    stretches = counts.groupBy("_sh_wide").agg(F.sum("_sh_n").alias("_sh_sum"))
    stretches = stretches.select(
        "_sh_wide", (F.sum("_sh_sum").over(W.orderBy("_sh_wide")) - F.col("_sh_sum")).alias("_sh_before")
    )
    inner = F.sum("_sh_n").over(W.partitionBy("_sh_wide").orderBy("_sh_bucket")) - F.col("_sh_n")
    return (
        counts.withColumn("_sh_inner", inner)
        .join(stretches, "_sh_wide")
        .select("_sh_bucket", (F.col("_sh_before") + F.col("_sh_inner")).alias("_sh_offset"))
    )


def fisher_yates(scattered: DataFrame, buckets: int, seed: int) -> DataFrame:
    """_sh_bucket, _sh_at (place in the bucket's random order, from 0) and the other columns of each row of ``scattered``."""
    tasks = min(buckets, MAX_TASKS)
    # draws follow the number of the partition and the order in it, which are fixed by these two lines
    held = scattered.repartition(tasks, "_sh_bucket").groupBy("_sh_bucket").agg(F.sort_array(F.collect_list("_sh_item")).alias("_sh_items"))
    mixed = held.sortWithinPartitions("_sh_bucket").select("_sh_bucket", F.shuffle("_sh_items", seed).alias("_sh_items"))
    return mixed.select("_sh_bucket", F.posexplode("_sh_items").alias("_sh_at", "_sh_item")).select("_sh_bucket", "_sh_at", "_sh_item.*")


def placed(rows: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, _sh_row; materialised) plus _sh_bucket, shard and slot."""
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    total, buckets = whole["n"], max(1, -(-whole["bytes"] // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_sh_key", "_sh_nth"), F.lit(buckets))
    item = F.struct("_sh_key", "_sh_nth", "doc_id", "size", "text_crc32", "_sh_row")
    mixed = materialize(fisher_yates(with_occurrence(rows).select(bucket.alias("_sh_bucket"), item.alias("_sh_item")), buckets, seed + 1))
    counts = mixed.groupBy("_sh_bucket").agg(F.count("*").alias("_sh_n"))
    return (
        mixed.join(offsets(counts, buckets), "_sh_bucket")
        .withColumn("_sh_place", F.col("_sh_offset") + F.col("_sh_at"))
        .withColumn("shard", F.expr(f"cast(_sh_place * {shards} div {max(total, 1)} as int)"))
        # a shard begins at ceil(shard * total / shards)
        .withColumn("slot", F.expr(f"_sh_place - (shard * {total}L + {shards - 1}) div {shards}"))
        .select(*rows.columns, "_sh_bucket", "shard", "slot")
    )


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with size (bytes of the text and 8) and text_crc32."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    )


def shard_plan(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """Where every row goes: doc_id, size, text_crc32, law, shard, slot, grown_shard. Texts don't move."""
    slim = materialize(sized(docs).select("doc_id", "size", "text_crc32"))
    return placed(slim.withColumn("_sh_row", F.monotonically_increasing_id()), shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write whole rows, a folder for each shard and a file for each bucket in it, ordered by slot.

    ``docs`` is evaluated once: pass 1 writes the rows to the shared folder, so that their ids hold for the join.
    """
    rows = materialize(sized(docs)).withColumn("_sh_row", F.monotonically_increasing_id())
    where = placed(rows.select("doc_id", "size", "text_crc32", "_sh_row"), shards, seed, bucket_bytes)
    out = rows.drop("shard", "slot").join(where.select("_sh_row", "_sh_bucket", "shard", "slot"), "_sh_row")
    out = out.repartition("shard", "_sh_bucket").sortWithinPartitions("shard", "slot").drop("_sh_row", "_sh_bucket")
    out.write.partitionBy("shard").parquet(path)
