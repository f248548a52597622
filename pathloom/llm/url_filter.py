"""URL filters as a temporal list join.

A list is a history of dated entries: at a time, a host pattern was put on a list or taken off. Entries of
one (list, pattern) become validity intervals that end where the next entry begins. A capture is joined, for its host and
every parent domain of it, with the interval that holds its fetch time: an as-of join that stays an equi-join, since
both sides are cut at days. Intervals are repeated for the days they span within the captures' own time range.

Skew: a host with a third of all captures is spread over its days, and a hot (host, day) is one that Spark's
skew handling can split, because only captures are many on it. Histories are ordered within days, and days among themselves, so that a
pattern with very many entries isn't one window.

Defined cases: a null or malformed URL has no host, and a capture without host or fetch time is never listed (its verdict is
``unknown``); of entries with one time the largest entry_id counts; an entry counts from its own time on; entries with a null
list, pattern, time or action are ignored; repeated captures are each reported; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of an http(s) URL without user, port and final dot; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([a-z0-9.-]+?)\.?(?::[0-9]*)?(?:[/?#].*)?$", 1)
    return F.when(found != "", found)


def parents(host: Column) -> Column:
    """The host and its parent domains of two labels at least."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def validity(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to) of what is on a list; valid_to is null for what still is.

    ``entries``: entry_id, list, pattern, listed_at, action ('add' or 'remove').
    """
    known = entries.select("entry_id", "list", "pattern", "listed_at", "action").dropna(subset=["list", "pattern", "listed_at", "action"])
    dated = (
        known.groupBy("list", "pattern", "listed_at")
        .agg(F.max_by("action", F.struct("entry_id", "action")).alias("action"))
        .withColumn("day", F.to_date("listed_at"))
    )
    key = ["list", "pattern"]
    days = dated.groupBy(*key, "day").agg(F.min("listed_at").alias("first"))
    later = days.withColumn("next_day", F.lead("first").over(W.partitionBy(*key).orderBy("day"))).drop("first")
    within = F.lead("listed_at").over(W.partitionBy(*key, "day").orderBy("listed_at"))
    return (
        dated.withColumn("within", within)
        .join(later, [*key, "day"])
        .filter(F.col("action") == "add")
        .select(*key, F.col("listed_at").alias("valid_from"), F.coalesce("within", "next_day").alias("valid_to"))
    )


def evaluate(captures: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Verdict of every capture at its fetch time.

    ``captures``: the keys, url, fetched_at. Out: the keys, host, fetched_at, n_active (entries that hold), block_pattern
    and allow_pattern (the longest that hold) and verdict: ``block`` if the longest pattern on list ``block`` is longer
    than the longest on ``allow``, else ``pass``.
    """
    seen = captures.select(*keys, host_of(F.col("url")).alias("host"), "fetched_at")
    named = seen.filter(F.col("host").contains(".") & F.col("fetched_at").isNotNull())
    unknown = seen.filter(~F.coalesce(F.col("host").contains(".") & F.col("fetched_at").isNotNull(), F.lit(False)))
    bounds = named.agg(F.to_date(F.min("fetched_at")).alias("low"), F.to_date(F.max("fetched_at")).alias("high")).first()

    intervals = validity(entries)
    first, last = F.greatest(F.to_date("valid_from"), F.lit(bounds["low"])), F.least(
        F.coalesce(F.to_date("valid_to"), F.lit(bounds["high"])), F.lit(bounds["high"])
    )
    by_day = intervals.withColumn("day", F.explode(F.when(first <= last, F.sequence(first, last))))

    looked_up = (
        named.withColumn("day", F.to_date("fetched_at"))
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("pattern", F.explode(parents(F.col("host"))))
    )
    on_day = by_day.withColumnsRenamed({"pattern": "_pattern", "day": "_day"})
    # the time is part of the join, so an entry that did not hold makes no row
    active = looked_up.join(
        on_day,
        (F.col("pattern") == F.col("_pattern"))
        & (F.col("day") == F.col("_day"))
        & (F.col("fetched_at") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))),
        "left",
    ).withColumn("holds", F.col("_pattern").isNotNull())

    def longest(name: str) -> Column:
        mine = F.when(F.col("holds") & (F.col("list") == name), F.struct(F.length("pattern").alias("n"), "pattern"))
        return F.max(mine)["pattern"]

    verdicts = active.groupBy("_id", *keys, "host", "fetched_at").agg(
        F.sum(F.col("holds").cast("long")).alias("n_active"),
        longest("block").alias("block_pattern"),
        longest("allow").alias("allow_pattern"),
    )
    blocked = F.length("block_pattern") > F.coalesce(F.length("allow_pattern"), F.lit(0))
    names = [*keys, "host", "fetched_at", "n_active", "block_pattern", "allow_pattern"]
    return verdicts.select(*names, F.when(blocked, "block").otherwise("pass").alias("verdict")).unionByName(
        unknown.select(
            *keys,
            "host",
            "fetched_at",
            F.lit(0).cast("long").alias("n_active"),
            F.lit(None).cast("string").alias("block_pattern"),
            F.lit(None).cast("string").alias("allow_pattern"),
            F.lit("unknown").alias("verdict"),
        )
    )
