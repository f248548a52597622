"""Secret scans with corpus-wide ownership frequency.

Candidates are found by pattern. The hash of each candidate's value is counted over the whole corpus: in how many
repositories of how many owners it stands. Both counts decide: a value that several owners have, or that one owner has in
COPIED_REPOSITORIES repositories or more, is a widely copied example and adds a span of kind ``copied`` over the value. What one owner alone
has in fewer repositories and looks random adds a span of kind ``live``. Both counts are returned for every added span.
Base spans stay. Counting goes (hash, owner, repository), then (hash, owner), then hash, each with partial sums,
so a key copied into a third of all rows is a few rows for each task. The join back moves (row, span, hash) only; hashes of more than
SPLIT_ROWS rows are split over several tasks. Places in a text of n matches take n**1.5 steps, so one long log of keys stalls no task.

Defined cases: null and empty texts have no spans; a null owner or repository counts as one of its own; repeated rows are each
reported; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import text_or_empty
from pathloom.operators.skew import MAX_SENT_KEYS, salted_lookup
from pathloom.session import materialize

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, group of the value, quick test); order of kinds at one start
KINDS = [
    ("assign", ASSIGN, 1, lambda t: t.contains("=") | t.contains(":")),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, lambda t: t.contains("AKIA")),
    ("hex", r"[0-9a-f]{32,}", 0, lambda t: t.rlike(r"[0-9a-f]{32}")),
]
NAMES = [k for k, *_ in KINDS] + ["live", "copied"]
MIN_VALUE = 8
MIN_DISTINCT = 6  # different characters of a value that looks random
COPIED_REPOSITORIES = 4  # of one owner, from which on a value counts as a copied example
SPLIT_ROWS = 1000  # rows of one hash that may share a task; more where that would make too long a list of hashes
CANDIDATE = "array<struct<start:int,kind:int,end:int,value_start:int,hash:binary,random:boolean>>"


def running_sum(steps: Column) -> Column:
    """Sums of the first 1, 2, ... numbers of an array: within stretches of about the root of its length, then over the stretches."""

    def sums(values: Column, start: Column) -> Column:
        return F.aggregate(
            values, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), start) + x))
        )

    def stretches(x: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(x["s"]))).cast("int")
        starts = F.when(wide > 0, F.sequence(F.lit(1), F.size(x["s"]), F.greatest(wide, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: sums(F.slice(x["s"], at, wide), F.lit(0)))

    def joined(x: Column) -> Column:
        before = sums(F.transform(x["p"], lambda p: F.element_at(p, -1)), F.lit(0))
        return F.transform(F.array(F.struct(x["p"].alias("p"), before.alias("b"))), shifted)[0]

    def shifted(x: Column) -> Column:
        # a stretch begins where the one before it ends
        return F.flatten(
            F.transform(x["p"], lambda p, i: F.transform(p, lambda v: v + F.when(i > 0, F.get(x["b"], i - 1)).otherwise(0)))
        )

    # arrays of one element hold what is used often, so that it is evaluated once
    held = F.transform(F.array(F.struct(steps.alias("s"))), lambda x: F.struct(stretches(x).alias("p")))
    return F.transform(held, joined)[0]


def candidates(text: Column) -> Column:
    """All base spans of a text with the hash of their values, ordered by start, then kind; code points.

    Places follow from the pieces between matches: a match begins after all pieces and matches before it.
    """

    def of(k: int, pattern: str, group: int, may: Callable[[Column], Column]) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        before = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.transform(F.arrays_zip(whole.alias("w"), before.alias("b")), lambda x: x["b"] + F.coalesce(F.length(x["w"]), F.lit(0)))
        ends = running_sum(steps)
        spans = F.transform(
            F.arrays_zip(whole.alias("w"), value.alias("v"), F.slice(ends, 1, F.size(whole)).alias("e")),
            lambda x: F.struct(
                (x["e"] - F.length(x["w"])).cast("int").alias("start"),
                F.lit(k).alias("kind"),
                x["e"].cast("int").alias("end"),
                (x["e"] - F.length(x["v"])).cast("int").alias("value_start"),
                F.unhex(F.md5(x["v"].cast("binary"))).alias("hash"),
                (F.size(F.array_distinct(F.split(x["v"], ""))) >= MIN_DISTINCT).alias("random"),
            ),
        )
        long_enough = F.filter(spans, lambda s: s["end"] - s["value_start"] >= MIN_VALUE)
        return F.when(may(text), long_enough.cast(CANDIDATE)).otherwise(F.array().cast(CANDIDATE))

    return F.sort_array(F.concat(*[of(k, *rest) for k, (_, *rest) in enumerate(KINDS)]))


def once(ordered: Column) -> Column:
    """An ordered array without repeats; ``array_distinct`` compares all pairs of structs."""
    held = F.array(F.struct(ordered.alias("a")))
    return F.transform(held, lambda x: F.filter(x["a"], lambda s, i: (i == 0) | ~s.eqNullSafe(F.get(x["a"], i - 1))))[0]


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repositories and number of every candidate value; ``found`` has hash, owner, repository."""
    each = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def _names() -> Column:
    return F.array(*[F.lit(k) for k in NAMES])


def _joined(spans: Column) -> Column:
    text = F.transform(
        spans, lambda s: F.concat(F.element_at(_names(), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    )
    return F.array_join(text, ",")


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per row: doc_id, counts of base spans, base_sha256, spans (base and added), n_live, n_copied, ownership.

    ``ownership`` has kind:start:end:owners:repositories of every added span, in their order among ``spans``.
    """
    rows = docs.select(
        "doc_id", owner.alias("owner"), repository.alias("repository"), candidates(text_or_empty()).alias("found")
    )
    rows = materialize(rows).withColumn("row", F.monotonically_increasing_id())
    with_any = rows.filter(F.size("found") > 0).select("row", "doc_id", "owner", "repository", F.explode("found").alias("s"))
    with_any = with_any.withColumn("hash", F.col("s.hash"))
    values = materialize(ownership(with_any.select("hash", "owner", "repository")))
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    owned = salted_lookup(with_any, values, ["hash"], "row", max(SPLIT_ROWS, -(-total // MAX_SENT_KEYS)))
    span = F.struct("s.start", "s.kind", "s.end", "s.value_start", "owners", "repositories", "s.random")
    judged = owned.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("found")).drop("row")
    none = rows.filter(F.size("found") == 0).select("doc_id", F.array().cast(judged.schema["found"].dataType).alias("found"))
    every = judged.unionByName(none)

    def widely(s: Column) -> Column:
        return (s["owners"] > 1) | (s["repositories"] >= COPIED_REPOSITORIES)

    def added(s: Column) -> Column:
        return F.struct(
            s["value_start"].alias("start"),
            F.when(widely(s), len(KINDS) + 1).otherwise(len(KINDS)).alias("kind"),
            s["end"].alias("end"),
            s["owners"].alias("owners"),
            s["repositories"].alias("repositories"),
        )

    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    # two kinds of candidates can have one value
    more = F.sort_array(F.transform(F.filter("found", lambda s: widely(s) | s["random"]), added))
    every = every.select("doc_id", "found", base.alias("base"), once(more).alias("more"))
    slim = F.transform("more", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    owned_by = F.transform("more", lambda s: F.concat_ws(":", F.element_at(_names(), s["kind"] + 1), s["start"], s["end"], s["owners"], s["repositories"]))

    def extra(k: int) -> Column:
        return F.size(F.filter("more", lambda s: s["kind"] == k)).cast("long")

    def count(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")

    return every.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", slim))).alias("spans"),
        extra(len(KINDS)).alias("n_live"),
        extra(len(KINDS) + 1).alias("n_copied"),
        F.array_join(owned_by, ",").alias("ownership"),
    )
