"""Fill-in-middle transformation by one counted-quantifier match for each text.

``regexp_count`` gives the number n of units of a text. Two seeded draws pick the cut points a <= b among 0..n, and a
pattern made for the row, ``\\A(unit{a})(unit{b-a})(rest)\\z``, captures prefix, middle and suffix in one match. The counted
groups are possessive: a unit is the longest one at its place in any case, so nothing is ever tried twice, and
the matcher goes through them in a loop and not by recursion. The replacement puts the three groups in the order of the form.

Everything is a JVM expression of one row: one scan, no shuffle, no Python.

Defined cases: null and empty texts are ``plain`` with n 0; a text that holds one of the markers is ``plain``, as its parts
could not be told apart; a null id draws like an empty one; repeated rows give equal results; an empty table gives no row; of extra columns
whose name clashes with an added one, that of the operator wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import keep_columns, text_or_empty

# fixed values: the unit, the markers and the shares of the forms in per cent
UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED = 90
SUFFIX_FIRST = 20
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")


def draws(key: Column, seed: int = 1, count: int = 4) -> list[Column]:
    """Unsigned 32-bit draws of a row: the leading 8-digit groups of a hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def restore(output: Column, form: Column) -> Column:
    """The text of an output: the parts between the markers in their first order."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """``docs`` without ``text`` plus n, form, prefix_chars, middle_chars, output and restored."""
    keep = keep_columns(docs, "text", *ADDED)
    h1, h2, h3, h4 = draws(F.col(key), seed)
    n = F.regexp_count(F.col("_fm_text"), F.lit(UNIT))
    rows = docs.select(
        *keep, text_or_empty().alias("_fm_text"), *[h.alias(f"_fm_h{i}") for i, h in enumerate((h1, h2, h3, h4), 1)]
    )
    rows = rows.withColumn("n", n.cast("long"))
    a, b = F.col("_fm_h1") % (F.col("n") + 1), F.col("_fm_h2") % (F.col("n") + 1)
    marked = F.contains("_fm_text", F.lit(PREFIX)) | F.contains("_fm_text", F.lit(SUFFIX)) | F.contains("_fm_text", F.lit(MIDDLE))
    plain = (F.col("_fm_text") == "") | marked | (F.col("_fm_h3") % 100 >= TRANSFORMED)
    rows = rows.select(
        *keep,
        "_fm_text",
        "n",
        F.least(a, b).alias("_fm_from"),
        F.greatest(a, b).alias("_fm_to"),
        F.when(plain, "plain").when(F.col("_fm_h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm").alias("form"),
    )
    pattern = F.concat(
        F.lit(rf"(?s)\A({UNIT}{{"), F.col("_fm_from").cast("string"), F.lit("}+)"),
        F.lit(f"({UNIT}{{"), (F.col("_fm_to") - F.col("_fm_from")).cast("string"), F.lit("}+)"),
        F.lit(r"(.*+)\z"),
    )
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    moved = F.col("form") != "plain"
    rows = rows.withColumn(
        "output", F.when(moved, F.regexp_replace("_fm_text", pattern, order)).otherwise(F.col("_fm_text"))
    )
    # the text holds no marker, so the first one of a kind in the output is the one put there
    at = {m: F.instr("output", m) for m in (PREFIX, SUFFIX, MIDDLE)}
    before = F.when(F.col("form") == "psm", at[SUFFIX]).otherwise(at[MIDDLE])
    return rows.select(
        *keep,
        "n",
        "form",
        F.when(moved, (before - at[PREFIX] - len(PREFIX)).cast("long")).alias("prefix_chars"),
        F.when(moved, (F.length("output") - at[MIDDLE] - len(MIDDLE) + 1).cast("long")).alias("middle_chars"),
        "output",
        restore(F.col("output"), F.col("form")).alias("restored"),
    )
