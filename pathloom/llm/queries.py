"""The registered query of every operator and, where SQL can state it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import (
    decontaminate,
    exact_dedup,
    fill_middle,
    language_id,
    near_dedup,
    packing,
    pii,
    secret_scan,
    sharding,
    token_alignment,
    token_counts,
    toxicity,
    url_filter,
)
from pathloom.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))


def list_history(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Dated list entries: what happened to a user's page puts its host, or at times its parent domain, on or off a list."""
    kinds = {"error": ("block", "add"), "signup": ("block", "remove"), "purchase": ("allow", "add"), "view": ("allow", "remove")}
    which = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[0])])
    action = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[1])])
    hosts = pages.select(F.col("page_id").alias("user_id"), url_filter.host_of(F.col("url")).alias("host"))
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    return events.join(hosts, "user_id").select(
        F.col("event_id").alias("entry_id"),
        which[F.col("event_type")].alias("list"),
        F.when(F.col("event_id") % 7 == 0, parent).otherwise(F.col("host")).alias("pattern"),
        F.col("ts").alias("listed_at"),
        action[F.col("event_type")].alias("action"),
    )


def captures(pages: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, page_id, url, fetched_at): each event fetches the page its user_id names; a page that is never fetched has no event."""
    fetched = events.select("event_id", F.col("user_id").alias("page_id"), F.col("ts").alias("fetched_at"))
    never = pages.join(fetched.select("page_id").distinct(), "page_id", "left_anti")
    return fetched.join(pages, "page_id", "left").unionByName(never, allowMissingColumns=True)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a capture of its user's page; a page without events and an event without page stay, as ``unknown``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    return url_filter.evaluate(captures(pages, events), list_history(pages, events), keys=("event_id", "page_id"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables name neither owner nor repository: the source stands for the owner, its documents of one language for a repository."""
    return secret_scan.scan(documents(spark, sf_dir), F.col("source"), F.col("lang"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), words=4, percent=80)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf_dir), benchmark)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return token_alignment.align_tokenizers(docs, digest=True)


def held_out(doc_id: Column) -> Column:
    """One document in three tells how good a fit is and is never learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = language_id.identify(docs, F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(documents(spark, sf_dir).select("doc_id", "text"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_token_counts,
        op3_url_filter,
        op4_secret_scan,
        op5_exact_dedup,
        op6_packing,
        op7_near_dedup,
        op8_sharding,
        op9_pii,
        op10_decontamination,
        op11_token_alignment,
        op12_language_id,
        op13_fill_middle,
    )
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

HOST = r"nullif(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([a-z0-9.-]+?)\.?(?::[0-9]*)?(?:[/?#].*)?$', 1), '')"

ASSIGN = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    """[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"""
)


def _spans_sql(kind: int, pattern: str, group: int) -> str:
    """Spans of one pattern with their places, from the lengths of the pieces around the matches."""
    return f"""
        SELECT row, doc_id, owner, repository, {kind} AS kind, v,
               sum(length(b) + length(w)) OVER (PARTITION BY row ORDER BY i) - length(w) AS s,
               sum(length(b) + length(w)) OVER (PARTITION BY row ORDER BY i) AS e
        FROM (SELECT row, doc_id, owner, repository, unnest(regexp_extract_all(t, '{pattern}')) AS w,
                     unnest(regexp_extract_all(t, '{pattern}', {group})) AS v,
                     unnest(list_slice(string_split_regex(t, '{pattern}'), 1, len(regexp_extract_all(t, '{pattern}')))) AS b,
                     unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i FROM d)
    """


ORACLES: dict[str, str] = {
    "op3_url_filter": f"""
        WITH h AS (SELECT page_id, {HOST} AS host FROM pages),
        c AS (
            SELECT event_id, user_id AS page_id, host, ts AS fetched_at FROM events LEFT JOIN h ON page_id = user_id
            UNION ALL
            SELECT NULL, page_id, host, NULL FROM h WHERE page_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)),
        e AS (
            SELECT CASE WHEN event_type IN ('error', 'signup') THEN 'block' ELSE 'allow' END AS list,
                   CASE WHEN event_id % 7 = 0 THEN regexp_replace(host, '^[^.]+\\.', '') ELSE host END AS pattern,
                   ts, event_id, event_type IN ('error', 'purchase') AS adds
            FROM events JOIN h ON page_id = user_id WHERE event_type <> 'click' AND host IS NOT NULL),
        last AS (SELECT list, pattern, ts, arg_max(adds, event_id) AS adds FROM e GROUP BY ALL),
        v AS (SELECT *, lead(ts) OVER (PARTITION BY list, pattern ORDER BY ts) AS till FROM last),
        j AS (
            SELECT event_id, list, pattern FROM c JOIN v ON adds AND ts <= fetched_at AND (till IS NULL OR fetched_at < till)
                AND (host = pattern OR ends_with(host, '.' || pattern)) AND contains(pattern, '.')),
        a AS (
            SELECT event_id, count(*) AS n_active, arg_max(pattern, length(pattern)) FILTER (list = 'block') AS block_pattern,
                   arg_max(pattern, length(pattern)) FILTER (list = 'allow') AS allow_pattern
            FROM j GROUP BY event_id)
        SELECT event_id, page_id, host, fetched_at, coalesce(n_active, 0)::BIGINT AS n_active, block_pattern, allow_pattern,
               CASE WHEN fetched_at IS NULL OR host IS NULL OR NOT contains(host, '.') THEN 'unknown'
                    WHEN length(block_pattern) > coalesce(length(allow_pattern), 0) THEN 'block' ELSE 'pass' END AS verdict
        FROM c LEFT JOIN a USING (event_id)
    """,
    "op4_secret_scan": f"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, source AS owner, lang AS repository, coalesce(text, '') AS t FROM documents),
        found AS (
            SELECT * FROM ({_spans_sql(0, ASSIGN, 1)}) WHERE length(v) >= 8
            UNION ALL {_spans_sql(1, "AKIA[A-Z0-9]{12,}", 0)} UNION ALL {_spans_sql(2, "[0-9a-f]{32,}", 0)}),
        owners AS (SELECT v, count(DISTINCT owner) AS n, count(DISTINCT (owner, repository)) AS r FROM found GROUP BY v),
        spans AS (
            SELECT row, kind, s, e, NULL AS n, NULL AS r FROM found
            UNION ALL
            SELECT DISTINCT row, 3, e - length(v), e, n, r FROM found JOIN owners USING (v)
            WHERE n = 1 AND r < 4 AND len(list_distinct(string_split(v, ''))) >= 6
            UNION ALL
            SELECT DISTINCT row, 4, e - length(v), e, n, r FROM found JOIN owners USING (v) WHERE n > 1 OR r >= 4),
        named AS (
            SELECT *, ['assign', 'access', 'hex', 'live', 'copied'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM spans)
        SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
               count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_live, count(*) FILTER (kind = 4) AS n_copied,
               sha256(coalesce(string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
               coalesce(string_agg(x, ',' ORDER BY s, kind, e), '') AS spans,
               coalesce(string_agg(x || ':' || n || ':' || r, ',' ORDER BY s, kind, e) FILTER (kind > 2), '') AS ownership
        FROM d LEFT JOIN named USING (row) GROUP BY row, doc_id
    """,
    "op5_exact_dedup": f"""
        WITH h AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM h WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op7_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS g
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        e AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)
    """,
    "op10_decontamination": f"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        iw AS (
            SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        patterns AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS words
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM patterns),
        windows AS (
            SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS words
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)),
        found AS (SELECT doc_id, i, x.n, item_id FROM windows x JOIN patterns p ON x.n = p.n AND x.words = p.words),
        hit AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op13_fill_middle": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
        u AS (
            SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
                   [('0x' || substr(d, 8 * k + 1, 8))::BIGINT for k in range(4)] AS h FROM t),
        c AS (
            SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (
            SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:], '') AS s FROM c)
        SELECT doc_id, n::BIGINT AS n, form,
               CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
    """,
}
