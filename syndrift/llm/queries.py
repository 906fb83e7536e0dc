"""The queries of this subpackage: each operator over its whole table, and SQL with the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, cotrain, decontam, licenses, minhash, mixing, repetition, secret_scan, token_counts, url_filter
from .store import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op1"))
    return decontam.report(found)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id bigint, turn bigint, role string, text string")
    return chat.report(chat.format_chats(rows.unionByName(own))).drop("violation")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.answers(Scratch(spark, "op3").write(token_counts.histogram(table(spark, sf_dir, "documents")), "histogram"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.verdict(repetition.repetition(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(minhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op5")))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.report(secret_scan.scan(docs, secret_scan.trained(docs)))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    return cotrain.score(docs, cotrain.train(docs, table(spark, sf_dir, "labels"), pages), pages)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.mine(pages, table(spark, sf_dir, "labels"), Scratch(spark, "op8")))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MARK_WORDS = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce({MARK_WORDS.format("text")}, []) AS ws FROM documents),
b AS (SELECT item_id, coalesce({MARK_WORDS.format("text")}, []) AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, list_slice(ws, i, i + least(len(ws), 13) - 1) AS g
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
runs AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, i, runs.n FROM runs JOIN win ON runs.n = win.n AND runs.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS k, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.k, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.k, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(covered.k, 0) > 0 AND 20 * coalesce(covered.k, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT *, coalesce(lag(role) OVER w, 'start') AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, t))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(t) + len(regexp_extract_all(t, '\\|###|</turn>')) + 14) AS BIGINT) AS formatted_chars,
  bool_and(before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant') AND (k < n OR role = 'assistant')) AS valid
FROM r GROUP BY conv_id
"""

OP4_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce({SPACE_WORDS.format("text")}, []) AS ws FROM documents),
one AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(ws, lambda x: length(x))) AS c FROM w),
size AS (SELECT doc_id, sum(c) AS c FROM one GROUP BY doc_id),
next AS (SELECT doc_id, i, [x, {", ".join(f"lead(x, {k}) OVER o" for k in range(1, 10))}] AS xs
  FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
gram AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS k, i, hash(xs[1:{k}]) AS g FROM next WHERE xs[{k}] IS NOT NULL" for k in range(2, 11))}),
twice AS (SELECT doc_id, k, g, min(i) AS first_, count(*) AS n FROM gram GROUP BY doc_id, k, g HAVING count(*) > 1),
top AS (SELECT doc_id, k, least(max(twice.n * length(array_to_string(list_slice(ws, first_, first_ + k - 1), ''))) / max(size.c), 1) AS share FROM twice JOIN w USING (doc_id) JOIN size USING (doc_id) GROUP BY doc_id, k),
inside AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS i FROM gram JOIN twice USING (doc_id, k, g) WHERE k = 3 OR k > 4 AND i > first_),
dup AS (SELECT doc_id, k, count(*) AS n, sum(one.c) / max(size.c) AS share FROM inside JOIN one USING (doc_id, i) JOIN size USING (doc_id) GROUP BY doc_id, k),
line AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, x) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lines AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (k > 1) AS n, count(*) FILTER (k > 1) / count(*) AS share, coalesce(sum(length(x)) FILTER (k > 1), 0) / sum(length(x)) AS chars FROM line GROUP BY doc_id),
bad AS (SELECT doc_id FROM top WHERE share > CASE k WHEN 2 THEN 0.20 WHEN 3 THEN 0.18 WHEN 4 THEN 0.16 END
  UNION SELECT doc_id FROM dup WHERE share > CASE k WHEN 5 THEN 0.20 WHEN 6 THEN 0.19 WHEN 7 THEN 0.18 WHEN 8 THEN 0.17 WHEN 9 THEN 0.16 WHEN 10 THEN 0.15 END
  UNION SELECT doc_id FROM lines WHERE lines.lines > 4 AND share > 0.30 OR chars > 0.20),
base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(size.c, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN size USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN (SELECT * FROM dup WHERE k = 3) dup USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM base
"""

OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({SPACE_WORDS.format(LOWER.format("text"))}, []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (g) JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id WHERE x.doc_id <> y.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (max(p.n) + max(q.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM w JOIN least_ USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len({SPACE_WORDS.format("text")}), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
o AS (SELECT *, coalesce(sum(3 * source_size) OVER f, 0) AS spent, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS whole, sum(source_size) OVER () AS n
      FROM w WHERE source_size > 0 WINDOW f AS (ORDER BY 3 * source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (n - spent) * w / whole > 3 * source_size AS full_ FROM o),
left_ AS (SELECT coalesce(sum(3 * source_size) FILTER (full_), 0) AS spent, sum(w) FILTER (NOT full_) AS whole, max(n) AS n FROM c),
t AS (SELECT source, CASE WHEN full_ THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(left_.n - left_.spent AS DOUBLE) * w / left_.whole END AS target FROM c, left_),
p AS (SELECT d.*, source_size, coalesce(target, 0) AS target,
        sum(size) OVER (PARTITION BY d.source ORDER BY left(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 15), doc_id NULLS FIRST, size) - size AS begin_
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (CAST(round_even(target, 0) AS BIGINT) // source_size) * size + greatest(0, least(begin_ + size, CAST(round_even(target, 0) AS BIGINT) % source_size) - begin_) END AS BIGINT) AS taken
FROM p
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_near_dedup": op5_near_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op7_source_mixing": op7_source_mixing,
    "op8_url_filters": op8_url_filters,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scans": op10_license_scans,
}
SQL = {
    "op1_decontamination": OP1_SQL,
    "op2_chat_formatting": OP2_SQL,
    "op4_quality_rules": OP4_SQL,
    "op5_near_dedup": OP5_SQL,
    "op7_source_mixing": OP7_SQL,
}
