"""The queries of the operators over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_tree, exact_dedup, filter_audit, jaccard_join, language_id, license_scan, packing, pii, quality_rules, source_divergence, suffix_dedup, token_counts, warc
from .shared import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group")


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe_tree.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_rules.passes("base-1")).alias("base_failed"), (quality_rules.passes("base-1") & quality_rules.passes("full-1")).alias("kept"), "fail_bits")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.array_join("license_ids", ",").alias("license_ids"), "n_units", "whole_text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums of every length, totals under each context limit, and quantiles."""
    return token_counts.report(token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(table(spark, sf_dir, "documents")))))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_shingles", "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii.DEMO_KEY)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (their source stands for the host) and pages, fused apart, in one result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = language_id.train(docs)
    of_docs = language_id.identify(docs.select("doc_id", "text", "source"), model, host_col="source", keep=["doc_id"])
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    of_pages = language_id.identify(pages, model, text_col="html", url_col="url", markup=True, keep=["page_id"])
    no_id = F.lit(None).cast("long")
    return of_docs.withColumn("page_id", no_id).unionByName(of_pages.withColumn("doc_id", no_id))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_bpe_tree, op3_quality_rules, op4_exact_dedup, op5_license_scan, op6_token_counts, op7_suffix_dedup, op8_jaccard_join, op9_pii, op10_language_id, op11_warc, op12_filter_audit, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the other queries are tested against brute force."""
    return {"op3_quality_rules": OP3, "op4_exact_dedup": OP4, "op5_license_scan": _license_sql(), "op8_jaccard_join": OP8, "op11_warc": OP11, "op12_filter_audit": OP12, "op13_source_divergence": OP13}


OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM i),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN l ON w.doc_id = l.doc_id),
b AS (SELECT *, (n_words < 50) AS b0, (100 * n_repeat_words > 50 * n_words) AS b1, (100 * n_symbols > 10 * n_words) AS b2, (n_dup_lines > 1 AND 100 * n_dup_lines > 30 * n_lines) AS b3,
  (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS b4, (n_letters > 0 AND 100 * n_upper > 50 * n_letters) AS b5 FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  b0 OR b1 AS base_failed, NOT (b0 OR b1 OR b2 OR b3 OR b4 OR b5) AS kept, CAST(b0 AS BIGINT) + 2 * CAST(b1 AS BIGINT) + 4 * CAST(b2 AS BIGINT) + 8 * CAST(b3 AS BIGINT) + 16 * CAST(b4 AS BIGINT) + 32 * CAST(b5 AS BIGINT) AS fail_bits FROM b
"""

OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT u AS doc_id, v AS seen FROM b UNION SELECT r.doc_id, b.v FROM r JOIN b ON r.seen = b.u),
c AS (SELECT doc_id, min(seen) AS least FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.doc_id
"""


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def form(c: str) -> str:
        x = f"regexp_replace(lower({c}), '(?m)^[ \\t*#/;-]*(copyright|©|\\(c\\))[^\\n]*$', ' ', 'g')"
        for pattern, short in license_scan.SPELLINGS:
            x = f"replace({x}, {quoted(pattern)}, {quoted(short)})"
        marks = license_scan._PUNCTUATION
        return f"trim(regexp_replace(translate({x}, {quoted(marks)}, {quoted(' ' * len(marks))}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"

    known = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in license_scan.KNOWN)
    return f"""
WITH k AS (SELECT DISTINCT license_id, sha256({form('t')}) AS digest FROM (VALUES {known}) x(license_id, t) WHERE length({form('t')}) > 0),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, 'whole' AS kind, t AS unit FROM d
  UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(t, '\n[ \t\r]*\n')) FROM d WHERE regexp_matches(t, '\n[ \t\r]*\n')
  UNION ALL SELECT doc_id, 'line', unnest(string_split(t, chr(10))) FROM d WHERE contains(t, chr(10))),
f AS (SELECT u.doc_id, kind, license_id FROM (SELECT doc_id, kind, sha256({form('unit')}) AS digest FROM u) u LEFT JOIN k ON u.digest = k.digest)
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list(license_id) FILTER (license_id IS NOT NULL))), ','), '') AS license_ids, count(license_id) AS n_units, coalesce(bool_or(kind = 'whole' AND license_id IS NOT NULL), false) AS whole_text FROM f GROUP BY doc_id
"""


OP4 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""

OP12 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
w AS (SELECT d.*, m.least, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS words FROM d JOIN m USING (t)),
x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
  'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)} AS f FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
y AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails FROM x),
z AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM y GROUP BY part, fails),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, [filter_order[i] FOR i IN range(1, step)] AS before FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o WHERE length(filter_order) = 5))
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (NOT list_has_any(fails, list_append(before, own))), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (list_contains(fails, own) AND list_has_any(fails, before)), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (fails = [own]), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(len(fails), 1))) FILTER (list_contains(fails, own)), 0) AS BIGINT) AS shapley
FROM z CROSS JOIN s GROUP BY part, filter_order, step, own
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
b AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM a),
p AS (SELECT b.lang, b.source, b.term, b.n, 1 + CAST((CAST(1000000000 AS HUGEINT) * (b.n + 5)) // (b.total + 5 * v.v) AS BIGINT) AS p, 1 + CAST((CAST(1000000000 AS HUGEINT) * (b.all_n + 5)) // (v.total + 5 * v.v) AS BIGINT) AS q FROM b JOIN v ON b.lang = v.lang),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.f, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT t, min(page_id) AS least FROM p GROUP BY t),
h AS (SELECT page_id, t, sha1(t) AS x, CASE WHEN page_id IS DISTINCT FROM least AND least IS NOT NULL THEN least END AS refers_to FROM p JOIN f USING (t))
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest FROM h
"""
