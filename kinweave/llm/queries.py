"""Registered queries of the corpus operators over the test tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.decontaminate import contamination_report
from kinweave.llm.html_extract import page_report
from kinweave.llm.jaccard_join import similar_components
from kinweave.llm.language_crf import language_report
from kinweave.llm.packing import pack
from kinweave.llm.periodic_runs import run_report, with_loops
from kinweave.llm.quality import quality_report
from kinweave.llm.secrets import secret_report
from kinweave.llm.slack_packing import slack_report
from kinweave.llm.substring_dedup import substring_report
from kinweave.llm.suffix_dedup import suffix_report
from kinweave.llm.turn_repair import damaged, repair_report
from kinweave.llm.warc_revisits import revisit_report


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences of all documents."""
    return substring_report(_table(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified revisits of all pages, resolved to the latest earlier full response."""
    return revisit_report(_table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents covered by a 200-byte string that starts elsewhere too."""
    return suffix_report(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_report(_table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.85 of four-word shingles."""
    return similar_components(_table(spark, sf_dir, "documents")).drop("n_links")


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a conditional random field over its words."""
    return language_report(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with those that look live told apart by who holds them."""
    return secret_report(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with thresholds of each language and source."""
    return quality_report(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 words without two pieces of a source or of a cluster of near copies."""
    return pack(_table(spark, sf_dir, "documents"), near=True)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, every tenth of them with a looping tail."""
    return run_report(with_loops(_table(spark, sf_dir, "documents")))


def op12_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents in sequences of at most 2,048, filled by minimum bin slack."""
    import public_tokenizers

    return slack_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of the turns of all conversations, a fifth of them damaged before."""
    conversations = _table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_language_crf": op3_language_crf,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_secrets": op5_secrets,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_slack_packing": op12_slack_packing,
    "op13_turn_repair": op13_turn_repair,
}

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_decontamination": rf"""
WITH bw AS (
  SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_slice(w, j, j + k - 1) win, k
  FROM (SELECT item, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) j FROM bw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w FROM documents),
lengths AS (SELECT DISTINCT k FROM windows),
hits AS (
  SELECT d.doc_id, d.j, d.k, x.item
  FROM (SELECT doc_id, k, j, list_slice(w, j, j + k - 1) win
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) j FROM dw, lengths)) d
  JOIN windows x ON x.k = d.k AND x.win = d.win),
covered AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(j, j + k)) p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) n, string_agg(item, ',' ORDER BY item) all_items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(i.all_items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)""",
    "op4_jaccard_join": rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, coalesce(regexp_extract_all({_FOLD.format("text")}, '[^\x20\x09-\x0D]+'), []) w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, list_slice(w, j, j + k - 1) g
  FROM (SELECT doc_id, w, least(4, len(w)) k, unnest(range(1, len(w) - least(4, len(w)) + 2)) j FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) n FROM grams GROUP BY 1),
links AS (
  SELECT x, y FROM (SELECT a.doc_id x, b.doc_id y, count(*) c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT x, y FROM edges UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other),
low AS (SELECT doc_id, min(other) low FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN low l USING (doc_id)""",
}

SQL["op10_quality"] = r"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
wins AS (SELECT doc_id, i, list_slice(w, i, i + 2) g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM words)),
rep AS (SELECT doc_id, count(DISTINCT p) n FROM (
  SELECT a.doc_id, unnest([i, i + 1, i + 2]) p FROM wins a JOIN (SELECT doc_id, g FROM wins GROUP BY 1, 2 HAVING count(*) > 1) b USING (doc_id, g)) GROUP BY 1),
lines AS (SELECT doc_id, count(*) n, count(*) - count(DISTINCT l) dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) l FROM words)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, lang, source, len(w) n_words, coalesce(length(array_to_string(w, '')), 0) word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, coalesce(l.n, 0) n_lines, coalesce(l.dup, 0) n_dup_lines, coalesce(r.n, 0) n_repeat_words
  FROM words LEFT JOIN lines l USING (doc_id) LEFT JOIN rep r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM m),
v AS (SELECT *, least(100 * word_chars // n_words, 10000) v0, 1000 * n_symbols // word_chars v1, 1000 * n_dup_lines // n_lines v2, 1000 * n_repeat_words // n_words v3
  FROM b WHERE NOT base_failed),
q AS (SELECT lang, source, quantile_disc(v0, 0.25) a0, quantile_disc(v0, 0.75) c0, quantile_disc(v1, 0.25) a1, quantile_disc(v1, 0.75) c1,
  quantile_disc(v2, 0.25) a2, quantile_disc(v2, 0.75) c2, quantile_disc(v3, 0.25) a3, quantile_disc(v3, 0.75) c3 FROM v GROUP BY 1, 2),
k AS (SELECT doc_id, v0 BETWEEN a0 - (3 * (c0 - a0) + 100) AND c0 + 3 * (c0 - a0) + 100 AND v1 <= c1 + 3 * (c1 - a1) + 150
  AND v2 <= c2 + 3 * (c2 - a2) + 300 AND v3 <= c3 + 3 * (c3 - a3) + 300 kept
  FROM v JOIN q ON v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(kept, false) AS kept FROM b LEFT JOIN k USING (doc_id)"""

SQL["op6_warc_revisits"] = r"""
WITH p AS (SELECT page_id, url, sha256(coalesce(html, '')) h, regexp_replace(trim(url), '#.*$', '') bare FROM pages),
k AS (SELECT page_id, h, substr(h, 1, 16) tag, page_id * 600 t,
  regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:(?i:https?://))?(?:[^/?@]*@)?([^/?]*)', 1)), ':(?:80|443)$', ''), '^www[0-9]?[.]', '') host,
  regexp_replace(regexp_extract(bare, '^(?:(?i:https?://))?[^/?]*([^?]*)', 1), '/+$', '') path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> '')), '&') q FROM p),
u AS (SELECT page_id, h, tag, t, CASE WHEN host <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END url_key FROM k),
r AS (SELECT u.*, t + 3600 rt FROM u),
f AS (SELECT r.page_id, r.url_key, r.tag, r.rt, w.page_id rp, w.h rh, w.tag rtag,
  row_number() OVER (PARTITION BY r.page_id ORDER BY w.t DESC, w.page_id DESC) n
  FROM r LEFT JOIN u w ON w.url_key = r.url_key AND (w.t < r.rt OR (w.t = r.rt AND w.page_id * 2 < r.page_id * 2 + 1))),
g AS (SELECT *, CASE WHEN rp IS NULL THEN 'unresolved' WHEN (CASE WHEN page_id % 5 = 0 THEN reverse(tag) ELSE tag END) <> rtag THEN 'mismatch' ELSE 'resolved' END status FROM f WHERE n = 1)
SELECT page_id * 2 + 1 AS record_id, url_key, status, CASE WHEN status = 'resolved' THEN rp * 2 END AS response_id,
  CASE WHEN status = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: ' || rt || chr(10) || 'etag: ' ||
    CASE WHEN page_id % 5 = 0 THEN reverse(tag) ELSE 'W/' || tag END || chr(10) || 'server: a' END AS headers,
  CASE WHEN status = 'resolved' THEN 'sha256:' || rh END AS payload_digest FROM g"""


def queries() -> dict:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(SQL)
