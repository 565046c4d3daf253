"""Queries over text: normalisation, keywords, citations, resolution, extraction, explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions import text as x
from kinweave.operators import capability_pipeline, explain, extraction, requirements, resolve
from kinweave.plans import corpus
from kinweave.plans.collab import table
from kinweave.plans.collab_sql import VIEWS
from kinweave.plans.graph_queries import _explained
from kinweave.sources import nested_graph

QUERIES = {}
SQL = {}


def query(sql_body: str | None = None, *needs: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql_body is not None:
            SQL[fn.__name__] = VIEWS.query(sql_body, *needs)
        return fn

    return register


_NORM = r"""trim(regexp_replace(regexp_replace(replace(replace(strip_accents(lower({0})), '-', ' '), '_', ' '), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"""
_STOP = "[" + ", ".join(f"'{t}'" for t in settings.GENERIC_TERMS) + "]"
_WORDS = "[" + ", ".join(f"'{t}'" for t in settings.QUERY_STOPWORDS) + "]"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_hash, length({_NORM.format('text')}) AS norm_length FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    norm = x.normalize(F.col("text"))
    out = table(spark, sf, "documents").select("doc_id", norm.alias("norm"))
    return out.select("doc_id", F.md5("norm").alias("norm_hash"), F.length("norm").cast("long").alias("norm_length"))


@query(f"""
SELECT DISTINCT replace({_NORM.format('word')}, ' ', '_') AS slug,
  trim(regexp_replace(regexp_replace(lower(strip_accents(word)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS key
FROM (SELECT unnest(regexp_extract_all(text, '\\p{{L}}+ \\p{{L}}+')) AS word FROM documents)""")
def slugs_and_name_keys(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+ \p{L}+"), F.lit(0))).alias("w")).distinct()
    return words.select(x.capability_id(F.col("w")).alias("slug"), x.name_key(F.col("w")).alias("key")).distinct()


@query(f"""
SELECT doc_id, array_to_string(list_slice(list_filter(phrases, lambda p, i: list_position(phrases, p) = i), 1, 30), '|') AS keywords FROM (
SELECT doc_id, list_concat(
  CASE WHEN n >= 3 THEN list_transform(range(1, n - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) ELSE [] END,
  CASE WHEN n >= 2 THEN list_transform(range(1, n), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END, t) AS phrases
FROM (SELECT doc_id, t, len(t) AS n FROM (SELECT item_id AS doc_id,
  list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\-\\s]', ' ', 'g'), '\\s+'),
    lambda w: length(w) > 2 AND NOT list_contains({_WORDS}, w)) AS t FROM benchmark)))""")
def query_keywords(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), x.query_keywords(F.col("text")).alias("k"))
    return out.select("doc_id", F.array_join("k", "|").alias("keywords"))


@query(f"""
SELECT conv_id, turn, list_contains({_STOP}, {_NORM.format("role || ' ' || word")}) OR (len(w) > 0 AND len(list_filter(w, lambda v: NOT list_contains({_STOP}, v))) = 0) AS generic
FROM (SELECT *, string_split({_NORM.format('word')}, ' ') AS w FROM (
SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'Data  Analysis' ELSE text END AS word FROM conversations))""")
def generic_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each turn, or a stop phrase in the users' place, is made of stop terms only."""
    said = F.when(F.col("role") == "user", F.lit("Data  Analysis")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", x.is_generic(said).alias("generic"))


@query(r"""
SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(
  replace(replace(html, '<', '['), '>', ']'), '\[([a-zA-Z0-9_.\-]+)\]', 1))), ',') AS cited FROM pages""")
def cited_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Bracketed identifiers of each page, its tags taken as brackets."""
    found = x.cited_ids(F.translate("html", "<>", "[]"))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(found), ",").alias("cited"))


@query(r"""
SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS segment,
  CASE WHEN length(url) <= 80 THEN url ELSE left(url, 77) || '...' END AS title,
  lower(url) AS slug FROM pages""")
def url_segments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", x.last_segment(F.col("url")).alias("segment"), x.short_title(F.col("url")).alias("title"), x.slug(F.col("url")).alias("slug")
    )


@query("""
SELECT event_id, CAST(year(ts) AS INTEGER) AS y1, CAST(year(ts) AS INTEGER) AS y2,
  CASE WHEN event_id >= 1000 THEN CAST(left(CAST(event_id AS VARCHAR), 4) AS INTEGER) END AS y3,
  true AS day_ok, false AS month_ok, event_type = 'view' AS lang_ok FROM events""")
def year_date_language(spark: SparkSession, sf: str) -> DataFrame:
    """Year parsing, date and language validity over the events."""
    day, month = F.date_format("ts", "yyyy-MM-dd'Z'"), F.date_format("ts", "yyyy-MM")
    number = F.when(F.col("event_id") >= 10000, F.substring(F.col("event_id").cast("string"), 1, 4)).otherwise(F.col("event_id").cast("string"))
    lang = F.when(F.col("event_type") == "view", F.lit("pt-BR")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(
        "event_id", x.parse_year(F.date_format("ts", "yyyy")).alias("y1"), x.parse_year(day).alias("y2"),
        x.parse_year(F.rpad(number, 4, "x")).alias("y3"),
        x.is_valid_date(day).alias("day_ok"), x.is_valid_date(month).alias("month_ok"), x.is_valid_language(lang).alias("lang_ok"),
    )


# -- resolution ------------------------------------------------------------

def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Part names in key order; every name is also written with its words swapped, as alias or as name."""
    parts = table(spark, sf, "part")
    words = F.split("p_name", " ")
    swapped = F.concat_ws(" ", F.element_at(words, 2), F.element_at(words, 1))
    return parts.select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") > 25, F.initcap("p_name")).otherwise(swapped).alias("name"),
        F.when(F.col("p_size") > 40, swapped).alias("alias"),
    )


def _known(spark: SparkSession, sf: str) -> DataFrame:
    """Existing records: the names of economy parts of the first brand."""
    parts = table(spark, sf, "part").where((F.col("p_type") == "ECONOMY") & (F.col("p_brand") == "Brand#1"))
    names = parts.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return names.select("ord", F.replace("name", F.lit(" "), F.lit("_")).alias("capability_id"), "name",
                        F.array(F.concat(F.lit("the "), F.col("name"))).alias("aliases"))


VIEWS.add("mentions", """
SELECT p_partkey AS seq, CASE WHEN p_size > 25 THEN p_name ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS norm,
  CASE WHEN p_size > 40 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS alias FROM part""")
VIEWS.add("known_names", "SELECT DISTINCT p_name AS name FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#1'")
VIEWS.add("offers", "SELECT alias, seq, norm FROM mentions WHERE alias <> norm", "mentions")
VIEWS.add("first_names", """
SELECT norm, first_seq, known, NOT known AND coalesce(o.seq >= first_seq, true) AS creates
FROM (SELECT norm, min(seq) AS first_seq, norm IN (SELECT name FROM known_names) AS known FROM mentions GROUP BY 1)
LEFT JOIN (SELECT alias, min(seq) AS seq FROM offers GROUP BY 1) o ON o.alias = norm""", "mentions", "known_names", "offers")
VIEWS.add("takeovers", """
SELECT o.alias, o.seq, o.norm AS owner FROM offers o JOIN first_names f ON f.norm = o.norm AND f.first_seq = o.seq AND f.creates""",
          "offers", "first_names")
VIEWS.add("told", """
SELECT m.seq, m.norm, CASE WHEN f.known OR f.creates THEN m.norm ELSE t.owner END AS owner, f.creates AND m.seq = f.first_seq AS created
FROM mentions m JOIN first_names f USING (norm) ASOF LEFT JOIN takeovers t ON t.alias = m.norm AND m.seq > t.seq""",
          "mentions", "first_names", "takeovers")
VIEWS.add("firsts", """
SELECT o.alias AS norm, t.norm AS up, t.owner FROM (SELECT alias, min(seq) AS seq FROM offers GROUP BY 1) o JOIN told t USING (seq)""", "offers", "told")
VIEWS.add("chains", """
SELECT norm, up, owner FROM firsts UNION ALL
SELECT c.norm, f.up, f.owner FROM chains c JOIN firsts f ON f.norm = c.up WHERE c.owner IS NULL""", "firsts")
VIEWS.add("resolved", """
SELECT t.seq, replace(coalesce(t.owner, c.owner), ' ', '_') AS capability_id, t.created
FROM told t LEFT JOIN (SELECT norm, owner FROM chains WHERE owner IS NOT NULL) c USING (norm)""", "told", "chains")


@query("SELECT seq, capability_id, created FROM resolved", "resolved")
def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_names(_mentions(spark, sf), _known(spark, sf)).select("seq", "capability_id", "created")


@query("SELECT count(*) FILTER (WHERE created) AS created, count(*) FILTER (WHERE NOT created) AS merged FROM resolved", "resolved")
def resolution_summary(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.save_summary(resolve.resolve_names(_mentions(spark, sf), _known(spark, sf)))


@query("""
SELECT CAST(a.vec_id AS VARCHAR) AS id, CAST(arg_max(b.vec_id, (sim, -b.vec_id)) AS VARCHAR) AS capability_id, round(max(sim), 6) AS similarity
FROM (SELECT m.vec_id, b.vec_id AS other, list_cosine_similarity(m.v, b.embedding::DOUBLE[]) AS sim FROM (
  SELECT a.vec_id, list_transform(list_zip(a.embedding, n.embedding), lambda p: p[1]::DOUBLE + a.label / 10.0::DOUBLE * p[2]::DOUBLE) AS v
  FROM embeddings a JOIN embeddings n ON n.vec_id = a.vec_id + 1) m, embeddings b) a JOIN embeddings b ON b.vec_id = a.other
WHERE sim >= 0.92 GROUP BY 1""")
def resolve_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector, mixed with its neighbour by the weight of its label, looked up among all vectors."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("other"))
    mixed = vectors.join(following, "vec_id").select(
        F.col("vec_id").alias("id"), F.zip_with("vector", "other", lambda a, b: a + b * F.col("label") / 10.0).alias("vector"),
        F.lit(settings.EMBEDDING_THRESHOLD).alias("threshold"),
    )
    index = vectors.select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("capability_id"), "vector")
    return resolve.nearest_records(mixed, index).withColumn("similarity", F.round("similarity", 6))


@query(r"""
SELECT p_partkey, CASE WHEN length(p_name) <= 6 AND NOT contains(p_name, ' ') THEN 0.97::DOUBLE ELSE 0.92::DOUBLE END AS name_threshold,
  CASE WHEN length(p_type) <= 6 THEN 0.97::DOUBLE ELSE 0.92::DOUBLE END AS type_threshold FROM part""")
def similarity_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", resolve.similarity_threshold(x.normalize(F.col("p_name"))).alias("name_threshold"),
        resolve.similarity_threshold(x.normalize(F.col("p_type"))).alias("type_threshold"),
    )


# -- requirements ----------------------------------------------------------

@query("""
WITH raw AS (SELECT p_partkey AS seq, p_type AS target_id, p_name AS name, CASE WHEN p_size > 45 THEN 0.5::DOUBLE ELSE p_size / 50.0::DOUBLE END AS importance FROM part),
known AS (SELECT DISTINCT p_name AS name FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#1'),
firsts AS (SELECT name, min(seq) AS seq FROM raw GROUP BY 1)
SELECT target_id, seq, name, round(CASE WHEN new THEN importance * 0.7::DOUBLE ELSE importance END, 6) AS importance,
  CASE WHEN NOT new THEN replace(name, ' ', '_') END AS capability_id FROM (
SELECT r.*, r.name NOT IN (SELECT name FROM known) AND f.seq = r.seq AS new FROM raw r JOIN firsts f ON f.name = r.name)""")
def requirement_mapping(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").select(
        F.col("p_type").alias("target_id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") <= 45, (F.col("p_size") / 50.0).cast("string")).otherwise("high").alias("importance"),
        F.lit("extracted").alias("source"),
    )
    out = requirements.map_requirements(raw, _known(spark, sf))
    return out.select("target_id", "seq", "name", F.round("importance", 6).alias("importance"), "capability_id")


@query("""
SELECT project_id AS target_id, name, 0.5::DOUBLE AS importance, 'extracted' AS source FROM project_domain JOIN domains USING (domain_id)""",
       "project_domain", "domains")
def requirement_domain_fallback(spark: SparkSession, sf: str) -> DataFrame:
    from kinweave.plans.collab import base_graph

    graph = base_graph(spark, sf)
    rows = graph.project_domain.join(graph.domains.select("domain_id", "name"), "domain_id")
    return requirements.domain_fallback(rows.withColumnRenamed("project_id", "target_id")).drop("capability_id")


# -- extraction ------------------------------------------------------------

def _publications(spark: SparkSession, sf: str) -> DataFrame:
    keywords = F.array_distinct(F.regexp_extract_all("text", F.lit(corpus.KEYWORD_PATTERN), F.lit(0)))
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("project_id"), F.lit("").alias("title"), F.col("text").alias("abstract"),
        keywords.alias("keywords"), F.array("lang").alias("domains"),
    )


@query(r"""
SELECT CAST(doc_id AS VARCHAR) AS project_id, word AS name, """ + _NORM.format("word") + r""" AS normalized_name, 'TOPIC' AS kind,
  round((length(word) - 6) / 20.0::DOUBLE, 6) AS confidence
FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\p{L}{12,}'))) AS word FROM documents) WHERE length(word) >= 16""")
def capability_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt, backend call, parsing and filters over all documents, with the deterministic backend."""
    projects = _publications(spark, sf)
    answers = extraction.capability_responses(projects, extraction.KeywordBackend(), "stub")
    out = extraction.accepted_capabilities(projects, answers)
    return out.select("project_id", "name", "normalized_name", "kind", F.round("confidence", 6).alias("confidence"))


VIEWS.add("accepted", r"""
SELECT CAST(doc_id AS VARCHAR) AS project_id, source AS person_id, 2000 + n_chars % 20 AS year, i AS pos, (length(word) - 6) / 20.0::DOUBLE AS confidence,
  replace(""" + _NORM.format("word") + r""", ' ', '_') AS capability_id
FROM (SELECT doc_id, source, n_chars, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT doc_id, source, n_chars, regexp_extract_all(text, '\p{L}{12,}') AS w FROM documents))
WHERE length(word) >= 16 QUALIFY row_number() OVER (PARTITION BY doc_id, word ORDER BY i) = 1""")


def _saved(spark: SparkSession, sf: str) -> capability_pipeline.Saved:
    projects = _publications(spark, sf)
    answers = extraction.capability_responses(projects, extraction.KeywordBackend(), "stub")
    accepted = extraction.accepted_capabilities(projects, answers)
    return capability_pipeline.save_extraction(accepted, capability_pipeline.no_records(spark), "2026-01-01", "stub")


@query("""
SELECT project_id, count(*) FILTER (WHERE n = 1) AS created, count(*) FILTER (WHERE n > 1) AS merged, 0::BIGINT AS skipped
FROM (SELECT project_id, row_number() OVER (PARTITION BY capability_id ORDER BY project_id, pos) AS n FROM accepted) GROUP BY 1""", "accepted")
def save_extraction_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Records started and mentions merged by each document, taken in the order of identifiers."""
    return capability_pipeline.save_counts(_saved(spark, sf).mentions)


@query(f"""
SELECT person_id, capability_id, count(*) AS publication_count, round(avg(confidence), 6) AS avg_confidence,
  count(*) FILTER (WHERE year >= 2019 - 5) AS recent_publication_count, min(year) AS first_seen_year, max(year) AS last_seen_year,
  round(least(1.0::DOUBLE, sum(pow(0.5::DOUBLE, greatest(0, 2019 - year) / 5.0::DOUBLE)) / count(*)), 6) AS score
FROM (SELECT project_id, person_id, year, capability_id, arg_min(confidence, pos) AS confidence FROM accepted GROUP BY 1, 2, 3, 4)
WHERE person_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {settings.MIN_EVIDENCE_COUNT}""", "accepted")
def capability_pipeline_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Answers, filters, resolution, evidence edges and aggregates, with the source of a document as its author."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("project_id"), F.col("source").alias("person_id"), (F.col("n_chars") % 20 + 2000).alias("year"))
    rows = capability_pipeline.author_capabilities(
        _saved(spark, sf).edges, docs.select("person_id", "project_id"), docs.select("project_id", "year"), 2019)
    return rows.select(
        F.col("author").alias("person_id"), F.col("capability").alias("capability_id"), F.col("publicationCount").alias("publication_count"),
        F.round("avgExtractionConfidence", 6).alias("avg_confidence"), F.col("recentPublicationCount").alias("recent_publication_count"),
        F.col("firstSeenYear").alias("first_seen_year"), F.col("lastSeenYear").alias("last_seen_year"), F.round("score", 6).alias("score"))


@query(r"""
WITH said AS (SELECT doc_id, lang, word, i FROM (SELECT doc_id, lang, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, lang, regexp_extract_all(text, '\p{L}{12,}') AS w FROM documents WHERE source NOT LIKE '%1' OR source IS NULL))
  QUALIFY row_number() OVER (PARTITION BY doc_id, word ORDER BY i) = 1)
SELECT CAST(doc_id AS VARCHAR) AS target_id, count(*) AS n, 0::BIGINT AS n_domains FROM said GROUP BY 1 UNION ALL
SELECT CAST(doc_id AS VARCHAR), count(*), count(*) FROM documents WHERE lang IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM said) GROUP BY 1""")
def requirement_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Requirements of every document: its long words, or its language where the backend fails or names nothing."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("project_id"), "source")
    refused = F.coalesce(F.col("source").endswith("1"), F.lit(False))
    projects = _publications(spark, sf).join(docs, "project_id").withColumn("title", F.when(refused, F.lit("refused")).otherwise(F.lit("")))
    answers = extraction.requirement_responses(projects, extraction.KeywordRequirements("Title: refused"))
    domains = projects.where("domains[0] IS NOT NULL").select(
        F.col("project_id").alias("target_id"), F.col("domains")[0].alias("domain_id"), F.col("domains")[0].alias("name"))
    found = requirements.requirements_or_domains(extraction.raw_requirements(answers), domains, capability_pipeline.no_records(spark))
    return found.groupBy("target_id").agg(F.count("*").alias("n"), F.count_if(F.col("importance") == settings.DEFAULT_IMPORTANCE).alias("n_domains"))


# -- explanations ----------------------------------------------------------

VIEWS.add("lead", """
SELECT c.target_id, c.person_id,
  (SELECT min(project_id) FROM evidence e WHERE e.target_id = c.target_id AND e.person_id = c.person_id AND kind = 'project') AS pid,
  (SELECT arg_min(id, (project_id, id)) FROM evidence e WHERE e.target_id = c.target_id AND e.person_id = c.person_id AND kind = 'domain') AS did,
  (SELECT string_agg('[' || id || '] (' || text || ')', ', ' ORDER BY id) FROM (SELECT id, text FROM evidence e
   WHERE e.target_id = c.target_id AND e.person_id = c.person_id AND kind = 'capability' ORDER BY id LIMIT 3)) AS caps
FROM ranked c""", "ranked", "evidence")


@query("""
SELECT l.target_id, l.person_id, concat_ws(' ',
  'Collaborator ' || CASE WHEN starts_with(l.person_id, 'unknown_') THEN l.person_id ELSE replace(p.full_name, '#', ' ') END || ' [' || l.person_id || '] is recommended based on graph evidence.',
  'Shows publication evidence related to ' || caps || '.',
  'Authored publication [' || pid || '] (''' || pr.title || ''') in ' || pr.year || '.',
  'Publication history aligns with research domain [' || did || '] (' || d.name || ').',
  printf('Scored %.2f on capability gap coverage and %.2f on team complementarity.', coalesce(gap_match, 0::DOUBLE), coalesce(complementarity, 0::DOUBLE)),
  'Caveats: ' || nullif(concat_ws(' ',
    CASE WHEN starts_with(l.person_id, 'unknown_') THEN 'Candidate identity is a fallback placeholder (''unknown_''); publication history may merge homonyms.' END,
    CASE WHEN graph = 0 THEN 'No prior co-authorship connection with existing project team members.' END,
    CASE WHEN coalesce(gap_match, 0) = 0 AND l.target_id IN (SELECT target_id FROM requirements) THEN 'No publication evidence directly matching uncovered project capability gaps.' END,
    CASE WHEN recency < 0.4 THEN 'Limited recent publication evidence within the last 3-5 years.' END), '')) AS explanation
FROM lead l JOIN ranked r USING (target_id, person_id) JOIN people p ON p.person_id = l.person_id
LEFT JOIN projects pr ON pr.project_id = pid LEFT JOIN domains d ON d.domain_id = did""",
       "lead", "ranked", "people", "projects", "domains", "requirements")
def explanation_template(spark: SparkSession, sf: str) -> DataFrame:
    res, shown = _explained(spark, sf)
    return explain.template_explanations(res.ranked, shown, res.gaps).select("target_id", "person_id", "explanation")


@query("""
SELECT target_id, person_id, rank % 2 = 0 AS used_template, CASE WHEN rank % 2 = 0 THEN 'Rejected: cited unknown IDs [''nowhere'']' END AS fallback_reason FROM ranked""",
       "ranked")
def citation_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that cite the person, and at every other rank an identifier nobody supplied."""
    res, shown = _explained(spark, sf)
    templates = explain.template_explanations(res.ranked, shown, res.gaps)
    wrong = F.when(F.col("rank") % 2 == 0, F.lit(" and [nowhere]")).otherwise("")
    texts = res.ranked.select("target_id", "person_id", F.concat(F.lit("Worked with ["), F.col("person_id"), F.lit("]"), wrong).alias("explanation"),
                              F.lit(None).cast("string").alias("error"))
    out = explain.verified_explanations(texts, templates, explain.valid_ids(res.ranked, shown))
    return out.select("target_id", "person_id", "used_template", "fallback_reason")


@query("""
SELECT target_id, person_id, count(*) FILTER (WHERE id IS NOT NULL) AS n_items,
  coalesce(string_agg('- [' || id || '] (' || kind || '): ' || text || CASE WHEN year <> 0 THEN ' (Year: ' || year || ')' ELSE '' END, chr(10)
    ORDER BY kind = 'capability', project_id, kind <> 'project', id), '- None.') AS items
FROM (SELECT r.target_id, r.person_id, kind, id, text, project_id, year FROM ranked r LEFT JOIN (
  SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY target_id, person_id, kind ORDER BY project_id, id) <= 3) e
  ON e.target_id = r.target_id AND e.person_id = r.person_id) GROUP BY 1, 2""", "ranked", "evidence")
def explanation_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence lines of each candidate's prompt, the first three of each kind."""
    res, shown = _explained(spark, sf)
    contexts = explain.explanation_contexts(res.ranked, shown, res.gaps, per_kind=3)
    prompts = explain.explanation_prompts(contexts, list(settings.RANKING_WEIGHTS)).join(contexts.select(*explain.PAIR, F.size("evidence").cast("long").alias("n_items")), explain.PAIR)
    lines = F.regexp_extract("prompt", r"(?s)#### Evidence[^\n]*\n(.*?)\n\n#### Caveats", 1)
    return prompts.select("target_id", "person_id", "n_items", lines.alias("items"))


@query("""
SELECT target_id, person_id, rank % 3 <> 0 AS used_template, CASE rank % 3 WHEN 1 THEN 'Rejected: cited unknown IDs [''nowhere'']'
  WHEN 2 THEN 'LLM failure: refused' END AS fallback_reason FROM ranked""", "ranked")
def explanations_with_backend(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt, call, verification and template in one: by rank the backend cites wrongly, fails, or cites the candidate."""
    res, shown = _explained(spark, sf)
    ranked = res.ranked.withColumn("full_name", F.concat("full_name", F.lit(" #"), F.col("rank") % 3))

    def backend(prompt: str) -> str:
        head = prompt.split("### Candidate: ", 1)[1].split("\n", 1)[0]
        name, _, person = head[:-1].rpartition(" (ID: ")
        case = name.rsplit("#", 1)[1]
        if case == "2":
            raise RuntimeError("refused")
        return f"Publication evidence of [{person}]" + (" and [nowhere]." if case == "1" else ".")

    out = explain.explain_candidates(ranked, shown, res.gaps, list(settings.RANKING_WEIGHTS), backend)
    return out.select("target_id", "person_id", "used_template", "fallback_reason")


@query("""
WITH o AS (SELECT DISTINCT l_orderkey AS p, l_suppkey AS s, l_partkey % 50 AS d FROM lineitem)
SELECT 'projects' AS table_name, count(DISTINCT p) AS n FROM o UNION ALL SELECT 'authors', count(DISTINCT s) FROM o UNION ALL
SELECT 'wrote', count(DISTINCT (p, s)) FROM o UNION ALL SELECT 'project_domain', count(DISTINCT (p, d)) FROM o UNION ALL
SELECT 'domains', count(DISTINCT d) FROM o UNION ALL SELECT 'subdomain_of', count(DISTINCT d) FROM o WHERE d >= 5 UNION ALL
SELECT 'has_capability', count(DISTINCT (s, d)) FROM o""")
def nested_graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as nested JSON, with suppliers as members and part groups as domains, loaded as graph tables."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("s"), (F.col("l_partkey") % 50).alias("d"))
    code = F.concat(F.lit("p"), F.col("d"))
    up = F.when(F.col("d") >= 5, F.array(F.concat(F.lit("p"), F.col("d") % 5))).otherwise(F.array())
    orders = rows.groupBy(F.col("l_orderkey").alias("project_id")).agg(  # an order has few lines
        F.collect_list(F.struct(F.col("s").alias("person_id"))).alias("members"),
        F.collect_list(F.struct(code.alias("domain_id"), up.alias("parent_ids"))).alias("domains"))
    able = rows.select(F.col("s").alias("person_id"), code.alias("capability_id")).distinct()
    as_text = lambda df: nested_graph.documents(df.select(F.to_json(F.struct("*")).alias("value")))
    loaded = nested_graph.nested_graph(as_text(orders), as_text(able))
    names = ["projects", "authors", "wrote", "project_domain", "domains", "subdomain_of", "has_capability"]
    return reduce(DataFrame.unionAll, [getattr(loaded, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n in names])
