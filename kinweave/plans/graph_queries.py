"""Queries over the collaboration graph, each with its check."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.scoring import linear_scorer
from kinweave.operators import capability, graph as g, recommend as rec
from kinweave.operators.recommend import PAIR
from kinweave.plans import collab
from kinweave.plans.collab_sql import VIEWS
from kinweave.session import discard, stage
from kinweave import settings

QUERIES = {}
SQL = {}
FEATURES = list(settings.RANKING_WEIGHTS)


def query(sql_body: str | None = None, *needs: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql_body is not None:
            SQL[fn.__name__] = VIEWS.query(sql_body, *needs)
        return fn

    return register


def _prepared(spark: SparkSession, sf: str, able: bool = True):
    graph, rows = collab.staged_graph(spark, sf, able)
    targets = collab.staged_targets(graph, rows, collab.largest_teams(graph))
    discard(rows)
    return graph, targets


def _recommendation(spark: SparkSession, sf: str):
    graph, targets = _prepared(spark, sf)
    return rec.recommend(graph, targets)


def _explained(spark: SparkSession, sf: str):
    """The recommendation with its ranking written out, and the evidence of the ranked alone."""
    graph, targets = _prepared(spark, sf)
    found = rec.recommend(graph, targets)
    found = replace(found, ranked=stage(found.ranked, "ranked"))
    return found, rec.evidence_of(graph, found.ranked, targets)


def _asked_evidence(spark: SparkSession, sf: str):
    """What the evidence of all candidates is made of; it needs no ranking."""
    graph, targets = _prepared(spark, sf)
    found = g.find_candidates(graph, targets.domains, targets.requirements, targets.team)
    return graph, stage(found.people.select(*PAIR), "candidates"), targets.domains, targets.requirements


def _rounded(df: DataFrame, names: list[str]) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


_ROUNDED_FEATURES = ", ".join(f"round(coalesce({n}, 0), 6) AS {n}" for n in FEATURES)


# -- lookups ---------------------------------------------------------------

@query("SELECT project_id, title, year FROM projects ORDER BY project_id LIMIT 100 OFFSET 50", "projects")
def project_page(spark: SparkSession, sf: str) -> DataFrame:
    return g.project_page(collab.base_graph(spark, sf).projects, limit=100, offset=50)


@query("SELECT project_id, title, year FROM projects ORDER BY project_id LIMIT 200 OFFSET (SELECT count(*) // 2 FROM projects)", "projects")
def project_page_deep(spark: SparkSession, sf: str) -> DataFrame:
    """A page in the middle of all projects, found by counts of ranges."""
    projects = stage(collab.base_graph(spark, sf).projects, "projects")
    return g.project_page(projects, limit=200, offset=projects.count() // 2, page_rows=0).select("project_id", "title", "year")


@query("""SELECT project_id, title, year FROM projects WHERE project_id = (SELECT max(project_id) FROM projects)""", "projects")
def project_lookup(spark: SparkSession, sf: str) -> DataFrame:
    projects = collab.base_graph(spark, sf).projects
    last = projects.agg(F.max("project_id").alias("project_id"))
    return projects.join(last, "project_id", "left_semi").select("project_id", "title", "year")


@query("""
SELECT DISTINCT p.project_id, p.title, p.year FROM projects p JOIN wrote USING (project_id) JOIN people USING (person_id)
WHERE full_name = 'Customer#000000007'""", "projects", "wrote", "people")
def author_projects(spark: SparkSession, sf: str) -> DataFrame:
    return g.author_projects(collab.base_graph(spark, sf), "Customer#000000007")


@query("""
SELECT title AS publication, full_name AS co_author FROM projects JOIN wrote USING (project_id) JOIN people USING (person_id)
WHERE contains(title, 'ring')""", "projects", "wrote", "people")
def title_contains_coauthors(spark: SparkSession, sf: str) -> DataFrame:
    return g.collaborators_by_title(collab.base_graph(spark, sf), "ring")


@query("""
SELECT title, count(*) AS n_authorships, count(DISTINCT person_id) AS n_people FROM projects JOIN wrote USING (project_id)
GROUP BY 1""", "projects", "wrote")
def authors_by_title(spark: SparkSession, sf: str) -> DataFrame:
    graph = collab.base_graph(spark, sf)
    joined = graph.wrote.join(graph.projects.select("project_id", "title"), "project_id")
    per_person = joined.groupBy("title", "person_id").agg(F.count(F.lit(1)).alias("n"))
    return per_person.groupBy("title").agg(F.sum("n").alias("n_authorships"), F.count(F.lit(1)).alias("n_people"))


@query("""
SELECT project_id, person_id, full_name, starts_with(person_id, 'unknown_') AS is_placeholder
FROM wrote JOIN people USING (person_id)""", "wrote", "people")
def project_members(spark: SparkSession, sf: str) -> DataFrame:
    return g.project_members(collab.base_graph(spark, sf))


# -- domains ---------------------------------------------------------------

@query("SELECT DISTINCT domain_id, ancestor_id FROM closure", "closure")
def domain_closure(spark: SparkSession, sf: str) -> DataFrame:
    return g.ancestor_closure(collab.base_graph(spark, sf).subdomain_of)


@query("""
SELECT project_id, domain_id, name, coalesce(array_to_string(parent_ids, ','), '') AS parent_ids FROM (
SELECT project_id, domain_id FROM project_domain UNION
SELECT project_id, ancestor_id FROM project_domain JOIN closure USING (domain_id))
JOIN domains USING (domain_id) LEFT JOIN ancestor_lists USING (domain_id)""",
       "project_domain", "closure", "domains", "ancestor_lists")
def project_domains_with_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    graph = collab.base_graph(spark, sf)
    rows = g.project_domains(graph, g.ancestor_closure(graph.subdomain_of))
    return rows.withColumn("parent_ids", F.array_join("parent_ids", ","))


@query("""
SELECT domain_id, name, coalesce(array_to_string(parent_ids, ','), '') AS parent_ids FROM domains LEFT JOIN ancestor_lists USING (domain_id)
WHERE contains(lower(name), 'promo') OR contains(lower(domain_id), 'promo') OR contains(lower(name), 'brand#2')
OR contains(lower(domain_id), 'brand#2')""", "domains", "ancestor_lists")
def domains_by_keyword(spark: SparkSession, sf: str) -> DataFrame:
    graph = collab.base_graph(spark, sf)
    rows = g.domains_by_keywords(graph.domains, g.ancestor_closure(graph.subdomain_of), [" Promo ", "BRAND#2", "x"])
    return rows.select("domain_id", "name", F.array_join("parent_ids", ",").alias("parent_ids"))


@query("""
SELECT DISTINCT replace(p_name, ' ', '_') AS capability_id, p_name AS name FROM part
WHERE p_name IN ('red widget', 'small ring') OR replace(p_name, ' ', '_') = 'blue_bolt' OR p_name LIKE 'green %'
AND lower(p_name) = 'green gear' OR lower('the ' || p_name) = 'the red bolt'""")
def capabilities_by_terms(spark: SparkSession, sf: str) -> DataFrame:
    names = collab.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    known = names.select(
        F.replace("name", F.lit(" "), F.lit("_")).alias("capability_id"), "name",
        F.array(F.concat(F.lit("the "), F.col("name"))).alias("aliases"),
    )
    terms = ["Red Widget", "small-ring", "blue_bolt", "Gréen  Gear!", "THE red bolt", " "]
    return g.capabilities_by_terms(known, terms).select("capability_id", "name")


# -- co-authorship ---------------------------------------------------------

@query("SELECT target_id, person_id, hops FROM distance", "distance")
def coauthor_distance(spark: SparkSession, sf: str) -> DataFrame:
    graph, rows = collab.staged_graph(spark, sf, able=False)
    chosen = stage(collab.largest_teams(graph), "targets").withColumnRenamed("target_id", "project_id")
    team = graph.wrote.join(chosen, "project_id", "left_semi").select(F.col("project_id").alias("target_id"), "person_id")
    return g.coauthor_distance(graph.wrote, stage(team, "team"))


@query("""
SELECT target_id, person_id, hops FROM distance JOIN candidates USING (target_id, person_id)""", "distance", "candidates")
def coauthor_distance_of_candidates(spark: SparkSession, sf: str) -> DataFrame:
    graph, targets = _prepared(spark, sf)
    found = g.find_candidates(graph, targets.domains, targets.requirements, targets.team)
    return g.coauthor_distance(graph.wrote, targets.team, stage(found.people, "candidates"))


# -- capabilities ----------------------------------------------------------

@query("SELECT person_id, project_id, year, capability_id, confidence FROM evidence_rows", "evidence_rows")
def capability_evidence_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(collab.facts(spark, sf), "facts")
    graph = collab.base_graph(spark, sf, rows)
    return capability.evidence_rows(graph.wrote, collab.evidences(rows), graph.projects).select(
        "person_id", "project_id", "year", "capability_id", "confidence"
    )


@query("""
SELECT person_id, capability_id, publication_count, evidence_count, round(avg_confidence, 6) AS avg_confidence,
recent_publication_count, first_seen_year, last_seen_year, round(score, 6) AS score FROM aggregates""", "aggregates")
def author_capability_agg(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(collab.facts(spark, sf), "facts")
    out = collab.aggregates(collab.base_graph(spark, sf, rows), rows)
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6)).withColumn("score", F.round("score", 6))


@query("""
SELECT count(*) FILTER (WHERE evidence_count >= 2) AS written, count(*) FILTER (WHERE evidence_count < 2) AS skipped_low_evidence,
0::BIGINT AS skipped_placeholder FROM aggregates""", "aggregates")
def evidence_gate_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(collab.facts(spark, sf), "facts")
    return capability.gate_summary(collab.aggregates(collab.base_graph(spark, sf, rows), rows))


@query("""
SELECT person_id AS author, capability_id AS capability, v AS "extractionVersion", 'agg-v1' AS "aggregationVersion",
evidence_count AS "evidenceCount", last_seen_year AS "lastSeenYear" FROM has_capability,
(VALUES ('capability-v1'), ('capability-v2')) t(v)""", "has_capability")
def version_coexistence(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(collab.facts(spark, sf), "facts")
    found = stage(collab.aggregates(collab.base_graph(spark, sf, rows), rows), "aggregates")
    first = capability.has_capability_rows(found)
    again = capability.merge_has_capability(first, capability.has_capability_rows(found))
    both = capability.merge_has_capability(again, capability.has_capability_rows(found, "capability-v2"))
    return both.select("author", "capability", "extractionVersion", "aggregationVersion", "evidenceCount", "lastSeenYear")


@query("""
SELECT project_id AS project, capability_id AS capability, 'capability-v1' AS "extractionVersion",
  1::DOUBLE - arg_min(l_discount, (pos, l_discount)) AS confidence
FROM facts GROUP BY 1, 2""", "facts")
def evidence_insert_once(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of one version: the first sighting stays, whatever arrives later."""
    rows = collab.facts(spark, sf).select(
        F.col("project_id").alias("project"), F.col("capability_id").alias("capability"),
        F.lit("capability-v1").alias("extractionVersion"), "confidence", "pos", "l_discount",
    )
    empty = rows.limit(0)
    stored = capability.merge_evidence(empty, rows, ["pos", "l_discount"])
    return capability.merge_evidence(stored, rows, ["pos", "l_discount"]).drop("pos", "l_discount")


# -- recommendation --------------------------------------------------------

@query("""
SELECT target_id, capability_id, name, importance, n_covering, is_covered FROM gaps""", "gaps")
def capability_gaps(spark: SparkSession, sf: str) -> DataFrame:
    graph, targets = _prepared(spark, sf)
    out = rec.capability_gaps(targets.requirements, rec.team_capabilities(graph, targets.team))
    return out.select("target_id", "capability_id", "name", "importance", "n_covering", "is_covered")


@query("SELECT target_id, req, person_id FROM gap_cover", "gap_cover")
def gap_cover(spark: SparkSession, sf: str) -> DataFrame:
    graph, targets = _prepared(spark, sf)
    return rec.gap_cover(targets.requirements, rec.team_capabilities(graph, targets.team))


@query("SELECT target_id, round(sum(importance), 6) AS importance FROM gaps WHERE NOT is_covered GROUP BY 1", "gaps")
def gap_importance(spark: SparkSession, sf: str) -> DataFrame:
    graph, targets = _prepared(spark, sf)
    gaps = rec.capability_gaps(targets.requirements, rec.team_capabilities(graph, targets.team))
    return rec.gap_importance(gaps).withColumn("importance", F.round("importance", 6))


@query("""SELECT target_id, person_id, n_caps, n_domains FROM candidates
QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY n_caps DESC, n_domains DESC, person_id) <= 50""", "candidates")
def candidates_by_matches(spark: SparkSession, sf: str) -> DataFrame:
    graph, targets = _prepared(spark, sf)
    return g.find_candidates(graph, targets.domains, targets.requirements, targets.team, settings.CANDIDATE_LIMIT).people


@query("""
SELECT target_id, person_id, count(*) FILTER (WHERE kind = 'capability') AS n_caps,
  count(*) FILTER (WHERE kind = 'domain') AS n_domains FROM (
  SELECT DISTINCT t.target_id, w.person_id, 'domain' AS kind, t.domain_id AS id FROM target_domains t
  JOIN (SELECT project_id, domain_id FROM project_domain UNION
        SELECT project_id, ancestor_id FROM project_domain JOIN closure USING (domain_id)) USING (domain_id)
  JOIN wrote w USING (project_id) UNION
  SELECT DISTINCT r.target_id, h.person_id, 'capability', r.capability_id FROM requirements r JOIN has_capability h USING (capability_id)) m
WHERE NOT EXISTS (SELECT 1 FROM team t WHERE t.target_id = m.target_id AND t.person_id = m.person_id)
GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY person_id) <= 200""",
       "target_domains", "project_domain", "closure", "wrote", "requirements", "has_capability", "team")
def candidates_id_order_expanded(spark: SparkSession, sf: str) -> DataFrame:
    graph, targets = _prepared(spark, sf)
    closure = g.ancestor_closure(graph.subdomain_of)
    return g.find_candidates(graph, targets.domains, targets.requirements, targets.team, 200, False, closure).people


@query("SELECT target_id, person_id, kind, id, text, project_id, year FROM evidence", "evidence")
def candidate_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return g.candidate_evidence(*_asked_evidence(spark, sf)).drop("ord")


@query("SELECT DISTINCT target_id, person_id, id FROM evidence", "evidence")
def evidence_ids(spark: SparkSession, sf: str) -> DataFrame:
    return g.candidate_evidence_ids(*_asked_evidence(spark, sf)).drop("ord")


@query("""
SELECT target_id, person_id, count(*) FILTER (WHERE kind = 'project') AS n_project, count(*) FILTER (WHERE kind = 'domain') AS n_domain,
count(*) FILTER (WHERE kind = 'capability') AS n_capability FROM evidence GROUP BY 1, 2""", "evidence")
def evidence_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return g.candidate_evidence_by_kind(*_asked_evidence(spark, sf))


@query(f"SELECT target_id, person_id, {_ROUNDED_FEATURES} FROM features", "features")
def candidate_features(spark: SparkSession, sf: str) -> DataFrame:
    features = _recommendation(spark, sf).features
    return features.select(*PAIR, *_rounded(features, FEATURES))


@query(f"""SELECT target_id, rank, person_id, total_score, {_ROUNDED_FEATURES} FROM ranked""", "ranked")
def recommend_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _recommendation(spark, sf).ranked
    return ranked.select("target_id", F.col("rank").cast("long").alias("rank"), "person_id", "total_score", *_rounded(ranked, FEATURES))


@query("""
SELECT target_id, person_id, """ + ", ".join(
    f"round(coalesce({n}, 0) * {w}::DOUBLE, 6) AS contrib_{n}" for n, w in settings.RANKING_WEIGHTS.items()) + " FROM ranked", "ranked")
def linear_score_contributions(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _recommendation(spark, sf).ranked
    return ranked.select(*PAIR, *[f"contrib_{n}" for n in FEATURES])


# -- leave-one-out ---------------------------------------------------------

# Every project with this many authors is asked for.
LOO_AUTHORS = 3
VIEWS.add("loo_members", "SELECT project_id AS target_id, person_id, pos FROM wrote", "wrote")
VIEWS.add("loo_held", f"""SELECT target_id, arg_min(person_id, (pos, person_id)) AS person_id FROM loo_members
GROUP BY 1 HAVING count(DISTINCT person_id) >= {LOO_AUTHORS}""", "loo_members")


@query("SELECT target_id, person_id FROM loo_held", "loo_held")
def held_out_authors(spark: SparkSession, sf: str) -> DataFrame:
    graph = collab.base_graph(spark, sf)
    return rec.held_out_split(graph.wrote, graph.projects, LOO_AUTHORS)[0]


def _leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    graph, rows = collab.staged_graph(spark, sf)
    keywords = stage(rows.select("project_id", F.col("p_brand").alias("keyword")).distinct(), "keywords")
    discard(rows)
    return rec.leave_one_out(graph, g.ancestor_closure(graph.subdomain_of), keywords, min_authors=LOO_AUTHORS)


# The same chain of views, asked for the held-out teams by domains and keywords.
_LOO = {
    "targets": ("SELECT target_id FROM loo_held", ("loo_held",)),
    "team": ("SELECT m.target_id, m.person_id FROM loo_members m JOIN loo_held h USING (target_id) WHERE m.person_id <> h.person_id", ("loo_members", "loo_held")),
    "requirements": ("SELECT '' AS target_id, '' AS capability_id, '' AS name, 0::DOUBLE AS importance WHERE false", ()),
}


def _loo_views():
    from kinweave.plans.sql import Views

    views = Views()
    views._bodies = {**VIEWS._bodies, **_LOO}
    return views


_LOO_DETAILS = """SELECT h.target_id, h.person_id AS held_out, rank, round(coalesce(1.0::DOUBLE / rank, 0), 4) AS rr
FROM loo_held h LEFT JOIN ranked r ON r.target_id = h.target_id AND r.person_id = h.person_id"""


@query()
def leave_one_out_eval(spark: SparkSession, sf: str) -> DataFrame:
    return _leave_one_out(spark, sf).withColumn("rank", F.col("rank").cast("long"))


@query()
def hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rec.hit_rates(_leave_one_out(spark, sf))


SQL["leave_one_out_eval"] = _loo_views().query(_LOO_DETAILS, "loo_held", "ranked")
SQL["hit_rates"] = _loo_views().query(f"""SELECT count(*) AS total_evaluated,
""" + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_{k}" for k in (1, 3, 5, 10)) + f""",
round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr FROM ({_LOO_DETAILS})""", "loo_held", "ranked")
