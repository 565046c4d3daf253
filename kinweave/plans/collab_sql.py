"""Check views of the collaboration graph, independent of the Spark plans."""

from __future__ import annotations

from kinweave.plans.sql import Views

VIEWS = Views()
_add = VIEWS.add

_add("people", """
SELECT c_custkey, c_name AS full_name,
  CASE WHEN c_acctbal < 0 THEN 'unknown_' || c_name ELSE lower(replace(c_name, '#', '-')) END AS person_id
FROM customer""")
_add("facts", """
SELECT 'S' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS project_id,
  CAST(year(l_shipdate) AS INTEGER) AS year, person_id, l_orderkey * 100 + l_linenumber AS pos,
  lower(p_type) || '.' || lower(replace(p_brand, '#', '-')) AS leaf, lower(p_type) AS root,
  l_returnflag, p_name, p_brand, l_discount, replace(p_name, ' ', '_') AS capability_id,
  1::DOUBLE - l_discount AS confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN people ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey""", "people")
_add("wrote", "SELECT person_id, project_id, min(pos) AS pos FROM facts GROUP BY 1, 2", "facts")
_add("projects", "SELECT project_id, 'Shipment of ' || min(p_name) AS title, min(year) AS year FROM facts GROUP BY 1", "facts")
_add("project_domain", """
SELECT project_id, leaf AS domain_id FROM facts UNION
SELECT project_id, root FROM facts WHERE l_returnflag = 'R'""", "facts")
_add("domains", """
SELECT lower(p_type) AS domain_id, p_type AS name FROM part UNION
SELECT lower(p_type) || '.' || lower(replace(p_brand, '#', '-')), p_type || ' ' || p_brand FROM part""")
_add("subdomain_of", """
SELECT DISTINCT lower(p_type) || '.' || lower(replace(p_brand, '#', '-')) AS child_id, lower(p_type) AS parent_id FROM part""")
_add("closure", """
SELECT child_id AS domain_id, parent_id AS ancestor_id FROM subdomain_of UNION
SELECT c.domain_id, s.parent_id FROM closure c JOIN subdomain_of s ON s.child_id = c.ancestor_id""", "subdomain_of")
_add("ancestor_lists", "SELECT domain_id, list_sort(list(DISTINCT ancestor_id)) AS parent_ids FROM closure GROUP BY 1", "closure")
_add("evidences", "SELECT project_id, capability_id, max(confidence) AS confidence FROM facts GROUP BY 1, 2", "facts")
_add("evidence_rows", """
SELECT w.person_id, e.project_id, p.year, e.capability_id, e.confidence
FROM evidences e JOIN projects p USING (project_id) JOIN wrote w USING (project_id)""", "evidences", "projects", "wrote")
_add("aggregates", """
SELECT person_id, capability_id, count(DISTINCT project_id) AS publication_count, count(*) AS evidence_count,
  avg(coalesce(confidence, 0)) AS avg_confidence,
  count(DISTINCT CASE WHEN year >= 2001 - 5 THEN project_id END) AS recent_publication_count,
  min(year) AS first_seen_year, max(year) AS last_seen_year,
  least(1.0::DOUBLE, sum(pow(0.5::DOUBLE, greatest(0, 2001 - year) / 5.0::DOUBLE)) / count(*)) AS score
FROM evidence_rows WHERE NOT starts_with(person_id, 'unknown_') GROUP BY 1, 2""", "evidence_rows")
_add("has_capability", """
SELECT *, replace(capability_id, '_', ' ') AS name FROM aggregates WHERE evidence_count >= 2""", "aggregates")
_add("targets", """
SELECT project_id AS target_id FROM wrote GROUP BY 1 ORDER BY count(*) DESC, project_id LIMIT 10""", "wrote")
_add("target_domains", """
SELECT project_id AS target_id, domain_id FROM project_domain WHERE project_id IN (SELECT target_id FROM targets) UNION
SELECT project_id, ancestor_id FROM project_domain JOIN closure USING (domain_id)
WHERE project_id IN (SELECT target_id FROM targets)""", "project_domain", "closure", "targets")
_add("requirements", """
SELECT * FROM (SELECT project_id AS target_id, capability_id, p_name AS name, round(max(l_discount) * 10, 2) AS importance
FROM facts WHERE project_id IN (SELECT target_id FROM targets) GROUP BY 1, 2, 3) WHERE importance > 0""", "facts", "targets")
_add("team", """
SELECT project_id AS target_id, person_id FROM wrote WHERE project_id IN (SELECT target_id FROM targets)""", "wrote", "targets")
_add("keywords", """
SELECT DISTINCT project_id AS target_id, p_brand AS keyword FROM facts
WHERE project_id IN (SELECT target_id FROM targets)""", "facts", "targets")
_add("team_caps", """
SELECT DISTINCT t.target_id, t.person_id, h.capability_id, h.name FROM team t JOIN has_capability h USING (person_id)""",
     "team", "has_capability")
_add("gap_cover", """
SELECT DISTINCT r.target_id, r.capability_id AS req, c.person_id FROM requirements r JOIN team_caps c
ON c.target_id = r.target_id AND (c.capability_id = r.capability_id OR lower(trim(c.name)) = lower(trim(r.name)))""",
     "requirements", "team_caps")
_add("gaps", """
SELECT r.*, coalesce(n, 0) AS n_covering, coalesce(n, 0) > 0 AS is_covered FROM requirements r
LEFT JOIN (SELECT target_id, req, count(*) AS n FROM gap_cover GROUP BY 1, 2) g
ON g.target_id = r.target_id AND g.req = r.capability_id""", "requirements", "gap_cover")
_add("matches", """
SELECT * FROM (
SELECT DISTINCT t.target_id, w.person_id, 'domain' AS kind, t.domain_id AS id FROM target_domains t
JOIN project_domain USING (domain_id) JOIN wrote w USING (project_id) UNION
SELECT DISTINCT r.target_id, h.person_id, 'capability', r.capability_id FROM requirements r JOIN has_capability h USING (capability_id)
) m WHERE NOT EXISTS (SELECT 1 FROM team t WHERE t.target_id = m.target_id AND t.person_id = m.person_id)""",
     "target_domains", "project_domain", "wrote", "requirements", "has_capability", "team")
_add("candidates", """
SELECT target_id, person_id, count(*) FILTER (WHERE kind = 'capability') AS n_caps,
  count(*) FILTER (WHERE kind = 'domain') AS n_domains FROM matches GROUP BY 1, 2""", "matches")
_add("evidence", """
SELECT c.target_id, c.person_id, 'project' AS kind, p.project_id AS id, p.title AS text, p.project_id, p.year
FROM candidates c JOIN wrote w USING (person_id) JOIN projects p USING (project_id)
UNION ALL
SELECT target_id, person_id, 'domain', domain_id, name, project_id, year FROM (
  SELECT c.target_id, c.person_id, t.domain_id, min(p.project_id) AS project_id FROM candidates c
  JOIN wrote w USING (person_id) JOIN projects p USING (project_id) JOIN project_domain d USING (project_id)
  JOIN target_domains t ON t.target_id = c.target_id AND t.domain_id = d.domain_id GROUP BY 1, 2, 3)
  JOIN projects USING (project_id) JOIN domains USING (domain_id)
UNION ALL
SELECT DISTINCT c.target_id, c.person_id, 'capability', h.capability_id, h.name, NULL, NULL FROM candidates c
JOIN has_capability h USING (person_id)
JOIN requirements r ON r.target_id = c.target_id AND r.capability_id = h.capability_id""",
     "candidates", "wrote", "projects", "project_domain", "target_domains", "domains", "has_capability", "requirements")
_add("hop1", """
SELECT DISTINCT t.target_id, b.person_id FROM team t JOIN wrote a USING (person_id) JOIN wrote b ON a.project_id = b.project_id
WHERE NOT EXISTS (SELECT 1 FROM team x WHERE x.target_id = t.target_id AND x.person_id = b.person_id)""", "team", "wrote")
_add("hop2", """
SELECT DISTINCT t.target_id, b.person_id FROM hop1 t JOIN wrote a USING (person_id) JOIN wrote b ON a.project_id = b.project_id
WHERE NOT EXISTS (SELECT 1 FROM team x WHERE x.target_id = t.target_id AND x.person_id = b.person_id)
AND NOT EXISTS (SELECT 1 FROM hop1 x WHERE x.target_id = t.target_id AND x.person_id = b.person_id)""", "hop1", "team", "wrote")
_add("hop3", """
SELECT DISTINCT t.target_id, b.person_id FROM hop2 t JOIN wrote a USING (person_id) JOIN wrote b ON a.project_id = b.project_id
WHERE NOT EXISTS (SELECT 1 FROM team x WHERE x.target_id = t.target_id AND x.person_id = b.person_id)
AND NOT EXISTS (SELECT 1 FROM hop1 x WHERE x.target_id = t.target_id AND x.person_id = b.person_id)
AND NOT EXISTS (SELECT 1 FROM hop2 x WHERE x.target_id = t.target_id AND x.person_id = b.person_id)""",
     "hop1", "hop2", "team", "wrote")
_add("distance", """
SELECT target_id, person_id, 0 AS hops FROM team UNION ALL SELECT *, 1 FROM hop1 UNION ALL
SELECT *, 2 FROM hop2 UNION ALL SELECT *, 3 FROM hop3""", "team", "hop1", "hop2", "hop3")
_add("abilities", """
SELECT c.target_id, c.person_id, h.capability_id, h.last_seen_year FROM candidates c JOIN has_capability h USING (person_id)""",
     "candidates", "has_capability")
_add("wanted", """
SELECT target_id, domain_id AS feature FROM target_domains UNION
SELECT target_id, capability_id FROM requirements UNION SELECT target_id, keyword FROM keywords""",
     "target_domains", "requirements", "keywords")
_add("shown", """
SELECT m.target_id, m.person_id, m.id AS feature FROM matches m JOIN candidates USING (target_id, person_id)
WHERE kind = 'domain' UNION
SELECT target_id, person_id, capability_id FROM abilities UNION
SELECT target_id, person_id, id FROM evidence WHERE kind <> 'project'""", "matches", "candidates", "abilities", "evidence")
_add("features", """
SELECT c.target_id, c.person_id,
  coalesce((SELECT sum(g.importance) FROM gaps g WHERE g.target_id = c.target_id AND NOT g.is_covered AND EXISTS (
     SELECT 1 FROM abilities a WHERE a.target_id = c.target_id AND a.person_id = c.person_id
     AND (a.capability_id = g.capability_id OR lower(a.capability_id) = lower(trim(g.name)))))
   / nullif((SELECT sum(importance) FROM gaps g WHERE g.target_id = c.target_id AND NOT g.is_covered), 0), 0) AS gap_match,
  n_domains::DOUBLE / (SELECT count(*) FROM target_domains t WHERE t.target_id = c.target_id) AS domain_relevance,
  CASE WHEN n_req = 0 THEN 0::DOUBLE ELSE n_able_req::DOUBLE / n_req END AS semantic,
  CASE WHEN n_req > 0 THEN CASE WHEN n_able_req = 0 THEN 0::DOUBLE ELSE n_able_req_new::DOUBLE / n_able_req END
       WHEN n_able = 0 THEN 0::DOUBLE ELSE n_able_new::DOUBLE / n_able END AS complementarity,
  n_common / (n_common + 0.5::DOUBLE * (n_wanted - n_common) + 0.5::DOUBLE * (n_shown - n_common)) AS project_similarity,
  CASE WHEN d.hops BETWEEN 1 AND 3 THEN 1::DOUBLE - (d.hops - 1) / 3.0::DOUBLE ELSE 0::DOUBLE END AS graph,
  CASE WHEN yr IS NULL THEN 0::DOUBLE ELSE pow(2.0::DOUBLE, -greatest(0, 2024 - yr) / 3.0::DOUBLE) END AS recency
FROM candidates c
LEFT JOIN (SELECT target_id, count(DISTINCT capability_id) AS n_req FROM requirements GROUP BY 1) q USING (target_id)
LEFT JOIN (SELECT a.target_id, a.person_id, count(*) AS n_able, count(r.capability_id) AS n_able_req,
    count(*) FILTER (WHERE t.capability_id IS NULL) AS n_able_new,
    count(r.capability_id) FILTER (WHERE t.capability_id IS NULL) AS n_able_req_new
  FROM abilities a LEFT JOIN requirements r USING (target_id, capability_id)
  LEFT JOIN (SELECT DISTINCT target_id, capability_id FROM team_caps) t USING (target_id, capability_id) GROUP BY 1, 2) p
  USING (target_id, person_id)
LEFT JOIN (SELECT target_id, count(*) AS n_wanted FROM wanted GROUP BY 1) w USING (target_id)
LEFT JOIN (SELECT s.target_id, s.person_id, count(*) AS n_shown, count(w.feature) AS n_common FROM shown s
  LEFT JOIN wanted w USING (target_id, feature) GROUP BY 1, 2) s USING (target_id, person_id)
LEFT JOIN distance d USING (target_id, person_id)
LEFT JOIN (SELECT target_id, person_id, max(y) AS yr FROM (
  SELECT target_id, person_id, year AS y FROM evidence UNION ALL
  SELECT target_id, person_id, last_seen_year FROM abilities) GROUP BY 1, 2) y USING (target_id, person_id)""",
     "candidates", "gaps", "abilities", "target_domains", "requirements", "team_caps", "wanted", "shown", "distance", "evidence")
_add("scored", """
SELECT *, round(0.30::DOUBLE * coalesce(gap_match, 0) + 0.15::DOUBLE * domain_relevance + 0.15::DOUBLE * coalesce(semantic, 0)
  + 0.15::DOUBLE * coalesce(complementarity, 0) + 0.10::DOUBLE * project_similarity + 0.10::DOUBLE * graph
  + 0.05::DOUBLE * recency, 6) AS total_score FROM features""", "features")
_add("ranked", """
SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY total_score DESC, person_id) AS rank FROM scored
QUALIFY rank <= 10""", "scored")
