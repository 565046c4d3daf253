"""Check views of the record corpus, written straight from the documents table."""

from __future__ import annotations

from kinweave.plans.sql import Views

VIEWS = Views()
_add = VIEWS.add

_KEY = r"""trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"""

_add("docs", r"""
SELECT *, 'hal-' || substr(md5(text), 1, 12) AS hal_id, DATE '2000-01-01' + CAST(n_chars AS INTEGER) AS day,
  regexp_extract_all(text, '\p{Lu}\p{L}+ \p{Ll}+') AS names,
  100 + CAST(regexp_extract(source, '(\d+)', 1) AS BIGINT) AS lab,
  CAST(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS BIGINT) AS country
FROM documents""")
_add("listed", f"""
SELECT doc_id, hal_id, lang, source, name, pos, n, {_KEY.format('name')} AS key,
  CASE WHEN length(name) % 3 <> 0 THEN CAST(length(name) AS BIGINT) END AS person
FROM (SELECT doc_id, hal_id, lang, source, len(names) AS n, unnest(names) AS name,
  unnest(range(len(names))) AS pos FROM docs)""", "docs")
_add("given", """
SELECT doc_id, CASE lang WHEN 'fr' THEN (pos + n - 1) % n ELSE pos END AS pos,
  CASE WHEN length(name) % 2 = 0 AND NOT (lang = 'es' AND pos = n - 1) THEN key END AS id FROM listed""", "listed")
_add("single_names", """
SELECT doc_id, key, min(pos) AS pos FROM listed WHERE key <> '' GROUP BY 1, 2 HAVING count(*) = 1""", "listed")
_add("id_matches", """
SELECT g.doc_id, g.pos AS source_pos, s.pos AS target_pos, g.id FROM given g JOIN single_names s
ON s.doc_id = g.doc_id AND s.key = g.id WHERE g.id <> ''""", "given", "single_names")
_add("shifted", "SELECT DISTINCT doc_id FROM id_matches WHERE source_pos <> target_pos", "id_matches")
_add("aligned", """
SELECT doc_id, target_pos AS pos, min(id) AS id FROM id_matches WHERE doc_id IN (SELECT doc_id FROM shifted)
GROUP BY 1, 2 HAVING count(*) = 1 UNION ALL
SELECT doc_id, pos, id FROM given WHERE id <> '' AND doc_id NOT IN (SELECT doc_id FROM shifted)""",
     "id_matches", "shifted", "given")
_add("author_rows", """
SELECT l.doc_id, l.hal_id AS project, l.pos, l.name,
  coalesce(a.id, CASE WHEN l.person IS NOT NULL THEN 'person_' || l.person ELSE 'unknown_' || l.name END) AS id,
  l.person, split_part(l.name, ' ', 1) AS first, split_part(l.name, ' ', 2) AS last,
  CASE WHEN l.lang = 'en' THEN l.source || '.org' ELSE '' END AS email
FROM listed l LEFT JOIN aligned a ON a.doc_id = l.doc_id AND a.pos = l.pos""", "listed", "aligned")
_add("projects", r"""
SELECT hal_id AS "halId", arg_min(coalesce(nullif(split_part(text, chr(10), 1), ''), 'Untitled'), doc_id) AS title,
  arg_min(CASE WHEN lang = 'de' THEN '' ELSE text END, doc_id) AS abstract,
  arg_min(CASE WHEN source LIKE '%1' THEN '' WHEN lang = 'fr' THEN '[''ART'']' WHEN lang = 'en' THEN 'COMM' ELSE '' END, doc_id) AS "documentType",
  arg_min(CASE lang WHEN 'de' THEN 'de|xx' ELSE lang END, doc_id) AS language,
  arg_min(CASE lang WHEN 'fr' THEN strftime(day, '%Y') WHEN 'de' THEN strftime(day, '%Y-%m')
    WHEN 'es' THEN strftime(day, '%Y-%m-%dZ') ELSE strftime(day, '%Y-%m-%d') END, doc_id) AS "publicationDate",
  arg_min(CASE lang WHEN 'es' THEN -1 ELSE CAST(year(day) AS INTEGER) END, doc_id) AS year_or_minus,
  arg_min(CASE WHEN lang = 'en' THEN '10.1/' || doc_id ELSE '' END, doc_id) AS doi
FROM docs GROUP BY 1""", "docs")
_add("conferences", """
SELECT hal_id AS project, doc_id, 'Conf ' || source AS title, strftime(day, '%Y') || '-01-01' AS start_date, upper(lang) AS city,
  'conf_' || source || '_' || strftime(day, '%Y') || '-01-01_' || lang AS id
FROM docs WHERE lang IN ('en', 'fr')""", "docs")
_add("codes", """
SELECT doc_id, hal_id AS project, lang || '.' || source AS code, true AS main, lang, source FROM docs UNION ALL
SELECT doc_id, hal_id, lang, false, lang, source FROM docs""", "docs")
