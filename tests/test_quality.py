import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import compare, hierarchy, integrity, quality, report, validation
from kinweave.operators.canonical import canonical_tables
from kinweave.session import stage_all

GOOD = {
    "halId_s": "h", "title_s": "T", "abstract_s": "A", "keyword_s": ["k"], "doiId_s": "d", "authFullName_s": ["A B"],
    "primaryDomain_s": "x", "docType_s": "ART", "publicationDate_s": "2026-01-03", "language_s": "en", "publicationDateY_i": 2026,
}


def codes(df):
    return sorted((r["doc_ord"], r["code"], r["field"]) for r in df.collect())


def test_clean_record_has_no_issue(records):
    assert codes(validation.document_issues(records(GOOD))) == []


def test_issue_codes(records):
    bad = {
        "halId_s": " ", "title_s": [""], "keyword_s": [], "doiId_s": "", "docType_s": "", "publicationDate_s": "bad-date",
        "producedDate_s": "2026-02", "language_s": ["xx", "fr"], "publicationDateY_i": "n/a", "authFullName_s": ["A", "B"],
        "authIdHal_s": ["a"], "authIdPerson_i": [], "structName_s": [], "structType_s": ["x"],
    }
    expected = [
        ("malformed_date", "producedDate_s"), ("malformed_date", "publicationDate_s"), ("malformed_language", "language_s"),
        ("malformed_publication_year", "publicationDateY_i"), ("missing_abstract", "abstract_s"), ("missing_doc_type", "docType_s"),
        ("missing_doi", "doiId_s"), ("missing_domains", "primaryDomain_s"), ("missing_hal_id", "halId_s"),
        ("missing_keywords", "keyword_s"), ("missing_title", "title_s"),
        ("parallel_array_length_mismatch", "authIdHal_s"), ("parallel_array_length_mismatch", "structType_s"),
    ]
    assert [c[1:] for c in codes(validation.document_issues(records(bad)))] == expected


def test_repeats_titles_and_odd_documents(records):
    found = codes(validation.document_issues(records(GOOD, {**GOOD, "title_s": ["a", "b"]}, "[1]", GOOD)))
    assert found == [(1, "duplicate_hal_id", "halId_s"), (1, "multi_title_value", "title_s"), (2, "non_object_document", "docs"),
                     (3, "duplicate_hal_id", "halId_s")]


def test_envelopes(spark):
    pages = [(0, json.dumps({"response": {"numFound": 1, "docs": [GOOD, GOOD]}}), 200, 1, 0), (1, "[]", 200, 1, 0), (2, '{"response": 3}', 500, 1, 0),
             (3, '{"response": {"docs": null}}', 200, 1, 0), (4, '{"response": {"docs": {}}}', 200, 1, 0), (5, '{"response": {"numFound": 9, "docs": []}}', 200, 1, 0)]
    df = spark.createDataFrame(pages, "page_id int, value string, status_code int, rows int, start int")
    found = sorted((r["page_id"], r["code"]) for r in validation.payload_issues(df).collect())
    assert found == [(0, "page_size_exceeded"), (0, "pagination_incomplete"), (0, "pagination_overflow"), (1, "invalid_response_root"),
                     (2, "http_error"), (2, "invalid_response_payload"), (3, "missing_docs"), (4, "invalid_docs_type")]
    repeats = validation.duplicate_records(validation.page_records(df)).collect()
    assert [(r["doc_ord"]["page_id"], r["doc_ord"]["pos"]) for r in repeats] == [(0, 1)]
    assert [i["code"] for i in validation.size_issues(3, 2, 2)] == ["pagination_overflow", "page_size_exceeded"]


def test_hierarchy_faults(spark):
    nodes = [(0, "a", "A", None), (1, "a.b", "B", None), (2, "a.b.c", "C", ""), (3, "a.b.c.d", "D", " "), (4, "x", None, None), (5, "y", " ", None),
             (6, "x", "X", None), (7, "lone", "L", None), (8, " ", "N", None), (9, "e..f", "E", None)]
    edges = [(0, "a.b", "a"), (1, "a.b.c", "a.b"), (2, "a.b.c.d", "a.b.c"), (3, "x", "y"), (4, "y", "x"), (5, "a.b", "a"), (6, None, "a"), (7, "z.z", "z"), (8, "y", "y")]
    domains = spark.createDataFrame(nodes, "ord int, id string, name string, name_fr string")
    links = spark.createDataFrame(edges, "ord int, child_id string, parent_id string")
    used = spark.createDataFrame([("a",), ("ghost",), ("e..f",)], "domain_id string")
    checks = hierarchy.all_checks(domains, links, used)
    rows = {n: df.collect() for n, df in checks.items()}
    assert [tuple(r) for r in rows["cycles"]] == [("x", 2, ["x", "y", "x"])]
    assert [r["domain_id"] for r in rows["orphan_domains"]] == ["lone"]
    assert {(r["child_id"], r["reason"]) for r in rows["missing_hierarchy_endpoints"]} == {(None, "blank"), ("z.z", "absent")}
    assert {(r["child_id"], r["parent_id"]) for r in rows["dotted_prefix_parent_rules"]} == {("x", "y"), ("y", "x"), ("y", "y")}
    assert [(r["child_id"], r["n"]) for r in rows["duplicate_hierarchy_edges"]] == [("a.b", 2)]
    assert [(r["domain_id"], r["levels"]) for r in rows["maximum_depth"]] == [("a.b.c.d", 4)]
    assert {(r["id"], r["reason"]) for r in rows["malformed_domain_ids"]} == {("", "blank"), ("e..f", "malformed")}
    assert {(r["domain_id"], r["language"]) for r in rows["malformed_domain_names"]} == {("x", "name"), ("y", "name"), ("a.b.c.d", "name_fr")}
    assert [tuple(r) for r in rows["duplicate_domain_ids"]] == [("x", 2)]
    assert [r["domain_id"] for r in rows["unknown_project_domain_associations"]] == ["ghost"]
    summary = {r["name"]: r["finding_count"] for r in hierarchy.summary(checks).collect()}
    assert summary["cycles"] == 1 and len(summary) == 10
    with pytest.raises(ValueError):
        hierarchy.excessive_depth(domains, 0)


def test_cyclic_domain_counts_as_root(spark):
    domains = spark.createDataFrame([(i, c, c, None) for i, c in enumerate("abcd")], "ord int, id string, name string, name_fr string")
    edges = spark.createDataFrame([(0, "a", "b"), (1, "b", "a"), (2, "c", "a"), (3, "d", "c")], "ord int, child_id string, parent_id string")
    pairs = hierarchy.inner_edges(domains, edges)
    levels = {r["domain_id"]: r["levels"] for r in hierarchy.domain_levels(domains, pairs, hierarchy.cyclic_components(pairs)).collect()}
    assert levels == {"a": 1, "b": 1, "c": 2, "d": 3}


def _reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        at = todo.pop()
        for parent, child in edges:
            if parent == at and child not in seen:
                seen.add(child)
                todo.append(child)
    return seen


def _first_cycle(edges, root):
    """Shortest closed walk from ``root`` from parent to child, first in order among those of its length."""
    walks = [[root]]
    while True:
        walks = [w + [c] for w in walks for c in sorted(c for p, c in edges if p == w[-1]) if c not in w[1:]]
        closed = sorted(w for w in walks if w[-1] == root)
        if closed:
            return closed[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_cycles_and_levels_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(26)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(30)} | {("n1", "n1"), ("n0", "n2"), ("n2", "n3"), ("n3", "n0"), ("n3", "m"), ("m", "w")}
    names += ["m", "w"]
    reach = {n: _reach(edges, n) for n in names}
    members = {n: min(x for x in reach[n] if n in reach[x]) for n in names if n in reach[n]}
    domains = spark.createDataFrame([(i, n, n, None) for i, n in enumerate(names)], "ord int, id string, name string, name_fr string")
    pairs = spark.createDataFrame([(c, p) for p, c in edges], "child_id string, parent_id string")
    components = hierarchy.cyclic_components(pairs)
    assert {r["domain_id"]: r["component_id"] for r in components.collect()} == members
    found = {r["component_id"]: (r["size"], r["cycle"]) for r in hierarchy.cycles(pairs, components).collect()}
    roots = set(members.values())
    assert found == {c: (sum(m == c for m in members.values()), _first_cycle({(p, x) for p, x in edges if members.get(p) == c == members.get(x)}, c)) for c in roots}

    def level(n):
        return 1 if n in members else 1 + max((level(p) for p, c in edges if c == n), default=0)

    assert {r["domain_id"]: r["levels"] for r in hierarchy.domain_levels(domains, pairs, components).collect()} == {n: level(n) for n in names}


def test_taxonomy_without_cycles(spark):
    pairs = spark.createDataFrame([("b", "a"), ("c", "b")], "child_id string, parent_id string")
    components = hierarchy.cyclic_components(pairs)
    assert components.collect() == [] and hierarchy.cycles(pairs, components).collect() == []


@pytest.fixture
def graph_tables(spark):
    return {
        "projects": spark.createDataFrame([("p",), ("q",), ("q",)], "halId string"),
        "authors": spark.createDataFrame([("a", "A"), ("unknown_x", "X")], "halId string, fullName string"),
        "conferences": spark.createDataFrame([("c",)], "conferenceId string"),
        "organizations": spark.createDataFrame([(1, "O", "lab"), (2, " ", "lab"), (3, "P", None)], "halId long, name string, type string"),
        "research_domains": spark.createDataFrame([("d",), ("e",), ("f",)], "id string"),
        "project_authors": spark.createDataFrame([("p", "a"), ("p", "a")], "projectHalId string, authorHalId string"),
        "project_conferences": spark.createDataFrame([("p", "c")], "projectHalId string, conferenceId string"),
        "project_organizations": spark.createDataFrame([("p", 1)], "projectHalId string, organizationHalId long"),
        "organization_relationships": spark.createDataFrame([(2, 1)], "sourceId long, targetId long"),
        "project_research_domains": spark.createDataFrame([("p", "d")], "projectHalId string, domainId string"),
        "research_domain_hierarchy": spark.createDataFrame([("d", "e")], "childId string, parentId string"),
    }


def test_integrity_checks(graph_tables):
    rows = {r["name"]: r["finding_count"] for r in integrity.summary(graph_tables).collect()}
    assert rows == {
        "unique_id_constraints": 1, "duplicate_ids": 1, "projects_without_authors": 2, "projects_without_domains": 2,
        "orphan_research_domains": 1, "orphan_organizations": 1, "bare_organizations": 2, "relationship_multiplicity": 1, "unknown_authors": 1,
    }
    totals = integrity.totals(integrity.summary(graph_tables)).first()
    assert (totals["check_count"], totals["preventive_check_count"], totals["finding_count"]) == (9, 1, 12)


def test_comparison(spark):
    schema = "halId string, title string, keywords array<string>"
    expected = spark.createDataFrame([("a", "A", ["k"]), ("b", "B", []), ("c", None, None), ("d", "D", [])], schema)
    actual = spark.createDataFrame([("a", "A", ["x"]), ("b", "B", []), ("b", "B", []), ("c", None, None)], schema)
    rows = compare.compare_entities("projects", expected, actual, "halId", ["title", "keywords"])
    assert sorted((r["id"], r["code"], r["field"] or "") for r in rows.collect()) == [
        ("a", "field_mismatch", "keywords"), ("b", "duplicate_node", ""), ("d", "missing_node", "")]
    pair = "s string, t string"
    left, right = spark.createDataFrame([("a", "x"), ("b", "y")], pair), spark.createDataFrame([("b", "y"), ("b", "y"), ("c", "z")], pair)
    rows = compare.compare_relations("r", left, right, "s", "t")
    assert sorted((r["source"], r["code"]) for r in rows.collect()) == [("a", "missing"), ("b", "duplicate"), ("c", "unexpected")]


def test_store_comparison(spark, records, tmp_path):
    docs = records({**GOOD, "authIdHal_s": ["a-b"], "domainAllCode_s": ["x", "x.y"]}, {**GOOD, "halId_s": "h2"}, GOOD)
    expected = stage_all(canonical_tables(docs))
    same = compare.comparison_report(compare.compare_tables(expected, expected), quality.duplicate_ids(docs))
    assert (same["summary"]["errors"], same["summary"]["warnings"]) == (0, 1)
    assert same["source_duplicates"]["duplicate_project_record_count"] == 1 and len(same["cause_hypotheses"]) == 1
    projects, edges = expected["projects"], expected["project_authors"]
    store = {**expected, "project_authors": edges.where("projectHalId <> 'h2'"), "authors": expected["authors"].limit(0),
             "projects": projects.withColumn("doi", F.when(F.col("halId") == "h", "other").otherwise(F.col("doi"))).union(projects.where("halId = 'h2'")).union(
                 projects.where("halId = 'h2'").withColumn("halId", F.lit("stranger")))}
    found = compare.compare_tables(expected, store, 7)
    made = compare.comparison_report(found, quality.duplicate_ids(docs))
    rows = found.entities.where("table = 'projects'").collect()
    assert sorted((r["id"], r["code"], r["field"], r["actual"]) for r in rows if r["code"] == "field_mismatch") == [("h", "field_mismatch", "doi", '{"v":"other"}')]
    assert [(r["id"], r["actual"]) for r in rows if r["code"] == "duplicate_node"] == [("h2", "2")]
    assert made["entities"]["projects"] == {"expected_count": 2, "matched_count": 2, "missing": 0, "duplicate": 1, "mismatched": 1, "unexpected": 0}
    assert made["relationships"]["project_authors"] == {
        "expected_count": edges.count(), "actual_count": edges.where("projectHalId <> 'h2'").count(), "missing": 1, "duplicate": 0, "mismatched": 0, "unexpected": 0}
    n = expected["authors"].count()
    assert made["summary"]["error_categories"] == {"missing_node": n, "duplicate_node": 1, "field_mismatch": 1, "relationship_mismatch": 1}
    assert made["summary"]["errors"] == n + 3 and len(made["cause_hypotheses"]) == 5
    path = compare.write_comparison(made, found, str(tmp_path / "r" / "c.json"), str(tmp_path / "lists"))
    assert json.loads(path.read_text())["summary"] == made["summary"]
    assert spark.read.parquet(str(tmp_path / "lists/entities")).count() == found.entities.count()


def test_equal_buckets_are_not_joined(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit(None).cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    changed = rows.withColumn("a", F.when(F.col("k") == "17", "x")).withColumn("b", F.when(F.col("k") == "18", None).otherwise(F.col("b")))
    assert compare.differing_buckets(rows, rows.repartition(7), ["k"], ["a", "b"]).where("differs").count() == 0
    assert compare.differing_buckets(rows, changed, ["k"], ["a", "b"]).where("differs").count() == 2
    doubled = rows.union(rows.where("k = '3'")).union(rows.where("k = '3'"))
    assert compare.differing_buckets(rows, doubled, ["k"], ["a", "b"]).where("differs").count() == 1


def test_commands_check_and_compare(spark, tmp_path, capsys):
    from kinweave import cli

    path, tables = tmp_path / "records.jsonl", str(tmp_path / "tables")
    path.write_text("\n".join(json.dumps(d) for d in (GOOD, {**GOOD, "halId_s": "h2"})), encoding="utf-8")
    assert cli.main(["ingest", "--snapshot", str(path), "--tables", tables]) == 0
    capsys.readouterr()
    cli.main(["integrity", "--tables", tables])
    assert '"name": "duplicate_ids"' in capsys.readouterr().out
    cli.main(["hierarchy", "--tables", tables])
    assert {r["name"]: r["status"] for r in json.loads(capsys.readouterr().out)}["cycles"] == "pass"
    cli.main(["compare", "--snapshot", str(path), "--tables", tables, "--output", str(tmp_path / "c.json")])
    assert json.loads((tmp_path / "c.json").read_text())["summary"]["errors"] == 0
    cli.main(["report", "--snapshot", str(path), "--tables", tables, "--output", str(tmp_path / "out")])
    made = json.loads(next((tmp_path / "out").glob("*.json")).read_text())
    assert [made[k]["status"] for k in ("integrity", "hierarchy", "comparison")] == ["completed"] * 3
    assert not any("not run" in r for r in made["open_risks"])


def test_report(records, tmp_path):
    from kinweave.sources.sinks import write_report

    docs = records(GOOD, {**GOOD, "authFullName_s": ["A B", "C D"], "authIdHal_s": ["a-b"]}, {"docid": 7, "authFullName_s": "A  b", "authIdPerson_i": [3]})
    made = report.build_report(docs, {"numFound": 5, "fetched_count": 3}, report_date=datetime.date(2026, 1, 2))
    part = made["records"]
    assert part["counts"] == {"projects": 2, "authors": 4, "research_domains": 1}
    assert part["missingness"]["doi"] == {"missing_count": 1, "missing_percent": 33.33}
    assert part["duplicate_record_count"] == 1 and part["pagination"]["complete"] is False
    assert part["author_identity"]["homonym_collision_group_count"] == 1
    assert part["author_array_alignment"]["mismatched_record_count"] == 1
    assert any("3 of 5" in r for r in made["open_risks"])
    paths = write_report(made, tmp_path)
    assert paths["json"].name == "data_quality_2026-01-02.json" and "## Open risks" in paths["markdown"].read_text()
    with pytest.raises(ValueError):
        write_report({**made, "report_date": "x"}, tmp_path)


def test_homonyms_need_two_real_identifiers(records):
    docs = records({"authFullName_s": ["A B"], "authIdHal_s": ["a-b"]}, {"authFullName_s": ["a  B"], "authIdPerson_i": [3]}, {"authFullName_s": ["C D"]})
    assert sorted(tuple(r) for r in quality.homonyms(docs).collect()) == [("a b", "a-b"), ("a b", "person_3")]


def test_homonyms_of_letters_that_fold_to_two(spark, tmp_path):
    """The query tells names apart as its SQL does; the operator's own key takes a sharp s for two letters."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(1, "Weißer fuß.", "en", "s1", 11), (2, "Weißer fuß.", "es", "s2", 11), (3, "Weisser fuss.", "en", "s1", 13), (4, "Weisser fuss.", "es", "s2", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in entry.queries()["quality_homonyms"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["quality_homonyms"]).fetchall())
    assert got == want and {name for name, _ in got} == {"weißer fuß"}
