import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from kinweave import cli, settings
from kinweave.operators.canonical import canonical_tables
from kinweave.operators.capability_pipeline import extract_to_tables
from kinweave.operators.upsert import with_bare_endpoints
from kinweave.schemas import CANONICAL_TABLES
from kinweave.sources import nested_graph, paged_api, records, sinks
from kinweave.streaming import ingest

DOCS = [{"halId_s": f"h{i}", "title_s": [f"T {i}"], "authFullName_s": ["Ada Byron", f"P {i}"], "domainAllCode_s": ["x", "x.y"],
         "level0_domain_s": ["x"], "level1_domain_s": ["x.y"]} for i in range(5)]


def stub_api():
    """A source whose pages come from memory; local, so that it travels to the workers by value."""

    class StubApi(paged_api.PublicationApi):
        @classmethod
        def name(cls):
            return "stub_api"

        @staticmethod
        def fetch(url, params):
            start, rows = int(params["start"]), int(params["rows"])
            docs = [{"halId_s": f"h{i}", "authFullName_s": ["Zoé B", "C D"], "authIdHal_s": ["zoe-b"]} for i in range(5)]
            return {"response": {"numFound": 5, "docs": docs[start:start + rows]}}

    return StubApi


def write(tmp_path, lines, name="records.jsonl"):
    path = tmp_path / name
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_pages_and_queries():
    assert paged_api.page_starts(5, 2) == [(0, 2), (2, 2), (4, 1)]
    assert paged_api.page_starts(5, 2, 3) == [(0, 2), (2, 1)]
    assert paged_api.build_query(hal_id="h", title="t", doc_type="ART") == "(halId_s:h) AND docType_s:ART"
    assert paged_api.build_query(title="a b") == 'title_t:"a b"'
    with pytest.raises(ValueError):
        paged_api.unwrap({"response": {}})


def test_nested_json_becomes_graph_tables(spark, tmp_path):
    projects = [
        {"project_id": "p1", "title": "Old", "members": [{"person_id": "zoe"}]},
        {"project_id": "p2", "keywords": ["k"], "year": 2024, "members": [{"person_id": "ada", "full_name": "Ada"}, {"full_name": "no id"}, {"person_id": "ada"}],
         "domains": [{"domain_id": "x.y", "name": "XY", "parent_ids": ["x"]}, {"domain_id": "x"}]},
        {"project_id": "p1", "title": "New", "members": [{"person_id": "unknown_q"}, {"person_id": "ada", "full_name": "Ada B"}], "domains": [{"domain_id": "x", "name": "X"}]},
    ]
    able = [{"person_id": "ada", "capability_id": "sql", "name": "SQL", "last_seen_year": 2020}, {"person_id": "eve", "capability_id": "ml", "name": "ML", "kind": "TOOL"},
            {"person_id": "bob", "capability_id": "ml"}]
    (tmp_path / "p.json").write_text(json.dumps(projects))
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, able)))
    graph = nested_graph.nested_graph(nested_graph.read_documents(spark, str(tmp_path / "p.json")), nested_graph.read_documents(spark, str(tmp_path / "c.jsonl"), lines=True))
    rows = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=repr)
    assert rows(graph.projects, "project_id", "title", "keywords", "year") == [("p1", "New", [], None), ("p2", "", ["k"], 2024)]
    assert rows(graph.authors, "person_id", "full_name") == [("ada", "Ada B"), ("bob", "bob"), ("eve", "ML"), ("unknown_q", "")]
    assert rows(graph.wrote, "person_id", "project_id", "pos") == [("ada", "p1", 1), ("ada", "p2", 0), ("unknown_q", "p1", 0)]
    assert rows(graph.project_domain, "project_id", "domain_id") == [("p1", "x"), ("p2", "x"), ("p2", "x.y")]
    assert rows(graph.domains, "domain_id", "name") == [("x", "X"), ("x.y", "XY")] and rows(graph.subdomain_of, "child_id", "parent_id") == [("x.y", "x")]
    assert rows(graph.has_capability, "person_id", "capability_id", "kind", "publication_count", "last_seen_year") == [
        ("ada", "sql", "UNKNOWN", 1, 2020), ("bob", "ml", "UNKNOWN", 1, None), ("eve", "ml", "TOOL", 1, None)]
    none = nested_graph.read_documents(spark, str(tmp_path / "absent.json"))
    assert none.count() == 0 and nested_graph.nested_graph(none, none).authors.count() == 0


def test_harvest_goes_on_where_it_failed(spark, tmp_path):
    log, state = tmp_path / "log", tmp_path / "state"
    log.mkdir()
    state.mkdir()
    marks = (str(log), str(state))

    class Flaky(paged_api.PublicationPages):
        @classmethod
        def name(cls):
            return "flaky_pages"

        @staticmethod
        def fetch(url, params):
            import os
            import uuid

            start, rows = int(params["start"]), int(params["rows"])
            found = 7 if os.path.exists(f"{marks[1]}/grown") else 5
            if rows:
                open(f"{marks[0]}/{start}-{uuid.uuid4().hex}", "w").close()
            if start == 2 and rows and not os.path.exists(f"{marks[1]}/tried"):
                open(f"{marks[1]}/tried", "w").close()
                raise OSError("cut off")
            return {"response": {"numFound": found, "docs": [{"halId_s": f"h{i}"} for i in range(found)][start:start + rows]}}

    folder = str(tmp_path / "pages")
    ask = lambda **more: paged_api.harvest(spark, "flaky:", folder, Flaky, 2, rowsperpage="2", **more)
    fetched = lambda: sorted(f.split("-")[0] for f in os.listdir(log))
    with pytest.raises(paged_api.HarvestIncomplete, match="1 of 3 pages"):
        ask()
    assert fetched() == ["0", "2", "4"]
    rows = ask().orderBy("doc_ord").collect()
    assert [r["doc_ord"] for r in rows] == [0, 1, 2, 3, 4] and json.loads(rows[4]["value"]) == {"halId_s": "h4"}
    assert fetched() == ["0", "2", "2", "4"]
    assert ask().count() == 5 and len(fetched()) == 4
    (state / "grown").touch()
    assert [r["doc_ord"] for r in ask().orderBy("doc_ord").collect()] == list(range(7)) and fetched() == ["0", "2", "2", "4", "4", "6"]
    with pytest.raises(ValueError, match="another request"):
        ask(sort="x")


def test_api_scan_and_snapshot(spark, tmp_path):
    lines = paged_api.read_publications(spark, "stub:", stub_api(), rowsperpage="2", sort="halId_s asc")
    assert lines.rdd.getNumPartitions() == 3 and lines.count() == 5
    folder = sinks.write_snapshot(lines, str(tmp_path), 5, sort="halId_s asc", timestamp="20260101T000000Z")
    manifest = records.read_manifest(spark, f"{folder}/manifest")
    assert (manifest["numFound"], manifest["fetched_count"], manifest["sort"]) == (5, 5, "halId_s asc")
    first = json.loads(spark.read.text(f"{folder}/records").orderBy("value").first()["value"])
    assert first["authIdHal_s"] == ["zoe-b", 0] and first["authFullName_s"] == ["Zoé B", "C D"] and first["halId_s"] == "h0"
    assert records.check_manifest(manifest) == 5


def test_short_page_raises(spark):
    class Short(stub_api()):
        @staticmethod
        def fetch(url, params):
            docs = [] if params["rows"] == "0" else [{"halId_s": "h0"}]
            return {"response": {"numFound": 4, "docs": docs}}

    assert paged_api.count_publications("stub:", Short) == 4
    with pytest.raises(Exception, match="holds 1 of 2 records"):
        paged_api.read_publications(spark, "stub:", Short, rowsperpage="2").collect()


def test_snapshot_files_follow_the_order_and_pad_every_author_field(spark, tmp_path):
    docs = [{"halId_s": f"h{i:04d}", "authFullName_s": ["A", "B"], "authQuality_s": "aut", "authIdPerson_i": [7, None, 9], "authNone_s": None} for i in range(400)]
    lines = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_ord long, value string").repartition(5)
    folder = sinks.write_snapshot(lines, str(tmp_path), 400, timestamp="20260101T000000Z")
    read = []
    for name in sorted(glob.glob(f"{folder}/records/part-*")):
        with open(name, encoding="utf-8") as file:
            read += [json.loads(line) for line in file]
    assert [d["halId_s"] for d in read] == [d["halId_s"] for d in docs]
    assert (read[0]["authQuality_s"], read[0]["authIdPerson_i"], read[0]["authNone_s"]) == (["aut", 0], [7, None], [0, 0])
    lone = sinks.snapshot_lines(spark.createDataFrame([(0, '{"authX_s": ["a", "b", "c"]}')], "doc_ord long, value string")).first()["value"]
    assert json.loads(lone)["authX_s"] == ["a", "b", "c"] and json.loads(lone)["authFullName_s"] == [0, 0, 0]


def test_line_faults_name_their_line(spark, tmp_path):
    with pytest.raises(records.SnapshotError, match="line 3"):
        records.check_lines(spark, write(tmp_path, [DOCS[0], "", "{bad", DOCS[1]]))
    with pytest.raises(records.SnapshotError, match="line 2 must be a JSON object"):
        records.check_lines(spark, write(tmp_path, [DOCS[0], "[1]"], "b.jsonl"))


def test_development_subset(spark, tmp_path):
    path = write(tmp_path, DOCS)
    rows = records.load_subset(spark, path, 2)
    assert [r[0] for r in rows.select(F.try_variant_get("doc", "$.halId_s", "string")).collect()] == ["h0", "h1"]
    for limit in (0, settings.DEV_SNAPSHOT_LIMIT + 1):
        with pytest.raises(records.SnapshotError):
            records.load_subset(spark, path, limit)
    with pytest.raises(records.SnapshotError, match="no records"):
        records.load_subset(spark, write(tmp_path, [""], "empty.jsonl"), 2)


def test_complete_snapshot_gate(spark, tmp_path):
    path = write(tmp_path, DOCS)
    manifest = {"query": "*:*", "numFound": 5, "fetched_count": 5}
    gate = lambda m: records.load_complete(spark, path, write(tmp_path, [json.dumps(m)], "manifest.json"))
    assert gate(manifest).count() == 5
    for broken in ({"query": "x"}, {"numFound": 6}, {"numFound": "5"}, {"numFound": 4, "fetched_count": 4}):
        with pytest.raises(records.SnapshotError):
            gate({**manifest, **broken})
    with pytest.raises(records.SnapshotError, match="requires its manifest"):
        records.load_complete(spark, path, str(tmp_path / "absent.json"))
    double = write(tmp_path, [*DOCS, DOCS[0]], "double.jsonl")
    with pytest.raises(records.SnapshotError, match="duplicate_hal_id=1"):
        records.load_complete(spark, double, write(tmp_path, [json.dumps({**manifest, "numFound": 6, "fetched_count": 6})], "m6.json"))


def test_csv_tables(spark, tmp_path):
    lines = spark.createDataFrame([(0, json.dumps({**DOCS[0], "keyword_s": ["a", 'b"c'], "primaryDomain_s": "x"}))], "doc_ord long, value string")
    sinks.write_csv_tables(canonical_tables(records.parse_lines(lines)), str(tmp_path), single_file=True)

    def rows(name):
        with open(glob.glob(f"{tmp_path}/{name}/part-*.csv")[0], encoding="utf-8", newline="") as file:
            return list(csv.DictReader(file))

    assert list(rows("projects")[0]) == CANONICAL_TABLES["projects"]
    assert json.loads(rows("projects")[0]["keywords"]) == ["a", 'b"c'] and rows("projects")[0]["publicationYear"] == ""
    assert {(r["domainId"], r["primary"]) for r in rows("project_research_domains")} == {("x", "True"), ("x.y", "False")}


def test_appended_batches_and_first_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    read = lambda: {tuple(r) for r in sinks.read_table(spark, path).select("k", "v").collect()}
    assert sinks.read_table(spark, path) is None
    sinks.append_new(path, rows(("a", 1), ("b", 1)), ["k"], 0)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/part-*")}
    for _ in range(2):
        sinks.append_new(path, rows(("a", 2), ("c", 2)), ["k"], 1)
        assert read() == {("a", 1), ("b", 1), ("c", 2)}
    assert all(os.path.getmtime(f) == t for f, t in before.items())
    assert spark.read.parquet(f"{path}/{sinks.BATCH}=b1").count() == 1
    nodes = with_bare_endpoints(rows(("a", 1)), spark.createDataFrame([("a", "z")], "s string, t string"), "k", ["s", "t"])
    assert {tuple(r) for r in nodes.collect()} == {("a", 1), ("z", None)}
    for version, value in (("v1", 1), ("v2", 1), ("v1", 2)):
        sinks.replace_partitions(str(tmp_path / "p"), rows(("a", value)).withColumn("version", F.lit(version)), ["version"])
    assert {(r["version"], r["v"]) for r in sinks.read_table(spark, str(tmp_path / "p")).collect()} == {("v1", 2), ("v2", 1)}


def test_streamed_batches_and_recommendation(spark, tmp_path, capsys):
    inbox, tables, marks = tmp_path / "in", str(tmp_path / "tables"), str(tmp_path / "marks")
    inbox.mkdir()
    write(inbox, DOCS[:3], "one.jsonl")
    ingest.start_ingest(spark, str(inbox), tables, marks).awaitTermination()
    write(inbox, [{**DOCS[0], "title_s": "changed"}, *DOCS[3:]], "two.jsonl")
    ingest.start_ingest(spark, str(inbox), tables, marks).awaitTermination()
    projects = {r["halId"]: r["title"] for r in sinks.read_table(spark, f"{tables}/projects").collect()}
    assert projects == {f"h{i}": f"T {i}" for i in range(5)}
    graph = cli.load_graph(spark, tables)
    rows = cli.recommendation_rows(graph, cli.project_target(graph, "h0"), 3, True)
    assert [r["person_id"] for r in rows] == ["unknown_P 1", "unknown_P 2", "unknown_P 3"]
    assert rows[0]["graph"] == 1.0 and rows[0]["explanation"].startswith("Collaborator unknown_P 1 [unknown_P 1] is recommended")
    assert "unknown_P 1" in cli.render_text("h0", rows)
    free = cli.recommendation_rows(graph, cli.text_target(graph, "about x.y", ["x.y", "zz"]), 2, False)
    assert len(free) == 2 and free[0]["gap_match"] == 0.0


def test_capabilities_of_ingested_tables(spark, tmp_path, capsys):
    inbox, tables = tmp_path / "in", str(tmp_path / "tables")
    inbox.mkdir()
    words = ["electromagnetism", "crystallography"]
    docs = [{"halId_s": f"h{i}", "title_s": [f"T {i}"], "authFullName_s": ["Ada Byron", f"P {i}"], "authIdHal_s": ["ada-byron", f"p-{i}"],
             "keyword_s": [w.title() if i else w for w in words] + ["short"], "publicationDateY_i": 2020 + i,
             "structId_i": [1], "structName_s": ["Lab"], "structIsChildOf_fs": ["1_x_JoinSep_77_FacetSep_y"],
             "domainAllCode_s": ["x", "x.y"], "level0_domain_s": ["x"], "level1_domain_s": ["x.y"]} for i in range(3)]
    write(inbox, docs, "one.jsonl")
    ingest.start_ingest(spark, str(inbox), tables, str(tmp_path / "marks")).awaitTermination()
    organizations = {r["halId"]: r["name"] for r in sinks.read_table(spark, f"{tables}/organizations").collect()}
    assert organizations[1] == "Lab" and organizations[77] is None
    run = lambda backend, **kw: extract_to_tables(spark, tables, backend, "m", "2024-01-01", 2024, **kw)

    def keywords(prompt):
        if "Title: T 1" in prompt:
            raise RuntimeError("no answer")
        line = next(x for x in prompt.split("\n") if x.startswith("Keywords: "))
        return [{"name": w, "normalized_name": w, "kind": "topic", "evidence": w, "confidence": (len(w) - 6) / 10} for w in line[10:].split(", ")]

    def broken(prompt):
        raise RuntimeError("asked again")

    assert run(keywords, dry_run=True) == {"created": 2, "merged": 2, "skipped": 0, "asked": 3, "failed": 1}
    assert sinks.read_table(spark, f"{tables}/capability") is None
    assert run(keywords)["created"] == 2
    assert run(broken, resume=True, project_id="h0") == {"created": 0, "merged": 2, "skipped": 0, "asked": 1, "failed": 0}
    assert sinks.read_table(spark, f"{tables}/evidences_capability").count() == 4
    able = {(r["author"], r["capability"], r["publicationCount"]) for r in sinks.read_table(spark, f"{tables}/has_capability").collect()}
    assert able == {("ada-byron", w, 2) for w in words}
    graph = cli.load_graph(spark, tables)
    rows = cli.recommendation_rows(graph, cli.text_target(graph, "about", ["electromagnetism", "x.y"]), 1, False)
    assert rows[0]["person_id"] == "ada-byron" and rows[0]["gap_match"] > 0
    assert cli.main(["capabilities", "--tables", tables, "--limit", "1", "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["asked"] == 1


def test_environment_settings():
    env = {"NEO4J_URI": "bolt://x", "NEO4J_USER": "u", "NEO4J_PASSWORD": "secret", "NEO4J_DATABASE": "d"}
    store = settings.graph_store_from_env(env=env)
    assert store.database == "d" and "secret" not in repr(store)
    assert settings.graph_store_from_env("mine", env).database == "mine"
    with pytest.raises(ValueError):
        settings.graph_store_from_env(env={})
    assert settings.text_backend_settings({})["provider"] == "fake"
    assert settings.graph_names()["relationships"]["authorship"] == "WROTE"


def test_nested_documents_are_parsed_once(spark):
    text = spark.createDataFrame([('{"project_id": "p", "members": [{"person_id": "a"}], "domains": [{"domain_id": "d"}]}',)], "value string")
    able = spark.createDataFrame([('{"person_id": "a", "capability_id": "c"}',)], "value string")
    graph = nested_graph.nested_graph(nested_graph.documents(text), nested_graph.documents(able))
    for table in (graph.projects, graph.authors, graph.wrote, graph.project_domain, graph.domains, graph.subdomain_of, graph.has_capability):
        assert "parseJson" not in str(table._jdf.queryExecution().optimizedPlan())
    assert graph.wrote.count() == graph.has_capability.count() == 1
