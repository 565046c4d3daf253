import math

import pytest
from pyspark.sql import functions as F

from kinweave.functions import scoring
from kinweave.operators import graph as g
from kinweave.operators import recommend as rec
from kinweave.plans import collab, graph_queries

WROTE = [("a", "p1"), ("b", "p1"), ("b", "p2"), ("c", "p2"), ("c", "p3"), ("d", "p3"), ("d", "p4"), ("e", "p4"), ("unknown_z", "p3")]
DOMAINS = [("p1", "x.y"), ("p2", "x.y"), ("p3", "x"), ("p4", "q")]
ABLE = [("a", "sql"), ("c", "sql"), ("c", "ml"), ("d", "ml"), ("e", "ml"), ("e", "rust")]


@pytest.fixture(scope="module")
def graph(spark):
    years = {"p1": 2020, "p2": 2021, "p3": 2024, "p4": 2018}
    return g.GraphTables(
        projects=spark.createDataFrame([(p, f"T {p}", y) for p, y in years.items()], "project_id string, title string, year int"),
        authors=spark.createDataFrame([(p, p.upper()) for p in "abcde"], "person_id string, full_name string"),
        wrote=spark.createDataFrame([(a, p, i) for i, (a, p) in enumerate(WROTE)], "person_id string, project_id string, pos int"),
        project_domain=spark.createDataFrame(DOMAINS, "project_id string, domain_id string"),
        domains=spark.createDataFrame([("x", "X", ""), ("x.y", "XY", ""), ("q", "Q", "Quoi")], "domain_id string, name string, name_fr string"),
        subdomain_of=spark.createDataFrame([("x.y", "x")], "child_id string, parent_id string"),
        has_capability=spark.createDataFrame([(p, c, c.upper(), "TOOL", 2022) for p, c in ABLE],
                                             "person_id string, capability_id string, name string, kind string, last_seen_year int"),
    )


def targets(spark, team=("a", "b"), required=(("sql", 0.5), ("ml", 1.0))):
    return rec.Targets(
        domains=spark.createDataFrame([("t", "x.y"), ("t", "x")], "target_id string, domain_id string"),
        requirements=spark.createDataFrame([("t", c, c, c.upper(), w, "s") for c, w in required],
                                           "target_id string, req string, capability_id string, name string, importance double, source string"),
        team=spark.createDataFrame([("t", p) for p in team], "target_id string, person_id string"),
        keywords=spark.createDataFrame([("t", "kw")], "target_id string, keyword string"),
    )


def brute_distance(team, limit=3):
    seen, frontier = {p: 0 for p in team}, set(team)
    for hop in range(1, limit + 1):
        projects = {p for a, p in WROTE if a in frontier}
        frontier = {a for a, p in WROTE if p in projects} - set(seen)
        seen.update({a: hop for a in frontier})
    return seen


def test_distance_from_both_sides(spark, graph):
    team = spark.createDataFrame([("t", "a")], "target_id string, person_id string")
    people = graph.wrote.select(F.lit("t").alias("target_id"), "person_id").distinct()
    full = {r["person_id"]: r["hops"] for r in g.coauthor_distance(graph.wrote, team).collect()}
    asked = {r["person_id"]: r["hops"] for r in g.coauthor_distance(graph.wrote, team, people).collect()}
    assert full == asked == brute_distance(["a"])
    assert "e" not in full


def test_closure_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child_id string, parent_id string")
    pairs = {tuple(r) for r in g.ancestor_closure(edges).select("domain_id", "ancestor_id").collect()}
    assert pairs == {(n, m) for n in "abcd" for m in "abc"}


def test_pages_concatenate(graph):
    pages = [[r["project_id"] for r in g.project_page(graph.projects, 2, o).collect()] for o in (0, 2)]
    assert sum(pages, []) == ["p1", "p2", "p3", "p4"]
    assert g.project_page(graph.projects, 0).collect() == []
    many = graph.projects.sparkSession.range(1000).select(F.format_string("p%05d", "id").alias("project_id"), F.lit("t").alias("title"))
    for limit, offset in ((7, 0), (300, 400), (50, 980), (5, 2000), (0, 3)):
        deep = [r["project_id"] for r in g.project_page(many, limit, offset, page_rows=0).collect()]
        assert deep == [f"p{i:05d}" for i in range(1000)][offset:offset + limit]
    with pytest.raises(ValueError):
        g.project_page(graph.projects, -1)


def test_candidates_order_and_expansion(spark, graph):
    t = targets(spark)
    found = g.find_candidates(graph, t.domains, t.requirements, t.team, 2)
    assert [tuple(r) for r in found.people.orderBy(F.desc("n_caps"), F.desc("n_domains")).collect()] == [("t", "c", 2, 2), ("t", "d", 1, 1)]
    wide = g.find_candidates(graph, t.domains, t.requirements, t.team, 10, False, g.ancestor_closure(graph.subdomain_of))
    assert {r["person_id"] for r in wide.people.collect()} == {"c", "d", "e", "unknown_z"}


def test_features_against_set_arithmetic(spark, graph):
    result = rec.recommend(graph, targets(spark))
    rows = {r["person_id"]: r for r in result.features.collect()}
    able = {p: {c for q, c in ABLE if q == p} for p in "abcde"}
    required, team, wanted = {"sql", "ml"}, able["a"] | able["b"], {"x", "x.y", "sql", "ml", "kw"}
    hops = brute_distance(["a", "b"])
    for person, matched, year in (("c", {"x", "x.y"}, 2024), ("d", {"x"}, 2024), ("e", set(), 2022)):
        caps, row = able[person], rows[person]
        shown = matched | caps
        assert row["gap_match"] == pytest.approx(1.0 if "ml" in caps else 0.0)  # sql is covered by a
        assert row["domain_relevance"] == pytest.approx(len(matched) / 2)
        assert row["semantic"] == pytest.approx(len(caps & required) / 2)
        assert row["complementarity"] == pytest.approx(len((caps & required) - team) / len(caps & required))
        common = len(shown & wanted)
        assert row["project_similarity"] == pytest.approx(common / (common + 0.5 * len(wanted - shown) + 0.5 * len(shown - wanted)))
        assert row["graph"] == pytest.approx(1 - (hops[person] - 1) / 3 if person in hops else 0.0)
        assert row["recency"] == pytest.approx(math.pow(2, -max(0, 2024 - year) / 3))
    for row in result.ranked.collect():
        total = sum(row[f"contrib_{n}"] for n in rec.settings.RANKING_WEIGHTS)
        assert row["total_score"] == pytest.approx(total, abs=1e-5)
    placeholder = result.ranked.where("is_placeholder").first()
    assert placeholder["full_name"] == "unknown_z"


def test_requirements_met_by_a_name_that_is_an_identifier_count_once(spark, graph):
    t = targets(spark, team=("b",), required=(("sql", 0.5),))
    t = rec.Targets(t.domains, t.requirements.withColumn("name", F.lit("ML")), t.team)
    rows = {r["person_id"]: r["gap_match"] for r in rec.recommend(graph, t).features.collect()}
    assert rows["c"] == rows["a"] == rows["d"] == 1.0 and rows["unknown_z"] == 0.0


def test_gaps_are_covered_by_identifier_or_name(spark, graph):
    t = targets(spark)
    caps = rec.team_capabilities(graph, t.team)
    renamed = t.requirements.withColumn("capability_id", F.lit(None).cast("string"))
    assert {r["req"]: r["is_covered"] for r in rec.capability_gaps(renamed, caps).collect()} == {"sql": True, "ml": False}
    assert rec.gap_importance(rec.capability_gaps(t.requirements, caps)).first()["importance"] == 1.0


def test_ties_and_weights(spark):
    rows = spark.createDataFrame([("t", "b", 1.0, 0.0), ("t", "a", 1.0, 0.0), ("t", "c", 0.0, 1.0)], "target_id string, person_id string, graph double, recency double")
    order = lambda w, k=10: [r["person_id"] for r in rec.rank_candidates(rows, w, k).orderBy("rank").collect()]
    assert order({"graph": 1.0}) == ["a", "b", "c"]
    assert order({"recency": 1.0}, 1) == ["c"]


def test_proximity_is_zero_for_the_team(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (None,)], "h int")
    assert [round(r[0], 3) for r in df.select(scoring.proximity(F.col("h"))).collect()] == [0.0, 1.0, 0.667, 0.333, 0.0, 0.0]


def test_held_out_author_is_the_first(spark, graph):
    held, team = rec.held_out_split(graph.wrote, graph.projects, 2)
    assert {tuple(r) for r in held.collect()} == {("p1", "a"), ("p2", "b"), ("p3", "c"), ("p4", "d")}
    ranked = spark.createDataFrame([("p1", "a", 2), ("p2", "x", 1)], "target_id string, person_id string, rank int")
    rates = rec.hit_rates(rec.evaluate_held_out(held, ranked)).first()
    assert (rates["total_evaluated"], rates["hit_at_1"], rates["hit_at_3"], rates["mrr"]) == (4, 0.0, 0.25, 0.125)
    assert rec.hit_rates(rec.evaluate_held_out(held.limit(0), ranked)).first()["mrr"] == 0.0


def test_leave_one_out_query_takes_every_project_of_three_authors(spark):
    sf = "/root/testdata/sf0.001"
    authors = collab.base_graph(spark, sf).wrote.groupBy("project_id").agg(F.countDistinct("person_id").alias("n"))
    eligible = {r["project_id"]: r["n"] for r in authors.where("n >= 3").collect()}
    assert 3 in eligible.values()
    assert {r["target_id"] for r in graph_queries.held_out_authors(spark, sf).collect()} == set(eligible)


def test_evidence_is_gathered_per_person_before_the_targets(spark, graph):
    """Identifiers and counts equal those of the evidence rows, also where a domain bears the identifier of a project."""
    from dataclasses import replace

    t = targets(spark)
    doubled = t.domains.unionByName(t.domains.withColumn("target_id", F.lit("t2")))
    asked = t.requirements.unionByName(t.requirements.withColumn("target_id", F.lit("t2")))
    same = graph.project_domain.withColumn("domain_id", F.when(F.col("domain_id") == "x", F.lit("p2")).otherwise(F.col("domain_id")))
    named = doubled.withColumn("domain_id", F.when(F.col("domain_id") == "x", F.lit("p2")).otherwise(F.col("domain_id")))
    for tables, wanted in ((graph, doubled), (replace(graph, project_domain=same), named)):
        people = g.find_candidates(tables, wanted, asked, t.team).people
        rows = g.candidate_evidence(tables, people, wanted, asked)
        plain = lambda df: sorted((r.asDict(recursive=True) for r in df.collect()), key=repr)
        assert plain(g.candidate_evidence_ids(tables, people, wanted, asked)) == plain(g.evidence_ids(rows))
        assert plain(g.candidate_evidence_by_kind(tables, people, wanted, asked)) == plain(g.evidence_by_kind(rows))
        few = people.where("person_id = 'c'")
        assert plain(rec.evidence_of(tables, few, rec.Targets(wanted, asked, t.team))) == plain(rows.where("person_id = 'c'"))


def _random_graph(spark, seed, people=60, projects=80):
    import random

    rnd = random.Random(seed)
    wrote = [(f"a{a:02d}", f"p{p:02d}", rnd.random()) for p in range(projects) for a in rnd.sample(range(people), rnd.choice([1, 1, 2, 3, 4, 5]))]
    links = {(f"p{p:02d}", d) for p in range(projects) for d in rnd.sample(["x", "x.y", "x.z", "q", "q.r", "ml"], rnd.choice([0, 1, 2, 3]))}
    able = {(f"a{a:02d}", c) for a in range(people) for c in rnd.sample(["sql", "ml", "ML", "rust", "x", "R"], rnd.choice([0, 0, 1, 2, 4]))}
    asked = {(f"p{p:02d}", c): (rnd.choice([c, "ml", "sql "]), rnd.choice([0.5, 1.0, 2.0])) for p in range(projects) for c in rnd.sample(["sql", "ML", "rust", "q"], rnd.choice([0, 1, 3]))}
    frame = spark.createDataFrame
    graph = g.GraphTables(
        projects=frame([(f"p{p:02d}", "T", rnd.choice([None, 2001, 2020, 2024])) for p in range(projects)], "project_id string, title string, year int"),
        authors=frame([(f"a{a:02d}", "A") for a in range(people)], "person_id string, full_name string"),
        wrote=frame([(a, p, int(1000 * x)) for a, p, x in wrote], "person_id string, project_id string, pos int"),
        project_domain=frame(sorted(links), "project_id string, domain_id string"),
        domains=frame([(d, d, "") for d in ("x", "x.y", "x.z", "q", "q.r", "ml")], "domain_id string, name string, name_fr string"),
        subdomain_of=frame([("x.y", "x"), ("x.z", "x"), ("q.r", "q")], "child_id string, parent_id string"),
        has_capability=frame([(p, c, c, "TOOL", 2022) for p, c in sorted(able)],
                             "person_id string, capability_id string, name string, kind string, last_seen_year int"),
    )
    keywords = frame([(f"p{p:02d}", k) for p in range(projects) for k in ("ml", "kw")], "project_id string, keyword string")
    required = frame([(p, c, c, name, w, "s") for (p, c), (name, w) in sorted(asked.items())],
                     "project_id string, req string, capability_id string, name string, importance double, source string")
    return graph, keywords, required


@pytest.mark.parametrize("with_requirements, top_k", [(False, 10), (True, 10), (True, 3)])
def test_held_out_ranks_are_those_of_the_whole_ranking_without_scoring_all(spark, monkeypatch, with_requirements, top_k):
    """Ranks equal those among all candidates, while only pairs that can matter are scored; blocks may be of any size."""
    from kinweave.operators import rivals

    monkeypatch.setattr(rivals, "PEOPLE_BLOCK", 25)
    monkeypatch.setattr(rivals, "BATCH", 7)
    graph, keywords, required = _random_graph(spark, 5)
    required = required if with_requirements else required.limit(0)
    closure = g.ancestor_closure(graph.subdomain_of)
    held, team = rec.held_out_split(graph.wrote, graph.projects, 3)
    of = lambda df: df.withColumnRenamed("project_id", "target_id").join(held.select("target_id"), "target_id", "left_semi")
    asked = rec.Targets(g.with_ancestors(of(graph.project_domain), closure, ["target_id"]), of(required), team, of(keywords))
    whole = rec.recommend(graph, asked, top_k=top_k)
    want = sorted(tuple(r) for r in rec.evaluate_held_out(held, whole.ranked).collect())
    scored = []
    compute = rec.compute_features

    def counted(gaps, profile, persons, people, *rest, **named):
        scored.append(people.count())
        return compute(gaps, profile, persons, people, *rest, **named)

    monkeypatch.setattr(rec, "compute_features", counted)
    got = sorted(tuple(r) for r in rec.leave_one_out(graph, closure, keywords, required, 3, top_k).collect())
    key = lambda rows: [(t, p, r, x) for t, p, r, x in rows]
    assert key(got) == key(want) and {r[2] for r in got} > {None, 1}
    assert sum(scored) < whole.features.count()


def test_tables_of_a_project_meet_without_being_moved(spark, tmp_path):
    """Grouping and joining by project of the staged graph shuffles nothing; only wanted domains reach the people."""
    from kinweave.operators.capability import evidence_rows

    graph, rows = collab.staged_graph(spark, "/root/testdata/sf0.001", able=False)
    joined = evidence_rows(graph.wrote, collab.evidences(rows), graph.projects)
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().toString()
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    want = collab.base_graph(spark, "/root/testdata/sf0.001")
    for name in ("wrote", "projects", "project_domain"):
        assert plain(getattr(graph, name).select(*getattr(want, name).columns)) == plain(getattr(want, name))


def test_only_wanted_domains_are_gathered(spark, graph):
    closure = g.ancestor_closure(graph.subdomain_of)
    wanted = spark.createDataFrame([("x",), ("q",)], "domain_id string")
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    for upper in (None, closure):
        every = g.person_domains(graph, upper)
        assert plain(g.person_domains(graph, upper, wanted)) == plain(every.join(wanted, "domain_id", "left_semi").select("person_id", "domain_id"))


def test_last_hop_is_walked_from_either_side(spark):
    graph, _, _ = _random_graph(spark, 8)
    team = spark.createDataFrame([("t", "a01"), ("u", "a02"), ("u", "a03")], "target_id string, person_id string")
    full = g.near_people(graph.wrote, team, 3).known
    near = g.near_people(graph.wrote, team, 2)
    people = graph.wrote.select("person_id").distinct().crossJoin(team.select("target_id").distinct()).select("target_id", "person_id")
    plain = lambda df: sorted(tuple(r) for r in df.select("target_id", "person_id", "hops").collect())
    assert full.where("hops = 3").count() > 0
    for asked, frontier in ((people, near.frontier), (people, near.frontier.limit(0).unionByName(near.frontier)), (people.where("person_id > 'a50'"), near.frontier)):
        got = g.distance_of(asked, g.Near(near.edges, near.known, frontier))
        assert plain(got) == plain(full.join(asked, ["target_id", "person_id"], "left_semi"))


@pytest.mark.parametrize("size", [25, 3])
def test_targets_and_people_are_not_copied_for_the_blocks(spark, monkeypatch, size):
    """Whatever the number of blocks, what is written holds a target and a person once; no target is asked again once settled."""
    from kinweave.operators import rivals

    graph, keywords, required = _random_graph(spark, 5)
    written, walked = {}, []
    put, walk = rivals.stage, rivals._walk

    def kept(df, label="staged"):
        out = put(df, label)
        written.setdefault(label, []).append(out.count())
        return out

    def walking(both, near, top_k, pairs):
        walked.append({r["target_id"] for r in both.targets.collect()})
        out = walk(both, near, top_k, pairs)
        walked.append({r["target_id"] for r in out[1].collect()})
        return out

    monkeypatch.setattr(rivals, "PEOPLE_BLOCK", size)
    monkeypatch.setattr(rivals, "stage", kept)
    monkeypatch.setattr(rivals, "_walk", walking)
    rows = rec.leave_one_out(graph, g.ancestor_closure(graph.subdomain_of), keywords, required, 3, 1)
    every, settled, asked, _ = walked
    assert settled and asked == every - settled and len(every) <= rows.count()
    assert written["rivals-asked"] == [len(every), len(asked)] and written["rival-people"] == [graph.wrote.select("person_id").distinct().count()]


def test_few_people_are_met_without_walking_from_all_targets(spark, monkeypatch):
    graph, _, _ = _random_graph(spark, 8)
    team = spark.createDataFrame([("t", "a01"), ("u", "a02"), ("u", "a03")], "target_id string, person_id string")
    edges = g.shared_edges(graph.wrote)
    full = g.near_people(graph.wrote, team, 3, edges).known
    plain = lambda df: sorted(tuple(r) for r in df.select("target_id", "person_id", "hops").collect())
    for asked in (full.where("hops <= 1"), full.where("target_id = 't' AND hops = 3 OR hops = 0"), full):
        assert plain(g.distance_of_few(edges, team, asked)) == plain(asked)
    hops = []
    walk = g._coauthors
    monkeypatch.setattr(g, "_coauthors", lambda people, *rest: hops.append({r[0] for r in people.select("target_id").collect()}) or walk(people, *rest))
    assert g.distance_of_few(edges, team, full.where("target_id = 't' AND hops = 1")).count() and hops == [{"t"}]


def test_staging_leaves_no_shuffle_files_and_the_order_lines_go(spark):
    """Shuffles of what is written out end with the writing; the graph's lines are deleted once its tables are there."""
    from pathlib import Path

    from kinweave import session
    from kinweave.plans import graph_queries

    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    counts = spark.range(1000).groupBy(F.col("id") % 7).count()
    kept = session.stage(counts)
    assert not shuffles() - before and kept.count() == 7 and spark.conf.get(session.CLEANUP_KEY, None) is None
    assert counts.count() == 7 and len(counts.collect()) == 7 and len(counts.collect()) == 7
    folder = Path(session.ensure_checkpoint_dir(spark).removeprefix("file:"))
    there = {p.name for p in folder.iterdir()}
    graph, targets = graph_queries._prepared(spark, "/root/testdata/sf0.001")
    made = {p.name.partition("_")[0] for p in folder.iterdir() if p.name not in there}
    assert "facts" not in made and "wrote" in made and graph.wrote.count() and targets.requirements.count()
    with pytest.raises(ValueError):
        session.discard(kept)
