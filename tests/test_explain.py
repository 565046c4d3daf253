import pytest
from pyspark.sql import functions as F

from kinweave.operators import explain

RANKED = "target_id string, person_id string, rank int, full_name string, is_placeholder boolean, graph double, gap_match double, recency double, complementarity double"
EVIDENCE = "target_id string, person_id string, kind string, id string, text string, project_id string, year int, ord int"


@pytest.fixture
def case(spark):
    ranked = spark.createDataFrame([("t", "ada", 1, "Ada", False, 0.0, 0.5, 0.9, 0.25), ("t", "unknown_x", 2, "unknown_x", True, 1.0, 0.0, 0.1, 0.0)], RANKED)
    rows = [("project", "p1", "Old", "p1", 2020), ("domain", "x.y", "XY", "p1", 2020), ("project", "p2", "New", "p2", 2024)]
    rows += [("capability", f"c{i}", f"C{i}", None, None) for i in range(5)]
    evidence = spark.createDataFrame([("t", "ada", *r, i) for i, r in enumerate(rows)], EVIDENCE)
    gaps = spark.createDataFrame([("t", "c1", "One", False)], "target_id string, capability_id string, name string, is_covered boolean")
    return ranked, evidence, gaps


def test_template_wording(case):
    rows = {r["person_id"]: r for r in explain.template_explanations(*case).collect()}
    assert rows["ada"]["explanation"] == (
        "Collaborator Ada [ada] is recommended based on graph evidence. Shows publication evidence related to [c0] (C0), [c1] (C1), [c2] (C2). "
        "Authored publication [p1] ('Old') in 2020. Publication history aligns with research domain [x.y] (XY). "
        "Scored 0.50 on capability gap coverage and 0.25 on team complementarity. "
        "Caveats: No prior co-authorship connection with existing project team members."
    )
    assert rows["ada"]["cited_ids"] == ["ada", "c0", "c1", "c2", "p1", "x.y"]
    assert rows["unknown_x"]["explanation"].count("Caveats") == 1 and "merge homonyms" in rows["unknown_x"]["explanation"]


def test_every_template_citation_is_valid(case):
    ranked, evidence, gaps = case
    texts = explain.template_explanations(ranked, evidence, gaps)
    assert explain.unknown_citations(texts, explain.valid_ids(ranked, evidence)).count() == 0


def test_unknown_citations_and_failures_fall_back(spark, case):
    ranked, evidence, gaps = case
    templates = explain.template_explanations(ranked, evidence, gaps)
    valid = explain.valid_ids(ranked, evidence)

    def backend(prompt):
        if "Ada" in prompt:
            return " Worked on [p1] with [c3]. "
        raise RuntimeError("down")

    prompts = ranked.select("target_id", "person_id", F.col("full_name").alias("prompt"))
    rows = {r["person_id"]: r for r in explain.verified_explanations(explain.generate(prompts, backend), templates, valid).collect()}
    assert rows["ada"]["explanation"] == "Worked on [p1] with [c3]." and rows["ada"]["fallback_reason"] is None
    assert rows["unknown_x"]["fallback_reason"] == "LLM failure: down" and rows["unknown_x"]["used_template"]
    bad = explain.generate(prompts, lambda p: "Cites [invented].")
    rows = {r["person_id"]: r for r in explain.verified_explanations(bad, templates, valid).collect()}
    assert rows["ada"]["fallback_reason"] == "Rejected: cited unknown IDs ['invented']"
    none = spark.createDataFrame([], "target_id string, person_id string, explanation string, error string")
    assert {r["fallback_reason"] for r in explain.verified_explanations(none, templates, valid).collect()} == {"No LLM backend provided"}


def test_covered_gaps(case):
    ranked, evidence, gaps = case
    assert [(r["person_id"], r["name"]) for r in explain.covered_gaps(ranked, evidence, gaps).collect()] == [("ada", "One")]


FEATURES = ["graph", "gap_match"]


@pytest.fixture
def scored(case):
    ranked, evidence, gaps = case
    return ranked.withColumns({f"contrib_{n}": F.col(n) * 0.5 for n in FEATURES}), evidence, gaps


def test_contexts_are_bounded_per_kind_and_worded(spark, scored):
    titles = spark.createDataFrame([("t", "Target title")], "target_id string, title string")
    rows = {r["person_id"]: r for r in explain.explanation_contexts(*scored, titles, per_kind=2).collect()}
    assert [e["id"] for e in rows["ada"]["evidence"]] == ["p1", "x.y", "p2", "c0", "c1"]
    assert rows["ada"]["covered"] == ["One"] and rows["ada"]["title"] == "Target title"
    assert rows["unknown_x"]["evidence"] == [] and rows["unknown_x"]["covered"] == [] and len(rows["unknown_x"]["missing"]) == 3
    prompts = {r["person_id"]: r["prompt"] for r in explain.explanation_prompts(explain.explanation_contexts(*scored), FEATURES).collect()}
    assert "- [p2] (project): New (Year: 2024)\n- [c0] (capability): C0\n" in prompts["ada"] and "- gap_match: score=0.500, contribution=0.250" in prompts["ada"]
    assert "Target Project: t\n" in prompts["ada"] and "- None.\n" in prompts["unknown_x"] and prompts["unknown_x"].count("\n- ") > 6


def test_backend_answers_are_verified_in_one_go(scored):
    ranked, evidence, gaps = scored

    def backend(prompt):
        if "unknown_x" in prompt:
            raise RuntimeError("down")
        return " Worked on [p1] and [c1], see [ada]. "

    rows = {r["person_id"]: r for r in explain.explain_candidates(ranked, evidence, gaps, FEATURES, backend).collect()}
    assert (rows["ada"]["explanation"], rows["ada"]["used_template"], rows["ada"]["fallback_reason"]) == ("Worked on [p1] and [c1], see [ada].", False, None)
    assert rows["unknown_x"]["used_template"] and rows["unknown_x"]["fallback_reason"] == "LLM failure: down"
    assert {r["fallback_reason"] for r in explain.explain_candidates(ranked, evidence, gaps, FEATURES).collect()} == {"No LLM backend provided"}
    wrong = explain.explain_candidates(ranked, evidence, gaps, FEATURES, lambda prompt: "See [p9].").collect()
    assert all(r["used_template"] and "p9" in r["fallback_reason"] and r["explanation"].startswith("Collaborator") for r in wrong)
