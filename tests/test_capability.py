import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import capability, extraction, requirements, resolve


def test_aggregation_and_gate(spark):
    rows = [("a", "p1", 2020, "c", 0.5), ("a", "p1", 2020, "c", 1.0), ("a", "p2", None, "c", None), ("b", "p1", 2026, "c", 0.9),
            ("unknown_x", "p1", 2020, "c", 0.9)]
    found = capability.aggregate_capabilities(
        spark.createDataFrame(rows, "person_id string, project_id string, year int, capability_id string, confidence double"), 2026)
    a = {r["person_id"]: r for r in found.collect()}
    assert set(a) == {"a", "b"}
    assert (a["a"]["publication_count"], a["a"]["evidence_count"], a["a"]["recent_publication_count"]) == (2, 3, 0)
    assert a["a"]["avg_confidence"] == pytest.approx(0.5) and a["a"]["score"] == pytest.approx(math.pow(0.5, 6 / 5) / 2)
    assert (a["a"]["first_seen_year"], a["a"]["last_seen_year"]) == (2020, 2020)
    assert capability.gate_summary(found).first().asDict() == {"written": 1, "skipped_low_evidence": 1, "skipped_placeholder": 0}
    stored = capability.has_capability_rows(found)
    again = capability.merge_has_capability(stored, capability.has_capability_rows(found))
    both = capability.merge_has_capability(again, capability.has_capability_rows(found, "capability-v2"))
    assert again.count() == 1 and both.count() == 2


def test_filters_on_extracted_capabilities(spark):
    items = [("Graph Mining", "", "method", "graph mining", "0.9"), ("Data Analysis", "", "x", "data", "0.9"), ("Rust", "", "tool", "rust", "0.4"),
             ("Spark", "", None, "absent words", "0.9"), ("", "", "x", "data", "0.9"), ("Kafka", "", "x", "", "0.9"), ("SQL", "Ünïque-SQL", "tool", "SQL", "high")]
    raw = spark.createDataFrame([("p", i) for i in items], "project_id string, item struct<name:string,normalized_name:string,kind:string,evidence:string,confidence:string>")
    kept = capability.accept(capability.parse_extracted(raw), F.lit("On Graph Mining"), F.lit("data and rust"), F.array(F.lit("k")))
    assert [(r["name"], r["normalized_name"], r["kind"]) for r in kept.collect()] == [("Graph Mining", "graph mining", "METHOD")]


def sequential(mentions, existing, near):
    """One mention at a time: existing is (id, aliases), near leads names to records by embedding."""
    ids = {i for i, _ in existing}
    aliases = {form: i for i, forms in existing for form in (i, *forms)}
    out = []
    for seq, name, alias in mentions:
        created = False
        if name in ids:
            target = name
        elif name in aliases:
            target = aliases[name]
        elif name in near:
            target = near[name]
        else:
            target, created = name, True
            ids.add(name)
            aliases[name] = name
        if alias and (created and alias != name or alias not in aliases):
            aliases[alias] = target
        out.append((seq, target, created))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_resolution_equals_one_by_one_processing(spark, monkeypatch, seed):
    monkeypatch.setattr(resolve, "STRETCH", 7)
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    mentions = [(seq, rng.choice(names), rng.choice(names) if rng.random() < 0.4 else None) for seq in range(60)]
    existing, near = [("n0", ["n1", "m1"]), ("n2", [])], {"n3": "n0", "n4": "n2"}
    known = spark.createDataFrame([(i, n, n, forms) for i, (n, forms) in enumerate(existing)], "ord int, capability_id string, name string, aliases array<string>")
    close = spark.createDataFrame(list(near.items()), "norm string, capability_id string")
    df = spark.createDataFrame(mentions, "seq int, name string, alias string")
    for given, by in ((None, {}), (close, near)):
        rows = resolve.resolve_names(df, known, given).orderBy("seq").collect()
        assert [(r["seq"], r["capability_id"], r["created"]) for r in rows] == sequential(mentions, existing, by)


def test_a_started_record_takes_its_alias_over(spark):
    known = spark.createDataFrame([], "ord int, capability_id string, name string, aliases array<string>")
    df = spark.createDataFrame([(0, "alpha", "x"), (1, "beta", "x"), (2, "x", None)], "seq int, name string, alias string")
    assert [r["capability_id"] for r in resolve.resolve_names(df, known).orderBy("seq").collect()] == ["alpha", "beta", "beta"]


def test_nearest_record_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK_ROWS", 40)
    monkeypatch.setattr(resolve, "CHUNK_ROWS", 60)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    index = np.vstack([centres[rng.integers(5)] + 0.3 * rng.normal(size=16) for _ in range(200)])
    asked = np.vstack([index[i] + 0.15 * rng.normal(size=16) for i in range(150)])
    left = spark.createDataFrame([(str(i), v.tolist(), 0.92) for i, v in enumerate(asked)], "id string, vector array<double>, threshold double")
    right = spark.createDataFrame([(i, f"c{i}", v.tolist()) for i, v in enumerate(index)], "ord long, capability_id string, vector array<double>")
    got = {r["id"]: r["capability_id"] for r in resolve.nearest_records(left, right).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(asked) @ unit(index).T
    assert got == {str(i): f"c{s.argmax()}" for i, s in enumerate(sims) if s.max() >= 0.92}


def test_requirements_lose_weight_until_known(spark):
    known = spark.createDataFrame([(0, "sql", "SQL", ["structured query"])], "ord int, capability_id string, name string, aliases array<string>")
    raw = spark.createDataFrame([("t", 0, "SQL", "0.9", None), ("t", 1, "Rust", "high", "x"), ("t", 2, "rust", "1.0", "x"), ("t", 3, " ", "1", "x"),
                                 ("t", 4, "Structured  Query", "0", "x")], "target_id string, seq int, name string, importance string, source string")
    rows = [(r["name"], r["importance"], r["capability_id"], r["source"]) for r in requirements.map_requirements(raw, known).orderBy("seq").collect()]
    assert rows == [("SQL", 0.9, "sql", "extracted"), ("Rust", pytest.approx(0.35), None, "x"), ("rust", 1.0, "rust", "x")]


def test_cache_spares_the_backend(spark):
    projects = spark.createDataFrame([("p1", "T", "uses interferometry", ["interferometry"], ["d"]), ("p2", "T", "y", [], [])],
                                     "project_id string, title string, abstract string, keywords array<string>, domains array<string>")
    answers = extraction.capability_responses(projects, extraction.KeywordBackend(), "m")
    stored = spark.createDataFrame(answers.collect(), answers.schema)

    def broken(prompt):
        raise RuntimeError("must not be asked")

    again = extraction.capability_responses(projects, broken, "m", stored)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in stored.collect()}
    assert [r["name"] for r in extraction.accepted_capabilities(projects, again).collect()] == []  # (14 - 6) / 20 is too low


def test_requirement_backend_failure_is_marked(spark):
    projects = spark.createDataFrame([("p1", "T", "A", ["k"], ["d"])], "project_id string, title string, abstract string, keywords array<string>, domains array<string>")

    def broken(prompt):
        raise RuntimeError("down")

    assert '"failed"' in extraction.requirement_responses(projects, broken).first()["response"]
    good = extraction.requirement_responses(projects, lambda p: {"requirements": [{"name": "SQL", "importance": 0.5}], "goals": []})
    assert [r["name"] for r in extraction.raw_requirements(good).collect()] == ["SQL"]
    assert requirements.structure_fault({"requirements": [{"name": ""}]}) is not None
