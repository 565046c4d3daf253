"""Calls to pluggable text backends: prompts, caching, and one call per publication inside tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.text import cache_key
from kinweave.operators.capability import EXTRACTED_SCHEMA, accept, parse_extracted
from kinweave.operators.requirements import structure_fault

CapabilityBackend = Callable[[str], list]
RequirementBackend = Callable[[str], dict]


def _listed(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise("none")


def _context(title: Column, abstract: Column, keywords: Column, domains: Column) -> Column:
    return F.concat(
        F.lit("Title: "), title, F.lit("\nAbstract: "), abstract, F.lit("\nKeywords: "), _listed(keywords),
        F.lit("\nResearch domains: "), _listed(domains),
    )


def capability_prompt(title: Column, abstract: Column, keywords: Column, domains: Column) -> Column:
    """Task and publication text."""
    task = (
        "List the concrete methods, tools and techniques this publication demonstrably uses, as a JSON array of objects "
        "with name, normalized_name (English), kind, evidence (quoted from the text) and confidence (0 to 1).\n\n"
    )
    return F.concat(F.lit(task), _context(title, abstract, keywords, domains))


def requirement_prompt(title: Column, abstract: Column, keywords: Column, domains: Column) -> Column:
    task = (
        "List the capabilities needed to carry out this project, as JSON with requirements (name, importance 0 to 1, "
        "source) and goals.\n\n"
    )
    return F.concat(F.lit(task), _context(title, abstract, keywords, domains))


def _ask(rows: DataFrame, backend: Callable[[str], object], fallback: object = None) -> DataFrame:
    """rows(key, project_id, prompt) to (key, project_id, response JSON, error): one call per row, in the tasks.

    A call that fails leaves its error and the fallback, or no response; the other calls are not lost.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    answers.append(json.dumps(backend(prompt), ensure_ascii=False))
                    errors.append(None)
                except Exception as fault:
                    answers.append(None if fallback is None else json.dumps(fallback))
                    errors.append(str(fault) or type(fault).__name__)
            yield batch[["key", "project_id"]].assign(response=answers, error=errors)

    return rows.select("key", "project_id", "prompt").mapInPandas(call, "key string, project_id string, response string, error string")


def cached_responses(rows: DataFrame, backend: Callable[[str], object], cache: DataFrame | None, fallback: object = None) -> DataFrame:
    """Answers from cache(key, project_id, response) where present, from the backend otherwise."""
    if cache is None:
        return _ask(rows, backend, fallback)
    none = F.lit(None).cast("string").alias("error")
    hits = cache.join(rows.select("key"), "key", "left_semi").select("key", "project_id", "response", none)
    return hits.unionByName(_ask(rows.join(cache.select("key"), "key", "left_anti"), backend, fallback))


def capability_responses(projects: DataFrame, backend: CapabilityBackend, model: str, cache: DataFrame | None = None) -> DataFrame:
    """Raw answers per project, or the error of the call; append the answers to the cache table to resume later.

    projects(project_id, title, abstract, keywords, domains).
    """
    prompt = capability_prompt(F.col("title"), F.col("abstract"), F.col("keywords"), F.col("domains"))
    key = cache_key(F.col("project_id"), F.lit(settings.PROMPT_VERSION), F.lit(model))
    return cached_responses(projects.select(key.alias("key"), "project_id", prompt.alias("prompt")), backend, cache)


def accepted_capabilities(projects: DataFrame, responses: DataFrame) -> DataFrame:
    """Capabilities of the answers that pass every filter, with (project_id, pos)."""
    items = responses.select("project_id", F.posexplode(F.from_json("response", EXTRACTED_SCHEMA)).alias("pos", "item"))
    joined = items.join(projects.select("project_id", "title", "abstract", "keywords"), "project_id")
    kept = accept(parse_extracted(joined), F.col("title"), F.col("abstract"), F.col("keywords"))
    return kept.select("project_id", "pos", "name", "normalized_name", "kind", "evidence", "confidence")


def requirement_responses(projects: DataFrame, backend: RequirementBackend, cache: DataFrame | None = None) -> DataFrame:
    """Requirement answers per project; unusable ones come back as null and call for the domain fallback."""

    def checked(prompt: str) -> dict | None:
        answer = backend(prompt)
        return None if structure_fault(answer) else answer

    prompt = requirement_prompt(F.col("title"), F.col("abstract"), F.col("keywords"), F.col("domains"))
    key = cache_key(F.col("project_id"), F.col("title"), F.lit(settings.REQUIREMENT_PROMPT_VERSION))
    rows = projects.select(key.alias("key"), "project_id", prompt.alias("prompt"))
    failed = {"failed": True}
    return cached_responses(rows, checked, cache, failed)


def raw_requirements(responses: DataFrame) -> DataFrame:
    """(target_id, seq, name, importance, source) of usable requirement answers."""
    schema = "struct<requirements:array<struct<name:string,importance:string,source:string>>,goals:array<string>>"
    parsed = responses.select("project_id", F.from_json("response", schema).alias("r"))
    rows = parsed.select("project_id", F.posexplode("r.requirements").alias("pos", "q"))
    return rows.select(F.col("project_id").alias("target_id"), F.struct("project_id", "pos").alias("seq"), "q.*")


class KeywordBackend:
    """Deterministic stand-in for a text model: every keyword of the prompt becomes a capability."""

    def __call__(self, prompt: str) -> list:
        line = next((x for x in prompt.split("\n") if x.startswith("Keywords: ")), "Keywords: none")
        words = [w for w in line[len("Keywords: "):].split(", ") if w != "none"]
        return [
            {"name": w, "normalized_name": w, "kind": "topic", "evidence": w, "confidence": (len(w) - 6) / 20} for w in words
        ]


class KeywordRequirements:
    """Deterministic stand-in: every keyword is required; prompts that hold ``refuse`` fail."""

    def __init__(self, refuse: str) -> None:
        self.refuse = refuse

    def __call__(self, prompt: str) -> dict:
        if self.refuse in prompt:
            raise RuntimeError("refused")
        names = [c["name"] for c in KeywordBackend()(prompt)]
        return {"requirements": [{"name": n, "importance": 0.9} for n in names], "goals": []}


class FixedBackend:
    """Answers in turn from a fixed list and repeats the last one, for tests."""

    def __init__(self, answers: list, default: object = None) -> None:
        self.answers, self.default, self.calls = list(answers), default, 0

    def __call__(self, prompt: str) -> object:
        if not self.answers:
            return self.default
        answer = self.answers[min(self.calls, len(self.answers) - 1)]
        self.calls += 1
        return answer
