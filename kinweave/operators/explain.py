"""Explanations of a ranking: evidence-bound templates and verification of cited identifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions.text import cited_ids, strip
from kinweave.session import stage

PAIR = ["target_id", "person_id"]
CITED_CAPABILITIES = 3

# Fixed wording of explanations and caveats.
LEAD = "Collaborator %s [%s] is recommended based on graph evidence."
CAPABILITY_SENTENCE = "Shows publication evidence related to %s."
PROJECT_SENTENCE = "Authored publication [%s] ('%s')%s."
DOMAIN_SENTENCE = "Publication history aligns with research domain [%s] (%s)."
SCORE_SENTENCE = "Scored %.2f on capability gap coverage and %.2f on team complementarity."
PLACEHOLDER_CAVEAT = "Candidate identity is a fallback placeholder ('unknown_'); publication history may merge homonyms."
NO_LINK_CAVEAT = "No prior co-authorship connection with existing project team members."
NO_GAP_CAVEAT = "No publication evidence directly matching uncovered project capability gaps."
STALE_CAVEAT = "Limited recent publication evidence within the last 3-5 years."
RECENT_ENOUGH = 0.4


def valid_ids(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(target_id, person_id, id) that may be cited: the person, the target, evidence and its projects."""
    people = ranked.select(*PAIR)
    shown = evidence.join(people, PAIR, "left_semi")
    parts = [
        people.select(*PAIR, F.col("person_id").alias("id")),
        people.select(*PAIR, F.col("target_id").alias("id")),
        shown.select(*PAIR, "id"),
        shown.select(*PAIR, F.col("project_id").alias("id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.where(F.col("id").isNotNull() & (F.col("id") != "")).distinct()


def caveats(has_gaps: Column) -> Column:
    """What is missing from a candidate's case, in fixed order."""
    found = F.array(
        F.when(F.col("is_placeholder"), F.lit(PLACEHOLDER_CAVEAT)),
        F.when(F.col("graph") == 0, F.lit(NO_LINK_CAVEAT)),
        F.when((F.col("gap_match") == 0) & has_gaps, F.lit(NO_GAP_CAVEAT)),
        F.when(F.col("recency") < RECENT_ENOUGH, F.lit(STALE_CAVEAT)),
    )
    return F.filter(found, lambda c: c.isNotNull())


def covered_gaps(ranked: DataFrame, evidence: DataFrame, gaps: DataFrame) -> DataFrame:
    """(target_id, person_id, capability_id, name): requirements among the candidate's evidence."""
    shown = evidence.join(ranked.select(*PAIR), PAIR, "left_semi").select(*PAIR, F.col("id").alias("capability_id")).distinct()
    return shown.join(gaps.select("target_id", "capability_id", "name"), ["target_id", "capability_id"])


def leading_evidence(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per candidate: the first project, the first domain, up to three capabilities.

    A ranking window with a limit keeps three rows per candidate and kind in each task, however
    much evidence a candidate has.
    """
    shown = evidence.join(ranked.select(*PAIR), PAIR, "left_semi")
    place = F.row_number().over(W.partitionBy(*PAIR, "kind").orderBy("ord"))
    top = shown.withColumn("place", place).where(F.col("place") <= CITED_CAPABILITIES)
    item = F.struct("id", "text", "year")

    def first(kind: str) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("place") == 1), item)).alias(kind)

    cited = F.collect_list(F.when(F.col("kind") == "capability", F.struct("place", "id", "text")))
    return top.groupBy(*PAIR).agg(first("project"), first("domain"), F.array_sort(cited).alias("capabilities"))


def template_explanations(ranked: DataFrame, evidence: DataFrame, gaps: DataFrame) -> DataFrame:
    """(target_id, person_id, rank, explanation, cited_ids) built from the ranking alone."""
    lead = leading_evidence(ranked, evidence)
    with_gaps = gaps.select("target_id").distinct().withColumn("gaps_known", F.lit(True))
    rows = ranked.join(lead, PAIR, "left").join(with_gaps, "target_id", "left")
    missing = caveats(F.col("gaps_known").isNotNull())
    cites = F.array_join(F.transform("capabilities", lambda c: F.concat(F.lit("["), c["id"], F.lit("] ("), c["text"], F.lit(")"))), ", ")
    project, domain = F.col("project"), F.col("domain")
    year = F.when(project["year"].isNotNull() & (project["year"] != 0), F.concat(F.lit(" in "), project["year"])).otherwise("")
    parts = [
        F.format_string(LEAD, "full_name", "person_id"),
        F.when(F.size("capabilities") > 0, F.format_string(CAPABILITY_SENTENCE, cites)),
        F.when(project.isNotNull(), F.format_string(PROJECT_SENTENCE, project["id"], project["text"], year)),
        F.when(domain.isNotNull(), F.format_string(DOMAIN_SENTENCE, domain["id"], domain["text"])),
        F.format_string(SCORE_SENTENCE, "gap_match", "complementarity"),
        F.when(F.size(missing) > 0, F.concat(F.lit("Caveats: "), F.array_join(missing, " "))),
    ]
    out = rows.select(*PAIR, "rank", F.concat_ws(" ", *parts).alias("explanation"))
    return out.withColumn("cited_ids", cited_ids(F.col("explanation")))


def unknown_citations(generated: DataFrame, valid: DataFrame) -> DataFrame:
    """(target_id, person_id, id): identifiers cited in ``explanation`` that may not be cited."""
    cited = generated.select(*PAIR, F.explode(cited_ids(F.col("explanation"))).alias("id"))
    return cited.join(valid, [*PAIR, "id"], "left_anti")


def verified_explanations(generated: DataFrame, templates: DataFrame, valid: DataFrame) -> DataFrame:
    """Generated texts whose every citation is valid; the template replaces all others.

    generated(target_id, person_id, explanation, error).
    """
    bad = unknown_citations(generated, valid).groupBy(*PAIR).agg(F.array_sort(F.collect_set("id")).alias("unknown"))
    rows = templates.select(*PAIR, F.col("explanation").alias("template")).join(
        generated.select(*PAIR, strip(F.col("explanation")).alias("generated"), "error"), PAIR, "left"
    ).join(bad, PAIR, "left")
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("LLM failure: "), F.col("error")))
        .when(F.col("generated").isNull(), F.lit("No LLM backend provided"))
        .when(F.col("unknown").isNotNull(), F.concat(F.lit("Rejected: cited unknown IDs ['"), F.array_join("unknown", "', '"), F.lit("']")))
    )
    text = F.when(reason.isNull(), F.col("generated")).otherwise(F.col("template"))
    return rows.select(
        *PAIR, text.alias("explanation"), cited_ids(text).alias("cited_ids"), reason.isNotNull().alias("used_template"),
        reason.alias("fallback_reason"),
    )


#: Evidence of each kind that a prompt shows, the first in evidence order.
PROMPT_EVIDENCE = 20
INSTRUCTIONS = (
    "Explain in two to four sentences why this researcher fits the target as a collaborator.\n"
    "- Rely on the evidence below alone; invent no publication, skill, affiliation or relation.\n"
    "- Write 'publication evidence related to X'; do not call anybody an expert.\n"
    "- Put the identifier behind each claim in square brackets. Allowed are those listed as evidence and the candidate's own.\n"
    "- Name the caveats. Do not speak of databases or queries."
)


def explanation_contexts(
    ranked: DataFrame, evidence: DataFrame, gaps: DataFrame, titles: DataFrame | None = None, per_kind: int = PROMPT_EVIDENCE,
) -> DataFrame:
    """One row per candidate: ranked columns with title, evidence (kind, id, text, year), missing and covered.

    Only the first ``per_kind`` evidence rows of each kind are gathered; a ranking window with a limit drops the rest in
    each task. titles(target_id, title) may name the targets.
    """
    shown = evidence.join(ranked.select(*PAIR), PAIR, "left_semi")
    place = F.row_number().over(W.partitionBy(*PAIR, "kind").orderBy("ord"))
    items = shown.withColumn("place", place).where(F.col("place") <= per_kind).groupBy(*PAIR).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind", "id", "text", "year"))),
                    lambda e: F.struct(e["kind"].alias("kind"), e["id"].alias("id"), e["text"].alias("text"), e["year"].alias("year"))).alias("evidence"))
    met = covered_gaps(ranked, evidence, gaps).groupBy(*PAIR).agg(F.array_sort(F.collect_set("name")).alias("covered"))
    known = gaps.select("target_id").distinct().withColumn("gaps_known", F.lit(True))
    rows = ranked.join(items, PAIR, "left").join(met, PAIR, "left").join(known, "target_id", "left")
    rows = rows.withColumn("title", F.lit("")) if titles is None else rows.join(titles.select("target_id", "title"), "target_id", "left")
    none = "array<struct<kind:string,id:string,text:string,year:int>>"
    return rows.withColumns({
        "title": F.coalesce(F.nullif("title", F.lit("")), "target_id"), "missing": caveats(F.col("gaps_known").isNotNull()),
        "evidence": F.coalesce(F.col("evidence").cast(none), F.array().cast(none)), "covered": F.coalesce("covered", F.array().cast("array<string>")),
    }).drop("gaps_known")


def context_text(features: list[str]) -> Column:
    """A row of ``explanation_contexts`` as lines: who is meant, scores and contributions, evidence, caveats."""
    scores = [F.format_string("- " + n + ": score=%.3f, contribution=%.3f", F.col(n), F.col(f"contrib_{n}")) for n in features]
    head = F.format_string("### Candidate: %s (ID: %s)", "full_name", "person_id")
    kind = F.concat(F.lit("Placeholder ID: "), F.when(F.col("is_placeholder"), "Yes (unreliable author identity)").otherwise("No"))

    def line(e: Column) -> Column:
        year = F.when(e["year"].isNotNull() & (e["year"] != 0), F.concat(F.lit(" (Year: "), e["year"], F.lit(")"))).otherwise("")
        return F.concat(F.lit("- ["), e["id"], F.lit("] ("), e["kind"], F.lit("): "), e["text"], year)

    def listed(values: Column, empty: str) -> Column:
        return F.when(F.size(values) > 0, F.array_join(values, "\n")).otherwise(F.lit(empty))

    return F.concat_ws(
        "\n", head, kind, F.concat(F.lit("Target Project: "), F.col("title")), F.lit("\n#### Scores and contributions"), *scores,
        F.lit("\n#### Evidence (identifiers that may be cited in brackets)"), listed(F.transform("evidence", line), "- None."),
        F.lit("\n#### Caveats"), listed(F.transform("missing", lambda m: F.concat(F.lit("- "), m)), "- None noted."))


def explanation_prompts(contexts: DataFrame, features: list[str]) -> DataFrame:
    """(target_id, person_id, prompt)."""
    return contexts.select(*PAIR, F.concat(F.lit(INSTRUCTIONS + "\n\n"), context_text(features), F.lit("\n\nExplanation:")).alias("prompt"))


def explain_candidates(
    ranked: DataFrame, evidence: DataFrame, gaps: DataFrame, features: list[str], backend: Callable[[str], str] | None = None,
    titles: DataFrame | None = None, per_kind: int = PROMPT_EVIDENCE,
) -> DataFrame:
    """(target_id, person_id, explanation, cited_ids, used_template, fallback_reason) of every ranked candidate.

    Each candidate's context goes to the backend once, and answers are written out before they are read several times.
    A text stays if all it cites is known of the candidate; a failed call, an unknown identifier or no backend at
    all leads to the template.
    """
    templates = template_explanations(ranked, evidence, gaps)
    if backend is None:
        texts = ranked.select(*PAIR, F.lit(None).cast("string").alias("explanation"), F.lit(None).cast("string").alias("error"))
    else:
        texts = stage(generate(explanation_prompts(explanation_contexts(ranked, evidence, gaps, titles, per_kind), features), backend), "explanations")
    return verified_explanations(texts, templates, valid_ids(ranked, evidence))


def generate(prompts: DataFrame, backend: Callable[[str], str]) -> DataFrame:
    """prompts(target_id, person_id, prompt) to (target_id, person_id, explanation, error)."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    texts.append(backend(prompt))
                    errors.append(None)
                except Exception as exc:  # any failure of the backend falls back to the template
                    texts.append(None)
                    errors.append(str(exc))
            yield batch[PAIR].assign(explanation=texts, error=errors)

    return prompts.select(*PAIR, "prompt").mapInPandas(
        call, "target_id string, person_id string, explanation string, error string"
    )
