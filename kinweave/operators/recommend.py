"""Collaborator recommendation for one target or a batch of targets, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.scoring import Scorer, jaccard, linear_scorer, proximity, recency, share, tversky
from kinweave.functions.text import display_name, is_placeholder, strip
from kinweave.operators.graph import (
    Candidates,
    GraphTables,
    candidate_evidence,
    coauthor_distance,
    distance_of,
    distance_of_few,
    find_candidates,
    near_people,
    person_domains,
    project_page,
    shared_edges,
    with_ancestors,
)
from kinweave.operators.rivals import may_outrank, outranked, sides
from kinweave.session import stage, stage_all

PAIR = ["target_id", "person_id"]


@dataclass(frozen=True)
class Targets:
    """What is asked, keyed by target_id. Sizes follow the number of targets, not the graph.

    domains(target_id, domain_id) with ancestors; requirements(target_id, req, capability_id, name,
    importance, source); team(target_id, person_id); keywords(target_id, keyword).
    """

    domains: DataFrame
    requirements: DataFrame
    team: DataFrame
    keywords: DataFrame | None = None


@dataclass(frozen=True)
class Recommendation:
    """``evidence`` is that of all candidates; ``evidence_of`` gives that of the ranked ones alone."""

    gaps: DataFrame
    candidates: Candidates
    evidence: DataFrame
    features: DataFrame
    ranked: DataFrame


def team_capabilities(graph: GraphTables, team: DataFrame) -> DataFrame:
    return team.select(*PAIR).distinct().join(
        graph.has_capability.select("person_id", "capability_id", "name"), "person_id"
    )


def gap_cover(requirements: DataFrame, team_caps: DataFrame) -> DataFrame:
    """(target_id, req, person_id): team members that cover a requirement by identifier or by name."""
    by_id = requirements.select("target_id", "req", "capability_id").join(
        team_caps.select("target_id", "capability_id", "person_id"), ["target_id", "capability_id"]
    )
    named = requirements.select("target_id", "req", F.lower(strip(F.col("name"))).alias("key"))
    by_name = named.join(
        team_caps.select("target_id", F.lower(strip(F.col("name"))).alias("key"), "person_id"), ["target_id", "key"]
    )
    columns = ["target_id", "req", "person_id"]
    return by_id.select(*columns).union(by_name.select(*columns)).distinct()


def capability_gaps(requirements: DataFrame, team_caps: DataFrame) -> DataFrame:
    """Requirements with is_covered and the number of covering members (``gap_cover`` lists them)."""
    covering = gap_cover(requirements, team_caps).groupBy("target_id", "req").agg(F.count(F.lit(1)).alias("n_covering"))
    joined = requirements.join(covering, ["target_id", "req"], "left")
    return joined.withColumn("n_covering", F.coalesce("n_covering", F.lit(0))).withColumn(
        "is_covered", F.col("n_covering") > 0
    )


def uncovered(gaps: DataFrame) -> DataFrame:
    return gaps.where(~F.col("is_covered"))


def gap_importance(gaps: DataFrame, uncovered_only: bool = True) -> DataFrame:
    """Summed importance per target."""
    chosen = uncovered(gaps) if uncovered_only else gaps
    return chosen.groupBy("target_id").agg(F.sum("importance").alias("importance"))


def default_requirements(matched_capabilities: DataFrame) -> DataFrame:
    """Requirements of a free-text target: the capabilities its keywords name, at a fixed importance."""
    return matched_capabilities.select(
        "target_id", F.col("capability_id").alias("req"), "capability_id", "name",
        F.lit(settings.LOOKUP_IMPORTANCE).alias("importance"), F.lit("capability_lookup").alias("source"),
    )


def target_profile(targets: Targets, gaps: DataFrame, team_caps: DataFrame) -> DataFrame:
    """All a target asks for, one row per (target_id, key): what the key stands for, and which open
    requirements it meets (by capability identifier, or by a lower-cased name that is an identifier)."""
    open_gaps = uncovered(gaps)
    meets = F.struct("req", "importance")
    none = F.lit(None).cast("struct<req:string,importance:double>")

    def rows(df: DataFrame, key: str, wanted: bool = False, domain: bool = False, required: bool = False, team: bool = False, gap=none):
        flags = {"wanted": wanted, "domain": domain, "required": required, "team": team}
        return df.select(
            "target_id", F.col(key).alias("key"), *[F.lit(v).alias(k) for k, v in flags.items()], gap.alias("gap")
        )

    required = targets.requirements.where(F.col("capability_id").isNotNull())
    parts = [
        rows(targets.domains, "domain_id", wanted=True, domain=True),
        rows(required, "capability_id", wanted=True, required=True),
        rows(team_caps, "capability_id", team=True),
        rows(open_gaps.where(F.col("capability_id").isNotNull()), "capability_id", gap=meets),
        rows(open_gaps.withColumn("key", F.lower(strip(F.col("name")))), "key", gap=meets),
    ]
    if targets.keywords is not None:
        parts.append(rows(targets.keywords, "keyword", wanted=True))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("target_id", "key").agg(
        *[F.bool_or(c).alias(c) for c in ("wanted", "domain", "required", "team")], F.collect_set("gap").alias("gaps")
    )


@dataclass(frozen=True)
class PersonTables:
    """What people show whatever the target, one pass over the graph for any number of targets.

    domains(person_id, domain_id) of all their projects, some target's domains at least; keys(person_id, key, own, both): capability identifiers (own)
    and their lower-cased forms, ``both`` where the key is also one of their domains; dates(person_id, n_able, last_year).
    """

    domains: DataFrame
    keys: DataFrame
    dates: DataFrame


def person_tables(graph: GraphTables, domains: DataFrame) -> PersonTables:
    """Tables of all people, written out; ``domains`` is ``person_domains`` of the same graph."""
    able = graph.has_capability.groupBy("person_id", "capability_id").agg(F.max(F.col("last_seen_year").cast("int")).alias("year"))
    lowered = able.where(F.col("capability_id") != F.lower("capability_id"))
    spelled = able.select("person_id", F.col("capability_id").alias("key"), F.lit(True).alias("own")).unionByName(
        lowered.select("person_id", F.lower("capability_id").alias("key"), F.lit(False).alias("own")))
    keys = spelled.groupBy("person_id", "key").agg(F.bool_or("own").alias("own"))
    shown = domains.select("person_id", F.col("domain_id").alias("key"), F.lit(True).alias("both"))
    keys = keys.join(shown, ["person_id", "key"], "left").withColumn("both", F.coalesce("both", F.lit(False)))
    published = graph.wrote.select("person_id", "project_id").join(graph.projects.select("project_id", "year"), "project_id")
    every = able.select("person_id", F.lit(1).alias("n"), "year").unionByName(
        published.select("person_id", F.lit(0).alias("n"), F.col("year").cast("int").alias("year")))
    dates = every.groupBy("person_id").agg(F.sum("n").alias("n_able"), F.max("year").alias("last_year"))
    made = stage_all({"person-keys": keys, "person-dates": dates})
    return PersonTables(domains, made["person-keys"], made["person-dates"])


def overlaps(profile: DataFrame, persons: PersonTables, pairs: DataFrame | None = None) -> DataFrame:
    """(target_id, person_id) with counts of the capabilities a person has that the target names, and the importance of
    the open requirements the person meets. Only common keys are joined; of what a person shows beside, sizes suffice.
    ``pairs`` are the candidates where they are few of all: only their keys are read then."""
    flags = profile.select("target_id", "key", "wanted", "domain", "required", "team").where("wanted OR domain OR required OR team")
    open_keys = profile.where(F.size("gaps") > 0).select("target_id", "key", "domain", "gaps")
    if pairs is not None:
        flags = pairs.select(*PAIR).distinct().join(flags, "target_id")
        open_keys = pairs.select(*PAIR).distinct().join(open_keys, "target_id")
    by = ["key"] if pairs is None else ["person_id", "key"]
    counts = persons.keys.where("own").join(flags, by).groupBy(*PAIR).agg(
        F.count_if("required").alias("n_required"), F.count_if("team").alias("n_team"),
        F.count_if(F.col("required") & ~F.col("team")).alias("n_required_new"), F.count_if("wanted").alias("n_wanted_able"),
        F.count_if(F.col("both") & F.col("domain")).alias("n_both"))
    meets = persons.keys.join(open_keys, by).select(*PAIR, "gaps").unionByName(
        persons.domains.withColumnRenamed("domain_id", "key").join(open_keys.where("domain"), by).select(*PAIR, "gaps"))
    met = F.array_distinct(F.flatten(F.collect_list("gaps")))
    gained = meets.groupBy(*PAIR).agg(F.aggregate(F.array_sort(met), F.lit(0.0), lambda total, m: total + m["importance"]).alias("gained"))
    return counts.join(gained, PAIR, "full_outer")


def compute_features(
    gaps: DataFrame, profile: DataFrame, persons: PersonTables, people: DataFrame, distance: DataFrame, few: bool = False
) -> DataFrame:
    """The seven features per candidate, each in [0, 1].

    Counts that do not depend on the target are read per person, matched domains were counted with the candidates, and
    what is left are keys that target and person have in common. ``few`` says that the people are few of all candidates.
    """
    sizes = profile.groupBy("target_id").agg(
        F.count_if("domain").alias("n_target_domains"), F.count_if("required").alias("n_target_required"),
        F.count_if("wanted").alias("n_wanted"),
    )
    importance = gap_importance(gaps).withColumnRenamed("importance", "open_importance")
    whole = (
        people.select(*PAIR, "n_domains").join(overlaps(profile, persons, people if few else None), PAIR, "left").join(distance.select(*PAIR, "hops"), PAIR, "left")
        .join(persons.dates, "person_id", "left").join(sizes, "target_id", "left").join(importance, "target_id", "left")
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    # matched domains are all wanted; one that is also a capability of the person counts once
    beside = zero("n_domains") - zero("n_both")
    return whole.select(
        *PAIR,
        share(zero("gained"), zero("open_importance")).alias("gap_match"),
        jaccard(zero("n_domains"), zero("n_domains"), zero("n_target_domains")).alias("domain_relevance"),
        share(zero("n_required"), zero("n_target_required")).alias("semantic"),
        F.when(zero("n_target_required") > 0, share(zero("n_required_new"), zero("n_required")))
        .otherwise(share(zero("n_able") - zero("n_team"), zero("n_able"))).alias("complementarity"),
        tversky(zero("n_wanted_able") + beside, zero("n_wanted"), zero("n_able") + beside).alias("project_similarity"),
        proximity(F.col("hops")).alias("graph"),
        recency(F.col("last_year")).alias("recency"),
    )


def rank_candidates(
    features: DataFrame,
    weights: dict[str, float] | None = None,
    top_k: int = settings.TOP_K,
    scorer: Scorer = linear_scorer,
) -> DataFrame:
    """Best ``top_k`` per target by total score, ties by person identifier.

    The ranking window carries the limit, so each task forwards at most ``top_k`` rows per target.
    """
    weights = settings.RANKING_WEIGHTS if weights is None else weights
    present = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in weights if n in features.columns}
    total, contributions = scorer(present, weights)
    scored = features.select(
        *features.columns, total.alias("total_score"), *[c.alias(f"contrib_{n}") for n, c in contributions.items()]
    )
    order = W.partitionBy("target_id").orderBy(F.desc("total_score"), F.asc("person_id"))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return best.withColumn("full_name", display_name(F.col("person_id"))).withColumn(
        "is_placeholder", is_placeholder(F.col("person_id"))
    )


def recommend(
    graph: GraphTables,
    targets: Targets,
    weights: dict[str, float] | None = None,
    top_k: int = settings.TOP_K,
    candidate_limit: int | None = None,
    by_matches: bool = True,
    closure: DataFrame | None = None,
) -> Recommendation:
    """Gaps, candidates, evidence, features and ranking for all targets at once.

    All candidates are scored unless ``candidate_limit`` cuts them per target. Their pairs with the targets are written
    out; matches and evidence are rows to be asked for, no feature needs them.
    """
    wanted = targets.domains.select("domain_id").distinct()
    shows = stage(person_domains(graph, closure, wanted), "person-domains")
    found = find_candidates(graph, targets.domains, targets.requirements, targets.team, candidate_limit, by_matches, shows=shows)
    first = stage_all({"team-caps": team_capabilities(graph, targets.team), "candidates": found.people})
    team_caps, people = first["team-caps"], first["candidates"]
    gaps = capability_gaps(targets.requirements, team_caps)
    second = stage_all({"gaps": gaps, "profile": target_profile(targets, gaps, team_caps)})
    gaps, profile = second["gaps"], second["profile"]
    candidates = Candidates(people, found.matches.join(people.select(*PAIR), PAIR, "left_semi"))
    evidence = candidate_evidence(graph, people, targets.domains, targets.requirements)
    distance = stage(coauthor_distance(graph.wrote, targets.team, people), "distance")
    features = stage(compute_features(gaps, profile, person_tables(graph, shows), people, distance), "features")
    return Recommendation(gaps, candidates, evidence, features, rank_candidates(features, weights, top_k))


def evidence_of(graph: GraphTables, ranked: DataFrame, targets: Targets) -> DataFrame:
    """Evidence of the ranked candidates; their own authorships are few and written out, so that joins know it."""
    people = ranked.select("person_id").distinct()
    own = stage_all({
        "ranked-wrote": graph.wrote.select("person_id", "project_id").join(people, "person_id", "left_semi"),
        "ranked-able": graph.has_capability.select("person_id", "capability_id", "name").join(people, "person_id", "left_semi"),
    })
    theirs = replace(graph, wrote=own["ranked-wrote"], has_capability=own["ranked-able"])
    return candidate_evidence(theirs, ranked.select(*PAIR), targets.domains, targets.requirements)


# ---------------------------------------------------------------------------
# Leave-one-author-out evaluation
# ---------------------------------------------------------------------------

def held_out_split(wrote: DataFrame, projects: DataFrame, min_authors: int) -> tuple[DataFrame, DataFrame]:
    """(held_out(target_id, person_id), team) for projects with enough authors; the first author is held out."""
    members = wrote.join(projects.select("project_id"), "project_id", "left_semi").select(
        F.col("project_id").alias("target_id"), "person_id", "pos"
    )
    first = members.groupBy("target_id").agg(
        F.min(F.struct("pos", "person_id")).alias("first"), F.count_distinct("person_id").alias("n")
    ).where(F.col("n") >= min_authors)
    held = first.select("target_id", F.col("first.person_id").alias("person_id"))
    team = members.select(*PAIR).join(first.select("target_id"), "target_id", "left_semi").join(held, PAIR, "left_anti")
    return held, team.distinct()


def leave_one_out(
    graph: GraphTables,
    closure: DataFrame,
    keywords: DataFrame | None = None,
    requirements: DataFrame | None = None,
    min_authors: int = 3,
    top_k: int = 10,
    limit_projects: int | None = None,
) -> DataFrame:
    """Rank of the first author of every project with enough authors, when the others look for a collaborator.

    keywords(project_id, keyword) and requirements(project_id, req, capability_id, name, importance, source)
    belong to the projects; a project without requirements is asked for by domains and keywords.
    ``limit_projects`` looks at the first projects by identifier only.
    """
    projects = graph.projects if limit_projects is None else project_page(graph.projects, limit=limit_projects)
    split = held_out_split(graph.wrote, projects, min_authors)
    chosen = stage_all({"held-out": split[0], "team": split[1]})
    held, team = chosen["held-out"], chosen["team"]

    def of_targets(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("project_id", "target_id").join(held.select("target_id"), "target_id", "left_semi")

    asked = {"domains": with_ancestors(of_targets(graph.project_domain), closure, ["target_id"])}
    if keywords is not None:
        asked["keywords"] = of_targets(keywords)
    none = graph.projects.sparkSession.createDataFrame(
        [], "project_id string, req string, capability_id string, name string, importance double, source string"
    )
    asked["requirements"] = of_targets(none if requirements is None else requirements)
    return evaluate_held_out(held, rank_held_out(graph, Targets(team=team, **stage_all(asked)), held, top_k))


def rank_held_out(graph: GraphTables, targets: Targets, held: DataFrame, top_k: int = settings.TOP_K) -> DataFrame:
    """The ranking of ``recommend`` as far as the held-out people's ranks depend on it.

    Held-out people are scored first. Targets whose held-out person ``top_k`` others surely outrank (``outranked``) are
    settled. Of the others it is looked up who is near them, and bounds tell who may come before the held-out person
    (``may_outrank``); only these pairs are scored.
    """
    first = stage_all({"person-domains": person_domains(graph), "team-caps": team_capabilities(graph, targets.team)})
    shows, team_caps = first["person-domains"], first["team-caps"]
    gaps = capability_gaps(targets.requirements, team_caps)
    second = stage_all({"gaps": gaps, "profile": target_profile(targets, gaps, team_caps)})
    gaps, profile = second["gaps"], second["profile"]
    persons = person_tables(graph, shows)
    edges = shared_edges(graph.wrote)

    def ranked(people: DataFrame, distance: DataFrame, k: int) -> DataFrame:
        return rank_candidates(compute_features(gaps, profile, persons, people, stage(distance, "distance"), few=True), top_k=k)

    people = stage(matched_pairs(held, profile, persons), "people")
    alone = stage(ranked(people, distance_of_few(edges, targets.team, people), 1).select(*PAIR, "total_score"), "held-scores")
    both = sides(profile, gap_importance(gaps), persons, alone)
    team = targets.team.select(*PAIR).distinct().join(alone.select("target_id"), "target_id", "left_semi")
    settled = outranked(both, team, top_k)
    both = replace(both, targets=both.targets.join(settled, "target_id", "left_anti"))
    near = near_people(graph.wrote, team.join(settled, "target_id", "left_anti"), settings.MAX_COAUTHOR_HOPS - 1, edges)
    found, lost = may_outrank(both, near.known, top_k)
    rivals = found.unionByName(alone.select(*PAIR).join(settled, "target_id", "left_anti"))
    pairs = stage(rivals.join(lost, "target_id", "left_anti"), "rivals")
    people = stage(matched_pairs(pairs, profile, persons), "people")
    open_ones = people.select("target_id").distinct()
    near = replace(near, known=near.known.join(open_ones, "target_id", "left_semi"), frontier=near.frontier.join(open_ones, "target_id", "left_semi"))
    return ranked(people, distance_of(people, near), top_k)


def matched_pairs(pairs: DataFrame, profile: DataFrame, persons: PersonTables) -> DataFrame:
    """Those of the pairs that are candidates, with their number of matched domains."""
    asked = pairs.select(*PAIR).distinct().join(profile.where("domain OR required").select("target_id", "key", "domain", "required"), "target_id")
    shown = asked.where("domain").join(persons.domains.withColumnRenamed("domain_id", "key"), ["person_id", "key"]).select(*PAIR, F.lit(1).alias("n"))
    able = asked.where("required").join(persons.keys.where("own"), ["person_id", "key"]).select(*PAIR, F.lit(0).alias("n"))
    return shown.unionByName(able).groupBy(*PAIR).agg(F.sum("n").alias("n_domains"))


def evaluate_held_out(held_out: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rank and reciprocal rank of each held-out author; NULL rank when not recommended."""
    found = ranked.select(*PAIR, "rank")
    joined = held_out.join(found, PAIR, "left")
    return joined.select(
        "target_id", F.col("person_id").alias("held_out"), "rank",
        F.round(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)), 4).alias("rr"),
    )


def hit_rates(details: DataFrame) -> DataFrame:
    """hit@1/3/5/10 and mean reciprocal rank over all evaluated targets."""
    reciprocal = F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))

    def rate(value):
        return F.coalesce(F.round(F.avg(value), 4), F.lit(0.0))

    hits = [
        rate(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in (1, 3, 5, 10)
    ]
    return details.agg(F.count(F.lit(1)).alias("total_evaluated"), *hits, rate(reciprocal).alias("mrr"))
