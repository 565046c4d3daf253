"""Property-graph lookups and traversals over vertex and edge tables."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.text import capability_id, is_placeholder, normalize, strip
from kinweave.session import stage, stage_all

PAIR = ["target_id", "person_id"]


@dataclass(frozen=True)
class GraphTables:
    """The collaboration graph as named DataFrames.

    projects(project_id, title, year, ...), authors(person_id, full_name),
    wrote(person_id, project_id, pos), project_domain(project_id, domain_id),
    domains(domain_id, name, name_fr), subdomain_of(child_id, parent_id),
    has_capability(person_id, capability_id, name, kind, last_seen_year, ...).
    """

    projects: DataFrame
    authors: DataFrame
    wrote: DataFrame
    project_domain: DataFrame
    domains: DataFrame
    subdomain_of: DataFrame
    has_capability: DataFrame | None = None

    def staged(self, *names: str, by: str | None = None) -> GraphTables:
        """A copy whose named tables are written out once and read many times, bucketed where a key is given."""
        chosen = names or [f.name for f in fields(self) if getattr(self, f.name) is not None]
        return replace(self, **stage_all({n: getattr(self, n) for n in chosen}, by))


# ---------------------------------------------------------------------------
# Hierarchy
# ---------------------------------------------------------------------------

def ancestor_closure(edges: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """All (domain_id, ancestor_id) pairs, any depth, cycles allowed.

    Each round joins the known pairs with themselves, so a chain of n edges closes in log2(n)
    rounds. It stops when a round finds nothing new. Each round is written out: the plan stays short.
    """
    known = stage(
        edges.select(F.col(child).alias("domain_id"), F.col(parent).alias("ancestor_id"))
        .where(F.col("domain_id").isNotNull() & F.col("ancestor_id").isNotNull())
        .distinct(),
        "closure",
    )
    while True:
        onward = known.select(F.col("domain_id").alias("ancestor_id"), F.col("ancestor_id").alias("further"))
        longer = known.join(onward, "ancestor_id").select("domain_id", F.col("further").alias("ancestor_id")).distinct()
        fresh = stage(longer.join(known, ["domain_id", "ancestor_id"], "left_anti"), "closure")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def with_ancestors(links: DataFrame, closure: DataFrame, keys: list[str]) -> DataFrame:
    """``links`` (keys + domain_id) plus one row per ancestor of each linked domain."""
    upper = links.join(closure, "domain_id").select(*keys, F.col("ancestor_id").alias("domain_id"))
    return links.select(*keys, "domain_id").unionByName(upper).distinct()


def ancestor_lists(closure: DataFrame) -> DataFrame:
    """Sorted ancestors per domain; their number is bounded by the depth of the taxonomy."""
    return closure.groupBy("domain_id").agg(F.array_sort(F.collect_set("ancestor_id")).alias("parent_ids"))


def project_domains(graph: GraphTables, closure: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Domains of a project, assigned ones and their ancestors, each with its own ancestor list."""
    links = graph.project_domain.select("project_id", "domain_id")
    if projects is not None:
        links = links.join(projects.select("project_id"), "project_id", "left_semi")
    named = with_ancestors(links, closure, ["project_id"]).join(graph.domains.select("domain_id", "name"), "domain_id")
    return _with_parents(named, closure).select("project_id", "domain_id", "name", "parent_ids")


def _with_parents(domains: DataFrame, closure: DataFrame) -> DataFrame:
    joined = domains.join(ancestor_lists(closure), "domain_id", "left")
    return joined.withColumn("parent_ids", F.coalesce("parent_ids", F.array().cast("array<string>")))


# ---------------------------------------------------------------------------
# Lookups
# ---------------------------------------------------------------------------

#: Rows one task may sort to find a page; pages further on are found by counts of ranges.
PAGE_ROWS = 10_000


def project_page(projects: DataFrame, limit: int = 100, offset: int = 0, page_rows: int = PAGE_ROWS) -> DataFrame:
    """One page of projects ordered by identifier.

    A page that ends beyond ``page_rows`` is not sorted out by one task that sees all rows before it. The projects are
    sorted by range and written with their place in their range; the sizes of the ranges tell which places the page
    holds, and only these are read.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be non-negative")
    if offset + limit <= page_rows:
        return projects.orderBy("project_id").offset(offset).limit(limit)
    ordered = projects.repartitionByRange("project_id").sortWithinPartitions("project_id")
    placed = stage(ordered.withColumn("_place", F.monotonically_increasing_id()), "project-ranges")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row per range
    wanted, before = F.lit(False), 0
    for row in sizes:
        low, high = max(offset - before, 0), min(offset + limit - before, row["n"])
        if low < high:
            first = row["part"] << 33
            wanted = wanted | F.col("_place").between(first + low, first + high - 1)
        before += row["n"]
    return placed.where(wanted).orderBy("_place").drop("_place")


def project_members(graph: GraphTables) -> DataFrame:
    """(project_id, person_id, full_name, is_placeholder) for every authorship."""
    people = graph.wrote.select("project_id", "person_id").join(graph.authors, "person_id", "left")
    return people.select(
        "project_id", "person_id",
        F.coalesce("full_name", F.lit("")).alias("full_name"),
        is_placeholder(F.col("person_id")).alias("is_placeholder"),
    )


def person_name(full_name: Column, first: Column, last: Column) -> Column:
    """The full name, or the non-empty name parts joined."""
    parts = F.concat_ws(" ", F.when(first != "", first), F.when(last != "", last))
    return F.when(full_name != "", full_name).otherwise(parts)


def author_projects(graph: GraphTables, full_name: str) -> DataFrame:
    """Publications of the authors of one exact full name."""
    people = graph.authors.where(F.col("full_name") == full_name).select("person_id")
    mine = graph.wrote.join(people, "person_id", "left_semi").select("project_id").distinct()
    return graph.projects.join(mine, "project_id", "left_semi").select("project_id", "title", "year")


def collaborators_by_title(graph: GraphTables, fragment: str) -> DataFrame:
    """(publication, co_author) rows for titles containing the fragment, repeated per authorship."""
    hits = graph.projects.where(F.contains("title", F.lit(fragment))).select("project_id", F.col("title").alias("publication"))
    people = graph.wrote.select("project_id", "person_id").join(hits, "project_id").join(graph.authors, "person_id")
    return people.select("publication", F.col("full_name").alias("co_author"))


def domains_by_keywords(domains: DataFrame, closure: DataFrame, keywords: list[str], french: bool = True) -> DataFrame:
    """Domains whose name, French name or code contains any keyword of two or more characters."""
    wanted = sorted({k.strip().lower() for k in keywords if len(k.strip()) >= 2})
    columns = ["name", "name_fr", "domain_id"] if french else ["name", "domain_id"]
    hit = F.lit(False)
    for column in columns:
        for keyword in wanted:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(keyword))
    return _with_parents(domains.where(hit).select("domain_id", "name"), closure)


def capabilities_by_terms(capabilities: DataFrame, terms: list[str]) -> DataFrame:
    """Capabilities named by a term: by slug, by normalised name, or by a normalised alias.

    Three equi joins united, since one join on alternatives would compare every pair.
    """
    spark = capabilities.sparkSession
    given = [(t,) for t in terms if t and t.strip()]
    words = spark.createDataFrame(given, "term string").select(
        capability_id(F.col("term")).alias("slug"), normalize(F.col("term")).alias("norm")
    ).distinct()
    rows = capabilities.select("capability_id", "name", "aliases")
    by_id = rows.join(words, F.col("capability_id") == F.col("slug"), "left_semi")
    by_name = rows.withColumn("key", normalize(F.coalesce("name", F.lit("")))).join(words, F.col("key") == F.col("norm"), "left_semi")
    spelled = rows.select("capability_id", F.explode("aliases").alias("alias")).withColumn("key", normalize(F.col("alias")))
    by_alias = spelled.join(words, F.col("key") == F.col("norm"), "left_semi")
    hits = reduce(DataFrame.union, [d.select("capability_id") for d in (by_id, by_name, by_alias)]).distinct()
    return capabilities.join(hits, "capability_id", "left_semi")


# ---------------------------------------------------------------------------
# Co-authorship
# ---------------------------------------------------------------------------

def _coauthors(people: DataFrame, wrote: DataFrame, keys: list[str]) -> DataFrame:
    """People sharing a project with ``people`` (the people themselves included).

    Goes person -> project -> person with a distinct in between: the work is linear in the
    authorships touched, and no pair list of a project's members is ever built.
    """
    edges = wrote.select("person_id", "project_id")
    reached = people.join(edges, "person_id").select(*keys, "project_id").distinct()
    return reached.join(edges, "project_id").select(*keys, "person_id").distinct()


def coauthor_distance(
    wrote: DataFrame, team: DataFrame, people: DataFrame | None = None, max_hops: int = settings.MAX_COAUTHOR_HOPS
) -> DataFrame:
    """Fewest co-authorship hops from each person to a team, (target_id, person_id, hops).

    ``team`` is (target_id, person_id); members have 0 hops; people further than ``max_hops`` get no row. With
    ``people`` given (a written table), only they are looked at and the last hop is walked from the smaller side.
    """
    if people is None:
        return near_people(wrote, team, max_hops).known
    return distance_of(people, near_people(wrote, team, max_hops - 1), max_hops)


@dataclass(frozen=True)
class Near:
    """edges(person_id, project_id) of shared projects, known(target_id, person_id, hops) of all people within some
    hops of a team, team included, and frontier(target_id, person_id), those of them at the last of these hops."""

    edges: DataFrame
    known: DataFrame
    frontier: DataFrame


def shared_edges(wrote: DataFrame) -> DataFrame:
    """(person_id, project_id), written out, without projects of a single person: they lead nowhere."""
    shared = wrote.groupBy("project_id").agg(F.min("person_id").alias("a"), F.max("person_id").alias("b")).where("a <> b").select("project_id")
    return stage(wrote.select("person_id", "project_id").join(shared, "project_id", "left_semi"), "shared-projects")


def near_people(wrote: DataFrame, team: DataFrame, hops: int, edges: DataFrame | None = None) -> Near:
    """People within ``hops`` of each team. Each hop is written out, so that the next one does not walk the earlier ones
    again. ``edges`` are ``shared_edges`` known already."""
    edges = shared_edges(wrote) if edges is None else edges
    frontier = team.select(*PAIR).distinct()
    known = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, hops + 1):
        frontier = stage(_coauthors(frontier, edges, ["target_id"]).join(known, PAIR, "left_anti"), "hop")
        known = known.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return Near(edges, known, frontier)


def distance_of_few(edges: DataFrame, team: DataFrame, people: DataFrame, max_hops: int = settings.MAX_COAUTHOR_HOPS) -> DataFrame:
    """``distance_of`` for few people a target: a hop is walked only for targets with people not met so far."""
    reached = team.select(*PAIR).distinct()
    asked = people.select(*PAIR).distinct()
    out = asked.join(reached, PAIR).withColumn("hops", F.lit(0))
    left, known = stage(asked.join(reached, PAIR, "left_anti"), "far"), reached
    for hop in range(1, max_hops + 1):
        if left.isEmpty():
            break
        mine = reached.join(left.select("target_id").distinct(), "target_id", "left_semi")
        reached = stage(_coauthors(mine, edges, ["target_id"]).join(known, PAIR, "left_anti"), "hop")
        known = known.unionByName(reached)
        out = out.unionByName(left.join(reached, PAIR, "left_semi").withColumn("hops", F.lit(hop)))
        left = stage(left.join(reached, PAIR, "left_anti"), "far")
    return out


def distance_of(people: DataFrame, near: Near, max_hops: int = settings.MAX_COAUTHOR_HOPS) -> DataFrame:
    """Hops of these (target_id, person_id), written out before, from what lies within ``max_hops - 1``.

    Others are at the last hop when a project of theirs has a member at the hop before. That step is walked from the side
    with fewer rows, the other side only answers whether it holds what was met.
    """
    asked = people.select(*PAIR).distinct()
    found = asked.join(near.known, PAIR)
    far = stage(asked.join(near.known, PAIR, "left_anti"), "far")
    if near.frontier.count() < far.count():
        last = far.join(_coauthors(near.frontier, near.edges, ["target_id"]), PAIR, "left_semi")
    else:
        theirs = far.join(near.edges, "person_id")
        met = theirs.select("target_id", "project_id").distinct().join(near.edges, "project_id").join(near.frontier, PAIR, "left_semi")
        last = theirs.join(met.select("target_id", "project_id").distinct(), ["target_id", "project_id"], "left_semi").select(*PAIR).distinct()
    return found.unionByName(last.withColumn("hops", F.lit(max_hops)))


# ---------------------------------------------------------------------------
# Candidates and their evidence
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Candidates:
    """people(target_id, person_id, n_caps, n_domains), matches(target_id, person_id, kind, id)."""

    people: DataFrame
    matches: DataFrame


def person_domains(graph: GraphTables, closure: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Distinct (person_id, domain_id) over all projects; with ``closure`` the ancestors of their domains too.

    Of ``wanted`` (domain_id) only, where given: each domain is mapped to the wanted ones it stands for before any
    project is looked at, so that neither other domains nor repeated ancestors are moved.
    """
    links = graph.project_domain.select("project_id", "domain_id")
    if wanted is not None:
        stands = wanted.select("domain_id", F.col("domain_id").alias("for"))
        if closure is not None:
            upper = closure.join(wanted.select(F.col("domain_id").alias("ancestor_id")), "ancestor_id", "left_semi")
            stands = stands.unionByName(upper.select("domain_id", F.col("ancestor_id").alias("for")))
        links = links.join(stands.distinct(), "domain_id").select("project_id", F.col("for").alias("domain_id"))
        if closure is not None:
            links = links.distinct()
    elif closure is not None:
        links = with_ancestors(links, closure, ["project_id"])
    return graph.wrote.select("person_id", "project_id").join(links, "project_id").select("person_id", "domain_id").distinct()


def find_candidates(
    graph: GraphTables,
    wanted_domains: DataFrame,
    wanted_capabilities: DataFrame,
    excluded: DataFrame,
    limit: int | None = None,
    by_matches: bool = True,
    closure: DataFrame | None = None,
    shows: DataFrame | None = None,
) -> Candidates:
    """People with a project in a wanted domain or with a wanted capability, team left out; all of them unless ``limit`` is given.

    ``by_matches`` orders by matched capabilities, matched domains, identifier; otherwise by
    identifier alone. ``closure`` also counts the ancestors of a project's domains as matches.
    ``shows`` are ``person_domains`` known already, of the wanted domains at least.
    """
    wanted = wanted_domains.select("target_id", "domain_id").distinct()
    shows = person_domains(graph, closure, wanted.select("domain_id").distinct()) if shows is None else shows
    in_domain = wanted.join(shows, "domain_id").select(
        "target_id", "person_id", F.lit("domain").alias("kind"), F.col("domain_id").alias("id"))
    able = (
        wanted_capabilities.select("target_id", "capability_id").where(F.col("capability_id").isNotNull()).distinct()
        .join(graph.has_capability.select("person_id", "capability_id").distinct(), "capability_id")
        .select("target_id", "person_id", F.lit("capability").alias("kind"), F.col("capability_id").alias("id"))
    )
    pair = ["target_id", "person_id"]
    # both sides of each join are distinct, so are the matches
    matches = in_domain.unionByName(able).join(excluded.select(*pair).distinct(), pair, "left_anti")
    counted = matches.groupBy(*pair).agg(
        F.count_if(F.col("kind") == "capability").alias("n_caps"), F.count_if(F.col("kind") == "domain").alias("n_domains")
    )
    if limit is None:
        return Candidates(counted, matches)
    order = [F.desc("n_caps"), F.desc("n_domains"), F.asc("person_id")] if by_matches else [F.asc("person_id")]
    ranked = counted.withColumn("place", F.row_number().over(W.partitionBy("target_id").orderBy(*order)))
    people = ranked.where(F.col("place") <= limit).drop("place")
    return Candidates(people, matches)


def candidate_evidence(
    graph: GraphTables,
    people: DataFrame,
    wanted_domains: DataFrame,
    wanted_capabilities: DataFrame,
) -> DataFrame:
    """Evidence rows (target_id, person_id, kind, id, text, project_id, year, ord).

    All projects of a person, each wanted domain once (at the first project that has it), and each
    wanted capability. ``ord`` sorts them: every project, then its domains, capabilities last.

    What a person shows is joined before the targets are: rows multiply by the targets last, on their way out.
    """
    works = _works(graph, people).select("person_id", "project_id", "title", "year")
    pid = F.col("project_id")
    projects = people.select(*PAIR).join(works, "person_id").select(
        *PAIR, F.lit("project").alias("kind"), pid.alias("id"),
        F.when(F.col("title") != "", F.col("title")).otherwise(pid).alias("text"),
        pid, "year", _order(0, pid, 0, pid).alias("ord"),
    )
    return projects.unionByName(_matched_evidence(graph, people, wanted_domains, wanted_capabilities))


def _order(section: int, anchor: Column, slot: int, key: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), anchor.alias("anchor"), F.lit(slot).alias("slot"), key.alias("key"))


def _works(graph: GraphTables, people: DataFrame) -> DataFrame:
    """Authorships of these people with the project's title and year, whatever the targets."""
    mine = graph.wrote.select("person_id", "project_id").join(people.select("person_id").distinct(), "person_id", "left_semi")
    return mine.join(graph.projects.select("project_id", "title", "year"), "project_id")


def _matched_evidence(graph: GraphTables, people: DataFrame, wanted_domains: DataFrame, wanted_capabilities: DataFrame) -> DataFrame:
    """The evidence rows of wanted domains and capabilities, at most one per candidate and wanted key."""
    wanted = wanted_domains.select("target_id", "domain_id").distinct()
    links = graph.project_domain.select("project_id", "domain_id").join(wanted.select("domain_id").distinct(), "domain_id", "left_semi")
    first = (
        _works(graph, people).select("person_id", "project_id", "year").join(links, "project_id")
        .groupBy("person_id", "domain_id").agg(F.min(F.struct("project_id", "year")).alias("first"))
    )
    placed = (
        first.join(wanted, "domain_id").join(people.select(*PAIR).distinct(), PAIR)
        .join(graph.domains.select("domain_id", "name"), "domain_id", "left")
    )
    domains = placed.select(
        *PAIR, F.lit("domain").alias("kind"), F.col("domain_id").alias("id"),
        F.when(F.col("name") != "", F.col("name")).otherwise(F.col("domain_id")).alias("text"),
        F.col("first.project_id"), F.col("first.year"),
        _order(0, F.col("first.project_id"), 1, F.col("domain_id")).alias("ord"),
    )
    asked = wanted_capabilities.select("target_id", "capability_id").where(F.col("capability_id").isNotNull()).distinct()
    able = (
        graph.has_capability.select("person_id", "capability_id", "name").join(asked, "capability_id")
        .join(people.select(*PAIR).distinct(), PAIR, "left_semi")
        .groupBy(*PAIR, "capability_id").agg(F.min("name").alias("name"))
    )
    capabilities = able.select(
        *PAIR, F.lit("capability").alias("kind"), F.col("capability_id").alias("id"),
        F.when(F.col("name") != "", F.col("name")).otherwise(F.col("capability_id")).alias("text"),
        F.lit(None).cast("string").alias("project_id"), F.lit(None).cast("int").alias("year"),
        _order(1, F.lit(""), 0, F.col("capability_id")).alias("ord"),
    )
    return domains.unionByName(capabilities)


def evidence_ids(evidence: DataFrame) -> DataFrame:
    """Distinct identifiers per candidate with the place of their first appearance."""
    return evidence.where(F.col("id") != "").groupBy("target_id", "person_id", "id").agg(F.min("ord").alias("ord"))


def candidate_evidence_ids(graph: GraphTables, people: DataFrame, wanted_domains: DataFrame, wanted_capabilities: DataFrame) -> DataFrame:
    """``evidence_ids`` of ``candidate_evidence`` without gathering the projects of each candidate anew for every target.

    A person's projects are made distinct once, before the targets are joined. Only identifiers that are a project's and
    also a wanted domain's or capability's can meet twice; they alone are gathered per candidate.
    """
    matched = stage(_matched_evidence(graph, people, wanted_domains, wanted_capabilities).select(*PAIR, "id", "ord"), "matched")
    works = _works(graph, people).where(F.col("project_id") != "").select("person_id", F.col("project_id").alias("id"))
    both = stage(matched.select("id").distinct().join(graph.projects.select(F.col("project_id").alias("id")), "id", "left_semi"), "both-kinds")
    place = _order(0, F.col("id"), 0, F.col("id")).alias("ord")
    asked = people.select(*PAIR).distinct()
    single = asked.join(works.join(both, "id", "left_anti").distinct(), "person_id").select(*PAIR, "id", place)
    met = asked.join(works.join(both, "id", "left_semi").distinct(), "person_id").select(*PAIR, "id", place)
    return single.unionByName(evidence_ids(matched.unionByName(met)))


def evidence_by_kind(evidence: DataFrame) -> DataFrame:
    """Number of evidence rows per candidate and kind."""
    return evidence.groupBy("target_id", "person_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("project", "domain", "capability")]
    )


def candidate_evidence_by_kind(graph: GraphTables, people: DataFrame, wanted_domains: DataFrame, wanted_capabilities: DataFrame) -> DataFrame:
    """``evidence_by_kind`` of ``candidate_evidence``; projects are counted per person, whatever the targets."""
    matched = evidence_by_kind(_matched_evidence(graph, people, wanted_domains, wanted_capabilities))
    # a candidate listed twice has its projects twice
    asked = people.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("times"))
    works = _works(graph, people).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    counted = asked.join(works, "person_id", "left").join(matched.drop("n_project"), PAIR, "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    rows = counted.select(*PAIR, (F.col("times") * zero("n")).alias("n_project"), zero("n_domain").alias("n_domain"), zero("n_capability").alias("n_capability"))
    return rows.where("n_project + n_domain + n_capability > 0")
