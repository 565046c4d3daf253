"""Checks of the research-domain taxonomy.

domains(ord, id, name, name_fr), edges(ord, child_id, parent_id), associations(domain_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions.text import SPACE, strip
from kinweave.session import stage


def _code(column: str) -> Column:
    return strip(F.col(column))


def valid_domains(domains: DataFrame) -> DataFrame:
    """Distinct non-blank identifiers."""
    return domains.select(_code("id").alias("domain_id")).where(F.col("domain_id") != "").distinct()


def complete_edges(edges: DataFrame) -> DataFrame:
    """Edges with both endpoints given, repeats kept."""
    rows = edges.select("ord", _code("child_id").alias("child_id"), _code("parent_id").alias("parent_id"))
    return rows.where((F.col("child_id") != "") & (F.col("parent_id") != ""))


def inner_edges(domains: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between known domains."""
    known = valid_domains(domains)
    pairs = complete_edges(edges).select("child_id", "parent_id").distinct()
    pairs = pairs.join(known.withColumnRenamed("domain_id", "child_id"), "child_id", "left_semi")
    return pairs.join(known.withColumnRenamed("domain_id", "parent_id"), "parent_id", "left_semi").select("child_id", "parent_id")


def cycle_core(pairs: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: those left after peeling, round by round, all domains without a parent or a child."""
    left = stage(pairs.select("child_id", "parent_id").distinct(), "core")
    count = left.count()
    while count:
        parents = left.select(F.col("parent_id").alias("child_id")).distinct()
        children = left.select(F.col("child_id").alias("parent_id")).distinct()
        kept = stage(left.join(parents, "child_id", "left_semi").join(children, "parent_id", "left_semi").select("child_id", "parent_id"), "core")
        now = kept.count()
        if now == count:
            break
        left, count = kept, now
    return left


def _spread(edges: DataFrame, found: DataFrame, low: bool) -> DataFrame:
    """found(domain_id, label) carried along edges(source, target); with ``low`` every domain takes the least label that
    reaches it, else domains without a label take the one that reaches them. Only fresh labels are joined in each round."""
    known, fresh = found, found
    while True:
        told = fresh.join(edges, fresh["domain_id"] == edges["source"]).groupBy(F.col("target").alias("domain_id")).agg(F.min("label").alias("told"))
        better = told.join(known, "domain_id", "left").where("label IS NULL OR told < label" if low else "label IS NULL")
        fresh = stage(better.select("domain_id", F.col("told").alias("label")), "fresh")
        if fresh.isEmpty():
            return known
        known = stage(known.join(fresh, "domain_id", "left_anti").unionByName(fresh), "labels")


def cyclic_components(pairs: DataFrame) -> DataFrame:
    """(component_id, domain_id): strongly connected domains that lie on a cycle, named after their smallest.

    Peeling leaves the cycles and what lies between them. Each domain is then coloured by the smallest one that
    leads down to it. Whoever leads back up to that smallest one within its colour belongs to its component. These
    are taken out, and the rest is peeled and coloured again.
    """
    parts = []
    left = cycle_core(pairs)
    loops = pairs.where("child_id = parent_id").select(F.col("child_id").alias("component_id")).distinct()
    while not left.isEmpty():
        down = left.select(F.col("parent_id").alias("source"), F.col("child_id").alias("target"))
        own = down.select(F.explode(F.array("source", "target")).alias("domain_id")).distinct().withColumn("label", F.col("domain_id"))
        colours = _spread(down, stage(own, "labels"), True)
        ends = colours.select(F.col("domain_id").alias("source"), F.col("label").alias("own"))
        inside = down.join(ends, "source").join(ends.withColumnsRenamed({"source": "target", "own": "other"}), "target").where("own = other")
        up = stage(inside.select(F.col("target").alias("source"), F.col("source").alias("target")), "inside")
        found = _spread(up, stage(colours.where("domain_id = label"), "labels"), False)
        parts.append(found.select(F.col("label").alias("component_id"), "domain_id"))
        done = found.select("domain_id")
        left = cycle_core(left.join(done.withColumnRenamed("domain_id", "child_id"), "child_id", "left_anti").join(
            done.withColumnRenamed("domain_id", "parent_id"), "parent_id", "left_anti"))
    if not parts:
        return pairs.limit(0).select(F.col("parent_id").alias("component_id"), F.col("child_id").alias("domain_id"))
    every = stage(reduce(DataFrame.unionByName, parts), "components")
    several = every.groupBy("component_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("component_id")
    return every.join(several.union(loops).distinct(), "component_id", "left_semi")


def cycles(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """(component_id, size, cycle): one shortest cycle from parent to child through the smallest domain of each component.

    ``cycle`` lists the domains from the smallest back to it; of equally short ones it is the first in order.
    Distances back to the smallest domain are spread upwards, one step a round, then one walk for each component
    goes down along them.
    """
    members = stage(components, "members")
    ends = members.select(F.col("domain_id").alias("parent_id"), "component_id")
    inner = stage(pairs.join(ends, "parent_id").join(members.withColumnRenamed("domain_id", "child_id"), ["child_id", "component_id"]).select(
        "component_id", "parent_id", "child_id"), "inner")
    # far: steps from a domain down to the smallest of its component, at least one
    far = stage(inner.where("child_id = component_id").select("component_id", F.col("parent_id").alias("domain_id"), F.lit(1).alias("far")).distinct(), "far")
    known, step = far, 1
    while not far.isEmpty():
        step += 1
        reached = inner.join(far.select("component_id", F.col("domain_id").alias("child_id")), ["component_id", "child_id"]).select(
            "component_id", F.col("parent_id").alias("domain_id")).distinct()
        far = stage(reached.join(known, ["component_id", "domain_id"], "left_anti").withColumn("far", F.lit(step)), "far")
        known = known.unionByName(far)
    known = stage(known, "distances")
    start = known.where("domain_id = component_id").select("component_id", F.col("domain_id").alias("at"), "far", F.array("domain_id").alias("cycle"))
    walks, closed = stage(start, "walks"), []
    while True:
        last = walks.where("far = 1")
        closed.append(last.select("component_id", F.concat("cycle", F.array("component_id")).alias("cycle")))
        onward = walks.where("far > 1").join(inner, (F.col("at") == F.col("parent_id")) & (walks["component_id"] == inner["component_id"])).select(
            walks["component_id"], "far", "cycle", "child_id")
        nearer = known.select(F.col("component_id"), F.col("domain_id").alias("child_id"), (F.col("far") + 1).alias("far"))
        stepped = onward.join(nearer, ["component_id", "child_id", "far"]).groupBy("component_id").agg(
            F.min("child_id").alias("at"), F.min("far").alias("far"), F.first("cycle").alias("cycle"))
        walks = stage(stepped.select("component_id", "at", (F.col("far") - 1).alias("far"), F.concat("cycle", F.array("at")).alias("cycle")), "walks")
        if walks.isEmpty():
            break
    sizes = members.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))
    return reduce(DataFrame.unionByName, closed).join(sizes, "component_id").select("component_id", "size", "cycle")


def cyclic_domains(components: DataFrame) -> DataFrame:
    """Domains that are their own ancestor."""
    return components.select("domain_id").distinct()


def domain_levels(domains: DataFrame, pairs: DataFrame, components: DataFrame) -> DataFrame:
    """(domain_id, levels): length of the longest way up to a root, counted in domains.

    A cyclic domain counts as a root. Domains are peeled from the roots: one whose parents all have their
    level gets its own, so each edge is joined once, in the round after its parent.
    """
    cyclic = cyclic_domains(components).withColumnRenamed("domain_id", "child_id")
    steps = stage(pairs.join(cyclic, "child_id", "left_anti"), "steps")
    open_ = steps.groupBy(F.col("child_id").alias("domain_id")).agg(F.count(F.lit(1)).alias("open"))
    waiting = stage(open_.withColumn("levels", F.lit(1)), "waiting")
    ready = stage(valid_domains(domains).join(waiting, "domain_id", "left_anti").withColumn("levels", F.lit(1)), "ready")
    done = [ready]
    while not ready.isEmpty():
        told = steps.join(ready.withColumnRenamed("domain_id", "parent_id"), "parent_id").groupBy(F.col("child_id").alias("domain_id")).agg(
            F.count(F.lit(1)).alias("told"), (F.max("levels") + 1).alias("above"))
        waiting = stage(waiting.where("open > 0").join(told, "domain_id", "left").select(
            "domain_id", (F.col("open") - F.coalesce("told", F.lit(0))).alias("open"),
            F.greatest("levels", F.coalesce("above", F.lit(1))).alias("levels")), "waiting")
        ready = waiting.where("open = 0").select("domain_id", "levels")
        done.append(ready)
    return reduce(DataFrame.unionByName, done)


def orphan_domains(domains: DataFrame, edges: DataFrame, associations: DataFrame) -> DataFrame:
    pairs = complete_edges(edges)
    used = reduce(DataFrame.union, [
        associations.select(_code("domain_id").alias("domain_id")),
        pairs.select(F.col("child_id").alias("domain_id")), pairs.select(F.col("parent_id").alias("domain_id")),
    ]).distinct()
    return valid_domains(domains).join(used, "domain_id", "left_anti")


def missing_endpoints(domains: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an endpoint that is blank, or absent from the domains."""
    known = valid_domains(domains)
    rows = edges.select("ord", _code("child_id").alias("child_id"), _code("parent_id").alias("parent_id"))
    given = (F.coalesce(F.col("child_id"), F.lit("")) != "") & (F.coalesce(F.col("parent_id"), F.lit("")) != "")
    blank = rows.where(~given).withColumn("reason", F.lit("blank"))
    full = rows.where(given)
    no_child = full.join(known.withColumnRenamed("domain_id", "child_id"), "child_id", "left_anti")
    no_parent = full.join(known.withColumnRenamed("domain_id", "parent_id"), "parent_id", "left_anti")
    columns = ["ord", "child_id", "parent_id"]
    absent = no_child.select(*columns).union(no_parent.select(*columns)).distinct().withColumn("reason", F.lit("absent"))
    return blank.unionByName(absent)


def prefix_violations(edges: DataFrame) -> DataFrame:
    """Edges whose parent is not a dotted prefix of the child."""
    rows = complete_edges(edges)
    proper = (F.col("child_id") != F.col("parent_id")) & F.startswith("child_id", F.concat("parent_id", F.lit(".")))
    return rows.where(~proper)


def duplicate_edges(edges: DataFrame) -> DataFrame:
    counted = complete_edges(edges).groupBy("child_id", "parent_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > 1)


def excessive_depth(levels: DataFrame, max_levels: int = settings.MAX_DOMAIN_LEVELS) -> DataFrame:
    if max_levels < 1:
        raise ValueError("max_levels must be at least 1.")
    return levels.where(F.col("levels") > max_levels)


def malformed_ids(domains: DataFrame) -> DataFrame:
    """Blank identifiers, and those with white space or an empty dotted segment."""
    rows = domains.select("ord", F.coalesce(_code("id"), F.lit("")).alias("id"))
    blank = F.col("id") == ""
    odd = F.col("id").rlike(f"(?U){SPACE}") | F.exists(F.split("id", r"\."), lambda p: p == "")
    reason = F.when(blank, "blank").when(odd, "malformed")
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull())


def malformed_names(domains: DataFrame) -> DataFrame:
    """(ord, domain_id, language): blank or missing names; an absent or empty French name is fine."""
    rows = domains.select("ord", _code("id").alias("domain_id"), "name", "name_fr").where(F.col("domain_id") != "")
    english = F.when(F.coalesce(strip(F.col("name")), F.lit("")) == "", F.lit("name"))
    french = F.when((F.col("name_fr") != "") & (strip(F.col("name_fr")) == ""), F.lit("name_fr"))
    found = F.filter(F.array(english, french), lambda x: x.isNotNull())
    return rows.select("ord", "domain_id", F.explode(found).alias("language"))


def duplicate_domains(domains: DataFrame) -> DataFrame:
    rows = domains.select(_code("id").alias("domain_id")).where(F.col("domain_id") != "")
    return rows.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unknown_associations(domains: DataFrame, associations: DataFrame) -> DataFrame:
    linked = associations.select(_code("domain_id").alias("domain_id")).where(F.col("domain_id") != "").distinct()
    return linked.join(valid_domains(domains), "domain_id", "left_anti")


def all_checks(domains: DataFrame, edges: DataFrame, associations: DataFrame, max_levels: int = settings.MAX_DOMAIN_LEVELS) -> dict[str, DataFrame]:
    """The ten checks in report order; ``cycles`` has one row for each component of cyclic domains."""
    pairs = stage(inner_edges(domains, edges), "edges")
    components = stage(cyclic_components(pairs), "components")
    return {
        "orphan_domains": orphan_domains(domains, edges, associations),
        "missing_hierarchy_endpoints": missing_endpoints(domains, edges),
        "dotted_prefix_parent_rules": prefix_violations(edges),
        "duplicate_hierarchy_edges": duplicate_edges(edges),
        "cycles": cycles(pairs, components),
        "maximum_depth": excessive_depth(domain_levels(domains, pairs, components), max_levels),
        "malformed_domain_ids": malformed_ids(domains),
        "malformed_domain_names": malformed_names(domains),
        "duplicate_domain_ids": duplicate_domains(domains),
        "unknown_project_domain_associations": unknown_associations(domains, associations),
    }


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, status, finding_count) per check."""
    rows = reduce(DataFrame.unionAll, [
        found.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("finding_count")) for name, found in checks.items()
    ])
    return rows.select("name", F.when(F.col("finding_count") > 0, "findings").otherwise("pass").alias("status"), "finding_count")
