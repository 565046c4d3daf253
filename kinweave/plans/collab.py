"""The collaboration graph seen in the order tables.

A project is what one supplier ships on one day; its authors are the customers whose orders it
holds. Parts give the research domains (type, and brand below type) and the capabilities (part
name). Customers in debt stand for authors without a usable identifier. Whole tables throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.capability import aggregate_capabilities, evidence_rows, gate
from kinweave.operators.graph import GraphTables, ancestor_closure, with_ancestors
from kinweave.operators.recommend import Targets
from kinweave.session import buckets, stage, stage_all, stage_by

REFERENCE_YEAR = 2001
TARGET_COUNT = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def person_id(name: Column, balance: Column) -> Column:
    return F.when(balance < 0, F.concat(F.lit("unknown_"), name)).otherwise(F.lower(F.replace(name, F.lit("#"), F.lit("-"))))


def root_code(part_type: Column) -> Column:
    return F.lower(part_type)


def leaf_code(part_type: Column, brand: Column) -> Column:
    return F.concat(F.lower(part_type), F.lit("."), F.lower(F.replace(brand, F.lit("#"), F.lit("-"))))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey"), person_id(F.col("c_name"), F.col("c_acctbal")).alias("person_id"), F.col("c_name").alias("full_name")
    )


def facts(spark: SparkSession, sf_dir: str, by_project: bool = False) -> DataFrame:
    """One row per order line, with its project, author, domain codes and capability.

    ``by_project`` brings the lines of a project together while rows are still narrow; other columns are made after that.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    # customers meet the orders, of which there are fewer than lines
    placed = orders.join(people(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "person_id")
    joined = (
        lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.lit("S"), F.col("l_suppkey"), F.lit("-"), F.date_format("l_shipdate", "yyyyMMdd")).alias("project_id"),
            F.year("l_shipdate").alias("year"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"),
            "l_discount", "l_returnflag", "person_id", "p_name", "p_type", "p_brand",
        )
    )
    if by_project:
        joined = joined.repartition(buckets(spark), "project_id")
    return joined.select(
        "project_id", "year", "person_id", "pos",
        leaf_code(F.col("p_type"), F.col("p_brand")).alias("leaf"),
        root_code(F.col("p_type")).alias("root"),
        "l_returnflag", "p_name", "p_brand", "l_discount",
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("capability_id"),
        (1 - F.col("l_discount")).alias("confidence"),
    )


def evidences(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id", "capability_id").agg(F.max("confidence").alias("confidence"))


def base_graph(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> GraphTables:
    """All tables but has_capability, lazily."""
    rows = facts(spark, sf_dir) if rows is None else rows
    parts = table(spark, sf_dir, "part")
    root, leaf = root_code(F.col("p_type")), leaf_code(F.col("p_type"), F.col("p_brand"))
    roots = parts.select(root.alias("domain_id"), F.col("p_type").alias("name"))
    leaves = parts.select(leaf.alias("domain_id"), F.concat_ws(" ", "p_type", "p_brand").alias("name"))
    codes = F.when(F.col("l_returnflag") == "R", F.array("leaf", "root")).otherwise(F.array("leaf"))
    links = rows.select("project_id", F.explode(codes).alias("domain_id"))
    return GraphTables(
        projects=rows.groupBy("project_id").agg(
            F.concat(F.lit("Shipment of "), F.min("p_name")).alias("title"), F.min("year").alias("year")
        ),
        authors=people(spark, sf_dir).select("person_id", "full_name"),
        wrote=rows.groupBy("person_id", "project_id").agg(F.min("pos").alias("pos")),
        project_domain=links.distinct(),
        domains=roots.union(leaves).distinct().withColumn("name_fr", F.lit("")),
        subdomain_of=parts.select(leaf.alias("child_id"), root.alias("parent_id")).distinct(),
    )


def aggregates(graph: GraphTables, rows: DataFrame) -> DataFrame:
    evidence = evidence_rows(graph.wrote, evidences(rows), graph.projects)
    return aggregate_capabilities(evidence, REFERENCE_YEAR)


def full_graph(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> GraphTables:
    rows = facts(spark, sf_dir) if rows is None else rows
    graph = base_graph(spark, sf_dir, rows)
    able = gate(aggregates(graph, rows)).withColumn("name", F.replace("capability_id", F.lit("_"), F.lit(" ")))
    return GraphTables(**{**graph.__dict__, "has_capability": able.withColumn("kind", F.lit("UNKNOWN"))})


def staged_graph(spark: SparkSession, sf_dir: str, able: bool = True) -> tuple[GraphTables, DataFrame]:
    """The graph with its edge tables written once, plus the rows it came from; all bucketed by project, so that only
    what is gathered by person is moved again."""
    rows = stage_by(facts(spark, sf_dir, by_project=True), "project_id", "facts")
    base = base_graph(spark, sf_dir, rows).staged("wrote", "projects", "project_domain", by="project_id")
    if not able:
        return base, rows
    known = gate(aggregates(base, rows)).withColumn("name", F.replace("capability_id", F.lit("_"), F.lit(" ")))
    return GraphTables(**{**base.__dict__, "has_capability": known.withColumn("kind", F.lit("UNKNOWN"))}).staged("has_capability"), rows


def largest_teams(graph: GraphTables, count: int = TARGET_COUNT) -> DataFrame:
    """The projects with most authors, as target_id."""
    sizes = graph.wrote.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.orderBy(F.desc("n"), "project_id").limit(count).select(F.col("project_id").alias("target_id"))


def targets_for(graph: GraphTables, rows: DataFrame, chosen: DataFrame) -> Targets:
    """Team, domains with ancestors, requirements and keywords of the chosen projects."""
    closure = ancestor_closure(graph.subdomain_of)
    mine = rows.withColumnRenamed("project_id", "target_id").join(chosen, "target_id", "left_semi")
    links = graph.project_domain.withColumnRenamed("project_id", "target_id").join(chosen, "target_id", "left_semi")
    requirements = mine.groupBy("target_id", "capability_id", F.col("p_name").alias("name")).agg(
        F.round(F.max("l_discount") * 10, 2).alias("importance")
    )
    return Targets(
        domains=with_ancestors(links, closure, ["target_id"]),
        requirements=requirements.where(F.col("importance") > 0).select(
            "target_id", F.col("capability_id").alias("req"), "capability_id", "name", "importance",
            F.lit("extracted").alias("source"),
        ),
        team=graph.wrote.withColumnRenamed("project_id", "target_id").join(chosen, "target_id", "left_semi").select("target_id", "person_id"),
        keywords=mine.select("target_id", F.col("p_brand").alias("keyword")).distinct(),
    )


def staged_targets(graph: GraphTables, rows: DataFrame, chosen: DataFrame) -> Targets:
    """The question's own tables, written out: every step of a recommendation reads them."""
    targets = targets_for(graph, rows, stage(chosen, "targets"))
    return Targets(**stage_all(dict(targets.__dict__)))
