"""Command line: ingest, capabilities, export, snapshot, recommend, compare, integrity, hierarchy, report."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import settings
from kinweave.functions import text as x
from kinweave.operators import compare, explain, integrity, quality
from kinweave.operators import graph as g
from kinweave.operators import recommend as rec
from kinweave.operators.canonical import canonical_tables
from kinweave.operators.capability_pipeline import extract_to_tables
from kinweave.operators.report import build_report, hierarchy_section, integrity_section
from kinweave.schemas import CANONICAL_TABLES
from kinweave.session import build_session, stage, stage_all
from kinweave.sources import paged_api, records, sinks

FEATURES = list(settings.RANKING_WEIGHTS)
SHOWN_EVIDENCE = 10


def load_graph(spark: SparkSession, path: str) -> g.GraphTables:
    """Graph tables out of the canonical and inferred tables below ``path``."""

    def table(name: str) -> DataFrame:
        found = sinks.read_table(spark, f"{path}/{name}")
        if found is None:
            raise FileNotFoundError(f"no table {name} below {path}")
        return found

    able = sinks.read_table(spark, f"{path}/has_capability")
    empty = "person_id string, capability_id string, name string, kind string, last_seen_year int"
    if able is None:
        has_capability = spark.createDataFrame([], empty)
    else:
        names = table("capability").select(F.col("id").alias("capability_id"), "name", "kind")
        current = (F.col("extractionVersion") == settings.EXTRACTION_VERSION) & (F.col("aggregationVersion") == settings.AGGREGATION_VERSION)
        has_capability = able.where(current).select(
            F.col("author").alias("person_id"), F.col("capability").alias("capability_id"), F.col("lastSeenYear").alias("last_seen_year")
        ).join(names, "capability_id")
    return g.GraphTables(
        projects=table("projects").select(F.col("halId").alias("project_id"), "title", F.col("publicationYear").alias("year"), "keywords"),
        authors=table("authors").select(F.col("halId").alias("person_id"), F.col("fullName").alias("full_name")),
        wrote=table("project_authors").select(F.col("authorHalId").alias("person_id"), F.col("projectHalId").alias("project_id"), F.lit(0).alias("pos")),
        project_domain=table("project_research_domains").select(F.col("projectHalId").alias("project_id"), F.col("domainId").alias("domain_id")),
        domains=table("research_domains").select(F.col("id").alias("domain_id"), "name", F.col("nameFr").alias("name_fr")),
        subdomain_of=table("research_domain_hierarchy").select(F.col("childId").alias("child_id"), F.col("parentId").alias("parent_id")),
        has_capability=has_capability,
    )


def project_target(graph: g.GraphTables, project_id: str) -> rec.Targets:
    """Team, domains with ancestors and keywords of one publication; no requirements are known for it."""
    spark = graph.projects.sparkSession
    target = F.lit(project_id).alias("target_id")
    mine = F.col("project_id") == project_id
    links = graph.project_domain.where(mine).select(target, "domain_id")
    return rec.Targets(
        domains=stage(g.with_ancestors(links, g.ancestor_closure(graph.subdomain_of), ["target_id"])),
        requirements=_no_requirements(spark),
        team=stage(graph.wrote.where(mine).select(target, "person_id").distinct()),
        keywords=stage(graph.projects.where(mine).select(target, F.explode("keywords").alias("keyword"))),
    )


def text_target(graph: g.GraphTables, title: str, keywords: list[str]) -> rec.Targets:
    """Domains and capabilities the keywords of a free-text target name."""
    spark = graph.projects.sparkSession
    target = F.lit(title).alias("target_id")
    closure = g.ancestor_closure(graph.subdomain_of)
    found = g.domains_by_keywords(graph.domains, closure, keywords).select(target, "domain_id")
    known = graph.has_capability.select("capability_id", "name").distinct().withColumn("aliases", F.array().cast("array<string>"))
    named = g.capabilities_by_terms(known, keywords).select(target, "capability_id", "name") if keywords else None
    return rec.Targets(
        domains=stage(g.with_ancestors(found, closure, ["target_id"])),
        requirements=stage(rec.default_requirements(named)) if named is not None else _no_requirements(spark),
        team=spark.createDataFrame([], "target_id string, person_id string"),
    )


def _no_requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "target_id string, req string, capability_id string, name string, importance double, source string")


def recommendation_rows(graph: g.GraphTables, targets: rec.Targets, top_k: int, with_text: bool) -> list[dict]:
    """The winners as dictionaries: at most ``top_k`` rows reach the driver."""
    found = rec.recommend(graph, targets, top_k=top_k)
    ranked = stage(found.ranked, "ranked")
    shown = rec.evidence_of(graph, ranked, targets)
    if with_text:
        texts = explain.template_explanations(ranked, shown, found.gaps).drop("rank")
        ranked = ranked.join(texts, ["target_id", "person_id"], "left")
    seen = g.evidence_ids(shown)
    place = F.row_number().over(g.W.partitionBy("target_id", "person_id").orderBy("ord"))
    first = seen.withColumn("place", place).where(F.col("place") <= SHOWN_EVIDENCE + 1).groupBy("target_id", "person_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "id"))).alias("items")
    )
    rows = ranked.join(first, ["target_id", "person_id"], "left").orderBy("rank").collect()
    out = []
    for row in rows:
        data = row.asDict(recursive=True)
        data["evidence_ids"] = [i["id"] for i in data.pop("items") or []]
        out.append(data)
    return out


def render_text(title: str, rows: list[dict]) -> str:
    lines = [f"Collaborators for: {title}"]
    if not rows:
        lines.append("No matching candidates.")
    for row in rows:
        mark = " (placeholder identity)" if row["is_placeholder"] else ""
        lines.append(f"{row['rank']}. {row['full_name']} [{row['person_id']}]{mark}  score {row['total_score']:.4f}")
        lines += [
            f"     {n:<20} value {row[n]:.3f}  weight {w:.2f}  contribution {row[f'contrib_{n}']:.4f}"
            for n, w in settings.RANKING_WEIGHTS.items()
        ]
        ids = row["evidence_ids"]
        lines.append("     evidence: " + (", ".join(ids[:SHOWN_EVIDENCE]) or "none") + ("..." if len(ids) > SHOWN_EVIDENCE else ""))
        if row.get("explanation"):
            lines.append("     " + row["explanation"])
    return "\n".join(lines)


def _keywords(spark: SparkSession, query: str) -> list[str]:
    return spark.createDataFrame([(query,)], "q string").select(x.query_keywords(F.col("q")).alias("k")).first()["k"]


def _recommend(spark: SparkSession, args: argparse.Namespace) -> int:
    graph = load_graph(spark, args.tables)

    def answer(query: str, keywords: list[str]) -> None:
        title = query if len(query) <= 80 else query[:77] + "..."
        show(title, text_target(graph, title, keywords))

    def show(title: str, targets: rec.Targets) -> None:
        rows = recommendation_rows(graph, targets, args.top_k, not args.no_explain)
        print(json.dumps(rows, ensure_ascii=False, indent=2, default=str) if args.format == "json" else render_text(title, rows))

    if args.interactive:
        for line in sys.stdin:
            if line.strip().lower() in ("exit", "quit", "q"):
                break
            if line.strip():
                answer(line.strip(), _keywords(spark, line.strip()))
    elif args.query:
        answer(args.query, _keywords(spark, args.query))
    elif args.project_id:
        show(args.project_id, project_target(graph, args.project_id))
    elif args.title:
        answer(args.title, [k.strip() for k in args.keywords.split(",") if k.strip()])
    else:
        print("Give --query, --interactive, --project-id or --title.", file=sys.stderr)
        return 1
    return 0


def _ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.full_import and not args.identity_migration_reviewed:
        raise SystemExit("A full import needs --identity-migration-reviewed.")
    if args.full_import:
        docs = records.load_complete(spark, args.snapshot, args.manifest)
    else:
        docs = records.load_subset(spark, args.snapshot, args.limit)
    sinks.merge_graph(args.tables, canonical_tables(stage(docs, "records")))
    return 0


def _capabilities(spark: SparkSession, args: argparse.Namespace) -> int:
    module, _, name = args.backend.partition(":")
    backend = getattr(importlib.import_module(module), name)()
    stamp = datetime.datetime.now(datetime.timezone.utc).isoformat()
    counts = extract_to_tables(
        spark, args.tables, backend, args.model, stamp, args.reference_year or int(stamp[:4]), args.project_id, args.limit, args.offset,
        args.resume, args.dry_run,
    )
    print(json.dumps(counts))
    return 0


def _export(spark: SparkSession, args: argparse.Namespace) -> int:
    query = paged_api.build_query(args.query, args.hal_id, args.title, args.doc_type)
    lines = paged_api.read_publications(spark, args.url, query=query, maxrows=str(args.rows))
    sinks.write_csv_tables(canonical_tables(stage(records.parse_lines(lines), "records")), args.output, single_file=args.single_file)
    return 0


def _snapshot(spark: SparkSession, args: argparse.Namespace) -> int:
    asked = {"query": args.query, "sort": "halId_s asc"}
    if args.pages:
        lines = paged_api.harvest(spark, args.url, args.pages, **asked)
    else:
        lines = stage(paged_api.read_publications(spark, args.url, **asked), "lines")
    found = paged_api.count_publications(args.url, query=args.query)
    print(sinks.write_snapshot(lines, args.output, found, args.query, "halId_s asc"))
    return 0


def stored_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The canonical tables below ``path``."""
    found = {name: sinks.read_table(spark, f"{path}/{name}") for name in CANONICAL_TABLES}
    absent = [name for name, rows in found.items() if rows is None]
    if absent:
        raise FileNotFoundError(f"no table {', '.join(absent)} below {path}")
    return {name: rows.select(*CANONICAL_TABLES[name]) for name, rows in found.items()}


def taxonomy_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Findings of each hierarchy check. Rows are told apart by a hash of their key, of which the tables hold one each."""
    domains = tables["research_domains"].select(F.xxhash64("id").alias("ord"), "id", "name", F.col("nameFr").alias("name_fr"))
    edges = tables["research_domain_hierarchy"].select(
        F.xxhash64("childId", "parentId").alias("ord"), F.col("childId").alias("child_id"), F.col("parentId").alias("parent_id"))
    return hierarchy_section(domains, edges, tables["project_research_domains"].select(F.col("domainId").alias("domain_id")))


def _print_rows(df: DataFrame) -> None:
    """One JSON object per check; their number is fixed."""
    print(json.dumps([r.asDict() for r in df.collect()], ensure_ascii=False, indent=2))


def _integrity(spark: SparkSession, args: argparse.Namespace) -> int:
    checks = stage(integrity_section(stored_tables(spark, args.tables)), "integrity")
    _print_rows(checks)
    _print_rows(integrity.totals(checks))
    return 0


def _hierarchy(spark: SparkSession, args: argparse.Namespace) -> int:
    _print_rows(taxonomy_summary(stored_tables(spark, args.tables)))
    return 0


def _comparison(spark: SparkSession, docs: DataFrame, tables: str) -> compare.Comparison:
    return compare.compare_tables(stage_all(canonical_tables(docs)), stored_tables(spark, tables))


def _compare(spark: SparkSession, args: argparse.Namespace) -> int:
    records.check_lines(spark, args.snapshot)
    docs = stage(records.parse_lines(records.read_lines(spark, args.snapshot)), "records")
    found = _comparison(spark, docs, args.tables)
    made = compare.comparison_report(found, quality.duplicate_ids(docs))
    path = compare.write_comparison(made, found, args.output, args.findings)
    print(json.dumps(made["summary"], indent=2))
    print(f"Report: {path}")
    return 0


def _report(spark: SparkSession, args: argparse.Namespace) -> int:
    records.check_lines(spark, args.snapshot)
    docs = stage(records.parse_lines(records.read_lines(spark, args.snapshot)), "records")
    manifest = records.read_manifest(spark, args.manifest) if args.manifest else None
    sections = {}
    if args.tables:
        tables, found = stored_tables(spark, args.tables), _comparison(spark, docs, args.tables)
        sections = {"integrity": integrity_section(tables), "hierarchy": taxonomy_summary(tables),
                    "entity_findings": found.entities, "relation_findings": found.relations}
    print(sinks.write_report(build_report(docs, manifest, **sections), args.output))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinweave")
    sub = top.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="snapshot to graph tables")
    ingest.add_argument("--snapshot", required=True)
    ingest.add_argument("--manifest")
    ingest.add_argument("--limit", type=int, default=100)
    ingest.add_argument("--full-import", action="store_true")
    ingest.add_argument("--identity-migration-reviewed", action="store_true")
    ingest.add_argument("--tables", required=True)
    ingest.set_defaults(run=_ingest)
    able = sub.add_parser("capabilities", help="capabilities of the ingested publications and their authors")
    able.add_argument("--tables", required=True)
    able.add_argument("--backend", default="kinweave.operators.extraction:KeywordBackend", help="module:class of a callable from prompt to list")
    able.add_argument("--model", default="keywords")
    able.add_argument("--project-id")
    able.add_argument("--limit", type=int)
    able.add_argument("--offset", type=int, default=0)
    able.add_argument("--reference-year", type=int)
    able.add_argument("--resume", action="store_true")
    able.add_argument("--dry-run", action="store_true")
    able.set_defaults(run=_capabilities)
    export = sub.add_parser("export", help="API query to CSV tables")
    paged_api.query_arguments(export)
    export.add_argument("--url", required=True)
    export.add_argument("--rows", type=int, default=100)
    export.add_argument("--output", required=True)
    export.add_argument("--single-file", action="store_true")
    export.set_defaults(run=_export)
    snapshot = sub.add_parser("snapshot", help="API query to a snapshot")
    snapshot.add_argument("--url", required=True)
    snapshot.add_argument("--query", default=settings.FULL_QUERY)
    snapshot.add_argument("--output", required=True)
    snapshot.add_argument("--pages", help="folder that keeps fetched pages, so that the same call goes on after a failure")
    snapshot.set_defaults(run=_snapshot)
    recommend = sub.add_parser("recommend", help="collaborators for a publication or a text")
    recommend.add_argument("--tables", required=True)
    for flag in ("--query", "--project-id", "--title", "--abstract", "--keywords"):
        recommend.add_argument(flag, default="")
    recommend.add_argument("--interactive", action="store_true")
    recommend.add_argument("--top-k", type=int, default=3)
    recommend.add_argument("--format", choices=["text", "json"], default="text")
    recommend.add_argument("--no-explain", action="store_true")
    recommend.set_defaults(run=_recommend)
    compared = sub.add_parser("compare", help="a snapshot's tables against the graph tables")
    compared.add_argument("--snapshot", required=True)
    compared.add_argument("--tables", required=True)
    compared.add_argument("--output", default="reports/comparison.json")
    compared.add_argument("--findings", help="folder for the finding lists as tables")
    compared.set_defaults(run=_compare)
    for name, run, text in (("integrity", _integrity, "integrity checks of the graph tables"), ("hierarchy", _hierarchy, "checks of the domain taxonomy")):
        checks = sub.add_parser(name, help=text)
        checks.add_argument("--tables", required=True)
        checks.set_defaults(run=run)
    report = sub.add_parser("report", help="data-quality report of a snapshot")
    report.add_argument("--snapshot", required=True)
    report.add_argument("--manifest")
    report.add_argument("--tables", help="graph tables to check and compare as well")
    report.add_argument("--output", default="reports")
    report.set_defaults(run=_report)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(build_session("kinweave"), args)


if __name__ == "__main__":
    sys.exit(main())
