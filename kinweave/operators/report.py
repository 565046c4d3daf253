"""The data-quality report: small aggregates collected into one document."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import hierarchy as tax
from kinweave.operators import integrity as graph_checks
from kinweave.operators import quality, validation


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def build_report(
    records: DataFrame,
    manifest: dict | None = None,
    integrity: DataFrame | None = None,
    hierarchy: DataFrame | None = None,
    entity_findings: DataFrame | None = None,
    relation_findings: DataFrame | None = None,
    report_date: datetime.date | None = None,
) -> dict:
    """Counts and rates only: finding lists stay tables, since they grow with the data.

    ``integrity`` and ``hierarchy`` are the per-check summaries; all four checks are optional.
    """
    manifest = manifest or {}
    special = _row(quality.special_records(records))
    issues = validation.issue_counts(validation.document_issues(records)).collect()  # one row per code
    errors = sum(r["n"] for r in issues if r["severity"] == "error")
    warnings = sum(r["n"] for r in issues if r["severity"] == "warning")
    total, found = special["records"], manifest.get("numFound")
    fetched = manifest.get("fetched_count", total)
    fetched = fetched if isinstance(fetched, int) else total
    known = isinstance(found, int)
    size = validation.size_issues(total, found if known else None)
    repeats = quality.duplicate_ids(records).agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra")).first()
    names = quality.homonyms(records).agg(F.count_distinct("normalized_name").alias("n")).first()["n"]
    report = {
        "report_date": (report_date or datetime.date.today()).isoformat(),
        "snapshot": {key: manifest.get(key) for key in ("query", "timestamp", "requested_fields", "numFound", "fetched_count", "sort")},
        "records": {
            "records_retrieved": total,
            "counts": {r["entity"]: r["n"] for r in quality.entity_counts(records).collect()},
            "missingness": {
                r["field"]: {"missing_count": r["missing_count"], "missing_percent": r["missing_percent"]}
                for r in quality.missingness(records).collect()
            },
            "duplicate_id_count": repeats["ids"],
            "duplicate_record_count": repeats["extra"],
            "author_identity": {
                **_row(quality.author_identity(records)), **_row(quality.authors_without_identifier(records)),
                "homonym_collision_group_count": names,
            },
            "author_array_alignment": _row(quality.array_alignment(records)),
            "missing_or_unknown_ids": special["missing_or_unknown_ids"],
            "multi_language_abstracts": special["multi_language_abstracts"],
            "pagination": {
                "num_found": found, "fetched_count": fetched, "difference": found - fetched if known else None,
                "complete": fetched >= found if known else None,
            },
        },
        "validation": {
            "is_valid": errors + len(size) == 0, "error_count": errors + len(size), "warning_count": warnings,
            "by_code": {r["code"]: r["n"] for r in issues},
        },
        "integrity": _section(integrity), "hierarchy": _section(hierarchy),
        "comparison": _comparison(entity_findings, relation_findings),
    }
    report["conclusions"], report["open_risks"] = summarize(report)
    return report


def _section(summary: DataFrame | None) -> dict:
    if summary is None:
        return {"status": "not_run", "finding_count": 0, "checks": {}}
    checks = {r["name"]: r["finding_count"] for r in summary.collect()}  # one row per check
    return {"status": "completed", "finding_count": sum(checks.values()), "checks": checks}


def _comparison(entities: DataFrame | None, relations: DataFrame | None) -> dict:
    if entities is None or relations is None:
        return {"status": "not_run", "entity_mismatch_count": 0, "relationship_mismatch_count": 0, "duplicate_node_count": 0}
    by_code = {r["code"]: r["n"] for r in entities.groupBy("code").agg(F.count_distinct("table", "id").alias("n")).collect()}
    edges = relations.count()
    return {
        "status": "completed",
        "entity_mismatch_count": by_code.get("missing_node", 0) + by_code.get("field_mismatch", 0) + edges,
        "relationship_mismatch_count": edges,
        "duplicate_node_count": by_code.get("duplicate_node", 0),
    }


def summarize(report: dict) -> tuple[list[str], list[str]]:
    """Rule-based conclusions and open risks."""
    records, checks = report["records"], report["validation"]
    conclusions, risks = [], []
    if checks["error_count"]:
        conclusions.append(f"Validation found {checks['error_count']} errors and {checks['warning_count']} warnings.")
    else:
        conclusions.append("Validation found no errors.")
    if records["duplicate_record_count"]:
        conclusions.append(f"{records['duplicate_record_count']} records repeat an earlier identifier.")
    if records["author_identity"]["unknown_author_share"]:
        conclusions.append(f"{records['author_identity']['unknown_author_share']:.1%} of author identities are placeholders.")
    for section, label, key in (
        ("comparison", "Comparison with the store", "entity_mismatch_count"),
        ("integrity", "Integrity checks", "finding_count"),
        ("hierarchy", "Hierarchy checks", "finding_count"),
    ):
        if report[section]["status"] == "completed":
            conclusions.append(f"{label}: {report[section][key]} findings.")
        else:
            risks.append(f"{label}: not run.")
    if records["pagination"]["complete"] is False:
        risks.append(f"Only {records['pagination']['fetched_count']} of {records['pagination']['num_found']} announced records are present.")
    if records["author_array_alignment"]["mismatched_record_count"]:
        risks.append(f"{records['author_array_alignment']['mismatched_record_count']} records have author arrays of unequal length.")
    if records["missing_or_unknown_ids"]:
        risks.append(f"{records['missing_or_unknown_ids']} records lack a usable identifier.")
    if report["integrity"]["checks"].get("bare_organizations"):
        risks.append(f"{report['integrity']['checks']['bare_organizations']} organisations lack a name or type.")
    return conclusions, risks


def render_markdown(report: dict) -> str:
    """Key metrics, conclusions and risks for readers."""
    records = report["records"]
    lines = [
        f"# Data quality report, {report['report_date']}", "",
        f"- Records: {records['records_retrieved']}",
        *[f"- Distinct {name}: {n}" for name, n in sorted(records["counts"].items())],
        f"- Errors / warnings: {report['validation']['error_count']} / {report['validation']['warning_count']}",
        f"- Placeholder share: {records['author_identity']['unknown_author_share']:.2%}",
        "", "## Missing fields", "", "| Field | Missing | Percent |", "|---|---:|---:|",
        *[f"| {f} | {m['missing_count']} | {m['missing_percent']:.2f}% |" for f, m in records["missingness"].items()],
        "", "## Conclusions", "", *[f"- {c}" for c in report["conclusions"]],
        "", "## Open risks", "", *([f"- {r}" for r in report["open_risks"]] or ["- None found by the checks that ran."]), "",
    ]
    return "\n".join(lines)


def integrity_section(tables: dict[str, DataFrame]) -> DataFrame:
    return graph_checks.summary(tables)


def hierarchy_section(domains: DataFrame, edges: DataFrame, associations: DataFrame) -> DataFrame:
    return tax.summary(tax.all_checks(domains, edges, associations))
