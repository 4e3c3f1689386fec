"""Report builders: every table of the audit/EDA stage from one cleaned
table, written once.

The deduplicated records and the analytical frame are materialised into the
shared checkpoint folder (a written table cuts the lineage), so the eight
report tables read them instead of re-running scan + dedup eight times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import audit as A
from ..operators import describe as D
from ..operators.clean import analytical_categoricals, prepare_analytical
from ..presets import Layout
from ..sources.sinks import scratch_path, write_tables

NUMERIC_SUMMARY = ["severity_score", "speed_limit", "month_number", "hour", "rush_hour_flag"]
SPEARMAN = ["severity_score", "speed_limit", "hour_sin", "hour_cos", "rush_hour_flag"]


def materialise(df: DataFrame, kind: str) -> DataFrame:
    """Write to the shared folder and read back (lineage cut, survives
    executor loss)."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def eda_tables(raw: DataFrame, layout: Layout) -> dict[str, DataFrame]:
    """audit_summary, column_audit, invalid_value_checks, severity_summary,
    numeric_summary, category_by_severity, categorical_associations,
    spearman_correlations."""
    analytical = materialise(prepare_analytical(raw, layout), "analytical")
    derived = len(analytical.columns) - 1
    cats = analytical_categoricals(analytical)
    return {
        "audit_summary": A.audit_summary(raw, layout, derived),
        "column_audit": A.column_audit(raw, layout),
        "invalid_value_checks": A.domain_checks(raw, layout),
        "severity_summary": D.class_summary(analytical),
        "numeric_summary": D.numeric_summary(analytical, NUMERIC_SUMMARY),
        "category_by_severity": D.category_by_class(analytical, cats[1:]),
        "categorical_associations": D.association_matrix(analytical, cats),
        "spearman_correlations": D.spearman(analytical, SPEARMAN),
    }


def write_eda(raw: DataFrame, layout: Layout, root: str, fmt: str = "csv") -> dict[str, str]:
    """All EDA tables as small single-file CSV (or parquet/json) under ``root``."""
    return write_tables(eda_tables(raw, layout), root, fmt, single_file=True)
