"""Profile and quality report of one table in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablegauge.operators import profile as P, quality as Q


@dataclass
class QualityReport:
    profile: DataFrame
    findings: DataFrame
    summary: DataFrame


def quality_report(df: DataFrame, target: str | None = None, checks: list[str] | None = None) -> QualityReport:
    findings = Q.run_checks(df, target, checks)
    return QualityReport(P.profile(df), Q.order_findings(findings), Q.summarise(findings))
