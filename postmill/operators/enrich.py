"""Filling in attributes of postings from their descriptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import runtime
from postmill.operators.filters import quarantine_split

FIELDS_A = ["required_studies", "technologies_required", "experience_years_needed", "salary_offered"]
FIELDS_B = ["experience_years_needed", "required_studies"]


def enrich_gate(desired: str, enabled: bool, lang: Column) -> Column:
    """Which rows an analyser sees."""
    if enabled and not desired:
        raise ValueError("a desired language is needed when analysis is enabled")
    return F.lit(enabled) & (F.lower(lang) == F.lit(desired.lower()))


def enrich_merge(df: DataFrame, analysis: Column, fields: list[str]) -> DataFrame:
    """Copy attributes into the posting; rows without an analysis keep what they have."""
    return df.withColumns({
        f: F.when(analysis.isNotNull(), analysis[f]).otherwise(F.col(f)) for f in fields
    })


def enrich(
    df: DataFrame,
    analyser: Callable[[Column], Column],
    gate: Column,
    fields: list[str],
    description: str = "description",
    answered: str | None = None,
) -> DataFrame:
    """Analyse the rows behind the gate and merge; adds `token_cost`.

    `analyser` maps a description column to the analysis struct, or has `analyse_rows`, from
    (rows, description, output) to rows with one more column. Python UDFs run for every row of
    their input whatever guards them, and a function may hide one, so the rows
    behind the gate are split off first; pass a checkpointed table. `answered` names a
    column that is false where an analysis was asked for and none came back.
    """
    cost = F.coalesce(F.col("_analysis.token_cost"), F.lit(0)).alias("token_cost")
    columns = [c for c in df.columns if c not in ("token_cost", answered)]
    usable = [] if answered is None else [F.col("_analysis").isNotNull().alias(answered)]
    unasked = [] if answered is None else [F.lit(True).alias(answered)]

    gated = df.withColumn("_gate", F.coalesce(gate, F.lit(False)))
    asked = gated.filter("_gate")
    if hasattr(analyser, "analyse_rows"):
        analysed = analyser.analyse_rows(asked, description, "_analysis")
    else:
        analysed = asked.withColumn("_analysis", analyser(F.col(description)))
    behind = enrich_merge(analysed, F.col("_analysis"), fields).select(*columns, cost, *usable)
    others = gated.filter("not _gate").select(*columns, F.lit(0).alias("token_cost"), *unasked)
    return behind.unionByName(others)


def analysed_rows(
    df: DataFrame, analyser: Callable[[Column], Column], gate: Column, fields: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantined) after one call per row behind the gate.

    A posting without a usable answer is not kept. The rows are written once, so later
    uses do not call the analyser again.
    """
    asked = enrich(runtime.cut_lineage(df), analyser, gate, fields, answered="_answered")
    good, failing = quarantine_split(runtime.cut_lineage(asked), {"no usable analysis": F.col("_answered")})
    return good.drop("_answered"), failing.drop("_answered")
