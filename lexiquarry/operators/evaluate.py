"""Golden checks of answers, and validation of inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eval_checks(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """Each case with what is missing from, or forbidden in, its answer; passed if nothing is and mode and quality fit."""
    rows = cases.join(answers, "case_id", "left")
    text = F.lower(F.coalesce("answer_text", F.lit("")))
    empty = F.array().cast("array<string>")
    missing = F.filter(F.coalesce("expected", empty), lambda x: ~F.contains(text, F.lower(x)))
    present = F.filter(F.coalesce("forbidden", empty), lambda x: F.contains(text, F.lower(x)))
    failed = F.array_compact(F.array(
        F.when(F.col("answer_text").isNull(), "no_answer"), F.when(F.size(missing) > 0, "missing_expected"), F.when(F.size(present) > 0, "forbidden_present"),
        F.when(F.col("expected_mode").isNotNull() & ~F.col("expected_mode").eqNullSafe(F.col("answer_mode")), "answer_mode_mismatch"),
        F.when(F.col("expected_quality").isNotNull() & ~F.col("expected_quality").eqNullSafe(F.col("evidence_quality")), "evidence_quality_mismatch")))
    return rows.select("case_id", missing.alias("missing"), present.alias("present"), failed.alias("failed_checks")).withColumn("passed", F.size("failed_checks") == 0)


def eval_summary(checked: DataFrame) -> DataFrame:
    rate = F.when(F.count("*") > 0, F.round(100.0 * F.count_if("passed") / F.count("*"), 2)).otherwise(0.0)
    return checked.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), (F.count("*") - F.count_if("passed")).alias("failed"), rate.alias("pass_rate"))


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with error_code: the first rule that fails (a false or null condition), null if all hold."""
    code = F.lit(None).cast("string")
    for name, holds in reversed(rules.items()):
        code = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(code)
    return rows.withColumn("error_code", code).withColumn("is_valid", F.col("error_code").isNull())
