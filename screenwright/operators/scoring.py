"""From detections to a score, a decision and the redacted prompt."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from screenwright import catalogue as C
from screenwright.functions.detections import no_detections
from screenwright.functions.reuse import built_once
from screenwright.functions.text import is_blank, let, settled


def total_score(detections: Column) -> Column:
    highest = F.array_max(F.transform(detections, lambda d: d["score"]))
    # No detections give no highest score; ``least`` would skip the null and answer with the cap.
    return F.least(F.coalesce(highest, F.lit(0)), F.lit(100))


def top_risk_type(detections: Column) -> Column:
    """Risk type of the highest score; the first in order wins a tie."""
    ranked = F.transform(detections, lambda d, i: F.struct(
        d["score"].alias("score"), (-i).alias("order"), d["risk_type"].alias("risk_type")))
    return F.coalesce(F.array_max(ranked)["risk_type"], F.lit("NONE"))


def by_band(score: Column, pick: int, below: str) -> Column:
    chain = None
    for band in C.BANDS:
        chain = F.when(score >= band[0], band[pick]) if chain is None else chain.when(score >= band[0], band[pick])
    return chain.otherwise(below)


def risk_level(score: Column) -> Column:
    return by_band(score, 1, "NONE")


def decide(score: Column) -> Column:
    """Action for a score. A row that could not be scored is let through."""
    return by_band(score, 2, "ALLOW")


def reason(action: Column, risk_type: Column, score: Column) -> Column:
    chain = None
    for name, (by_type, default, ending) in C.REASONS.items():
        start = None
        for kind, text in by_type.items():
            start = F.when(risk_type == kind, text) if start is None else start.when(risk_type == kind, text)
        text = F.concat(start.otherwise(default), F.lit(ending), score.cast("string"), F.lit(")."))
        chain = F.when(action == name, text) if chain is None else chain.when(action == name, text)
    return chain.otherwise(C.ALLOW_REASON)


def placeholder(risk_type: Column) -> Column:
    chain = None
    for kind, text in C.PLACEHOLDERS.items():
        chain = F.when(risk_type == kind, text) if chain is None else chain.when(risk_type == kind, text)
    return chain.otherwise(C.DEFAULT_PLACEHOLDER)


def redact(prompt: Column, detections: Column) -> Column:
    """Replace matched values in detection order. A matched ``*`` replaces the whole prompt."""
    whole = F.get(F.filter(detections, lambda d: d["matched_value"] == "*"), F.lit(0))
    folded = F.aggregate(
        F.filter(detections, lambda d: ~is_blank(d["matched_value"])),
        prompt,
        lambda text, d: F.replace(text, d["matched_value"], placeholder(d["risk_type"])),
    )
    return let(whole, lambda w: F.when(w.isNotNull(), placeholder(w["risk_type"])).otherwise(folded))


def combine(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One ordered ``detections`` array from the columns of the single detectors."""
    columns = [f"_found_{n}" for n in names]
    found = F.concat(*[F.coalesce(F.col(c), no_detections()) for c in columns])
    return df.withColumn("detections", settled(found)).drop(*columns)


def explode_detections(df: DataFrame, keep: list[str]) -> DataFrame:
    """Long form: one row per detection with its position."""
    return df.select(*keep, F.posexplode("detections").alias("ord", "d")).select(*keep, "ord", "d.*")


def with_decision(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Add score, type, level, action, reason and the redacted prompt to a frame with ``detections``."""
    for step in decision_columns(prompt):
        df = df.withColumns(step)
    return df


@built_once
def decision_columns(prompt: str) -> tuple[dict[str, Column], ...]:
    """The columns of ``with_decision``, in steps that use those of the step before."""
    return {
        "risk_score": total_score(F.col("detections")),
        "highest_risk_type": top_risk_type(F.col("detections")),
    }, {
        "risk_level": risk_level(F.col("risk_score")),
        "action": decide(F.col("risk_score")),
    }, {
        "action_reason": reason(F.col("action"), F.col("highest_risk_type"), F.col("risk_score")),
        "redacted_prompt": settled(
            F.when(F.col("action") == "REDACT", redact(F.col(prompt), F.col("detections"))).otherwise(F.col(prompt))),
    }


def response(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, "action", F.col("action_reason").alias("reason"),
                     F.col("redacted_prompt").alias("redactedPrompt"), F.col("risk_score").alias("riskScore"),
                     F.col("risk_level").alias("riskLevel"))


def enforce(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """What the tool finally receives: nothing, the redacted or the original prompt."""
    redacted = F.when(F.coalesce(F.col("redacted_prompt"), F.lit("")) == "", F.col(prompt)).otherwise(
        F.col("redacted_prompt"))
    return df.withColumn(
        "forwarded_prompt",
        F.when(F.col("action") == "BLOCK", F.lit(None).cast("string"))
        .when(F.col("action") == "REDACT", redacted)
        .otherwise(F.col(prompt)),
    )


def hits_per_detector(df: DataFrame) -> DataFrame:
    """How often each detector reported something: detections and prompts.

    Counted inside the row first, so that only one small record per detector leaves a partition.
    """
    per_prompt = F.transform(
        F.array_distinct(F.transform("detections", lambda d: d["detector"])),
        lambda name: F.struct(
            name.alias("detector"),
            F.size(F.filter("detections", lambda d: d["detector"] == name)).cast("bigint").alias("n")),
    )
    return df.select(F.explode(per_prompt).alias("h")).groupBy("h.detector").agg(
        F.sum("h.n").alias("detections"), F.count(F.lit(1)).alias("prompts"))


def observe_hits(df: DataFrame, detectors: tuple[str, ...], to: Observation | str) -> DataFrame:
    """Count what ``hits_per_detector`` counts while the rows pass, without a pass of its own.

    ``to`` is an ``Observation`` for a batch, read with ``observed_hits`` after the action that screens; for a stream it is
    a name, under which each progress report has the metrics of its micro-batch.
    """
    def counted(name: str) -> list[Column]:
        n = F.size(F.filter("detections", lambda d: d["detector"] == name))
        return [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(f"{name}_detections"), F.count_if(n > 0).alias(f"{name}_prompts")]

    return df.observe(to, *(metric for name in detectors for metric in counted(name)))


def observed_hits(metrics: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(detector, detections, prompts) of the detectors that reported something."""
    names = [key.removesuffix("_detections") for key in metrics if key.endswith("_detections")]
    return [(n, metrics[f"{n}_detections"], metrics[f"{n}_prompts"]) for n in names if metrics[f"{n}_detections"]]
