"""Token cost per call and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..session import cut
from .joins import lookup_join


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(list(v.PRICES), "model string, usd_in double, usd_out double")


def with_cost(calls: DataFrame, prices: DataFrame | None = None, default: str = v.DEFAULT_MODEL) -> DataFrame:
    """Adds cost_usd and cost_inr; a model that is not listed is priced as the default one."""
    prices = price_table(calls.sparkSession) if prices is None else prices
    fallback = prices.where(F.col("model") == default)
    fallback_in = fallback.agg(F.first("usd_in").alias("p")).scalar()
    fallback_out = fallback.agg(F.first("usd_out").alias("p")).scalar()
    spread = [f.name for f in calls.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    priced = lookup_join(calls, cut(prices), ["model"], spread, "left")
    usd = F.col("input_tokens") / 1_000_000 * F.coalesce("usd_in", fallback_in) + F.col(
        "output_tokens"
    ) / 1_000_000 * F.coalesce("usd_out", fallback_out)
    return priced.withColumn("cost_usd", usd).withColumn("cost_inr", F.col("cost_usd") * v.USD_TO_INR).drop(
        "usd_in", "usd_out"
    )


def summary_columns() -> list[Column]:
    return [
        F.count("*").alias("queries_measured"),
        F.round(F.avg("input_tokens"), 1).alias("avg_input_tokens"),
        F.round(F.avg("output_tokens"), 1).alias("avg_output_tokens"),
        F.round(F.avg("latency_s"), 3).alias("avg_latency_s"),
        F.round(F.avg("cost_inr"), 4).alias("avg_cost_inr_per_query"),
        F.round(F.avg("cost_inr") * 1000, 2).alias("cost_inr_per_1000_queries"),
    ]


def cost_by_model(costed: DataFrame) -> DataFrame:
    return costed.groupBy("model").agg(*summary_columns())


def active_summary(costed: DataFrame, order: str) -> DataFrame:
    """The summary of the model that made the last call; no row for an empty log."""
    active = costed.agg(F.max_by("model", order).alias("m")).scalar()
    return cost_by_model(costed.where(F.col("model") == active))


def report_rows(costed: DataFrame, order: str) -> DataFrame:
    """(kind, seq, json): the summary and every entry, one JSON object per row."""
    entry = F.to_json(F.struct("question", "input_tokens", "output_tokens", "latency_s", "model"))
    entries = costed.select(F.lit("entry").alias("kind"), F.col(order).alias("seq"), entry.alias("json"))
    summary = active_summary(costed, order)
    whole = F.to_json(
        F.struct(
            "queries_measured", "avg_input_tokens", "avg_output_tokens", "avg_latency_s", "model",
            "avg_cost_inr_per_query", "cost_inr_per_1000_queries",
        )
    )
    return summary.select(
        F.lit("summary").alias("kind"), F.lit(-1).cast("long").alias("seq"), whole.alias("json")
    ).unionByName(entries)


def save_report(costed: DataFrame, order: str, path: str) -> None:
    """JSON lines under ``kind=summary`` and ``kind=entry``; entries never meet in one row."""
    report_rows(costed, order).select("kind", F.col("json").alias("value")).write.partitionBy("kind").text(path)
