"""Loss values over log-probability tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factsieve import settings


def sequence_logprob(tokens: DataFrame) -> DataFrame:
    """Summed log-probability of the unmasked tokens; the first position never counts."""
    counts = (F.col("label") != settings.MASKED_LABEL) & (F.col("pos") > 0)
    return tokens.groupBy("model", "record_id").agg(
        F.sum(F.when(counts, F.col("logprob")).otherwise(0.0)).alias("logp"))


def log_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def _by_model(logprobs: DataFrame, model: str, name: str) -> DataFrame:
    return logprobs.filter(F.col("model") == model).select("record_id", F.col("logp").alias(name))


def missing_logprobs(records: DataFrame, logprobs: DataFrame, model: str = "ref") -> DataFrame:
    """Records without a reference log-probability; must be empty before a loss is taken."""
    return records.select("record_id").distinct().join(_by_model(logprobs, model, "_"), "record_id", "left_anti")


def npo_loss(logprobs: DataFrame, beta: float = settings.NPO_BETA, theta: str = "theta", ref: str = "ref") -> DataFrame:
    """-(2/beta) * mean(log sigmoid(-beta * delta)); fails on an empty batch."""
    if beta <= 0:
        raise ValueError("beta must be positive")
    pairs = _by_model(logprobs, theta, "t").join(_by_model(logprobs, ref, "r"), "record_id")
    mean = F.avg(log_sigmoid((F.col("t") - F.col("r")) * F.lit(-beta)))
    return pairs.agg(F.count(F.lit(1)).alias("n"), (mean * F.lit(-2.0 / beta)).alias("_loss")).select(
        "n", F.when(F.col("n") > 0, F.col("_loss")).otherwise(
            F.raise_error(F.lit("no record in the batch")).cast("double")).alias("loss"))


def ga_loss(logprobs: DataFrame, theta: str = "theta") -> DataFrame:
    return _by_model(logprobs, theta, "t").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("loss"))


def total_loss(forget: DataFrame, retain: DataFrame, weight: float = settings.RETAIN_WEIGHT) -> DataFrame:
    """Total per method: npo adds the weighted retain loss, ga has no retain term.

    ``forget(method, forget_loss)``, ``retain(logp)``.
    """
    kept = retain.agg(-F.avg("logp")).scalar()
    return forget.withColumn("retain_loss", kept).withColumn(
        "total_loss", F.when(F.col("method") == "npo", F.col("forget_loss") + F.lit(weight) * F.col("retain_loss"))
        .otherwise(F.col("forget_loss")))
