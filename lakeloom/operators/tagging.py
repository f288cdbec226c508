"""Tags with provenance, and three ways to remember rejected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import ascii_fold, unicode_trim


def manual_tags(rows: DataFrame) -> DataFrame:
    """(asset_id, label) as manual tags, without confidence."""
    return rows.select("asset_id", "label", F.lit("manual").alias("source"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("float").alias("confidence"), F.lit(False).alias("rejected"))


def model_tags(rows: DataFrame, model: str, version: str, provider: str | None = None) -> DataFrame:
    """(asset_id, label, confidence) as tags of a local model, or of a cloud provider's; confidence must be in 0..1."""
    sure = F.when(F.col("confidence").between(0, 1), F.col("confidence").cast("float")).otherwise(F.raise_error(F.lit("confidence must be from 0 to 1")).cast("float"))
    return rows.select("asset_id", "label", F.lit("cloud" if provider else "local").alias("source"), F.lit(model).alias("model"), F.lit(version).alias("version"), F.lit(provider).cast("string").alias("provider"), sure.alias("confidence"), F.lit(False).alias("rejected"))


def filter_rejected(tags: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, flagged) by exact label, whatever asset and source."""
    gone = labels.select("label").distinct()
    return tags.join(gone, "label", "left_anti"), tags.join(gone, "label", "left_semi")


def normal_label(c: Column) -> Column:
    return ascii_fold(unicode_trim(c))


def remember(rejections: DataFrame) -> DataFrame:
    """Rejection memory: distinct (asset_id, label, source) of model tags; models and versions don't count."""
    return rejections.where(F.col("source") != "manual").select("asset_id", normal_label(F.col("label")).alias("label"), "source").distinct()


def memory_entries(memory: DataFrame) -> DataFrame:
    return memory.select("asset_id", "label", "source", F.lit("*").alias("model"), F.lit("*").alias("version")).orderBy("asset_id", "label", "source")


def decisions(tags: DataFrame, memory: DataFrame) -> DataFrame:
    """tags with `decision`: propose, or propose-flagged-rejected where the memory holds the tag."""
    keys = memory.select("asset_id", F.col("label").alias("_label"), "source", F.lit(True).alias("_known"))
    joined = tags.withColumn("_label", normal_label(F.col("label"))).join(keys, ["asset_id", "_label", "source"], "left")
    return joined.select(*tags.columns, F.when(F.col("_known"), "propose-flagged-rejected").otherwise("propose").alias("decision"))


def strict_matches(tags: DataFrame, rejected: DataFrame) -> DataFrame:
    """Tags rejected exactly: same asset, label and whole source, versions included."""
    keys = ["asset_id", "label", "source", "model", "version", "provider"]
    r = rejected.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return tags.join(r, cond, "left_semi")


class CloudDisabled(PermissionError):
    pass


def require_cloud(ai: dict) -> None:
    """Raises unless the archive has a provider and one cloud feature on."""
    if not (ai.get("provider") and any(v for k, v in ai.items() if k.startswith("cloud_"))):
        raise CloudDisabled("cloud tagging is off")


def enable_cloud(ai: dict, feature: str, provider: str) -> dict:
    return ai | {f"cloud_{feature}": True, "provider": provider}


def disable_cloud(ai: dict) -> dict:
    """All cloud features off, no provider; tags stay."""
    return {k: False if k.startswith("cloud_") else v for k, v in ai.items()} | {"provider": None}
