"""Result tables ("marts") as files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from spanledger.sources.files import exists, move, read_text, remove, write_text

# The result set and where each member lies under the output folder.
MART_PATHS = {
    "acq_monthly": "acquisition/monthly_new_accounts",
    "acq_by_referral": "acquisition/by_referral_source",
    "acq_by_plan": "acquisition/by_plan_tier",
    "acq_by_industry": "acquisition/by_industry",
    "acq_by_country": "acquisition/by_country",
    "mrr_monthly": "mrr/monthly_aggregate_mrr",
    "mrr_by_plan": "mrr/monthly_mrr_by_plan_tier",
    "conv_subscription_overall": "conversion/subscription_level_overall",
    "conv_subscription_by_plan": "conversion/subscription_level_by_plan_tier",
    "conv_account_overall": "conversion/account_level_overall",
    "ret_pooled_curve": "retention/pooled_retention_curve",
    "eng_top_features": "engagement/top_features_by_usage",
    "eng_summary_by_churn": "engagement/churn_status_engagement_summary",
    "churn_monthly": "churn/monthly_churn_events",
    "churn_by_reason": "churn/by_reason_code",
    "churn_by_plan": "churn/by_plan_tier",
    "churn_repeat_summary": "churn/repeat_churn_summary",
    "sup_volume_by_churn": "support/volume_and_resolution_by_churn_status",
    "sup_priority_mix": "support/priority_mix_by_churn_status",
}


#: Beside a mart's parts; readers of folders pass over names with an underscore.
SCHEMA_FILE = "_schema.json"


def write_mart(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write ``df`` as a folder of part files, with its schema beside them; CSV parts carry a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    write_text(df.sparkSession, f"{path}/{SCHEMA_FILE}", df.schema.json())


def read_mart(
    spark: SparkSession, path: str, fmt: str = "csv", schema: StructType | None = None
) -> DataFrame | None:
    """A mart read back with the types it was written with, or None when it was never written.

    The types come from ``schema``, else from the schema beside the parts.  Of a
    CSV folder without either, types are inferred, which costs a pass over it.
    """
    if schema is None and (stored := read_text(spark, f"{path}/{SCHEMA_FILE}")) is not None:
        schema = StructType.fromJson(json.loads(stored))
    reader = spark.read
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_marts(spark: SparkSession, out: str, fmt: str = "csv") -> dict[str, DataFrame | None]:
    """Every registered mart under ``out``."""
    return {
        name: read_mart(spark, f"{out.rstrip('/')}/{stem}", fmt)
        for name, stem in MART_PATHS.items()
    }


def publish(spark: SparkSession, built: str, out: str, stems: Iterable[str]) -> None:
    """Put the folders ``stems`` under ``built`` in the place of those under ``out``.

    Both lie in one file system, so each change is a rename.  The folders replaced
    are kept under ``out`` until all are changed; when a change fails, those made
    before it are taken back, so the old set stands as a whole.
    """
    replaced = f"{out}/_replaced-{uuid.uuid4().hex}"
    changed: list[tuple[str, bool]] = []
    try:
        for stem in stems:
            had = exists(spark, f"{out}/{stem}")
            if had:
                move(spark, f"{out}/{stem}", f"{replaced}/{stem}")
            changed.append((stem, had))
            move(spark, f"{built}/{stem}", f"{out}/{stem}")
    except Exception:
        for stem, had in reversed(changed):
            remove(spark, f"{out}/{stem}")
            if had:
                move(spark, f"{replaced}/{stem}", f"{out}/{stem}")
        raise
    finally:
        remove(spark, replaced)
