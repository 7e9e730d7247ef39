"""Raw extracts as text (SRC-1..SRC-4)."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.contracts import RAW, RAW_OPTIONAL, Contract, ContractError, DataQualityError, validate
from stockloom.functions.scalar import null_tokens

log = logging.getLogger("stockloom")


class MissingFileError(FileNotFoundError):
    """A required extract is absent."""


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, leading blanks kept, with the arrival order in ``_row_seq``.

    The order is (file, block, position in block), which is stable however the files
    are split into tasks.
    """
    try:
        names = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        raise MissingFileError(f"no extract at {path}") from error
    raw = (
        spark.read.schema(", ".join(f"`{n}` string" for n in names))
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("multiLine", False)
        .csv(path)
    )
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select(*[null_tokens(n).alias(n) for n in names], seq.alias("_row_seq"))


def read_extract(spark: SparkSession, path: str, rules: Contract) -> DataFrame:
    """SRC-1: one extract; presence of its columns is checked, an empty file is an error."""
    df = read_text(spark, path)
    if df.limit(1).count() == 0:
        raise DataQualityError(f"extract at {path} contains no rows")
    return validate(df, rules, presence_only=True)


def load_extracts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """SRC-2: the four required extracts."""
    return {
        name: read_extract(spark, f"{folder.rstrip('/')}/{name}.csv", rules)
        for name, rules in RAW.items()
    }


def load_optional(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """SRC-3: optional driver extracts; a missing or malformed one reads as not supplied."""
    out: dict[str, DataFrame | None] = {}
    for name, rules in RAW_OPTIONAL.items():
        try:
            out[name] = read_extract(spark, f"{folder.rstrip('/')}/{name}.csv", rules)
        except (MissingFileError, ContractError, DataQualityError) as error:
            log.warning("optional extract %s is not used: %s", name, error)
            out[name] = None
    return out


# The alternative header set and the labels it spells differently.
RENAMES = {
    "sales_daily": {
        "Date": "date", "SKU": "sku_id", "Units_Sold": "units_sold", "Revenue": "revenue",
        "Price": "unit_price", "Promotion": "promo_flag",
    },
    "sku_master": {
        "SKU": "sku_id", "Category": "category", "Subcategory": "subcategory",
        "Launch_Date": "launch_date", "Cost_Price": "unit_cost", "Selling_Price": "list_price",
    },
    "calendar": {"promotion_event": "promo_event"},
    "inventory_snapshots": {
        "Snapshot_Date": "date", "SKU": "sku_id", "Current_Stock": "on_hand_units",
        "On_Order": "on_order_units", "Lead_Time_Days": "lead_time_days",
        "Reorder_Point": "reorder_point",
    },
}
CATEGORY_ALIGNMENT = {
    "Home Decor": "Decor",
    "Storage": "Storage & Organisation",
    "Kitchen": "Kitchen & Dining",
}


def adapt_extract(df: DataFrame, rename: dict[str, str],
                  labels: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """SRC-4: rename columns, align labels; the error lists every missing source column."""
    missing = [c for c in rename if c not in df.columns]
    if missing:
        raise DataQualityError(f"expected column(s) {missing}; found {df.columns}")
    out = df
    for column, mapping in (labels or {}).items():
        out = out.replace(mapping, subset=[column])
    return out.withColumnsRenamed(rename)
