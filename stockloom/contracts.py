"""Table contracts, vocabularies and settings.

A contract is written as one line per table: ``name:kind`` with ``!`` for a
column that may not be null.  :func:`validate` reports every violation at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table does not satisfy its contract; carries every problem found."""

    def __init__(self, table: str, problems: list[str]):
        super().__init__(f"{table}: " + "; ".join(problems))
        self.table = table
        self.problems = problems


class DataQualityError(ValueError):
    """The data cannot be used for the requested step."""


class InsufficientHistoryError(ValueError):
    """History is too short for the requested step."""


class LeakageError(ValueError):
    """A feature read data from after its origin week."""


_KINDS = {
    "string": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "number": (
        T.ByteType, T.ShortType, T.IntegerType, T.LongType,
        T.FloatType, T.DoubleType, T.DecimalType,
    ),
    "boolean": (T.BooleanType,),
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "any": (T.DataType,),
}
_DEFAULT_TYPE = {
    "string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(),
    "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "any": T.StringType(),
}


@dataclass(frozen=True)
class ColumnRule:
    name: str
    kind: str
    nullable: bool


@dataclass(frozen=True)
class Contract:
    name: str
    columns: tuple[ColumnRule, ...]
    key: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c.name, _DEFAULT_TYPE[c.kind], c.nullable) for c in self.columns]
        )

    @property
    def text_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T.StringType()) for c in self.columns])


def contract(name: str, spec: str, key: str = "") -> Contract:
    rules = []
    for token in spec.split():
        column, kind = token.rstrip("!").split(":")
        rules.append(ColumnRule(column, kind, not token.endswith("!")))
    return Contract(name, tuple(rules), tuple(key.split()))


RAW = {
    "sales_daily": contract(
        "sales_daily (raw)",
        "date:any sku_id:any units_sold:any revenue:any unit_price:any promo_flag:any",
    ),
    "sku_master": contract(
        "sku_master (raw)",
        "sku_id:any category:any subcategory:any launch_date:any unit_cost:any list_price:any",
    ),
    "calendar": contract(
        "calendar (raw)", "date:any week:any month:any season:any is_holiday:any promo_event:any"
    ),
    "inventory_snapshots": contract(
        "inventory_snapshots (raw)",
        "date:any sku_id:any on_hand_units:any on_order_units:any lead_time_days:any "
        "reorder_point:any",
    ),
}

RAW_OPTIONAL = {
    "marketing_spend": contract(
        "marketing_spend (raw)",
        "week_start:any sku_id:any media_spend:any impressions:any email_sends:any",
    ),
    "web_analytics": contract(
        "web_analytics (raw)", "date:any sku_id:any sessions:any add_to_cart:any"
    ),
    "market_conditions": contract(
        "market_conditions (raw)",
        "week_start:any category:any competitor_price_index:any weather_anomaly:any",
    ),
}

CLEAN = {
    "sales_daily": contract(
        "sales_daily (clean)",
        "date:date! sku_id:string! units_sold:number! revenue:number! unit_price:number! "
        "promo_flag:integer!",
        "date sku_id",
    ),
    "sku_master": contract(
        "sku_master (clean)",
        "sku_id:string! category:string! subcategory:string! launch_date:date! "
        "unit_cost:number! list_price:number!",
        "sku_id",
    ),
    "calendar": contract(
        "calendar (clean)",
        "date:date! iso_year:integer! iso_week:integer! week_start:date! month:integer! "
        "season:string! is_holiday:integer! promo_event:string! planned_discount:number!",
        "date",
    ),
    "inventory_snapshots": contract(
        "inventory_snapshots (clean)",
        "date:date! sku_id:string! on_hand_units:number! on_order_units:number! "
        "lead_time_days:number! reorder_point:number!",
        "date sku_id",
    ),
    "marketing_spend": contract(
        "marketing_spend (clean)",
        "week_start:date! sku_id:string! media_spend:number! impressions:number! "
        "email_sends:number!",
        "week_start sku_id",
    ),
    "web_analytics": contract(
        "web_analytics (clean)",
        "date:date! sku_id:string! sessions:number! add_to_cart:number!",
        "date sku_id",
    ),
    "market_conditions": contract(
        "market_conditions (clean)",
        "week_start:date! category:string! competitor_price_index:number! weather_anomaly:number!",
        "week_start category",
    ),
}

ANALYSIS_READY = contract(
    "analysis_ready (daily)",
    "date:date! sku_id:string! units_sold:number! revenue:number! unit_price:number! "
    "promo_flag:integer! category:string! subcategory:string! launch_date:date! "
    "unit_cost:number! list_price:number! week_start:date! is_holiday:integer! "
    "promo_event:string! season:string!",
    "date sku_id",
)

WEEKLY_PANEL = contract(
    "weekly_panel",
    "sku_id:string! week_start:date! units:number! revenue:number! avg_price:number! "
    "promo_days:number! holiday_days:number! category:string! subcategory:string! "
    "unit_cost:number! list_price:number! launch_date:date! weeks_since_launch:number! "
    "is_post_launch:integer! media_spend:number! impressions:number! email_sends:number! "
    "sessions:number! add_to_cart:number! discount_pct:number! competitor_price_index:number! "
    "weather_anomaly:number!",
    "sku_id week_start",
)

# The controlled vocabularies and the product-code convention.
CATEGORY_CODES = {
    "Bedding & Bath": "BTH",
    "Lighting": "LGT",
    "Kitchen & Dining": "KTD",
    "Decor": "DEC",
    "Storage & Organisation": "STO",
    "Small Appliances": "APP",
}
SKU_CODE_PATTERN = r"^NBL-([A-Z]{3})-\d+$"
UNCLASSIFIED = "Unclassified"

SEASONS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4),
    "Summer": (5, 6),
    "Monsoon": (7, 8, 9),
    "Festive": (10, 11),
}

ACTION_LABELS = {
    "reorder_now": "Reorder now",
    "markdown_clear": "Markdown / clear",
    "watch_volatile": "Watch / volatile",
    "healthy": "Healthy",
}
ACTION_RATIONALE = {
    "reorder_now": "High stockout risk, low overstock risk - raise a replenishment order "
    "before stock runs out.",
    "markdown_clear": "High overstock risk, low stockout risk - promote or discount to free "
    "up capital.",
    "watch_volatile": "High on both - demand is erratic relative to cover; review manually.",
    "healthy": "Low on both - no action needed.",
}
RISK_LEVELS = (("critical", 0.80), ("high", 0.50), ("medium", 0.25), ("low", 0.05))
SEVERITY_ORDER = {"critical": 0, "warning": 1, "info": 2}


@dataclass(frozen=True)
class Settings:
    """Defaults of every run; :meth:`check` rejects combinations that cannot work."""

    horizon_weeks: int = 8
    backtest_folds: int = 6
    backtest_step_weeks: int = 4
    min_train_weeks: int = 60
    interval_coverage: float = 0.8
    service_level: float = 0.95
    overstock_cover_weeks: float = 12.0
    risk_high_threshold: float = 0.5
    lead_time_min_days: int = 1
    lead_time_max_days: int = 120
    random_seed: int = 20260907
    extend_lead_time: bool = False
    extras: dict = field(default_factory=dict)

    @property
    def horizons(self) -> tuple[int, ...]:
        return tuple(range(1, self.horizon_weeks + 1))

    @property
    def quantile_levels(self) -> tuple[float, float]:
        tail = (1.0 - self.interval_coverage) / 2.0
        return round(tail, 6), round(1.0 - tail, 6)

    @property
    def coverage_z(self) -> float:
        return NormalDist().inv_cdf(0.5 * (1.0 + self.interval_coverage))

    @property
    def service_z(self) -> float:
        return NormalDist().inv_cdf(self.service_level)

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    def check(self, history_weeks: int) -> None:
        needed = (
            self.min_train_weeks
            + self.horizon_weeks
            + (self.backtest_folds - 1) * self.backtest_step_weeks
        )
        if not 1 <= self.horizon_weeks <= 26:
            raise ValueError("horizon_weeks must lie between 1 and 26")
        if self.lead_time_min_days >= self.lead_time_max_days:
            raise ValueError("lead_time_min_days must be below lead_time_max_days")
        if history_weeks < needed:
            raise InsufficientHistoryError(
                f"history has {history_weeks} weeks, the configured backtest needs {needed}"
            )


DEFAULTS = Settings()


# --------------------------------------------------------------------------- #
# CON-1
# --------------------------------------------------------------------------- #
def shape_problems(df: DataFrame, rules: Contract, check_types: bool = True) -> list[str]:
    """Problems visible in the schema alone: missing columns and wrong kinds."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    missing = sorted(c.name for c in rules.columns if c.name not in have)
    if missing:
        problems.append("missing column(s): " + ", ".join(missing))
    if check_types:
        for c in rules.columns:
            if c.name in have and not isinstance(have[c.name], _KINDS[c.kind]):
                problems.append(
                    f"column '{c.name}' should be {c.kind} but is {have[c.name].simpleString()}"
                )
    return problems


def contract_counts(df: DataFrame, rules: Contract) -> DataFrame:
    """One row of counts: nulls per required column, null keys, surplus key rows.

    The key is grouped once with a map-side combine, so a hot key costs one row
    per task; the null counts ride along as sums over the same groups.
    """
    required = [c.name for c in rules.columns if not c.nullable and c.name in df.columns]
    null_count = [
        F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in required
    ]
    key = [k for k in rules.key if k in df.columns]
    if not key or len(key) != len(rules.key):
        return df.agg(F.count(F.lit(1)).alias("rows"), *null_count)
    any_null: Column = F.lit(False)
    for k in key:
        any_null = any_null | F.col(k).isNull()
    grouped = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), *null_count)
    return grouped.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *[F.coalesce(F.sum(f"nulls_{c}"), F.lit(0)).alias(f"nulls_{c}") for c in required],
        F.coalesce(F.sum(F.when(any_null, F.col("rows"))), F.lit(0)).alias("null_key_rows"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicate_key_rows"),
    )


def validate(df: DataFrame, rules: Contract, *, presence_only: bool = False) -> DataFrame:
    """Raise :class:`ContractError` naming every violation; return ``df`` otherwise."""
    problems = shape_problems(df, rules, check_types=not presence_only)
    if not presence_only:
        counts = contract_counts(df, rules).first().asDict()
        for c in rules.columns:
            nulls = counts.get(f"nulls_{c.name}", 0)
            if nulls:
                problems.append(f"column '{c.name}' is non-nullable but has {nulls} null(s)")
        if counts.get("duplicate_key_rows"):
            problems.append(
                f"primary key {rules.key} is not unique: "
                f"{counts['duplicate_key_rows']} duplicate row(s)"
            )
        if counts.get("null_key_rows"):
            problems.append(f"primary key {rules.key} has {counts['null_key_rows']} null row(s)")
    if problems:
        raise ContractError(rules.name, problems)
    return df
