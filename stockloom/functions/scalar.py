"""Column-to-column functions (FN-*).  All of them stay inside JVM codegen."""

from __future__ import annotations

import math
import unicodedata
from functools import cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockloom.contracts import RISK_LEVELS, SEASONS

# The encodings read as "true", and the extra null tokens of an extract.
TRUTHY = ("1", "1.0", "y", "yes", "true", "t", "on", "promo", "promoted")
NULL_TOKENS = (
    "", "NA", "N/A", "n/a", "null", "NULL", "None", "-", "#N/A", "#N/A N/A", "#NA", "-1.#IND",
    "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "NaN", "nan",
)

# Date layouts, tried in this order.
DATE_LAYOUTS = (
    "yyyy-M-d",
    "d-M-yyyy",
    "d/M/yyyy",
    "d.M.yyyy",
    "yyyy/M/d",
    "yyyyMMdd",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "yyyy-M-d H:m:s",
)
UPLOAD_DATE_LAYOUTS = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d",
                       "d MMM yyyy", "MMM d, yyyy", "yyyy-M-d H:m:s")

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
EPSILON = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_sku(c) -> Column:
    """FN-1: trim, collapse inner whitespace, upper-case."""
    return F.upper(F.regexp_replace(F.regexp_replace(col(c), r"^\s+|\s+$", ""), r"\s+", " "))


@cache
def _accent_tables() -> tuple[str, str]:
    """Every BMP character that decomposes to one other character, and that character."""
    source, target = [], []
    for code in range(0xA0, 0xFFFE):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or unicodedata.combining(ch):
            continue
        base = "".join(
            x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)
        )
        if len(base) == 1 and base != ch and ord(base) < 0x250:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(c) -> Column:
    source, target = _accent_tables()
    return F.translate(F.regexp_replace(col(c), r"\p{M}", ""), source, target)


def fold_label(c) -> Column:
    """FN-2: comparable key of a free-text label."""
    lowered = F.lower(F.regexp_replace(strip_accents(c), r"^\s+|\s+$", ""))
    joined = F.replace(lowered, F.lit(" and "), F.lit(" & "))
    spelled = F.replace(joined, F.lit("organization"), F.lit("organisation"))
    return F.regexp_replace(spelled, r"\s+", " ")


def parse_dates(c, layouts=DATE_LAYOUTS) -> Column:
    """FN-4: first layout that reads the text, else null."""
    text = F.trim(col(c))
    return F.coalesce(*[F.try_to_date(text, layout) for layout in layouts])


def parse_flag(c) -> Column:
    """FN-5: 1 for a known "true" encoding, 0 for anything else."""
    return F.coalesce(F.lower(F.trim(col(c))).isin(*TRUTHY).cast("int"), F.lit(0))


def to_number(c) -> Column:
    """FN-6: number from text with thousands separators, null when unreadable."""
    text = F.replace(F.trim(col(c)), F.lit(","), F.lit(""))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def null_tokens(c) -> Column:
    """Null tokens of a text extract become null; other text is left as it is."""
    return F.when(~col(c).isin(*NULL_TOKENS), col(c))


def week_start(c) -> Column:
    """FN-7: Monday of the week."""
    return F.date_trunc("week", col(c)).cast("date")


def iso_week(c) -> Column:
    return F.weekofyear(col(c))


def iso_year(c) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(c))


def season(c) -> Column:
    """FN-9: season of a date's month."""
    month = F.month(col(c))
    out = None
    for name, months in SEASONS.items():
        hit = month.isin(*months)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def week_angle(week) -> Column:
    return F.lit(2.0 * math.pi) * col(week).cast("double") / F.lit(52.0)


def week_sin(week) -> Column:
    return F.sin(week_angle(week))


def week_cos(week) -> Column:
    return F.cos(week_angle(week))


def clip(c, low: float | None = None, high: float | None = None) -> Column:
    """FN-11: bounds that leave null alone (``least``/``greatest`` would skip it)."""
    value = col(c)
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def ratio(a, b, eps: float = EPSILON) -> Column:
    """FN-12: a / (b + eps), null when either side is null."""
    return F.try_divide(col(a), col(b) + F.lit(eps))


def ratio_or_null(a, b) -> Column:
    """FN-12: a / b, null when b is zero."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0.0)))


def norm_pdf(c) -> Column:
    x = col(c)
    return F.exp(-(x * x) / 2.0) * F.lit(1.0 / math.sqrt(2.0 * math.pi))


def norm_cdf(c) -> Column:
    """FN-13: normal distribution function.

    Spark has no ``erf``; this is the published rational approximation 7.1.26 of
    Abramowitz and Stegun (absolute error below 1.5e-7).
    """
    # The coefficients of that formula.
    p, a1, a2, a3, a4, a5 = (
        0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429,
    )
    x = col(c)
    z = F.abs(x) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * z)
    poly = ((((F.lit(a5) * t + a4) * t + a3) * t + a2) * t + a1) * t
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.when(x >= 0, F.lit(0.5) * (F.lit(1.0) + erf)).when(
        x < 0, F.lit(0.5) * (F.lit(1.0) - erf)
    )


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_loss(mean, sigma, available, eps: float = 1e-9) -> Column:
    """FN-14: expected unmet demand of a normal demand against a stock level."""
    m, s, a = col(mean), col(sigma), col(available)
    safe = F.greatest(s, F.lit(eps))
    k = (m - a) / safe
    loss = safe * (k * norm_cdf(k) + norm_pdf(k))
    return F.when(s > eps, F.greatest(loss, F.lit(0.0))).otherwise(
        F.greatest(m - a, F.lit(0.0))
    )


def risk_level(c) -> Column:
    """FN-15: severity band of a score."""
    out = None
    for name, floor in RISK_LEVELS:
        hit = col(c) >= floor
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("none")


def format_inr(c) -> Column:
    """FN-16: rupee amount in crore / lakh / units."""
    x = col(c)
    sign = F.when(x < 0, "-").otherwise("")
    value = F.abs(x)
    finite = x.isNotNull() & ~F.isnan(x) & (value < F.lit(float("inf")))
    body = (
        F.when(value >= 1e7, F.concat(F.lit("Rs "), F.format_number(value / 1e7, 2), F.lit(" Cr")))
        .when(value >= 1e5, F.concat(F.lit("Rs "), F.format_number(value / 1e5, 2), F.lit(" L")))
        .otherwise(F.concat(F.lit("Rs "), F.format_number(value, 0)))
    )
    return F.when(finite, F.concat(sign, body)).otherwise("n/a")


def round_even(c, places: int) -> Column:
    """FN-17: half-even rounding."""
    return F.bround(col(c), places)


def same_text(c, wanted: str) -> Column:
    """FN-18: case-insensitive equality."""
    return F.lower(col(c)) == F.lit(wanted.strip().lower())


def has_text(c, needle: str) -> Column:
    """FN-18: case-insensitive substring."""
    return F.contains(F.lower(col(c)), F.lit(needle.strip().lower()))


def launch_age(week, launch) -> tuple[Column, Column]:
    """FN-20: whole weeks since launch (never below 0) and the post-launch flag."""
    weeks = F.floor(F.datediff(col(week), col(launch)) / F.lit(7))
    return F.greatest(weeks, F.lit(0)).cast("long"), (weeks >= 0).cast("int")
