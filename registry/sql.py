"""SQL building blocks: the retail tables as common table expressions."""

from __future__ import annotations

import math

from registry.core import q

_CAT = (
    "CASE p_type WHEN 'ECONOMY' THEN 'Bedding & Bath' WHEN 'LARGE' THEN 'Lighting' "
    "WHEN 'MEDIUM' THEN 'Kitchen & Dining' WHEN 'PROMO' THEN 'Decor' "
    "WHEN 'SMALL' THEN 'Storage & Organisation' WHEN 'STANDARD' THEN 'Small Appliances' END"
)
_CODE = (
    "CASE p_type WHEN 'ECONOMY' THEN 'BTH' WHEN 'LARGE' THEN 'LGT' WHEN 'MEDIUM' THEN 'KTD' "
    "WHEN 'PROMO' THEN 'DEC' WHEN 'SMALL' THEN 'STO' WHEN 'STANDARD' THEN 'APP' END"
)
_NUMBER = {
    "style": "lpad(regexp_extract(p_brand, '([0-9]+)', 1), 3, '0')",
    "part": "lpad(CAST(p_partkey AS VARCHAR), 12, '0')",
}
_LAGS = (0, 1, 2, 3, 4, 8, 13, 26, 52)
_ROLLS = (4, 8, 13, 26, 52)


def _products(cat: str) -> str:
    return (
        f"SELECT p_partkey, 'NBL-' || {_CODE} || '-' || {_NUMBER[cat]} AS sku_id, "
        f"{_CAT} AS category, p_brand AS subcategory FROM part"
    )


def _features() -> str:
    cols = [f"lag(units, {k}) OVER w AS units_lag_{k}" for k in _LAGS]
    for n in _ROLLS:
        least = max(2, n // 4)
        w = f"(PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols.append(f"CASE WHEN count(units) OVER {w} >= {least} THEN avg(units) OVER {w} END AS units_roll_mean_{n}")
        cols.append(f"CASE WHEN count(units) OVER {w} >= {least} THEN stddev_samp(units) OVER {w} END AS units_roll_std_{n}")
    w13 = "(PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)"
    cols.append(f"CASE WHEN count(units) OVER {w13} >= 3 THEN max(units) OVER {w13} END AS units_roll_max_13")
    for n in (8, 26):
        least = max(2, n // 4)
        w = f"(PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols.append(
            f"CASE WHEN count(units) OVER {w} >= {least} THEN "
            f"avg(CASE WHEN units <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER {w} END AS zero_frac_{n}"
        )
    for n in (4, 13):
        w = f"(PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols.append(f"sum(promo_days) OVER {w} AS promo_days_roll_{n}")
        if n == 4:
            cols.append(f"avg(avg_price) OVER {w} AS price_roll_mean_4")
    return (
        "SELECT *, units_roll_mean_4/(units_roll_mean_13+1e-6) AS trend_ratio_4_13, "
        "units_roll_mean_13/(units_roll_mean_52+1e-6) AS trend_ratio_13_52, "
        "units_roll_std_13/(units_roll_mean_13+1e-6) AS cv_13, "
        "avg_price/(list_price+1e-6) AS price_vs_list, "
        "greatest(1.0-avg_price/(list_price+1e-6), 0.0) AS discount_depth, "
        "list_price-unit_cost AS gross_margin_per_unit FROM (SELECT *, "
        + ", ".join(cols)
        + " FROM panel WINDOW w AS (PARTITION BY sku_id ORDER BY week_start))"
    )


def _supervised(labelled: bool) -> str:
    parts = []
    for h in range(1, 9):
        parts.append(
            f"SELECT *, {h} AS horizon, lead(units,{h}) OVER w AS y, lag(units,{52 - h}) OVER w AS "
            f"units_seasonal_lag, week_start + {7 * h} AS target_week FROM feat "
            "WINDOW w AS (PARTITION BY sku_id ORDER BY week_start)"
        )
    body = " UNION ALL ".join(parts)
    return f"SELECT * FROM ({body}) WHERE y IS NOT NULL" if labelled else body


_HOLIDAY = "((month(d)=1 AND day(d) IN (1,26)) OR (month(d)=12 AND day(d)=25))"
_SEASON = (
    "CASE WHEN month(d) IN (12,1,2) THEN 'Winter' WHEN month(d) IN (3,4) THEN 'Spring' "
    "WHEN month(d) IN (5,6) THEN 'Summer' WHEN month(d) IN (7,8,9) THEN 'Monsoon' ELSE 'Festive' END"
)
_EVENT = "CASE weekofyear(d) WHEN 3 THEN 'New Year' WHEN 20 THEN 'Summer' WHEN 32 THEN 'Monsoon' WHEN 44 THEN 'Festive' ELSE '' END"
_DEPTH = "CASE weekofyear(d) WHEN 3 THEN 0.1::DOUBLE WHEN 20 THEN 0.15 WHEN 32 THEN 0.2 WHEN 44 THEN 0.3 ELSE 0.0 END"
SKU_NO = "(CAST(regexp_extract(sku_id, '([0-9]+)$', 1) AS BIGINT) + 7*length(category))"
WEEK_NO = "((week_start - DATE '1990-01-01') // 7)"

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "products": ((), "{products}"),
    "lines": (
        ("products",),
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_discount, l_tax, "
        "CAST(l_shipdate AS DATE) AS \"date\", l_quantity AS units_sold, l_extendedprice AS revenue, "
        "l_extendedprice/l_quantity AS unit_price, CAST(l_discount >= 0.08::DOUBLE AS INT) AS promo_flag, "
        "sku_id, category, subcategory FROM lineitem JOIN products ON l_partkey = p_partkey",
    ),
    "sales": (
        ("lines",),
        "SELECT \"date\", sku_id, sum(units_sold) AS units_sold, sum(revenue) AS revenue, "
        "avg(unit_price) AS unit_price, max(promo_flag) AS promo_flag FROM (SELECT DISTINCT \"date\", "
        "sku_id, units_sold, revenue, unit_price, promo_flag FROM lines) GROUP BY \"date\", sku_id",
    ),
    "master": (
        ("lines",),
        "SELECT sku_id, category, subcategory, launch_date, "
        + q("list_price*0.6", 2)
        + " AS unit_cost, list_price FROM (SELECT sku_id, category, subcategory, min(\"date\") AS "
        "launch_date, "
        + q("CAST(sum(CAST(round(revenue*100) AS BIGINT)) AS DOUBLE)/(CAST(sum(CAST(units_sold AS BIGINT)) AS DOUBLE)*100.0::DOUBLE)", 2)
        + " AS list_price FROM lines GROUP BY 1,2,3)",
    ),
    "span": ((), "SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem"),
    "days": (
        ("span",),
        "SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b + 140 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM span",
    ),
    "calendar": (
        ("days",),
        f"SELECT d AS \"date\", isoyear(d) AS iso_year, weekofyear(d) AS iso_week, CAST(date_trunc('week', d) AS DATE) AS week_start, "
        f"month(d) AS \"month\", {_SEASON} AS season, CAST({_HOLIDAY} AS INT) AS is_holiday, {_EVENT} AS promo_event, "
        f"{_DEPTH} AS planned_discount FROM days",
    ),
    "weeks": (
        ("calendar",),
        "SELECT week_start, min_by(iso_week, \"date\") AS iso_week, min_by(\"month\", \"date\") AS \"month\", "
        "CAST(sum(is_holiday) AS DOUBLE) AS holiday_days, count(*) FILTER (promo_event <> '') AS promo_event_days, "
        "count(*) AS days_in_week, max(planned_discount) AS planned_discount, "
        "CAST(count(*) FILTER (promo_event <> '') > 0 AS INT) AS has_promo_event, "
        f"sin({2 * math.pi!r}::DOUBLE * min_by(iso_week, \"date\") / 52.0::DOUBLE) AS week_sin, "
        f"cos({2 * math.pi!r}::DOUBLE * min_by(iso_week, \"date\") / 52.0::DOUBLE) AS week_cos "
        "FROM calendar GROUP BY week_start",
    ),
    "grid": (
        ("master", "sales", "span"),
        "SELECT g.sku_id, g.d AS \"date\", coalesce(s.units_sold, 0) AS units_sold, coalesce(s.revenue, 0) AS revenue, "
        "s.unit_price AS sold_price, coalesce(s.promo_flag, 0) AS promo_flag, category, subcategory, unit_cost, list_price, launch_date "
        "FROM (SELECT m.*, CAST(unnest(generate_series(CAST(greatest(a, launch_date) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d "
        "FROM master m, span) g LEFT JOIN sales s ON s.sku_id = g.sku_id AND s.\"date\" = g.d",
    ),
    "daily": (
        ("grid", "calendar"),
        "SELECT sku_id, g.\"date\", units_sold, revenue, coalesce(last_value(sold_price IGNORE NULLS) OVER (PARTITION BY sku_id ORDER BY g.\"date\" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        "first_value(sold_price IGNORE NULLS) OVER (PARTITION BY sku_id ORDER BY g.\"date\" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), list_price) AS unit_price, "
        "promo_flag, category, subcategory, unit_cost, list_price, launch_date, week_start, is_holiday, promo_event, season "
        "FROM grid g JOIN calendar c ON c.\"date\" = g.\"date\"",
    ),
    "panel_daily": (
        ("daily",),
        "SELECT *, greatest((week_start - launch_date)//7, 0) AS weeks_since_launch, CAST(week_start >= launch_date AS INT) AS is_post_launch FROM ("
        "SELECT sku_id, week_start, sum(units_sold) AS units, sum(revenue) AS revenue, avg(unit_price) AS avg_price, "
        "CAST(sum(promo_flag) AS DOUBLE) AS promo_days, CAST(sum(is_holiday) AS DOUBLE) AS holiday_days, category, subcategory, unit_cost, list_price, launch_date "
        "FROM daily GROUP BY sku_id, week_start, category, subcategory, unit_cost, list_price, launch_date HAVING count(*) = 7)",
    ),
    "seg": (
        ("master", "sales", "span"),
        "SELECT m.*, s.\"date\" AS sdate, s.units_sold, s.revenue AS rev, s.promo_flag, coalesce(s.unit_price, m.list_price) AS price, "
        "CASE WHEN row_number() OVER w = 1 THEN greatest(a, launch_date) ELSE s.\"date\" END AS seg_from, "
        "coalesce(lead(s.\"date\") OVER w - 1, b) AS seg_to FROM master m CROSS JOIN span LEFT JOIN sales s ON s.sku_id = m.sku_id "
        "AND s.\"date\" >= greatest(a, launch_date) WINDOW w AS (PARTITION BY m.sku_id ORDER BY s.\"date\")",
    ),
    "cov": (
        ("seg",),
        "SELECT *, CAST(unnest(generate_series(CAST(date_trunc('week', seg_from) AS TIMESTAMP), CAST(seg_to AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_start FROM seg",
    ),
    "panel": (
        ("cov", "weeks"),
        "SELECT p.*, w.holiday_days, greatest((p.week_start - launch_date)//7, 0) AS weeks_since_launch, CAST(p.week_start >= launch_date AS INT) AS is_post_launch FROM ("
        "SELECT sku_id, week_start, category, subcategory, unit_cost, list_price, launch_date, "
        "sum(CASE WHEN date_trunc('week', sdate) = week_start THEN units_sold ELSE 0.0::DOUBLE END) AS units, "
        "sum(CASE WHEN date_trunc('week', sdate) = week_start THEN rev ELSE 0.0::DOUBLE END) AS revenue, "
        "sum(price * (least(seg_to, week_start + 6) - greatest(seg_from, week_start) + 1)) / sum(least(seg_to, week_start + 6) - greatest(seg_from, week_start) + 1) AS avg_price, "
        "CAST(sum(CASE WHEN date_trunc('week', sdate) = week_start THEN promo_flag ELSE 0 END) AS DOUBLE) AS promo_days "
        "FROM cov GROUP BY ALL HAVING sum(least(seg_to, week_start + 6) - greatest(seg_from, week_start) + 1) = 7) p JOIN weeks w ON w.week_start = p.week_start",
    ),
    "inventory": (
        ("panel",),
        "SELECT week_start AS \"date\", sku_id, CAST(floor(recent * (2 + (7*wk + 3*no) % 20) / 10.0::DOUBLE) AS DOUBLE) AS on_hand_units, "
        "CAST(floor(recent * ((wk + no) % 3) / 4.0::DOUBLE) AS DOUBLE) AS on_order_units, CAST(7 + no % 40 AS DOUBLE) AS lead_time_days, "
        "CAST(floor(recent / 4.0::DOUBLE) AS DOUBLE) AS reorder_point FROM (SELECT *, "
        f"{SKU_NO} AS no, {WEEK_NO} AS wk, sum(units) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM panel)",
    ),
    "feat": (("panel",), _features()),
    "sup": (("feat",), _supervised(True)),
    "wk": (("panel",), "SELECT week_start, row_number() OVER (ORDER BY week_start) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week_start FROM panel)"),
    "origins": (
        ("wk",),
        # labelled weeks are all but the last, so the last origin is index n-1-1-8
        "SELECT week_start, 6 - (n - 10 - i)//4 AS fold FROM wk WHERE i <= n - 10 AND (n - 10 - i) % 4 = 0 AND (n - 10 - i)//4 < 6",
    ),
    "test": (
        ("sup", "origins"),
        "SELECT s.*, o.fold, greatest(coalesce(units_seasonal_lag, units_roll_mean_4, 0.0), 0.0) AS baseline, "
        "greatest(coalesce(units_lag_0, 0.0), 0.0) AS naive FROM sup s JOIN origins o ON o.week_start = s.week_start",
    ),
}


def with_sql(cat: str, needs: str | tuple[str, ...], final: str, extra: str = "") -> str:
    """``final`` behind every table it needs, directly or not."""
    needs = (needs,) if isinstance(needs, str) else needs
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in _CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({_CTES[n][1].replace('{products}', _products(cat))})" for n in order]
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


# Aggregates shared by the accuracy queries.
def wape_sql(a: str, p: str) -> str:
    return f"sum(abs({a}-{p}))/nullif(sum(abs({a})),0)"


def bias_sql(a: str, p: str) -> str:
    return f"sum({p}-{a})/nullif(sum(abs({a})),0)"


def cdf_sql(x: str) -> str:
    """The same rational approximation as the engine's normal distribution."""
    z = f"(abs({x})/{math.sqrt(2.0)!r}::DOUBLE)"
    t = f"(1.0::DOUBLE/(1.0::DOUBLE+0.3275911::DOUBLE*{z}))"
    poly = (
        f"((((1.061405429::DOUBLE*{t}-1.453152027::DOUBLE)*{t}+1.421413741::DOUBLE)*{t}"
        f"-0.284496736::DOUBLE)*{t}+0.254829592::DOUBLE)*{t}"
    )
    erf = f"(1.0::DOUBLE-({poly})*exp(-{z}*{z}))"
    return f"(CASE WHEN {x} >= 0 THEN 0.5::DOUBLE*(1.0::DOUBLE+{erf}) ELSE 0.5::DOUBLE*(1.0::DOUBLE-{erf}) END)"


def pdf_sql(x: str) -> str:
    return f"(exp(-({x}*{x})/2.0::DOUBLE)*{1.0 / math.sqrt(2.0 * math.pi)!r}::DOUBLE)"
