"""Orders of preference among families, sources and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which family a formula reads a field from first.
FORMULA_PRIORITY = {
    "RPT_F10_FINANCE_GBALANCE": 0,
    "RPT_F10_FINANCE_GINCOME": 1,
    "RPT_F10_FINANCE_GCASHFLOW": 2,
    "RPT_F10_FINANCE_MAINFINADATA": 3,
    "RPT_F10_FINANCE_GRATIO": 4,
    "RPT_F10_QTR_MAINFINADATA": 5,
    "RPT_F10_FINANCE_QGRATIO": 6,
    "RPT_F10_FINANCE_GINCOMEQC": 7,
    "RPT_F10_FINANCE_GCASHFLOWQC": 8,
    "RPT_F10_FINANCE_DUPONT": 90,
    "PageAjax": 99,
}
# Which family a comparison reads a field from first.
COMPARE_PRIORITY = {
    "RPT_F10_FINANCE_GBALANCE": 0,
    "RPT_F10_FINANCE_GINCOME": 0,
    "RPT_F10_FINANCE_GCASHFLOW": 0,
    "RPT_F10_FINANCE_GINCOMEQC": 1,
    "RPT_F10_FINANCE_GCASHFLOWQC": 1,
    "RPT_F10_FINANCE_MAINFINADATA": 2,
    "RPT_F10_QTR_MAINFINADATA": 2,
    "RPT_F10_FINANCE_GRATIO": 3,
    "RPT_F10_FINANCE_QGRATIO": 3,
    "RPT_F10_FINANCE_DUPONT": 4,
}
# Families of independent quarters, of statements, and units of money.
INDEPENDENT = ["RPT_F10_FINANCE_GINCOMEQC", "RPT_F10_FINANCE_GCASHFLOWQC", "RPT_F10_QTR_MAINFINADATA", "RPT_F10_FINANCE_QGRATIO"]
# Families whose quarters add up to twelve months, and those whose totals run through the year.
SINGLE_QUARTER = ["RPT_F10_FINANCE_GINCOMEQC", "RPT_F10_FINANCE_GCASHFLOWQC"]
CUMULATIVE = ["RPT_F10_FINANCE_GINCOME", "RPT_F10_FINANCE_GCASHFLOW"]
STATEMENTS = {
    "RPT_F10_FINANCE_GBALANCE": "balance_sheet",
    "RPT_F10_FINANCE_GINCOME": "income_statement",
    "RPT_F10_FINANCE_GCASHFLOW": "cash_flow",
    "RPT_F10_FINANCE_GINCOMEQC": "income_statement",
    "RPT_F10_FINANCE_GCASHFLOWQC": "cash_flow",
    "RPT_F10_FINANCE_MAINFINADATA": "financial_indicator",
    "RPT_F10_QTR_MAINFINADATA": "financial_indicator",
    "RPT_F10_FINANCE_GRATIO": "financial_ratio",
    "RPT_F10_FINANCE_QGRATIO": "financial_ratio",
    "RPT_F10_FINANCE_DUPONT": "dupont",
}
UNIT_SCALES = {"元": 1.0, "人民币元": 1.0, "千元": 1_000.0, "万元": 10_000.0, "亿元": 100_000_000.0}
SOURCE_PRIORITIES = {
    ("OFFICIAL_DISCLOSURE", "FACT_DIRECT"): 100,
    ("OFFICIAL_DISCLOSURE", "FACT_CALCULATED"): 90,
    ("OFFICIAL_DISCLOSURE", "OFFICIAL_METADATA"): 85,
    ("EASTMONEY", "FACT_DIRECT"): 60,
    ("EASTMONEY", "FACT_CALCULATED"): 55,
    ("EASTMONEY", "SOURCE_SPECIFIC"): 40,
}


def looked_up(column: Column | str, values: dict, other) -> Column:
    """The value that a small fixed dictionary has for a column, as an expression."""
    c = F.col(column) if isinstance(column, str) else column
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), other if isinstance(other, Column) else F.lit(other))


def formula_priority(family: Column | str = "family") -> Column:
    return looked_up(family, FORMULA_PRIORITY, 50)


def scaled(value: Column | str, unit: Column | str) -> Column:
    """A value in 元 where its unit is a multiple of that."""
    v = F.col(value) if isinstance(value, str) else value
    u = F.trim(F.col(unit) if isinstance(unit, str) else unit)
    return v * looked_up(F.coalesce(u, F.lit("")), UNIT_SCALES, 1.0)


def canonical_unit(unit: Column | str) -> Column:
    u = F.trim(F.col(unit) if isinstance(unit, str) else unit)
    return F.when(u.isin(*UNIT_SCALES), "元").otherwise(u)


def source_priority(source: Column, status: Column) -> Column:
    out = F.when(status.isin("PARSE_SUSPECT", "UNRESOLVED"), 0)
    for (s, t), p in SOURCE_PRIORITIES.items():
        out = out.when((source == s) & (status == t), p)
    return out.when(source == "EASTMONEY", 50).otherwise(70)
