"""Twelve months, formulas, ratios and quarters with known answers."""

import datetime

import pytest

from factloom.operators import timeseries as ts

COLUMNS = "security_code string, family string, dataset string, field_key string, field_name_cn string, report_date date, value_num double, unit string"
BALANCE, INCOME, QUARTERS = "RPT_F10_FINANCE_GBALANCE", "RPT_F10_FINANCE_GINCOME", "RPT_F10_FINANCE_GINCOMEQC"


def day(text):
    return datetime.date.fromisoformat(text)


def facts(spark, rows):
    full = [("688521", family, family, key, name, day(date), value, "元") for key, name, date, value, family in rows]
    return spark.createDataFrame(full, COLUMNS)


BASE = [
    ("REVENUE_Q", "单季度收入", "2025-06-30", 20.0, QUARTERS), ("REVENUE_Q", "单季度收入", "2025-09-30", 30.0, QUARTERS),
    ("REVENUE_Q", "单季度收入", "2025-12-31", 40.0, QUARTERS), ("REVENUE_Q", "单季度收入", "2026-03-31", 10.0, QUARTERS),
    ("CIP", "在建工程", "2026-03-31", 25.0, BALANCE), ("TOTAL_ASSETS", "资产总计", "2026-03-31", 100.0, BALANCE),
    ("CIP", "在建工程", "2026-03-31", 999.0, "RPT_F10_FINANCE_DUPONT"), ("TOTAL_ASSETS", "资产总计", "2026-03-31", 1000.0, "RPT_F10_FINANCE_DUPONT"),
]


def at(spark, formula, rows, end):
    ends = spark.createDataFrame([("688521", day(end))], "security_code string, report_date date")
    return ts.evaluate(formula, facts(spark, rows), ends).first()


def test_four_quarters(spark):
    rows = facts(spark, BASE)
    (found,) = ts.ttm_components(rows, rows).collect()
    assert (found.ttm, found.method, len(found.components)) == (100.0, "FOUR_INDEPENDENT_QUARTERS", 4)
    assert found.formula == "2025-06-30:20 + 2025-09-30:30 + 2025-12-31:40 + 2026-03-31:10"


def test_formula_of_localised_names(spark):
    r = at(spark, 'F("在建工程") / F("资产总计")', BASE, "2026-03-31")
    assert (r.value, r.reason, [t.family for t in r.trace]) == (0.25, None, [BALANCE, BALANCE])


def test_only_the_two_families_add_up_to_a_year(spark):
    dates = ["2025-03-31", "2025-06-30", "2025-09-30", "2025-12-31"]
    both = [("X", "x", d, v, f) for d in dates for f, v in ((QUARTERS, 10.0), ("RPT_F10_QTR_MAINFINADATA", 7.0))]
    rows = facts(spark, both)
    assert [(r.report_date, r.ttm) for r in ts.ttm(rows, rows).collect()] == [(day("2025-12-31"), 40.0)]
    ratios = facts(spark, [("ROE", "roe", d, 5.0, "RPT_F10_FINANCE_QGRATIO") for d in dates] + [("A", "a", d, 5.0, BALANCE) for d in dates])
    assert ts.ttm(ratios, ratios).collect() == []


def test_cumulative_by_exact_dates(spark):
    rows = [("X", "x", "2024-12-31", 100.0, INCOME), ("X", "x", "2024-06-30", 40.0, INCOME), ("X", "x", "2025-06-30", 55.0, INCOME)]
    odd = [("Y", "y", "2024-12-31", 1.0, INCOME), ("Y", "y", "2024-06-29", 1.0, INCOME), ("Y", "y", "2025-06-30", 1.0, INCOME)]
    df = facts(spark, rows + odd)
    found = {(r.field_key, str(r.report_date)): r for r in ts.ttm_components(df, df).collect()}
    assert sorted(found) == [("X", "2024-12-31"), ("X", "2025-06-30"), ("Y", "2024-12-31")]
    r = found["X", "2025-06-30"]
    assert (r.ttm, r.method) == (115.0, "FY_MINUS_PRIOR_SAME_PLUS_CURRENT") and r.formula == "2024-12-31:100 - 2024-06-30:40 + 2025-06-30:55"
    assert [c.role for c in r.components] == ["add_previous_fy", "subtract_previous_same", "add_current_cumulative"]
    assert found["X", "2024-12-31"].formula == "2024-12-31年报累计值" and found["X", "2024-12-31"].method == "FULL_YEAR_EQUALS_TTM"


def test_each_function_as_of_an_end(spark):
    rows = [("X", "x", f"{y}-12-31", v, INCOME) for y, v in ((2020, 100.0), (2021, 110.0), (2022, 121.0))]
    rows += [("X", "x", "2022-12-31", 7.0, "PageAjax"), ("X", "x", "2022-09-30", 1.0, "PageAjax"), ("x2", "X", "2023-01-31", 5.0, INCOME)]
    end = "2023-02-15"
    value = lambda f: round(at(spark, f, rows, end).value, 9)
    assert value("X") == 121.0 and value('VALUE(X, "2021-12-31")') == 110.0 and value("f(x)") == 121.0
    assert value("YOY(X)") == 0.1 and value("QOQ(X)") == 0.1 and value("CAGR(X)") == 0.1 and value("CAGR(X, 1)") == 0.1
    assert value("AVG(X, 2)") == 63.0 and value("AVG(X)") == round((5 + 121 + 1 + 110) / 4, 9)
    assert value("-X ** 2 + 2 * (X - 1)") == -(121.0**2) + 240
    r = at(spark, "QOQ(X) + AVG(X, 2)", rows, end)
    assert [(t.function, t.prior) for t in r.trace] == [("QOQ", 110.0), ("AVG", 121.0)] and [t.periods for t in r.trace] == [None, 2]


def test_reasons(spark):
    rows = [("X", "x", "2022-12-31", 1.0, INCOME), ("Z", "z", "2022-12-31", 0.0, INCOME)]
    reason = lambda f, end="2022-12-31": at(spark, f, rows, end).reason
    assert [reason("X / Z"), reason("X / Y"), reason("TTM(X)", "2023-03-31"), reason("YOY(X)"), reason("(0 - X) ** 0.5"), reason("1 + 1")] == [
        "DIVISION_BY_ZERO", "MISSING_INPUT", "MISSING_INPUT", "MISSING_INPUT", "NOT_FINITE", None]


@pytest.mark.parametrize("text", ["__import__('os')", "X.y", "X[0]", "lambda: 1", "open('f')", "X; Y", "F('a\\'b')", "X if Y else Z", "X == 1"])
def test_nothing_else_is_let_through(text):
    with pytest.raises((ValueError, SyntaxError)):
        ts.compiled(text)


def test_ratios_from_a_table(spark):
    rows = [("1", day("2025-12-31"), "consolidated", k, v) for k, v in (("TOTAL_LIABILITIES", 40.0), ("TOTAL_ASSETS", 100.0), ("OPERATE_INCOME", 0.0), ("NETPROFIT", 3.0))]
    df = spark.createDataFrame(rows, "security_code string, report_date date, scope string, field_key string, value_num double")
    (r,) = ts.ratio_facts(df).collect()
    assert (r.field_key, r.value_num, r.unit, r.source_row, r.statement_type) == ("ZCFZL", 40.0, "%", ts.RATIOS["ZCFZL"], "financial_ratio")
    assert {r.field_key: r.value_num for r in ts.ratio_facts(df, {"A": "TOTAL_ASSETS ** 2 - 1.5", "B": "TOTAL_ASSETS / NONE"}).collect()} == {"A": 9998.5}


def test_quarters_of_flows_only(spark):
    rows = [("688521", s, c, k, day(f"2025-{d}"), v, "") for s, c, k in (("income_statement", "consolidated", "OPERATE_INCOME"), ("cash_flow", "parent", "BEGIN_CCE"), ("balance_sheet", "parent", "X"))
        for d, v in (("03-31", 100.0), ("06-30", 250.0), ("09-30", 450.0), ("12-31", 800.0))]
    df = spark.createDataFrame(rows, "security_code string, statement_type string, scope string, field_key string, report_date date, value_num double, note string")
    found = ts.independent_quarters(df).collect()
    assert {r.period_type: r.value_num for r in found} == {"Q2": 150.0, "Q3": 200.0, "Q4": 350.0} and len(found) == 3
    assert ts.independent_quarters(df.filter("month(report_date) <> 6")).count() == 1
