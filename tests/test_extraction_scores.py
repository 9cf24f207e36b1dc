"""Amounts of labelled rows, wherever the label stands, with known answers."""

import pytest

from factloom.functions import targets
from factloom.operators import documents

CASES = {
    "note column": ("投资支付的现金", "(56)(d) (1,630,616) (129,979) – (3,000,000)\n投资支付的现金 四\n(56)(f) (28,251) (696,654) – –\n取得子公司支付的现金净额 四", -1_630_616_000.0, "千元"),
    "income before": ("营业外收入", "(52)(a) 386,539 311,972 – –\n加：营业外收入 四\n(52)(b) (232,129) (373,060) – –\n减：营业外支出 四", 386_539_000.0, "千元"),
    "expense before": ("营业外支出", "(52)(a) 386,539 311,972 – –\n加：营业外收入 四\n(52)(b) (232,129) (373,060) – –\n减：营业外支出 四\n14,917,877 13,607,261 2,485,980 5,042,321\n三、利润总额",
        -232_129_000.0, "千元"),
    "value before": ("营业收入", "四(42) 308,226,647 284,420,059\n一、营业收入", 308_226_647_000.0, "千元"),
    "split label": ("归属于上市公司股东的扣除非经常性损益的净利润", "归属于上市公司股东的扣除非经常性损益\n2,317,341 1,973,620 17.42%\n的净利润（千元）", 2_317_341_000.0, "千元"),
    "per share": ("基本每股收益", "基本每股收益（元/股） 0.51 0.45 13.33%", 0.51, "元/股"),
    "next label": ("存货", "存货 1,000（商誉 2,000）", 1_000_000.0, "千元"),
    "two labels": ("存货", "存货 1,000 商誉 2,000", None, None),
    "longer label": ("存货", "存货跌价准备 5,000", None, None),
    "no amount": ("存货", "存货 (12)\n商誉", None, None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, f"单位：千元\n.\n.\n.\n{text}") for name, (_, text, _, _) in CASES.items()]
    asked = {label for label, *_ in CASES.values()} | {"商誉"}
    wanted = spark.createDataFrame([(a, a, "s") for a in asked], "field_key string, label string, statement string")
    out = documents.extracted(spark.createDataFrame(rows, "document_id string, text string"), wanted)
    return {(r.document_id, r.field_key): r for r in out.collect()}


@pytest.mark.parametrize("name", CASES)
def test_amount(found, name):
    label, _, value, unit = CASES[name]
    r = found.get((name, label))
    assert (r and (r.value, r.unit)) == (value and (value, unit))


def test_tolerances(found):
    assert found["per share", "基本每股收益"].tolerance == 0.005 and found["value before", "营业收入"].tolerance == 500.0


def test_statements_scopes_and_pages(spark):
    pages = [
        (1, ["主要财务数据", "总资产 7,777"]), (2, ["母公司资产负债表", "货币资金 1,111"]), (3, ["合并资产负债表", "单位：万元", "货币资金 2,222 9", "资产总计 5,000"]),
        (4, ["合并利润表", "减：营业成本 (300)"]), (5, ["合并现金流量表", "货币资金 4,444"]),
    ]
    rows = [("d", page, k, line) for page, own in pages for k, line in enumerate(own)]
    lines = spark.createDataFrame(rows, "document_id string, page int, line_no int, line string")
    found = {r.field_key: (r.statement, r.page, r.value, r.unit) for r in documents.statement_values(lines, targets.labels(spark)).collect()}
    assert found == {
        "MONETARYFUNDS": ("balance_sheet", 3, 22_220_000.0, "万元"), "TOTAL_ASSETS": ("balance_sheet", 3, 50_000_000.0, "万元"), "OPERATE_COST": ("income_statement", 4, 3_000_000.0, "万元"),
    }


def test_default_targets(spark):
    assert targets.default_targets(spark).select("field_key").distinct().count() == 24
    assert targets.labels(spark).filter("field_key = 'TOTAL_ASSETS'").first().label == "总资产"


def test_nothing(spark):
    none = spark.createDataFrame([], "document_id string, text string")
    assert documents.extracted(none, targets.labels(spark)).collect() == []
