"""The values that are looked for in reports when nothing else is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BALANCE, INCOME, CASH, MAIN, QUARTER = (
    f"RPT_F10_{x}" for x in ("FINANCE_GBALANCE", "FINANCE_GINCOME", "FINANCE_GCASHFLOW", "FINANCE_MAINFINADATA", "QTR_MAINFINADATA")
)
# Field, label, statement, aliases, families, semantics.
TARGETS = [
    ("MONETARYFUNDS", "货币资金", "balance_sheet", ["货币资金"], [BALANCE], "point_in_time"),
    ("ACCOUNTS_RECE", "应收账款", "balance_sheet", ["应收账款"], [BALANCE], "point_in_time"),
    ("INVENTORY", "存货", "balance_sheet", ["存货"], [BALANCE], "point_in_time"),
    ("CIP", "在建工程", "balance_sheet", ["在建工程"], [BALANCE], "point_in_time"),
    ("FIXED_ASSET", "固定资产", "balance_sheet", ["固定资产"], [BALANCE], "point_in_time"),
    ("GOODWILL", "商誉", "balance_sheet", ["商誉"], [BALANCE], "point_in_time"),
    ("TOTAL_ASSETS", "资产总计", "balance_sheet", ["资产总计"], [BALANCE], "point_in_time"),
    ("TOTAL_LIABILITIES", "负债合计", "balance_sheet", ["负债合计"], [BALANCE], "point_in_time"),
    ("TOTAL_EQUITY", "所有者权益合计", "balance_sheet", ["所有者权益合计", "股东权益合计", "所有者权益（或股东权益）合计"], [BALANCE], "point_in_time"),
    ("TOTAL_LIAB_EQUITY", "负债和所有者权益总计", "balance_sheet", ["负债和所有者权益总计", "负债和股东权益总计", "负债和所有者权益（或股东权益）总计"], [BALANCE],
        "point_in_time"),
    ("OPERATE_INCOME", "营业收入", "income_statement", ["营业收入"], [INCOME], "flow"),
    ("OPERATE_COST", "营业成本", "income_statement", ["营业成本"], [INCOME], "flow"),
    ("RESEARCH_EXPENSE", "研发费用", "income_statement", ["研发费用"], [INCOME], "flow"),
    ("OPERATE_PROFIT", "营业利润", "income_statement", ["营业利润"], [INCOME], "flow"),
    ("NETPROFIT", "净利润", "income_statement", ["净利润"], [INCOME], "flow"),
    ("PARENT_NETPROFIT", "归属于母公司股东的净利润", "income_statement", ["归属于母公司股东的净利润", "归属于上市公司股东的净利润"], [INCOME, MAIN], "flow"),
    ("DEDUCT_PARENT_NETPROFIT", "扣非归母净利润", "summary",
        ["归属于上市公司股东的扣除非经常性损益的净利润", "归属于母公司股东的扣除非经常性损益的净利润", "扣除非经常性损益后的净利润"], [MAIN, QUARTER], "flow"),
    ("NETCASH_OPERATE", "经营活动产生的现金流量净额", "cash_flow", ["经营活动产生的现金流量净额"], [CASH], "flow"),
    ("NETCASH_INVEST", "投资活动产生的现金流量净额", "cash_flow", ["投资活动产生的现金流量净额"], [CASH], "flow"),
    ("NETCASH_FINANCE", "筹资活动产生的现金流量净额", "cash_flow", ["筹资活动产生的现金流量净额"], [CASH], "flow"),
    ("RATE_CHANGE_EFFECT", "汇率变动对现金及现金等价物的影响", "cash_flow", ["汇率变动对现金及现金等价物的影响", "汇率变动对现金及现金等价"], [CASH], "flow"),
    ("CCE_ADD", "现金及现金等价物净增加额", "cash_flow", ["现金及现金等价物净增加额"], [CASH], "flow"),
    ("BEGIN_CCE", "期初现金及现金等价物余额", "cash_flow", ["期初现金及现金等价物余额"], [CASH], "flow"),
    ("END_CCE", "期末现金及现金等价物余额", "cash_flow", ["期末现金及现金等价物余额"], [CASH], "flow"),
]
# How reports write some of them besides; they come before the aliases above.
ALSO = {
    ("balance_sheet", "TOTAL_LIAB_EQUITY"): ["负债及股东权益总计"],
    ("balance_sheet", "TOTAL_ASSETS"): ["总资产"],
    ("income_statement", "FINANCE_EXPENSE"): ["财务（费用）/收入", "财务（费用）收入"],
    ("income_statement", "PARENT_NETPROFIT"): ["归属于母公司所有者的净利润"],
    ("income_statement", "OTHER_COMPRE_INCOME"): ["其他综合收益的税后净额"],
    ("cash_flow", "NETCASH_OPERATE"): ["经营活动产生/（使用）的现金流量净额", "经营活动产生（使用）的现金流量净额"],
    ("cash_flow", "NETCASH_INVEST"): ["投资活动（使用）/产生的现金流量净额", "投资活动（使用）产生的现金流量净额", "投资活动使用的现金流量净额"],
    ("cash_flow", "NETCASH_FINANCE"): ["筹资活动使用的现金流量净额"],
    ("cash_flow", "CCE_ADD"): ["现金及现金等价物净（减少）/增加额", "现金及现金等价物净（减少）增加额"],
    ("cash_flow", "BEGIN_CCE"): ["年初现金及现金等价物余额"],
    ("cash_flow", "END_CCE"): ["年末现金及现金等价物余额"],
    ("cash_flow", "FINANCE_EXPENSE"): ["财务费用（收益以“－”号填列）"],
}
# Labels that a summary of key figures states itself.
SUMMARY_LABELS = [
    "总资产", "资产总计", "归属于上市公司股东的净资产", "归属于母公司股东的净资产", "经营活动产生的现金流量净额", "营业收入",
    "归属于上市公司股东的净利润", "归属于母公司股东的净利润", "归属于上市公司股东的扣除非经常性损益的净利润",
    "归属于母公司股东的扣除非经常性损益的净利润", "基本每股收益", "稀释每股收益", "加权平均净资产收益率", "研发投入占营业收入的比例",
]


def default_targets(spark: SparkSession) -> DataFrame:
    """(family, field_key, label, aliases, statement_type, semantics), a row for each family of each target."""
    rows = [(f, key, label, aliases, statement, kind) for key, label, statement, aliases, families, kind in TARGETS for f in families]
    return spark.createDataFrame(rows, "family string, field_key string, label string, aliases array<string>, statement_type string, semantics string")


def labels(spark: SparkSession) -> DataFrame:
    """(field_key, label, statement, summary, semantics), a row for each way to write each target."""
    rows = []
    for key, _, statement, aliases, _, kind in TARGETS:
        every = dict.fromkeys([*ALSO.get((statement, key), []), *aliases])
        summary = any(a in SUMMARY_LABELS for a in every)
        rows += [(key, a, statement, summary, kind) for a in every]
    return spark.createDataFrame(rows, "field_key string, label string, statement string, summary boolean, semantics string")
