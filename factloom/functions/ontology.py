"""The metrics that facts are mapped to, and how a fact finds its metric."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric, name, research module, source keys, unit, kind, scope.
METRICS = [
    ("company.security_code", "证券代码", "company_master", ["SECURITY_CODE", "SECUCODE"], "", "entity", "entity"),
    ("company.security_name", "证券简称", "company_master", ["SECURITY_NAME_ABBR", "SECURITY_NAME"], "", "entity", "entity"),
    ("financial.revenue", "营业收入", "financial_statements", ["OPERATE_INCOME", "TOTAL_OPERATE_INCOME"], "元", "flow", "consolidated"),
    ("financial.operating_cost", "营业成本", "financial_statements", ["OPERATE_COST"], "元", "flow", "consolidated"),
    ("financial.operating_profit", "营业利润", "financial_statements", ["OPERATE_PROFIT"], "元", "flow", "consolidated"),
    ("financial.net_profit", "净利润", "financial_statements", ["NETPROFIT"], "元", "flow", "consolidated"),
    ("financial.parent_net_profit", "归母净利润", "financial_statements", ["PARENT_NETPROFIT"], "元", "flow", "consolidated"),
    ("profit_quality.adjusted_parent_net_profit", "扣非归母净利润", "profit_quality", ["DEDUCT_PARENT_NETPROFIT", "KCFJCXSYJLR", "DEDU_PARENT_PROFIT"], "元", "flow",
        "consolidated"),
    ("profit_quality.non_recurring_profit", "非经常性损益", "profit_quality", ["NON_RECURRING_PROFIT", "NONRECURRING_PROFIT"], "元", "flow", "consolidated"),
    ("cashflow.operating_cash_flow", "经营活动现金流量净额", "profit_quality", ["NETCASH_OPERATE"], "元", "flow", "consolidated"),
    ("cashflow.investing_cash_flow", "投资活动现金流量净额", "financial_statements", ["NETCASH_INVEST"], "元", "flow", "consolidated"),
    ("cashflow.financing_cash_flow", "筹资活动现金流量净额", "financial_statements", ["NETCASH_FINANCE"], "元", "flow", "consolidated"),
    ("cashflow.capital_expenditure", "购建长期资产支付现金", "profit_quality", ["CONSTRUCT_LONG_ASSET"], "元", "flow", "consolidated"),
    ("balance.cash", "货币资金", "financial_statements", ["MONETARYFUNDS"], "元", "point_in_time", "consolidated"),
    ("balance.accounts_receivable", "应收账款", "profit_quality", ["ACCOUNTS_RECE"], "元", "point_in_time", "consolidated"),
    ("balance.inventory", "存货", "profit_quality", ["INVENTORY"], "元", "point_in_time", "consolidated"),
    ("balance.contract_assets", "合同资产", "profit_quality", ["CONTRACT_ASSET", "CONTRACT_ASSETS"], "元", "point_in_time", "consolidated"),
    ("balance.fixed_assets", "固定资产", "financial_statements", ["FIXED_ASSET"], "元", "point_in_time", "consolidated"),
    ("balance.construction_in_progress", "在建工程", "financial_statements", ["CIP"], "元", "point_in_time", "consolidated"),
    ("balance.goodwill", "商誉", "profit_quality", ["GOODWILL"], "元", "point_in_time", "consolidated"),
    ("balance.total_assets", "资产总计", "financial_statements", ["TOTAL_ASSETS"], "元", "point_in_time", "consolidated"),
    ("balance.total_liabilities", "负债合计", "financial_statements", ["TOTAL_LIABILITIES"], "元", "point_in_time", "consolidated"),
    ("balance.total_equity", "所有者权益合计", "financial_statements", ["TOTAL_EQUITY"], "元", "point_in_time", "consolidated"),
    ("research.rd_expense", "研发费用", "profit_quality", ["RESEARCH_EXPENSE"], "元", "flow", "consolidated"),
    ("research.rd_investment", "研发投入", "segments_and_kpis", ["RD_EXPENSE", "R&D_EXPENSE", "TOTAL_RD_EXPENSE"], "元", "flow", "consolidated"),
    ("research.capitalized_rd", "资本化研发投入", "profit_quality", ["CAPITALIZED_RD", "CAPITALIZED_RESEARCH_EXPENSE"], "元", "flow", "consolidated"),
    ("profitability.gross_margin", "毛利率", "profit_quality", ["GROSS_MARGIN", "XSMLL"], "%", "", "consolidated"),
    ("profitability.roe", "净资产收益率", "profit_quality", ["ROE", "ROE_WEIGHT"], "%", "", "consolidated"),
    ("per_share.basic_eps", "基本每股收益", "quarterly_and_ttm", ["BASIC_EPS"], "元/股", "flow", "consolidated"),
    ("capital.total_shares", "总股本", "capital_structure", ["TOTAL_SHARES", "TOTAL_SHARE", "TOTAL_EQUITY_SHARES"], "股", "point_in_time", "consolidated"),
    ("capital.free_float_shares", "流通股本", "capital_structure", ["FREE_SHARES", "FREE_FLOAT_SHARES"], "股", "point_in_time", "consolidated"),
    ("capital.holder_count", "股东户数", "capital_structure", ["HOLDER_TOTAL_NUM", "HOLDER_NUM"], "户", "point_in_time", "consolidated"),
    ("governance.pledge_ratio", "质押比例", "governance_and_events", ["PLEDGE_RATIO"], "%", "event", "entity"),
    ("market.close_price", "收盘价", "market_and_consensus", ["CLOSE_PRICE", "CLOSE"], "元/股", "event", "entity"),
    ("consensus.revenue_forecast", "一致预期营业收入", "market_and_consensus", ["PREDICT_OPERATE_INCOME", "FORECAST_REVENUE"], "元", "forecast", "entity"),
    ("consensus.parent_profit_forecast", "一致预期归母净利润", "market_and_consensus", ["PREDICT_PARENT_NETPROFIT", "FORECAST_PARENT_NETPROFIT"], "元", "forecast",
        "entity"),
]
# Research modules in the order of their views.
MODULES = [
    "company_master", "financial_statements", "quarterly_and_ttm", "profit_quality", "segments_and_kpis", "capital_structure", "governance_and_events",
    "market_and_consensus", "coverage_and_gaps",
]


def slug(text: Column, empty: str = "unknown") -> Column:
    t = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", ""))
    return F.when(t == "", empty).otherwise(t)


def metric_of(key: Column, family: Column, name: Column, unit: Column, semantics: Column, scope: Column) -> Column:
    """(metric_id, metric_name_cn, research_module, unit, data_semantics, scope, known) of a fact.

    By its key in the list of metrics; any other fact has a metric of its own, source.<family>.<key>, among the gaps.
    """
    text = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    entry = lambda m, label, module, u, kind, where: F.struct(*[F.lit(x).alias(n) for n,
        x in zip(("metric_id", "metric_name_cn", "research_module", "unit", "data_semantics", "scope"), (m, label, module, u, kind, where))],
        F.lit(True).alias("known"))
    table = F.create_map(*[x for m, label, module, keys, u, kind, where in METRICS for k in keys for x in (F.lit(k.upper()),
        entry(m, label, module, u, kind, where))])
    own = F.struct(
        F.concat_ws(".", F.lit("source"), slug(text(family, F.lit("source"))), slug(key)).alias("metric_id"),
            text(name, text(key, F.lit("未命名字段"))).alias("metric_name_cn"),
        F.lit("coverage_and_gaps").alias("research_module"), F.coalesce(unit, F.lit("")).alias("unit"),
            F.coalesce(semantics, F.lit("")).alias("data_semantics"),
        text(scope, F.lit("entity")).alias("scope"), F.lit(False).alias("known"),
    )
    return F.coalesce(F.try_element_at(table, F.upper(F.coalesce(key, F.lit("")))), own)
