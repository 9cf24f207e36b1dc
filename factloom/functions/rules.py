"""Rules as data: accounting identities, topics and their patterns, and the metrics that each topic needs."""

from __future__ import annotations

# Identity, what it says, its left side, the parts of its right side (sign, field, needed), and how many times
# the widest tolerance of its group of fields it may be off.
IDENTITIES = [
    ("BALANCE_ASSETS_EQ_LIAB_PLUS_EQUITY", "资产总计 = 负债合计 + 所有者权益合计", "TOTAL_ASSETS", [(1, "TOTAL_LIABILITIES", True), (1, "TOTAL_EQUITY", True)], 2),
    ("BALANCE_ASSETS_EQ_TOTAL_LIAB_EQUITY", "资产总计 = 负债和所有者权益总计", "TOTAL_ASSETS", [(1, "TOTAL_LIAB_EQUITY", True)], 1),
    ("CASHFLOW_NET_CHANGE", "现金及现金等价物净增加额 = 经营 + 投资 + 筹资 + 汇率影响", "CCE_ADD",
        [(1, "NETCASH_OPERATE", True), (1, "NETCASH_INVEST", True), (1, "NETCASH_FINANCE", True), (1, "RATE_CHANGE_EFFECT", False)], 3),
]
# Fields whose tolerances an identity takes, where they are more than its own.
TOLERANCE_GROUPS = [["TOTAL_ASSETS", "TOTAL_LIABILITIES", "TOTAL_EQUITY", "TOTAL_LIAB_EQUITY"]]

# Parts of a key, label or family that make a fact one of a topic.
TOPICS = {
    "research_and_development": ["RESEARCH", "R&D", "RD_", "研发"],
    "capital_structure": [
        "SHARE", "HOLDER", "CAPITAL", "PLEDGE", "BUYBACK", "REPURCHASE", "CONVERTIBLE", "RESTRICT", "LOCKUP", "UNLOCK", "股本", "股东", "质押", "回购",
        "可转债", "限售", "解禁",
    ],
    "capital_events": ["DIVIDEND", "PLACEMENT", "RIGHTS_ISSUE", "REFINANCE", "MERGER", "RESTRUCT", "减持", "增持", "分红", "定增", "配股", "再融资", "重组"],
    "corporate_governance": [
        "DIRECTOR", "MANAGER", "EXECUTIVE", "RELATED_PARTY", "GUARANTEE", "CONTROL_PERSON", "董事", "监事", "高管", "关联交易", "担保", "实际控制人",
    ],
    "risk_events": [
        "PENALTY", "VIOLATION", "LITIGATION", "LAWSUIT", "ARBITRATION", "DEFAULT", "BANKRUPTCY", "处罚", "违规", "诉讼", "仲裁", "违约", "破产",
    ],
}
# Metrics without which a topic has a gap.
REQUIRED = {
    "profit_quality": [
        "financial.parent_net_profit", "profit_quality.adjusted_parent_net_profit", "cashflow.operating_cash_flow", "cashflow.capital_expenditure",
    ],
    "research_and_development": ["research.rd_expense"],
    "capital_structure": ["capital.total_shares"],
}
