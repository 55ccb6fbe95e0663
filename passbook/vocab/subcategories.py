"""The default sub-category master, one entry per line of the taxonomy.

``Sub(name, side, group, tags, patterns, priority, ceiling)``; the ceiling is in rupees.
Patterns are compared with case, spaces and punctuation squashed. Entry order breaks ties.
"""

from __future__ import annotations

from typing import NamedTuple


class Sub(NamedTuple):
    name: str
    side: str
    group: str
    tags: list[str]
    patterns: list[str]
    priority: int = 0
    ceiling: int | None = None


RC, RD, ECS_TAG = "Regular credit", "Regular debit", "ECS transaction"
TRADE_OUT = [RD, ECS_TAG]
OPEX = "Operating Expenses (OpEx)"
STATUTORY = "Statutory & Compliance"
FRICTION = "Banking Friction & Penal"
RISK = "Speculative & High-Risk Spending"

CREDIT = [
    Sub("Misc. credit", "credit", "Misc. Credit", [], ["SUBSIDY"], 100, 50),
    Sub("Business income", "credit", "Operational Revenue", [RC],
        ["NEFT", "RTGS", "IMPS", "INVOICE", "INV NO", "BILL", "SALES"], -10),
    Sub("POS / Merchant / QR Settlements", "credit", "Operational Revenue", [RC],
        ["RAZORPAY", "PINELABS", "PAYTM", "BILLDESK", "MRL", "CCAVENUE", "PHONEPE", "BHARATPE",
         "MSWIPE", "EZETAP", "INSTAMOJO", "CASHFREE", "PAYU", "POS SETTLEMENT",
         "MERCHANT SETTLEMENT", "UPI SETTLEMENT"]),
    Sub("Cheque Clearances (Inward)", "credit", "Operational Revenue", [RC],
        ["CLG", "CTS", "INWARD CLEARING", "CHQ DEP", "CHEQUE DEPOSIT", "MICR"]),
    Sub("Rental Income", "credit", "Operational Revenue", [RC],
        ["RENT", "LEASE", "LICENCE FEE", "LICENSE FEE"]),
    Sub("Interest & Treasury Income", "credit", "Non-Operating Receipts",
        ["Interest received", "Investment return credited"],
        ["INT CR", "FD INT", "TREASURY", "SWEEP", "INTEREST", "DIVIDEND", "MUTUAL FUND"]),
    Sub("Asset Sale Proceeds", "credit", "Non-Operating Receipts", [RC],
        ["SALE OF ASSET", "ASSET SALE", "SALE PROCEEDS", "PROPERTY SALE", "VEHICLE SALE"]),
    Sub("Tax & Duty Refunds", "credit", "Non-Operating Receipts", ["return / refund", RC],
        ["GST REFUND", "ITR REFUND", "INCOME TAX REFUND", "CUSTOMS DRAWBACK", "DRAWBACK",
         "REFUND OF TAX", "TDS REFUND", "IT REFUND", "CBDT", "PAHAL", "DBTL", "ITDTAX",
         "TAX REFUND", "ITD REFUND"], 20),
    Sub("Loan Disbursal", "credit", "Capital & Financing", ["Loan amount disbursal"],
        ["LN DISB", "LOAN DISB", "DISBURSAL", "DISBURSEMENT"]),
    Sub("Promoter / Equity Infusion", "credit", "Capital & Financing", [RC, "Related party credit"],
        ["CAPITAL CONTRIB", "CAPITAL INTRO", "SHARE APPLICATION", "EQUITY INFUSION",
         "PROMOTER CONTRIB", "PARTNER CAPITAL", "DIRECTOR CONTRIB", "TRANSFER TO SELF",
         "SELF TRANSFER", "PAY TO SELF"]),
    Sub("OD / CC Drawdowns", "credit", "Capital & Financing", [RC],
        ["OD DRAWDOWN", "CC DRAWDOWN", "CASH CREDIT", "OVERDRAFT", "OD SWEEP", "CC SWEEP",
         "LIMIT UTILISATION", "LIMIT UTILIZATION"]),
    Sub("Intra-Account / Own Transfers", "credit", "Transfers & Adjustments", [RC],
        ["SELF", "OWN ACCOUNT", "OWN A/C", "INTERNAL TRANSFER", "FUND TRANSFER SELF"]),
    Sub("Related Party / Group Inflows", "credit", "Transfers & Adjustments",
        ["Related party credit", RC],
        ["TRANSFER TO FAMILY", "FAMILY TRANSFER", "TRANSFER FROM FAMILY"]),
    Sub("Direct Cash Deposits", "credit", "Transfers & Adjustments", ["cash deposit"], []),
    Sub("Reversals & refunds", "credit", "Contra / Technical", ["return / refund", RC],
        ["REV-UPI", "RVSL", "UPI REVERSAL", "PAYMENT REVERSAL", "PHONEPEREVERS", "REVERSAL",
         "REFUND"], 10),
    Sub("Outward Cheque / Mandate Returns", "credit", "Contra / Technical",
        ["Outward Bounced Xns", "return / refund"],
        ["INW RET", "RETURN CHEQUE", "RETURN CHQ", "MANDATE REJECT", "REVERSAL", "CHQ RETURN",
         "RET CHQ"]),
]

DEBIT = [
    Sub("Loan EMIs", "debit", "Debt Obligations (Fixed)", ["EMI transaction"],
        ["EMI", "NACH", "ACH", "LOAN INSTAL"]),
    Sub("Credit Card Payments", "debit", "Debt Obligations (Fixed)", ["EMI transaction", *TRADE_OUT],
        ["CRED", "BBPS CC", "CREDIT CARD", "CC PAYMENT", "CARD BILL", "AMEX", "CC BILL PAY"]),
    Sub("OD / CC Interest & Renewal Fees", "debit", "Debt Obligations (Fixed)",
        ["Interest / fee payments"],
        ["INT DR", "ANNUAL RENEWAL", "RENEWAL CHG", "PROCESSING FEE", "INTEREST DEBIT", "OD INT",
         "CC INT"]),
    Sub("Payroll & Wages", "debit", OPEX, ["Salary paid"],
        ["SAL", "SALARY", "WAGES", "CMS SAL", "NEFT WAGES", "PAYROLL"]),
    Sub("Supplier / Vendor Settlements", "debit", OPEX, TRADE_OUT,
        ["NEFT", "RTGS", "IMPS", "VENDOR", "SUPPLIER", "PURCHASE", "PAYABLE"], -10),
    Sub("Staff Welfare, Food & Pantry", "debit", OPEX, TRADE_OUT,
        ["STAFF WELFARE", "PANTRY", "CANTEEN", "CATERING", "CATERERS", "REFRESHMENT",
         "TEA SUPPLY", "MESS BILL", "STAFF FOOD", "EMPLOYEE WELFARE", "STAFF REFRESHMENT",
         "SWIGGY", "ZOMATO", "BLINKIT", "ZEPTO", "INSTAMART", "BIGBASKET", "DUNZO"]),
    Sub("Commercial Rent & Utilities", "debit", OPEX, TRADE_OUT,
        ["RENT", "LEASE", "ELECTRICITY", "BESCOM", "MSEB", "TNEB", "TELECOM", "AIRTEL", "JIO",
         "VODAFONE", "BSNL", "WATER", "BBPS", "BBPSBP", "RECHARGE", "UTILITY", "GAS BILL",
         "BROADBAND", "INTERNET BILL", "SOUNDBOX"]),
    Sub("Travel & Conveyance expenses", "debit", OPEX, TRADE_OUT,
        ["REDBUS", "UBER", "OLA", "IRCTC", "MAKEMYTRIP", "IBIBO", "IXIGO", "GOIBIBO",
         "CLEARTRIP", "EASEMYTRIP", "YATRA", "INDIGO", "SPICEJET", "AIR INDIA", "VISTARA",
         "RAPIDO", "MERU", "TRAVEL", "AIRLINES"]),
    Sub("GST Payments", "debit", STATUTORY, TRADE_OUT, ["GST PMT", "GST", "CPIN", "CBIC", "GSTN"]),
    Sub("Direct Tax (TDS / Advance Tax)", "debit", STATUTORY, TRADE_OUT,
        ["OLTAS", "CHALLAN 281", "CHALLAN 280", "TDS", "ADVANCE TAX", "INCOME TAX",
         "SELF ASSESSMENT TAX", "TCS PAYMENT", "DTAX"]),
    Sub("Compliance Fees", "debit", STATUTORY, TRADE_OUT,
        ["FSSAI", "FOOD SAFETY", "TRADE LICENCE", "TRADE LICENSE", "MUNICIPAL", "MCA21",
         "POLLUTION CONTROL", "DRUG LICENCE", "DRUG LICENSE", "SHOPS AND ESTAB",
         "LABOUR LICENCE"]),
    Sub("Labour Welfare (PF / ESIC)", "debit", STATUTORY, TRADE_OUT,
        ["EPFO", "ESIC", "PROVIDENT FUND", "PF CHALLAN", "ESI", "LWF"]),
    Sub("Misc. debit", "debit", "Misc. debit", [], [], 100, 50),
    Sub("Bank Charges & Processing Fees", "debit", OPEX, TRADE_OUT,
        ["INSTAALERT", "SMS CHG", "SMS CHRG", "ALERT CHG", "FEE-ATMCASH", "FEE-ATMNONCASH",
         "ATMCASH", "ATMNONCASH", "NEFT CHG", "NEFT CHRG", "RTGS CHG", "IMPS CHG", "CHQ BOOK",
         "FOLIO CHG", "CARD FEE", "ANNUAL FEE", "PROCESSING FEE", "SERVICE CHG",
         "INCIDENTAL CHARGES", "IMPSP2P", "CHARGES FOR", "RTGS CHRGS", "IMPS CHRGS",
         "NEFT CHRGS", "ECS TXN CHRGS", "BNA TXN CHRGS", "POS GST", "ATM TXN CHRGS"], 20),
    Sub("Cash Withdrawals", "debit", "Cash & Non-Operating", ["cash withdrawal"], []),
    Sub("Promoter Drawings / Remittances", "debit", "Cash & Non-Operating",
        ["Related party debit", RD],
        ["DRAWINGS", "PARTNER DRAW", "DIRECTOR REMUN", "PROPRIETOR", "DIRECTOR TRANSFER",
         "PARTNER TRANSFER", "TRANSFER TO SELF", "SELF TRANSFER", "PAY TO SELF",
         "TRANSFER TO FAMILY", "FAMILY TRANSFER"]),
    Sub("Investments Outflows", "debit", "Cash & Non-Operating", TRADE_OUT,
        ["MUTUAL FUND", "SIP", "MF PURCHASE", "LIC", "INSURANCE PREMIUM", "FIXED DEPOSIT",
         "RD INSTAL", "PPF", "NPS", "INSURANCE", "ASSURANCE", "POLICYBAZAAR"]),
    Sub("Bank Penalties & Non-Maintenance", "debit", FRICTION,
        ["other penal charges", "inward bounce penal charges", "Outward Bounced Xns", *TRADE_OUT],
        ["RTN CHG", "CHQ RTN CHG", "CHQ RTRN CHRGS", "CHQ RTRN CHRG", "CHEQUE RETURN CHG",
         "ECS RET CHG", "ECS RETURN CHG", "NACH BOUNCE CHGS", "NACH BOUNCE CHG",
         "ACH RETURN CHG", "NSF CHG", "MIN BAL CHG", "MAB CHG", "NON MAINT CHG",
         "LIMIT EXPIRY PENALTY", "PENAL INT", "EXCESS OD CHG", "TOD PENALTY", "PENAL",
         "EXCESS OD", "MIN BAL", "MAB", "AMB", "NON MAINT"], 20),
    Sub("Inward Cheque / Mandate Bounces", "debit", FRICTION,
        ["inward bounce penal charges", "Outward Bounced Xns", *TRADE_OUT],
        ["INW CLG RET", "INW RET", "CHEQUE RETURN", "CHQ RTN", "ECS RETURN", "ACH RETURN",
         "NACH REJECT", "DISHONOUR", "INSUFFICIENT FUNDS", "EXCEEDS ARRANGEMENT"]),
    Sub("Statutory Penalty / Late Fees", "debit", FRICTION, ["other penal charges", RD],
        ["ITR LATE FEE", "GST LATE FEE", "TDS PENALTY", "MCA ADDITIONAL FEE", "LATE FEE",
         "PENALTY"]),
    Sub("Gambling / Betting / Real-Money Gaming", "debit", RISK, [],
        ["DREAM11", "RUMMY", "POKER", "1XBET", "PARIMATCH", "CASINO", "LOTTERY", "GAMES24X7",
         "BETTING", "MPL", "WINZO", "JUNGLEE"], 100),
    Sub("Virtual Digital Assets / Crypto Exchanges", "debit", RISK, [],
        ["WAZIRX", "COINDCX", "BINANCE", "COINSWITCH", "ZEBPAY", "UNOCOIN", "CRYPTO", "BITBNS",
         "KUCOIN"], 100),
    Sub("Unlicensed / P2P Lending Outflows", "debit", RISK, [],
        ["FAIRCENT", "LENDBOX", "LIQUILOANS", "P2P LENDING", "PEER LENDING"], 100),
    Sub("Speculative Stock & Derivatives Funding", "debit", RISK, [],
        ["ZERODHA", "GROWW", "UPSTOX", "ANGELONE", "MCX", "COMMODITY", "F&O", "FNO FUNDING",
         "SHAREKHAN", "MOTILAL OSWAL", "ICICIDIRECT", "5PAISA", "DHAN"], 100),
]

DEFAULT_BY_TAG = {
    "cash deposit": "Direct Cash Deposits",
    "cash withdrawal": "Cash Withdrawals",
    "EMI transaction": "Loan EMIs",
    "Interest / fee payments": "OD / CC Interest & Renewal Fees",
    "Loan amount disbursal": "Loan Disbursal",
    "Salary paid": "Payroll & Wages",
    "Interest received": "Interest & Treasury Income",
    "Investment return credited": "Interest & Treasury Income",
    "Related party credit": "Related Party / Group Inflows",
    "Related party debit": "Promoter Drawings / Remittances",
    "inward bounce penal charges": "Inward Cheque / Mandate Bounces",
    "Outward Bounced Xns": "Outward Cheque / Mandate Returns",
    "other penal charges": "Bank Penalties & Non-Maintenance",
    "return / refund": "Outward Cheque / Mandate Returns",
    "ECS transaction": "Supplier / Vendor Settlements",
    "Regular credit": "Business income",
    "Regular debit": "Supplier / Vendor Settlements",
}
