"""Keyword lists, tags and name tables used by the rules.

Every list keeps its meaning-bearing order (first listed wins). They can be replaced
by the user's own.
"""

# ---- tags -----------------------------------------------------------------
EMI = "EMI transaction"
INTEREST_IN = "Interest received"
INTEREST_OUT = "Interest / fee payments"
INVESTMENT = "Investment return credited"
DISBURSAL = "Loan amount disbursal"
SALARY_OUT = "Salary paid"
SALARY_IN = "Salary credited"
ECS = "ECS transaction"
CASH_IN = "cash deposit"
CASH_OUT = "cash withdrawal"
INWARD_BOUNCE = "inward bounce penal charges"
OUTWARD_BOUNCE = "Outward Bounced Xns"
PENAL = "other penal charges"
REFUND = "return / refund"
RELATED_IN = "Related party credit"
RELATED_OUT = "Related party debit"
REGULAR_IN = "Regular credit"
REGULAR_OUT = "Regular debit"

PAYMENTS_ISSUED = [EMI, SALARY_OUT, ECS, RELATED_OUT, REGULAR_OUT]
PAYMENTS_DEPOSITED = [RELATED_IN, REGULAR_IN]
NON_TURNOVER = [DISBURSAL, SALARY_IN, INTEREST_IN, INVESTMENT, REFUND, RELATED_IN]

# ---- rule keywords (fixed values) -----------------------------------------
LENDERS = [
    "Krazybee", "Kreditbee", "Kisetsu", "Saison", "SMFG", "SMFGINDIA", "ABFL",
    "Adithya Financ", "Sanchetna Financial", "Sanchetnafinancial", "Kinara Capital",
    "Clix Capital", "Bajaj Fin", "Bajaj Finance", "HDB Financ", "Tata Capital",
    "Aditya Birla Fin", "Fullerton", "Cholamandalam", "Shriram Fin", "Muthoot",
    "Manappuram", "L&T Finance", "Piramal Fin", "Piramal Cap", "Piramal Housing",
    "VastuHFC", "Poonawalla", "Indiabulls", "LIC Housing", "PNB Housing", "Canfin",
    "SMFG India Credit", "SMFGINDIACREDIT", "Royal Capital", "Northern Arc", "Vivriti",
    "UGRO", "Lendingkart", "Flexiloans", "Ambit Fin", "IIFL Fin", "IIFL Home",
    "IIFL Samasta", "Axis Finance", "Axis Finanace", "Cholamx",
]
PENAL_KEYWORDS = [
    "MAB", "MIN BAL", "MIN BALANCE", "MINIMUM BAL", "MINIMUM BALANCE", "AVG BAL",
    "AVG BALANCE", "AVERAGE BAL", "AMB CHG", "AMB CHRG", "NON MAINTENANCE",
    "NONMAINTENANCE", "POS THRESHOLD", "PENAL", "OVERDUE", "LATE FEE", "LATE PAYMENT",
]
SERVICE_FEE_KEYWORDS = [
    "CARD CHARGE", "DR CARD", "DEBIT CARD", "TXN CHRG", "TXN CHARGE",
    "TRANSACTION CHARGE", "BNA", "ATM CHARGE", "SMS CHARGE", "SMS CHRG",
]
CASH_DEPOSIT_KEYWORDS = [
    "CASHDEP", "CASH DEP", "CDM", "BY CASH", "CASH DEPOSIT", "ATM-CASH", "ATM CASH",
    "ATMCASH", "BNA/",
]
CASH_WITHDRAWAL_KEYWORDS = [
    "CHQ PAID SELF", "SELF CHQ PAID", "CASH PAID", "CASH WDL", "CASH WITHDRAWAL", "CHEQUE CASH",
]
RETURN_KEYWORDS = [
    "CHQ DEP RET", "I/W CHEQUE RETURN", "RETURN IMPS", "IMPS RETURN", "RETURN NEFT",
    "NEFT RETURN", "RETURN RTGS", "RTGS RETURN", "INB RETURN",
]
DIVIDEND_PAYERS = ["JSW Steel", "Narayana Hrudayalaya"]
INVESTMENT_HINTS = [
    "SHAREKHAN", "ZERODHA", "GROWW", "UPSTOX", "ANGEL", "ICCLR", "MUTUAL FUND",
    "MF REDEMPTION", "NSE ", "BSE ", "CDSL", "NSDL", "RD MATURITY", "FD CLOS",
    "SECURITIES", "BROKING", "DIVIDEND",
]
HIGH_RISK_GROUPS = {
    "Gambling / betting / real-money gaming": [
        "DREAM11", "GAMES24X7", "MY11CIRCLE", "RUMMYCIRCLE", "JUNGLEERUMMY", "ACE2THREE",
        "POKERBAAZI", "1XBET", "PARIMATCH", "STAKE.COM", "BET365", "LOTTERY", "CASINO",
    ],
    "Virtual digital assets / crypto": [
        "WAZIRX", "COINDCX", "COINSWITCH", "ZEBPAY", "UNOCOIN", "BITBNS", "BINANCE", "CRYPTO",
    ],
    "Unlicensed / P2P lending outflows": ["FAIRCENT", "LENDBOX", "I2IFUNDING", "LENDENCLUB"],
    "Speculative stock & derivatives funding": [
        "ZERODHA", "GROWW", "UPSTOX", "ANGELONE", "ANGEL BROKING", "5PAISA", "DHAN BROKING",
        "MCX", "F&O FUNDING",
    ],
}

# ---- party vocabulary (fixed values) --------------------------------------
CHANNEL_TOKENS = ["P2A", "P2M", "P2V", "P2P", "UPI", "IMPS", "NEFT", "RTGS", "MMT", "DR", "CR"]
REMARK_WORDS = [
    "PAY", "PAYM", "PAYME", "PAYMEN", "PAYMENT", "PAYMENTS", "TRANSFER", "TRF", "FUND",
    "FUNDS", "TXN", "BILL", "PYMT", "TRF.", "SALARY", "RENT", "GST", "REQPAY", "COLLPAY",
    "PAYREQ", "COLLECT", "REQUEST", "REQ", "COLL", "MANDATE", "AUTOPAY", "QRPAY",
]
BARE_NAME_STOP = [
    "INTEREST", "CHARGE", "CHARGES", "CHRG", "CHRGS", "DEBIT", "CREDIT", "CASH", "RETURN",
    "POSTING", "RECOVERY", "WDL", "DEP", "TFR", "INT", "BULK", "CMS", "CHEQUE", "CHQ", "SELF",
    "BANK", "RET", "REVERSAL", "CLOSED", "BALANCE", "ACH", "NACH", "INW", "INB", "ATM", "POS",
    "EMI", "LIMIT", "SETTLEMENT",
]
PARTY_STOP = [
    "ATTN", "TPT", "CHG", "RETURN", "REVERSAL", "ACCOUNT CLOSED", "UTR NO", "UTR", "CLG",
    "NEFT CR", "NEFT DR", "RTGS CR", "RTGS DR",
]
STAMP_WORDS = (
    "WDL|DEP|TFR|TRF|IMPS|NEFT|RTGS|UPI|ACH|NACH|ECS|P2A|P2M|IMPSAB|CHG|CHRG|CHRGS|CHARGES|"
    "SENDER|TRANSFER|PAYMENT|PAYME|CR|DR|INB|INF|TPT|BY|TO|FROM|SELF|CLG"
)
SEGMENT_BANK_CODES = (
    "SBIN|HDFC|ICIC|UTIB|KKBK|PUNB|CNRB|BARB|IDIB|IOBA|UBIN|INDB|YESB|IDFB|FDRL|KVBL|MAHB|AUBL|"
    "ESFB|NTBL|BKID|SIBL|AIRP|YBL|PTSB"
)
PARTY_BANK_CODES = (
    "SBIN|HDFC|ICIC|UTIB|KKBK|PUNB|CNRB|BARB|IDIB|IOBA|UBIN|INDB|YESB|IDFB|FDRL|KVBL|MAHB|AUBL|"
    "ESFB|CIUB|SCBL|RATN|BKID|SIBL|PYTM"
)
BANK_FRAGMENTS = [
    "RAT", "UTI", "SBI", "IOB", "YES", "KKB", "HDF", "ICI", "PUN", "CNR", "BAR", "IDF", "IND",
    "KAR", "UBI", "MAH",
]
BANK_BRANDS = [
    "SBI", "STATE BANK", "HDFC", "ICICI", "AXIS", "KOTAK", "KOTAK MAHINDRA", "CANARA", "PNB",
    "PUNJAB NATIONAL", "IOB", "INDIAN OVERSEAS", "IDBI", "IDFC", "IDFC FIRST", "YES",
    "INDUSIND", "UNION", "UNION OF INDIA", "BOB", "BARODA", "EQUITAS", "AU",
    "AU SMALL FINANCE", "FEDERAL", "KARNATAKA", "CITY UNION", "DEUTSCHE", "RBL", "DBS", "HSBC",
    "CITI", "CITIBANK", "STANDARD CHARTERED", "INDIAN", "CENTRAL", "UCO", "BANDHAN",
]
PAYMENT_RAILS = [
    "PAYTM", "PHONEPE", "GPAY", "GOOGLEPAY", "BHARATPE", "AMAZONPAY", "MOBIKWIK", "FREECHARGE",
    "PAYZAPP", "PAYU", "RAZORPAY", "BHIM", "PAYTMQR", "OKAXIS", "OKICICI", "OKSBI",
    "OKHDFCBANK", "YBL", "IBL", "AXL", "PTYS", "PTYB", "APL", "UPI", "VYAPAR", "EAZYPAY",
    "YESPAY", "YESPAYBIZS",
]
WEAK_PARTY = ["", "BPAY", "P2A", "P2M", "BANK ACCOUNT", "UNKNOWN PARTY", "BILL", "BBPS"]
PAYMENT_APPS = [
    "GOOGLEINDIADIGITAL", "GOOGLEINDIA", "GPAY", "GOOGLEPAY", "PHONEPE", "PAYTM", "BHARATPE",
    "AMAZONPAY", "CRED", "MOBIKWIK",
]
LEGAL_FORM = [
    "M", "S", "MS", "MESSRS", "THE", "PRIVATE", "PVT", "LIMITED", "LTD", "LLP", "COMPANY", "CO",
    "AND", "CORPORATION", "CORP", "INC", "INDIA", "SONS", "BROTHERS", "BROS", "ENTERPRISE",
    "ENTERPRISES", "TRADERS", "TRADING", "INDUSTRIES", "SERVICES", "SOLUTIONS", "GROUP",
    "PROPRIETOR",
]
ROUTING_BANKS = {
    "SBIN": "State Bank of India", "HDFC": "HDFC Bank", "ICIC": "ICICI Bank", "UTIB": "Axis Bank",
    "KKBK": "Kotak Mahindra Bank", "PUNB": "Punjab National Bank", "CNRB": "Canara Bank",
    "BARB": "Bank of Baroda", "IDIB": "Indian Bank", "IOBA": "Indian Overseas Bank",
    "UBIN": "Union Bank of India", "YESB": "YES Bank", "INDB": "IndusInd Bank",
    "IDFB": "IDFC FIRST Bank", "FDRL": "Federal Bank", "RATN": "RBL Bank",
    "KARB": "Karnataka Bank", "MAHB": "Bank of Maharashtra", "CBIN": "Central Bank of India",
    "BKID": "Bank of India", "AUBL": "AU Small Finance Bank",
    "ESFB": "Equitas Small Finance Bank", "CIUB": "City Union Bank",
    "TMBL": "Tamilnad Mercantile Bank", "SCBL": "Standard Chartered Bank",
}
SHORT_BANKS = {
    "icici bank": "ICICI", "axis bank": "AXIS", "hdfc bank": "HDFC",
    "state bank of india": "SBI", "kotak mahindra bank": "KOTAK",
}
NARRATION_STAMPS = [
    "UPI", "IMPS", "NEFT", "RTGS", "MMT", "P2A", "P2M", "P2P", "DR", "CR", "ACH", "TPT", "INB",
    "INF", "BIL", "ONL", "NA", "UPIINTENT", "PAYMENT", "TRANSFER", "URGENT", "REVSWEEP", "OUT",
    "IN", "WDL", "TFR", "DEP", "TRF", "CHQ", "CLG", "INT", "SELF", "RET", "RETURN", "TO", "FROM",
    "BY",
]

# ---- report tables (fixed values) -----------------------------------------
DESTINATION_TABLES = {
    EMI: "EMI Xns", ECS: "ECS Xns", CASH_IN: "Cash Deposit Xns", CASH_OUT: "Cash Withdrawal Xns",
    SALARY_OUT: "Salary Paid Xns", SALARY_IN: "Salary Paid Xns", DISBURSAL: "Loan Disbursed Xns",
    INWARD_BOUNCE: "Bounced-Penal Xns", OUTWARD_BOUNCE: "Outward Bounced Xns",
    PENAL: "Bounced-Penal Xns", REGULAR_IN: "Regular Credits", REGULAR_OUT: "Regular Debits",
    RELATED_IN: "Regular Credits", RELATED_OUT: "Regular Debits", INTEREST_IN: "Other Xns",
    INTEREST_OUT: "Other Xns", INVESTMENT: "Other Xns", REFUND: "Other Xns",
}
GROUPED_TABLES = ["Regular Credits", "Regular Debits"]
REPORT_TABLES = [
    "Summary", "EOD Balances", "ECS Xns", "Cash Deposit Xns", "Cash Withdrawal Xns",
    "Top 10 Party Credits", "Top 10 Party Debits", "Loan Disbursed Xns", "EMI Xns",
    "Salary Paid Xns", "Top 10 Credits (Annual)", "Top 10 Debits (Annual)", "Avg Balances",
    "Regular Credits", "Regular Debits", "Outward Bounced Xns", "Bounced-Penal Xns", "Xns",
    "SundayXns",
]
SUMMARY_ROWS = [
    "Balance on 5th", "Balance on 15th", "Balance on 25th",
    "Average Balance (of 5th, 15th and 25th)", "Average Balance (month)",
    "Credit Instances No. of times (As per Statement)", "Total Credit Amount (As per Statement)",
    "Debit Instances No. of times (As per Statement)", "Total Debit Amount (As per Statement)",
    "No of Inward Bounces", "Number of Payments Issued", "Inward Payment Return (%)",
    "No of Outward Bounces", "Number of Payments Deposited", "Outward Cheque Return (%)",
]
EDITING_TOOLS = [
    "pdf-lib", "pdfsharp", "photoshop", "illustrator", "gimp", "canva", "inkscape",
    "microsoft word", "powerpoint", "libreoffice", "google docs", "foxit phantom", "nitro",
]
SWEEP_STAMPS = [
    "UPI", "NEFT", "RTGS", "IMPS", "TRF", "TFR", "WDL", "DEP", "ACH", "TPT", "INB", "INF", "BIL",
    "ONL", "DR", "CR", "P2A", "P2M", "PAYMENT", "TRANSFER", "ATTN", "REF", "NA", "MMT", "CLG",
    "CHQ", "INT", "OUT", "IN", "TO", "FROM", "BY", "NEFT CR", "NEFT DR", "RTGS CR", "RTGS DR",
    "MB", "IB", "PVT", "LTD",
]
TAG_SIGN = {
    SALARY_OUT: -1, SALARY_IN: 1, CASH_IN: 1, CASH_OUT: -1, INTEREST_IN: 1, INTEREST_OUT: -1,
    DISBURSAL: 1, EMI: -1, INWARD_BOUNCE: -1, PENAL: -1, REGULAR_IN: 1, REGULAR_OUT: -1,
}
