"""Word lists, thresholds, labels and formats that decide results.

Everything in this module is data.  Order matters wherever a tuple is used:
rule tables are evaluated first-match-wins, so ``vi`` in the telecom row also
catches "dividend" and "savings" before the income rows are reached.
"""

# --- Statement categories, full rule table (first match wins) ---------------
CATEGORY_RULES = (
    ("Food_Delivery", ("zomato", "swiggy", "dominos", "domino", "mcdonald", "kfc", "pizza hut", "burger king")),
    ("Quick_Commerce", ("blinkit", "zepto", "dunzo", "instamart", "bigbasket", "big basket", "grofers")),
    ("Grocery_Store", ("dmart", "d mart", "big bazaar", "bigbazaar", "more store", "reliance fresh", "kirana", "grocery")),
    ("Telecom_Expense", ("recharge", "jio", "airtel", "vi", "vodafone", "bsnl", "mobile", "prepaid", "postpaid")),
    ("Utility_Electricity", ("bescom", "msedcl", "tpddl", "uppcl", "electricity", "power", "light bill", "eb payment", "energy bill")),
    ("Rent_Expense", ("rent", "house rent", "monthly rent", "landlord")),
    ("Fuel_Expense", ("hpcl", "indian oil", "iocl", "bpcl", "bharat petro", "petrol", "diesel", "fuel")),
    ("Transportation", ("uber", "ola", "rapido", "cab", "taxi", "auto", "ride")),
    ("Ecommerce_Shopping", ("amazon", "flipkart", "myntra", "meesho", "ajio", "snapdeal", "ecommerce")),
    ("EMI_Loan_Payment", ("emi", "loan", "hdfc loan", "sbi loan", "bajaj finance", "home credit", "lendenclub", "lending club", "nach", "repayment")),
    ("SHG_Contribution", ("shg", "self help", "women group", "micro credit")),
    ("SIP_Investment", ("sip", "mutual fund", "starmf", "groww", "zerodha", "coin", "investment")),
    ("Insurance_Premium", ("lic premium", "lic", "hdfc life", "sbi life", "max life", "icici pru", "insurance premium", "policy")),
    ("Agriculture_Input", ("fertilizer", "agri store", "krishi", "seed", "pesticide", "farm input")),
    ("Tractor_EMI", ("tractor", "mahindra finance tractor", "farm equipment")),
    ("ATM_Cash_Withdrawal", ("atm", "cash withdrawal", "atm wd", "cash wd")),
    ("Local_Market", ("local market", "market", "vendor", "sabzi", "vegetable")),
    ("LPG_Gas", ("lpg", "gas", "hp gas", "indane", "bharat gas")),
    ("Healthcare_Medical", ("hospital", "doctor", "clinic", "pharmacy", "medical", "apollo", "fortis", "medicine")),
    ("Education", ("school", "college", "university", "education", "course", "fees", "tuition")),
    ("Bank_Charges", ("sms charges", "sms", "quarterly charges")),
    ("Payment_Bounce", ("ach return", "bounce", "insuff", "insufficient funds", "cheque return")),
    ("UPI_Payment", ("upi", "paytm", "phonepe", "google pay", "gpay", "amazonpay", "bhim")),
    ("Salary_Income", ("salary", "payroll", "income credit", "employer", "wages")),
    ("Gig_Income", ("bundl", "swiggy.*payout", "zomato.*payout", "urban company", "porter", "rapido.*payout", "delivery partner", "gig")),
    ("Govt_DBT_PMKisan", ("dbt.*pm.*kisan", "pm-kisan", "kisan samman", "pmkisan")),
    ("Mandi_Sale_Income", ("enam", "mandi", "crop sale", "agricultural sale")),
    ("MGNREGA_Income", ("mgnrega", "nrega", "rural employment")),
    ("SHG_Dividend_Income", ("shg dividend", "shg credit", "group dividend")),
    ("Interest_Dividend_Income", (r"int\.pd", "interest", "fd interest", "savings interest", "dividend")),
    ("Business_P2P_Income", ("cust payment", "customer", "business deposit", "p2p", "peer to peer", "personal transfer")),
)

# --- Statement categories, short rule table of the streaming line -----------
CATEGORY_RULES_DLT = (
    ("Food_Delivery", ("zomato", "swiggy", "domino", "pizza", "mcdonald", "kfc", "burger")),
    ("Salary_Income", ("salary", "payroll", "wages")),
    ("EMI_Loan_Payment", ("emi", "loan repay", "equated monthly")),
    ("UPI_Payment", ("upi",)),
    ("Utility_Electricity", ("bescom", "electricity", "power bill")),
    ("Telecom_Recharge", ("jio", "airtel", "vodafone", "bsnl", "telecom")),
    ("Rent_Payment", ("rent", "house rent")),
    ("SIP_Investment", ("sip", "mutual fund", "investment")),
    ("Insurance_Premium", ("insurance", "lic", "policy premium")),
    ("Govt_PMKisan", ("pm-kisan", "pmkisan", "kisan samman")),
    ("Govt_MGNREGA", ("mgnrega", "nrega")),
    ("Ecommerce", ("amazon", "flipkart", "myntra", "meesho")),
    ("Transportation", ("uber", "ola", "rapido")),
    ("Healthcare", ("hospital", "clinic", "pharmacy", "medicine")),
    ("Education", ("school", "college", "tuition", "education")),
    ("Payment_Bounce", ("bounce", "return", "dishono")),
    ("Gig_Income", ("freelance", "gig", "upwork", "fiverr")),
)
OTHER_CATEGORY = "Other"

# --- Merchant patterns ------------------------------------------------------
MERCHANT_PATTERN = "(UPI[A-Z]*-[A-Z0-9]+|[A-Z]{3,})"
MERCHANT_BRANDS_DLT = ("zomato", "swiggy", "amazon", "flipkart", "jio", "airtel", "uber", "ola", "pmkisan")

# --- Personas (first match wins); predicates over the per-user signals -------
PERSONA_RULES = (
    ("Farmer", "pmkisan_count >= 1 OR mandi_sale_count >= 1 OR (mgnrega_count >= 2 AND tractor_emi_count >= 1)"),
    ("Gig_Worker", "gig_income_count >= 3 AND total_gig_income > 5000"),
    ("Salaried_Employee", "salary_credit_count >= 3 AND total_salary > 10000"),
    ("Kirana_Owner", "business_deposit_count >= 10 AND total_business_income > 15000"),
    ("SHG_Woman", "shg_txn_count >= 1 OR shg_income_count >= 1"),
    ("Street_Vendor", "atm_txn_count >= 8 AND market_txn_count >= 3 AND total_credits < 20000"),
    ("Financially_Disciplined", "sip_count >= 2 AND insurance_payment_count >= 2 AND emi_payment_count >= 3 AND bounce_count = 0"),
    ("High_Risk_Bounces", "bounce_count >= 1"),
    ("Diverse_Spender", "category_diversity >= 10"),
)
PERSONA_RULES_DLT = (
    ("Farmer", "pmkisan_count > 0"),
    ("Salaried_Employee", "salary_count >= 5"),
    ("Gig_Worker", "gig_count > 0"),
    ("Diverse_Spender", "category_diversity > 15"),
)
DEFAULT_PERSONA = "Casual_User"
PERSONA_FLAGS = {
    "is_farmer": "Farmer",
    "is_gig_worker": "Gig_Worker",
    "is_salaried": "Salaried_Employee",
    "is_kirana_owner": "Kirana_Owner",
    "is_shg_woman": "SHG_Woman",
    "is_street_vendor": "Street_Vendor",
}

# --- Per-user persona signals: column -> (measure, category) -----------------
PERSONA_SIGNALS = {
    "shg_txn_count": ("count", "SHG_Contribution"),
    "shg_income_count": ("count", "SHG_Dividend_Income"),
    "market_txn_count": ("count", "Local_Market"),
    "gas_txn_count": ("count", "LPG_Gas"),
    "gig_income_count": ("count", "Gig_Income"),
    "total_gig_income": ("deposit", "Gig_Income"),
    "food_delivery_count": ("count", "Food_Delivery"),
    "quickcom_count": ("count", "Quick_Commerce"),
    "ride_txn_count": ("count", "Transportation"),
    "fuel_txn_count": ("count", "Fuel_Expense"),
    "rent_payment_count": ("count", "Rent_Expense"),
    "salary_credit_count": ("count", "Salary_Income"),
    "total_salary": ("deposit", "Salary_Income"),
    "sip_count": ("count", "SIP_Investment"),
    "ecommerce_count": ("count", "Ecommerce_Shopping"),
    "fd_interest_count": ("count", "Interest_Dividend_Income"),
    "pmkisan_count": ("count", "Govt_DBT_PMKisan"),
    "mandi_sale_count": ("count", "Mandi_Sale_Income"),
    "mgnrega_count": ("count", "MGNREGA_Income"),
    "fertilizer_count": ("count", "Agriculture_Input"),
    "tractor_emi_count": ("count", "Tractor_EMI"),
    "business_deposit_count": ("count", "Business_P2P_Income"),
    "total_business_income": ("deposit", "Business_P2P_Income"),
    "atm_txn_count": ("count", "ATM_Cash_Withdrawal"),
    "insurance_payment_count": ("count", "Insurance_Premium"),
    "emi_payment_count": ("count", "EMI_Loan_Payment"),
    "bounce_count": ("count", "Payment_Bounce"),
}

# --- Expectations on streamed statements and on the feature table ------------
LOW_BALANCE_LIMIT = 500
LARGEST_WITHDRAWAL = 10_000_000
USER_ID_PATTERN = "^USR-[0-9]+$"
FRESH_DAYS = 365
MIN_HISTORY = 10

# --- Pillar tables: validity limits and enumerations --------------------------
SEGMENTS = ("shg_woman", "gig_worker", "kirana_owner", "salaried_informal", "rural_farmer")
BILL_TYPES = ("electricity", "mobile", "water", "dth")
UPI_STATUSES = ("SUCCESS", "FAILED")
MAX_BILL, MAX_UPI, MAX_INCOME = 50_000, 200_000, 500_000

# --- Feature contract of the pillar line --------------------------------------
# name -> (pillar key, reader-facing label), in contract order
CONTRACT_FEATURES = {
    "p1_bill_ontime_rate": ("pillar_1_bill_payment", "Bill payment consistency"),
    "p1_avg_days_late": ("pillar_1_bill_payment", "Average payment delay"),
    "p1_severe_late_rate": ("pillar_1_bill_payment", "Severely late bills"),
    "p1_bill_type_diversity": ("pillar_1_bill_payment", "Bill type variety"),
    "p1_payment_trend": ("pillar_1_bill_payment", "Payment improvement trend"),
    "p2_upi_txn_per_month": ("pillar_2_upi_flow", "UPI transaction volume"),
    "p2_avg_txn_amount": ("pillar_2_upi_flow", "Average UPI amount"),
    "p2_txn_cv": ("pillar_2_upi_flow", "Transaction consistency"),
    "p2_failure_rate": ("pillar_2_upi_flow", "UPI failure rate"),
    "p2_merchant_diversity": ("pillar_2_upi_flow", "Merchant diversity"),
    "owns_land_d": ("pillar_3_assets", "Land ownership"),
    "land_acres_capped": ("pillar_3_assets", "Land holding size"),
    "owns_vehicle_d": ("pillar_3_assets", "Vehicle ownership"),
    "bank_vintage_capped": ("pillar_3_assets", "Banking tenure"),
    "has_fd_or_rd_d": ("pillar_3_assets", "Fixed/recurring deposit"),
    "income_log": ("pillar_4_income", "Income level"),
    "itr_filed_d": ("pillar_4_income", "ITR filing status"),
    "gst_registered_d": ("pillar_4_income", "GST registration"),
    "employment_capped": ("pillar_4_income", "Employment tenure"),
    "jan_dhan_active_d": ("pillar_5_identity", "Jan Dhan account activity"),
    "shg_member_d": ("pillar_5_identity", "SHG membership"),
    "shg_months": ("pillar_5_identity", "SHG tenure"),
    "dbt_months": ("pillar_5_identity", "DBT benefit history"),
    "svanidhi_repaid_d": ("pillar_5_identity", "SVANidhi loan repaid"),
    "sim_tenure_months": ("pillar_6_stability", "Mobile SIM tenure"),
    "location_stability": ("pillar_6_stability", "Location stability"),
    "fraud_flag_d": ("pillar_6_stability", "Fraud flag"),
    "derived_income_to_bills_ratio": ("derived", "Income vs bills ratio"),
    "derived_digital_engagement": ("derived", "Digital engagement"),
    "derived_formal_economy_score": ("derived", "Formal economy score"),
    "derived_asset_score": ("derived", "Asset strength"),
}
CONTRACT_LABEL = "default_label"
PILLARS = ("pillar_1_bill_payment", "pillar_2_upi_flow", "pillar_3_assets",
           "pillar_4_income", "pillar_5_identity", "pillar_6_stability")
# Labels used by the refresh run; features not listed keep their column name.
REFRESH_LABELS = {
    "p1_bill_ontime_rate": "Bill payment consistency",
    "p1_avg_days_late": "Average payment delay",
    "p2_upi_txn_per_month": "UPI transaction volume",
    "p2_failure_rate": "UPI failure rate",
    "income_log": "Income level",
    "itr_filed_d": "ITR filing",
    "owns_land_d": "Land ownership",
    "bank_vintage_capped": "Banking tenure",
    "fraud_flag_d": "Fraud flag",
    "sim_tenure_months": "SIM tenure",
    "jan_dhan_active_d": "Jan Dhan activity",
    "shg_member_d": "SHG membership",
}
NO_POSITIVE = "No strong positive factors"
NO_NEGATIVE = "No strong negative factors"

# Progressive feature sets of the classifier comparison
BASELINE_FEATURES = ("income_log", "employment_capped", "owns_land_d", "owns_vehicle_d",
                     "bank_vintage_capped", "itr_filed_d", "sim_tenure_months")
BILL_FEATURES = ("p1_bill_ontime_rate", "p1_avg_days_late", "p1_severe_late_rate",
                 "p1_bill_type_diversity", "p1_payment_trend")

# --- Scores ---------------------------------------------------------------------
SCORE_FLOOR, SCORE_CEILING = 300, 900
SCORE_CATEGORIES = ((750, "Excellent"), (650, "Good"), (550, "Fair"), (450, "Poor"))
LOWEST_CATEGORY = "Very Poor"
SCORE_BANDS = ((400, "Poor"), (600, "Fair"), (750, "Good"), (901, "Excellent"))  # upper bounds, inclusive
SCORE_TIERS = ((700, "excellent"), (550, "good"), (400, "fair"))
LOWEST_TIER = "building"
APP_LABELS = ((700, "Good"), (500, "Fair"))
LOWEST_APP_LABEL = "Needs Work"
APPROVALS = ((700, "RECOMMEND APPROVAL"), (550, "CONDITIONAL APPROVAL"))
LOWEST_APPROVAL = "HIGH RISK"
PERSONA_POINTS = {"is_salaried": 80, "is_farmer": 60, "is_gig_worker": 70,
                  "is_kirana_owner": 75, "is_shg_woman": 65, "is_street_vendor": 55}
IMPROVEMENT_TIPS = (
    ("bills_on_time_pct", 0.9, "Pay all bills (electricity, gas, mobile) on time via UPI"),
    ("upi_txn_count", 500, "Use UPI for daily purchases to build transaction history"),
)
STANDING_TIPS = (
    "Start a small recurring deposit (even Rs 500/month helps)",
    "Get a micro-insurance policy (LIC/PMJJBY) for credit profile",
    "Apply for PM SVANidhi to build formal loan repayment record",
)

# --- Loan schemes ------------------------------------------------------------------
# First LIKE match with a sufficient score decides eligibility.
SCHEME_SCORE_RULES = (("%Shishu%", 300), ("%SVANidhi%", 400), ("%Kishor%", 550), ("%Tarun%", 700),
                      ("%Vishwakarma%", 350), ("%Kisan%", 400), ("%SHG%", 350), ("%NABARD%", 500))
# name, minimum score, occupation keywords (empty = any), amount, interest, collateral
APP_SCHEMES = (
    ("PMMY Mudra Shishu", 300, (), "50,000", "10%", "No"),
    ("PM SVANidhi Tier 1", 450, (), "10,000", "7%", "No"),
    ("PMMY Mudra Kishor", 550, (), "5,00,000", "12%", "Partial"),
    ("PM Vishwakarma Tier 1", None, ("artisan", "tailor", "weaver", "carpenter", "potter", "blacksmith", "barber"), "1,00,000", "5%", "No"),
    ("Kisan Credit Card", None, ("farmer", "dairy", "agriculture", "cattle", "fish"), "3,00,000", "7%", "Land records"),
)
SCHEME_THRESHOLDS = {  # name -> (minimum score, largest loan)
    "PM SVANidhi Tier 1": (400, 10_000),
    "PM SVANidhi Tier 2": (550, 20_000),
    "PM SVANidhi Tier 3": (650, 50_000),
    "PMMY Mudra Shishu": (300, 50_000),
    "PMMY Mudra Kishor": (550, 500_000),
    "PMMY Mudra Tarun": (700, 1_000_000),
    "PM Vishwakarma T1": (350, 100_000),
    "PM Vishwakarma T2": (500, 200_000),
    "Kisan Credit Card": (400, 300_000),
}
# scheme_id, name, target group, state, one-line description in our words
SCHEME_CORPUS = (
    (1, "PM SVANidhi Tier 1", "street_vendor", "All India", "First working-capital loan for street vendors, up to Rs 10,000, repaid over a year without security."),
    (2, "PM SVANidhi Tier 2", "street_vendor", "All India", "Second vendor loan of Rs 20,000 once the first is repaid, with cashback for digital payments."),
    (3, "PM SVANidhi Tier 3", "street_vendor", "All India", "Third vendor loan of Rs 50,000 for vendors who repaid both earlier loans and want to grow."),
    (4, "PMMY Mudra Shishu", "micro_business", "All India", "Loan up to Rs 50,000 for small shops, food stalls and repair services, no security asked."),
    (5, "PMMY Mudra Kishor", "small_business", "All India", "Loan of Rs 50,000 to Rs 5 lakh for growing firms with a year of history behind them."),
    (6, "PMMY Mudra Tarun", "established_business", "All India", "Loan of Rs 5 lakh to Rs 10 lakh for established firms with a documented track record."),
    (7, "Kisan Credit Card", "farmer", "All India", "Revolving farm credit up to Rs 3 lakh for crops, dairy, fishery and livestock."),
    (8, "NABARD Dairy Entrepreneurship Scheme", "farmer", "All India", "Loan up to Rs 7 lakh with a capital subsidy for small dairy farms and milk processing."),
    (9, "SHG Bank Linkage Programme", "shg_woman", "All India", "Group loan up to Rs 10 lakh for women's savings groups, secured by the group's own savings."),
    (10, "PM Vishwakarma Tier 1", "artisan", "All India", "Loan of Rs 1 lakh at 5 percent for traditional craftspeople, with training and a toolkit grant."),
    (11, "PM Vishwakarma Tier 2", "artisan", "All India", "Second craft loan of Rs 2 lakh at 5 percent after the first is repaid."),
)
# scheme_id, name, largest loan, interest percent, collateral, eligibility in our words
SCHEME_PRICES = (
    ("SVA001", "PM SVANidhi Tier 1", 10_000, 7.0, "No", "vendor with a certificate"),
    ("SVA002", "PM SVANidhi Tier 2", 20_000, 7.0, "No", "first vendor loan repaid"),
    ("SVA003", "PM SVANidhi Tier 3", 50_000, 7.0, "No", "both vendor loans repaid"),
    ("MUD001", "PMMY Mudra Shishu", 50_000, 10.0, "No", "no earlier default, basic KYC"),
    ("MUD002", "PMMY Mudra Kishor", 500_000, 12.0, "Partial", "one year in business"),
    ("MUD003", "PMMY Mudra Tarun", 1_000_000, 14.0, "Yes", "two years in business, audited"),
    ("KCC001", "Kisan Credit Card Crop Loan", 300_000, 7.0, "Land records", "owns or leases farm land"),
    ("KCC002", "Kisan Credit Card Allied Activities", 200_000, 7.0, "Land records", "dairy, poultry or fishery"),
    ("NAB001", "NABARD Dairy Development Scheme", 700_000, 8.5, "Yes", "dairy plan and two animals"),
    ("SHG001", "Self Help Group Bank Linkage", 1_000_000, 7.0, "No", "group active for six months"),
    ("VIS001", "PM Vishwakarma Tier 1", 100_000, 5.0, "No", "registered craftsperson"),
    ("VIS002", "PM Vishwakarma Tier 2", 200_000, 5.0, "No", "first craft loan repaid"),
)

# --- Retrieval corpus -----------------------------------------------------------------
FINANCE_TOPICS = ("Commerce", "Banking", "Finance", "Economics", "Business Studies",
                  "Accounting", "Insurance", "Taxation", "Investment", "Microfinance")
ALL_STATES = "All India"
STATE_BOOST = 0.1
CONTEXT_CHUNKS, CONTEXT_CHARS, REPLY_CHARS = 4, 250, 490
FALLBACK_REPLY = "Aapke liye sahi yojana dhundh rahe hain. Kripya dobara puchein."
LANGUAGES = {"hi": "Hindi", "ta": "Tamil", "te": "Telugu", "mr": "Marathi", "bn": "Bengali",
             "gu": "Gujarati", "pa": "Punjabi", "en": "English", "kn": "Kannada", "ml": "Malayalam"}
DEFAULT_LANGUAGE = "hi"
