"""Closed domains of the data model, in their order."""

# Source authorities with their score; the first five are primary sources.
AUTHORITIES = (
    ("REGULATOR", 100), ("STATUTORY_DISCLOSURE", 98), ("OFFICIAL_COMPANY", 92), ("INDUSTRY_BODY", 88), ("SPECIALIST_RESEARCH", 84),
    ("ESTABLISHED_MEDIA", 78), ("PROFESSIONAL_SERVICES", 76), ("OTHER_PUBLISHER", 58), ("SOCIAL_OR_BLOG", 35), ("UNKNOWN", 45),
)
PRIMARY = 5

# Categories of a document, departments, and which department reads which category.
CATEGORIES = (
    "MACRO_ECONOMIC", "INDUSTRY_REGULATION", "MARKET_STRUCTURE", "COMPANY_FINANCIAL_PERFORMANCE", "CORPORATE_ACTION",
    "TECHNOLOGY_AI", "CUSTOMER_EXPERIENCE", "PEOPLE_TALENT", "BRAND_REPUTATION", "STRATEGIC_RESEARCH", "PRODUCT_LAUNCH",
    "FEE_BENEFIT_COMMISSION_CHANGE", "PRODUCT_REGULATION", "SALES_DATA", "DISTRIBUTION_CHANNEL",
)
DEPARTMENTS = ("STRATEGY", "PRODUCT", "SALES", "COMPLIANCE")
ROUTING = (
    ("PRODUCT_LAUNCH", "PRODUCT"), ("PRODUCT_LAUNCH", "SALES"), ("FEE_BENEFIT_COMMISSION_CHANGE", "PRODUCT"), ("FEE_BENEFIT_COMMISSION_CHANGE", "SALES"),
    ("PRODUCT_REGULATION", "PRODUCT"), ("PRODUCT_REGULATION", "COMPLIANCE"), ("SALES_DATA", "SALES"), ("DISTRIBUTION_CHANNEL", "SALES"),
)

# Gate outcomes; a worse one comes earlier.
GATES = ("FAIL_SCHEMA", "FAIL_NO_CITATION", "FAIL_UNKNOWN_CITATION", "FAIL_NAME_NOT_IN_EVIDENCE", "FAIL_DATE_NOT_IN_EVIDENCE", "FAIL_NUMBER_NOT_IN_EVIDENCE", "PASS")
APPROVED = ("AUTO_APPROVED", "APPROVED", "EDITED_APPROVED", "FORCE_APPROVED")
FACT_TYPES = ("PRODUCT_LAUNCH", "REGULATION", "METRIC", "CORPORATE_ACTION", "OTHER")

#: The day that all ages and windows are taken from in the registered queries.
AS_OF = "2026-08-06"
#: Local dates are those of this zone.
ZONE = "Asia/Ho_Chi_Minh"
EVIDENCE_CHARS = 600
CHUNK_CHARS, CHUNK_OVERLAP = 24_000, 1_200
