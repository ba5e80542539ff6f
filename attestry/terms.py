"""Term lists and the entity registry of the decision rules, and patterns over them."""

from __future__ import annotations

import re

# Terms that decide how material a statement is.
BANKING = ("bank", "banking", "ngân hàng", "deposit", "tiền gửi", "mortgage", "thế chấp", "credit card", "thẻ tín dụng", "lending", "cho vay")
INSURANCE = ("insurance", "insurer", "life insurance", "bảo hiểm", "bảo hiểm nhân thọ", "policy", "policyholder", "premium", "quyền lợi", "hợp đồng bảo hiểm")
OFFER = (
    "benefit", "coverage", "premium", "fee", "price", "pricing", "feature", "rider", "product", "policy", "segment",
    "quyền lợi", "phạm vi bảo hiểm", "phí", "giá", "tính năng", "sản phẩm", "bổ trợ", "phân khúc", "điều khoản",
)
REGULATION = ("regulation", "regulatory", "circular", "decree", "law", "compliance", "approval", "quy định", "thông tư", "nghị định", "luật", "tuân thủ", "phê duyệt")
DISTRIBUTION_INNOVATION = (
    "digital distribution", "embedded insurance", "bancassurance", "digital agent", "e-kyc", "online underwriting", "digital underwriting", "ai underwriting",
    "phân phối số", "bảo hiểm nhúng", "đại lý số", "thẩm định trực tuyến", "kênh số",
)
LAUNCH_ACTION = (
    "launch", "launched", "launches", "introduce", "introduced", "introduces", "unveil", "unveiled", "new insurance plan", "new insurance product",
    "ra mắt", "giới thiệu", "sản phẩm mới", "kế hoạch bảo hiểm mới",
)
DISTRIBUTION_CHANGE = (
    "launch", "launched", "introduce", "introduced", "new", "partner", "partnership", "integrate", "integrated", "deploy", "deployed", "transfer", "transfers", "use", "uses",
    "ra mắt", "giới thiệu", "mới", "hợp tác", "tích hợp", "triển khai", "chuyển giao", "sử dụng",
)
OFFER_CHANGE = (
    "increase", "decrease", "change", "changed", "adjust", "adjusted", "revise", "revised", "expand", "expanded", "reduce", "reduced",
    "tăng", "giảm", "thay đổi", "điều chỉnh", "mở rộng", "sửa đổi",
)
PATTERN = ("trend", "across the market", "multiple insurers", "industry-wide", "market shift", "xu hướng", "toàn thị trường", "nhiều doanh nghiệp bảo hiểm", "chuyển dịch thị trường")
COUNTER_EVIDENCE = ("however", "but", "decline", "risk", "uncertain", "caveat", "contradict", "tuy nhiên", "nhưng", "suy giảm", "rủi ro", "không chắc chắn", "mâu thuẫn")
NON_LIFE = ("non-life", "property and casualty", "p&c", "bảo hiểm phi nhân thọ", "phi nhân thọ")

# Terms of the kinds of product events, in the order in which kinds are tried.
EVENT_PROMOTION = ("promotion", "promotional", "campaign", "voucher", "giveaway", "khuyến mãi", "khuyến mại", "hoàn phí", "chiến dịch", "ưu đãi", "quà tặng")
EVENT_WITHDRAWAL = ("withdraw", "withdrawal", "suspend", "suspension", "terminate product", "discontinue", "tạm ngừng", "ngừng triển khai", "dừng bán", "chấm dứt sản phẩm")
EVENT_LAUNCH = (
    "launch", "launched", "launches", "introduce", "introduced", "introduces", "unveil", "unveiled", "pioneer", "pioneers", "new insurance plan", "new insurance product",
    "ra mắt", "giới thiệu", "sản phẩm mới",
)
EVENT_PRODUCT = (
    "insurance product", "insurance products", "insurance plan", "insurance plans", "policy", "rider", "coverage", "benefit", "shield plan", "life protection", "investment-linked",
    "sản phẩm bảo hiểm", "sản phẩm bảo vệ", "hợp đồng bảo hiểm", "quyền lợi", "bảo hiểm bổ trợ",
)
EVENT_BENEFIT = ("benefit", "coverage", "sum assured", "hospital network", "quyền lợi", "phạm vi bảo hiểm", "số tiền bảo hiểm", "mạng lưới bệnh viện")
EVENT_PRICE = ("premium", "fee", "price", "deductible", "commission", "phí bảo hiểm", "mức phí", "giá", "khấu trừ", "hoa hồng")
EVENT_CHANGE = (
    "increase", "increased", "increases", "decrease", "decreased", "decreases", "expand", "expanded", "expands", "change", "changed", "changes", "adjust", "adjusted", "adjusts",
    "double", "doubled", "doubles", "reduce", "reduced", "reduces", "revise", "revised", "revises", "transfer", "transfers", "partner", "partnership", "integrate", "deploy", "new",
    "latest", "tăng", "giảm", "mở rộng", "thay đổi", "điều chỉnh", "gấp đôi", "sửa đổi", "hợp tác", "ký kết",
)
EVENT_REGULATION = (
    "regulation", "regulatory", "law", "decree", "circular", "effective date", "compliance", "quy định", "pháp luật", "nghị định", "thông tư", "ngày hiệu lực", "tuân thủ",
)
EVENT_NEED = (
    "survey", "study", "research", "protection gap", "unmet need", "index found", "respondents", "decumulation", "longevity solutions",
    "khảo sát", "nghiên cứu", "khoảng trống bảo vệ", "nhu cầu chưa được đáp ứng", "người trả lời", "giải pháp trường thọ",
)
EVENT_DISTRIBUTION = (
    "bancassurance", "embedded insurance", "digital distribution", "digital insurance platform", "agent network", "advisor network", "partnership",
    "phân phối", "bảo hiểm nhúng", "nền tảng bảo hiểm số", "mạng lưới đại lý", "mạng lưới tư vấn", "hợp tác",
)
EVENT_SERVICE = (
    "app feature", "customer journey", "self-service", "claims service", "concierge", "premium reminder", "payment reminder",
    "tính năng ứng dụng", "hành trình khách hàng", "tự phục vụ", "dịch vụ bồi thường", "nhắc phí", "nhắc đóng phí",
)
EVENT_PERFORMANCE = ("sales", "revenue", "premium income", "new business", "market share", "profit", "doanh số", "doanh thu", "phí bảo hiểm", "khai thác mới", "thị phần", "lợi nhuận")
EVENT_CORPORATE = (
    "award", "anniversary", "appointment", "financial results", "csr", "charity", "accreditation", "reaccreditation", "disaster relief", "flood relief",
    "giải thưởng", "kỷ niệm", "bổ nhiệm", "kết quả tài chính", "từ thiện", "chung tay", "mưa lũ", "khắc phục hậu quả",
)

# Words whose number tells a text's language, and the letters of Vietnamese.
ENGLISH_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "should", "within", "owner", "criterion", "source", "signal", "market", "customer", "innovation", "digital",
    "distribution", "engagement", "regulatory", "screen", "unit", "economics", "launch", "launches", "insurer", "plan", "benefit", "pricing", "process", "portfolio", "validate",
    "evidence", "current", "development", "change", "requires", "review", "new", "health", "insurance", "assessment", "decision", "research", "prototype", "roadmap", "legal",
)
VIETNAMESE_WORDS = (
    "và", "của", "là", "cần", "để", "trong", "với", "được", "từ", "nguồn", "tín", "hiệu", "sản", "phẩm", "khách", "hàng", "thị", "trường", "bằng", "chứng", "kiểm", "tra", "đánh",
    "giá", "điều", "chỉnh", "quy", "định", "công", "bố", "doanh", "nghiệp", "ngày", "tháng",
)

# What an action must hold to count as a decision, or as watching only.
DIRECTIVES = (" should ", " must ", " needs to ", " need to ", " nen ", " can ", " phai ")
MONITORING = (" monitor", "watch", " track", "theo doi", "quan sat")
DECIDING = (
    "investigate", "validate", "prototype", "compare", "decide", "stop", "quantify", "map ", "review", "assess", "test ", "audit", "calculate", "evaluate", "pilot", "measure",
    "danh gia", "xac dinh", "lap ", "ra soat", "thu nghiem", "so sanh", "quyet dinh", "kiem tra", "do luong", "tinh toan",
)
PRODUCT_QUESTIONS = (
    "KIQ_1_OFFER_CHANGE", "KIQ_2_MARKET_PATTERN", "KIQ_3_REGULATORY_RESPONSE", "KIQ_4_TRANSFERABLE_INNOVATION", "KIQ_5_CUSTOMER_NEED", "KIQ_6_CHANGE_OVER_TIME", "KIQ_7_COUNTER_EVIDENCE",
    "P-KIQ-01", "P-KIQ-02", "P-KIQ-03", "P-KIQ-04", "P-KIQ-05", "P-KIQ-06", "P-KIQ-07",
)
OFFER_EVENTS = ("PRODUCT_LAUNCH", "PRODUCT_CHANGE", "BENEFIT_CHANGE", "PRICING_CHANGE", "PRODUCT_WITHDRAWAL")
THEME_EVENTS = {
    "VN_PRODUCT_OFFER": OFFER_EVENTS,
    "VN_REGULATORY_CHANGE": ("REGULATORY_CHANGE",),
    "DISTRIBUTION_INNOVATION": ("DISTRIBUTION_CHANGE", "SERVICE_EXPERIENCE_CHANGE"),
    "REGIONAL_TRANSFER": (*OFFER_EVENTS, "DISTRIBUTION_CHANGE", "SERVICE_EXPERIENCE_CHANGE", "CUSTOMER_NEED_SIGNAL"),
    "MARKET_PATTERN": (*OFFER_EVENTS, "CUSTOMER_NEED_SIGNAL", "COMPETITIVE_PERFORMANCE"),
}

# Legal entities as (key, kind, market, brand, own aliases, aliases shared with others).
_LOCAL, _PARENT, _OTHER, _REGULATOR = "LOCAL_OPERATING_COMPANY", "PARENT_GROUP", "UNRELATED_CONFUSABLE", "REGULATOR"
ENTITIES = (
    ("PRUDENTIAL_VN", _LOCAL, "VN", "PRUDENTIAL", ("prudential việt nam", "prudential vietnam", "công ty tnhh bảo hiểm nhân thọ prudential việt nam"), ("prudential",)),
    ("PRUDENTIAL_PLC", _PARENT, "GLOBAL", "PRUDENTIAL", ("prudential plc", "prudential group plc", "lse: pru", "hkex: 2378"), ("prudential",)),
    ("PRUDENTIAL_FINANCIAL_US", _OTHER, "US", "PRUDENTIAL_US", ("prudential financial", "prudential financial, inc", "pgim", "nyse: pru", "nyse:pru", "newark, new jersey"), ()),
    ("MANULIFE_VN", _LOCAL, "VN", "MANULIFE", ("manulife việt nam", "manulife vietnam"), ("manulife",)),
    ("MANULIFE_GROUP", _PARENT, "GLOBAL", "MANULIFE", ("manulife financial corporation", "tsx: mfc"), ("manulife",)),
    ("AIA_VN", _LOCAL, "VN", "AIA", ("aia việt nam", "aia vietnam"), ("aia",)),
    ("AIA_GROUP", _PARENT, "GLOBAL", "AIA", ("aia group", "aia group limited", "hkex: 1299"), ("aia",)),
    ("DAIICHI_VN", _LOCAL, "VN", "DAIICHI", ("dai-ichi life việt nam", "dai-ichi life vietnam", "công ty tnhh bảo hiểm nhân thọ dai-ichi việt nam"), ("dai-ichi", "daiichi")),
    ("DAIICHI_GROUP", _PARENT, "GLOBAL", "DAIICHI", ("dai-ichi life holdings", "dai-ichi life group"), ("dai-ichi", "daiichi")),
    ("CHUBB_VN", _LOCAL, "VN", "CHUBB", ("chubb life việt nam", "chubb life vietnam", "chubb life insurance vietnam company limited", "công ty tnhh bảo hiểm nhân thọ chubb việt nam"), ("chubb life", "chubb")),
    ("CHUBB_GROUP", _PARENT, "GLOBAL", "CHUBB", ("chubb limited", "nyse: cb"), ("chubb life", "chubb")),
    ("HANWHA_VN", _LOCAL, "VN", "HANWHA", ("hanwha life việt nam", "hanwha life vietnam", "công ty tnhh bảo hiểm hanwha life việt nam", "korea life insurance vietnam"), ("hanwha life", "hanwha")),
    ("HANWHA_GROUP", _PARENT, "KR", "HANWHA", ("hanwha life insurance co., ltd.", "hanwha life insurance korea", "krx: 088350"), ("hanwha life", "hanwha")),
    ("FWD_VN", _LOCAL, "VN", "FWD", ("fwd việt nam", "fwd vietnam", "công ty tnhh bảo hiểm nhân thọ fwd việt nam"), ("fwd",)),
    ("FWD_GROUP", _PARENT, "GLOBAL", "FWD", ("fwd group holdings", "fwd group limited", "hkex: 1828"), ("fwd",)),
    ("GENERALI_VN", _LOCAL, "VN", "GENERALI", ("generali việt nam", "generali vietnam", "công ty tnhh bảo hiểm nhân thọ generali việt nam"), ("generali",)),
    ("GENERALI_GROUP", _PARENT, "GLOBAL", "GENERALI", ("assicurazioni generali", "generali group", "borsa italiana: g"), ("generali",)),
    ("SUNLIFE_VN", _LOCAL, "VN", "SUNLIFE", ("sun life việt nam", "sun life vietnam", "công ty tnhh bảo hiểm nhân thọ sun life việt nam"), ("sun life", "sunlife")),
    ("SUNLIFE_GROUP", _PARENT, "GLOBAL", "SUNLIFE", ("sun life financial", "tsx: slf", "nyse: slf"), ("sun life", "sunlife")),
    ("BAOVIET_LIFE_VN", _LOCAL, "VN", "BAOVIET_LIFE", ("bảo việt nhân thọ", "bao viet life", "baoviet life"), ()),
    ("BAOVIET_GENERAL_VN", _OTHER, "VN", "BAOVIET_GENERAL", ("bảo hiểm bảo việt", "baoviet insurance", "bảo việt phi nhân thọ"), ()),
    ("MB_AGEAS_VN", _LOCAL, "VN", "MB_AGEAS", ("mb ageas life", "mb ageas", "mb life", "mbal", "công ty tnhh bảo hiểm nhân thọ mb ageas"), ()),
    ("BIDV_METLIFE_VN", _LOCAL, "VN", "METLIFE", ("bidv metlife", "bidv-metlife", "công ty tnhh bảo hiểm nhân thọ bidv metlife"), ()),
    ("METLIFE_US", _PARENT, "US", "METLIFE_US", ("metlife, inc", "metlife inc", "nyse: met"), ()),
    ("TECHCOM_LIFE_VN", _LOCAL, "VN", "TECHCOM_LIFE", ("techcom life", "công ty cổ phần bảo hiểm nhân thọ kỹ thương"), ()),
    ("MVI_LIFE_VN", _LOCAL, "VN", "MVI_LIFE", ("mvi life", "công ty tnhh bảo hiểm nhân thọ mvi"), ()),
    ("CATHAY_VN", _LOCAL, "VN", "CATHAY", ("cathay life việt nam", "cathay life vietnam", "công ty tnhh bảo hiểm nhân thọ cathay việt nam"), ("cathay life", "cathay")),
    ("CATHAY_LIFE_TW", _PARENT, "TW", "CATHAY", ("cathay life insurance co., ltd.", "cathay life taiwan"), ("cathay life", "cathay")),
    ("CATHAY_FINANCIAL_GROUP", _PARENT, "GLOBAL", "CATHAY_FINANCIAL", ("cathay financial holding", "cathay financial holdings", "twse: 2882"), ()),
    ("SHINHAN_VN", _LOCAL, "VN", "SHINHAN", ("shinhan life việt nam", "shinhan life vietnam", "công ty tnhh bảo hiểm nhân thọ shinhan life việt nam"), ("shinhan life",)),
    ("SHINHAN_GROUP", _PARENT, "KR", "SHINHAN", ("shinhan life insurance co., ltd.", "shinhan life korea"), ("shinhan life",)),
    ("PHUHUNG_VN", _LOCAL, "VN", "PHUHUNG", ("phú hưng life", "phu hung life", "công ty cổ phần bảo hiểm nhân thọ phú hưng"), ()),
    ("FUBON_VN", _LOCAL, "VN", "FUBON", ("fubon life việt nam", "fubon life vietnam", "fubon life insurance (vietnam) co., ltd.", "công ty tnhh bảo hiểm nhân thọ fubon việt nam"), ("fubon life", "fubon")),
    ("FUBON_LIFE_TW", _PARENT, "TW", "FUBON", ("fubon life insurance co., ltd.", "fubon life taiwan"), ("fubon life", "fubon")),
    ("FUBON_FINANCIAL_GROUP", _PARENT, "GLOBAL", "FUBON_FINANCIAL", ("fubon financial holding", "fubon financial holdings", "twse: 2881"), ()),
    ("MAP_LIFE_VN", _LOCAL, "VN", "MAP_LIFE", ("map life", "mirae asset prévoir life", "mirae asset prevoir life", "công ty tnhh bảo hiểm nhân thọ mirae asset prévoir"), ()),
    ("MIRAE_ASSET_LIFE_KR", _PARENT, "KR", "MIRAE_ASSET_LIFE", ("mirae asset life insurance", "mirae asset life korea"), ()),
    ("PREVOIR_GROUP_FR", _PARENT, "FR", "PREVOIR", ("prévoir group", "prevoir group", "groupe prévoir", "groupe prevoir"), ()),
    ("LP_LIFE_VN", _LOCAL, "VN", "LP_LIFE", ("lp life", "công ty cổ phần bảo hiểm nhân thọ lp"), ()),
    ("MOF_INSURANCE_VN", _REGULATOR, "VN", "MOF_VN", ("bộ tài chính", "ministry of finance of vietnam", "cục quản lý, giám sát bảo hiểm", "cục quản lý giám sát bảo hiểm", "insurance supervisory authority of vietnam"), ()),
    ("SBV_VN", _REGULATOR, "VN", "SBV_VN", ("ngân hàng nhà nước việt nam", "state bank of vietnam"), ()),
    ("NSO_VN", _REGULATOR, "VN", "NSO_VN", ("cục thống kê", "national statistics office of vietnam", "general statistics office of vietnam"), ()),
    ("IAV_VN", "OTHER", "VN", "IAV_VN", ("hiệp hội bảo hiểm việt nam", "insurance association of vietnam"), ()),
)
# Competitors with the aliases that name them, and who is easily taken for one of them, by what marks.
COMPETITORS = (
    ("Prudential Việt Nam", ("prudential việt nam", "prudential vietnam")),
    ("Manulife Việt Nam", ("manulife việt nam", "manulife vietnam")),
    ("AIA Việt Nam", ("aia việt nam", "aia vietnam")),
    ("Dai-ichi Life Việt Nam", ("dai-ichi life việt nam", "dai-ichi life vietnam")),
    ("Chubb Life Việt Nam", ("chubb life việt nam", "chubb life vietnam")),
    ("Hanwha Life Việt Nam", ("hanwha life việt nam", "hanwha life vietnam")),
    ("FWD Việt Nam", ("fwd việt nam", "fwd vietnam")),
    ("Generali Việt Nam", ("generali việt nam", "generali vietnam")),
    ("Sun Life Việt Nam", ("sun life việt nam", "sun life vietnam")),
    ("Bảo Việt Nhân thọ", ("bảo việt nhân thọ", "bao viet life", "baoviet life")),
    ("MB Life", ("mb ageas", "mb life", "mbal")),
    ("BIDV MetLife", ("bidv metlife", "bidv-metlife")),
    ("Techcom Life", ("techcom life",)),
    ("MVI Life", ("mvi life",)),
    ("Fubon Life Việt Nam", ("fubon life việt nam", "fubon life vietnam")),
    ("MAP Life", ("map life", "mirae asset prévoir life", "mirae asset prevoir life")),
    ("Cathay Life Việt Nam", ("cathay life việt nam", "cathay life vietnam")),
    ("Shinhan Life Việt Nam", ("shinhan life việt nam", "shinhan life vietnam")),
    ("Phú Hưng Life", ("phú hưng life", "phu hung life")),
    ("LP Life", ("lp life",)),
)
CONFUSABLES = (
    ("Prudential Việt Nam", "Prudential Financial (Hoa Kỳ)", ("prudential financial", "pgim", "nyse: pru", "nyse:pru", "newark, new jersey")),
    ("Bảo Việt Nhân thọ", "Bảo hiểm Bảo Việt (phi nhân thọ)", ("bảo hiểm bảo việt", "baoviet insurance", "bảo việt phi nhân thọ")),
    ("BIDV MetLife", "MetLife, Inc. (Hoa Kỳ)", ("metlife, inc", "metlife inc", "nyse: met")),
)
#: Brands that are easily taken for one another count as one.
BRAND_FAMILIES = ("PRUDENTIAL", "BAOVIET", "METLIFE")
#: Markets that are no country and never narrow a shared brand.
WIDE_MARKETS = ("GLOBAL", "REGIONAL", "MULTI", "MULTI_MARKET", "UNKNOWN")


def family(brand: str) -> str:
    return next((f for f in BRAND_FAMILIES if brand.startswith(f)), brand)


def alternatives(terms) -> str:
    """The terms as one pattern, special signs escaped."""
    return "|".join(re.sub(r"([.+*?^$()\[\]{}|\\])", r"\\\1", term) for term in terms)


def word_pattern(terms) -> str:
    """A pattern that finds a term between characters that are no letters or digits."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{alternatives(terms)})(?![\p{{L}}\p{{N}}])"


def word_sql(text: str, terms) -> str:
    """The same test in SQL, whose patterns know no look-around."""
    quoted = alternatives(terms).replace("'", "''")
    return f"regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}])({quoted})($|[^\\p{{L}}\\p{{N}}])')"
