"""Word lists. They must stay as they are for the results to match."""

AXES = ("KR", "US", "GLOBAL")
ALL_AXIS = "ALL"
AXIS_SCOPES = (*AXES, ALL_AXIS)

SENTIMENTS = ("positive", "neutral", "negative", "mixed")
STATUSES = ("analyzed", "low_confidence", "unanalyzed")
CALL_OUTCOMES = ("parsed", "parse_failed", "call_failed", "reused")

LOW_CONFIDENCE = 0.6
MAX_CATEGORIES = 2
UNTITLED = "(제목 없음)"
BODY_UNAVAILABLE = "body_unavailable"
KEYWORD_ANALYZER = "keyword_analyzer"

CATEGORIES = (
    "통화정책·금리", "환율·외환", "물가", "경기·성장", "고용·노동", "주식시장", "채권·자금시장",
    "은행·금융업", "가상자산", "부동산·주택", "가계·소비", "재정·세금", "무역·통상", "반도체",
    "자동차·배터리", "AI·테크", "에너지·원자재", "산업·제조", "기업 경영·실적", "중소기업·자영업",
    "규제·금융당국", "지역경제", "농림·수산·식품", "지정학·국제정세", "기타",
)
OTHER_CATEGORY = "기타"

SUBJECTS = (
    "한국은행 기준금리", "삼성전자", "원/달러 환율", "코스피", "전기요금", "가계부채", "SK하이닉스",
    "부동산 PF", "Federal Reserve", "Nvidia", "US CPI", "S&P 500", "AI 반도체 capex", "원유 가격",
    "글로벌 공급망",
)

# Substring of a title -> subject, tried in this order.
TITLE_ALIASES = (
    ("samsung", "삼성전자"),
    ("삼성", "삼성전자"),
    ("fed", "Federal Reserve"),
    ("기준금리", "한국은행 기준금리"),
    ("환율", "원/달러 환율"),
)

# Canonical name -> the names that are folded onto it.
SPELLINGS = {
    "한국은행 기준금리": ("한국은행 기준금리", "기준금리"),
    "삼성전자": ("삼성전자", "samsung", "삼성"),
    "원/달러 환율": ("원/달러 환율", "환율"),
    "코스피": ("코스피",),
    "전기요금": ("전기요금",),
    "가계부채": ("가계부채",),
    "SK하이닉스": ("SK하이닉스",),
    "부동산 PF": ("부동산 PF",),
    "연준": (
        "Federal Reserve", "연준", "fed", "the fed", "미 연준", "미국 연준", "연방준비제도", "미국 연방준비제도",
    ),
    "엔비디아": ("Nvidia", "엔비디아"),
    "미국 소비자물가지수": ("US CPI", "미국 소비자물가지수", "미국 cpi", "미국 소비자물가"),
    "S&P 500": ("S&P 500",),
    "AI 반도체 설비투자": ("AI 반도체 capex", "AI 반도체 설비투자"),
    "원유 가격": ("원유 가격",),
    "글로벌 공급망": ("글로벌 공급망",),
    "세계은행": ("world bank", "세계은행그룹", "world bank group"),
    "국제통화기금": ("imf",),
    "국제금융공사": ("ifc",),
    "국제개발협회": ("ida",),
    "국제부흥개발은행": ("ibrd",),
    "다자간투자보증기구": ("miga",),
    "국제통화금융위원회": ("imfc",),
    "중동 전쟁": ("중동 전쟁",),
    "이란 전쟁": ("이란 전쟁",),
}

# A trailing Latin acronym in brackets, plain or full-width.
ACRONYM_GLOSS = r"\s*[(（]\s*[A-Za-z][A-Za-z0-9&.\- ]*\s*[)）]\s*$"

# Body markers the keyword labeller reads.
TONE_MARK = r"tone=(\w+)"
COUNTRY_MARK = r"대상국=([^.]+)"
