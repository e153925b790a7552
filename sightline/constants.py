"""Their content is part of the result contract, not a design choice."""

from __future__ import annotations

# Traditional -> simplified characters, one pair per word.
SCRIPT_PAIRS = """
啟启 區区 樓楼 層层 實实 廳厅 開开 盤盘 價价 呎呎 號号 廈厦 龍龙 譽誉 灣湾 維维 港港 壹一 玺玺 璽玺
滙汇 匯汇 峯峰 臺台 台台 麗丽 園园 單单 間间 營营 堅坚 環环 鐘钟 門门 黃黄 銅铜 鑼锣 鰂鲗 魚鱼 鴨鸭
淺浅 數数 碼码 紅红 樂乐 橫横 鑽钻 崗岗 雲云 觀观 頭头 鯉鲤 將将 軍军 寶宝 調调 嶺岭 圍围 錦锦 橋桥
東东 馬马 藍蓝 貢贡 窩窝 長长 島岛 嶼屿 鷄鸡 雞鸡 掃扫 鴉鸦 烏乌 瀝沥 華华 濱滨 豐丰 慶庆 筆笔 莊庄
學学 灘滩 顯显 徑径 頂顶 當当 勞劳 蠔蚝 鄉乡 藪薮 駿骏 欖榄 蘭兰 壩坝 廟庙 鶴鹤 蓮莲 窰窑 舊旧 硤硖
繡绣 櫃柜 壽寿 貝贝 瑤瑶 奧奥 運运 麥麦 鳳凤 荔荔 葵葵 罕罕
""".split()
TRAD = "".join(p[0] for p in SCRIPT_PAIRS)
SIMP = "".join(p[1] for p in SCRIPT_PAIRS)

# The way back: the last traditional form of each simplified one; these three stay as they are.
_KEEP = "一玺台"
_BACK = {s: t for t, s in SCRIPT_PAIRS if s != t and s not in _KEEP}
BACK_FROM = "".join(_BACK)
BACK_TO = "".join(_BACK.values())

# Characters dropped from comparison keys.
PUNCTUATION = "·．.。,:：;；|｜/\\-_()（）[]【】#"

# Separators of a term list.
TERM_SEPARATORS = ",，+＋/、\n"

# Numerals.
CHINESE_DIGITS = {
    "零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "贰": 2, "貳": 2, "两": 2, "兩": 2, "三": 3, "叁": 3, "參": 3,
    "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "陸": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9,
}
ENGLISH_DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]

# Words and phrases of layout text.
STUDIO = "开放式"
ROOM = "房"
STUDIO_WORDS = ["开放式", "開放式", "studio", "open plan", "open-plan"]
CHINESE_ROOM_DIGITS = "零〇一二两兩三四五六七八九十壹贰貳叁參肆伍陆陸柒捌玖"
ROOM_WORDS_CN = "房|室|居室|居"

# Marketing tags in front of a card text.
MARKETING_TAGS = [
    "中原地产", "中原地產", "美联物业", "美聯物業", "香港置业", "香港置業", "利嘉阁", "利嘉閣",
    "AI装修", "AI裝修", "AI讲房", "AI講房", "装修及讲房", "裝修及講房", "独家", "獨家", "锁匙盘", "鎖匙盤",
    "VR", "bookmark", "靓装即住", "靚裝即住", "笋盘", "筍盤", "董事推介", "经理心水", "經理心水",
    "露台", "天台", "连租约", "連租約",
]

# Words that mark an anchor text as a listing.
LISTING_HINTS = ["租", "实用", "實用", "/呎", "@", "房", "开放式", "開放式"]

# Patterns of a card text, in order of preference.
RENT_PATTERNS = [
    r"租\s*\$?\s*([0-9][0-9,]*)",
    r"rent\s*\$?\s*([0-9][0-9,]*)",
    r"\$\s*([0-9][0-9,]*)\s*(?:實|实|@|租)",
]
AREA_PATTERNS = [
    r"(?:实用|實用)\s*(?:实|實)?\s*([0-9][0-9,]*)\s*呎",
    r"(?:实|實)\s*([0-9][0-9,]*)\s*呎",
    r"\b([0-9][0-9,]*)\s*呎\s*@",
]
PSF_PATTERNS = [
    r"@\s*\$?\s*([0-9][0-9,]*)\s*/?\s*呎",
    r"\$\s*([0-9][0-9,]*)\s*/\s*呎",
]
LAYOUT_PATTERNS = [
    r"(開放式|开放式)",
    r"([0-9一二两兩三四五六七八九十]\s*房\s*(?:\([0-9一二两兩三四五六七八九十]\s*套房\))?)",
    r"([0-9一二两兩三四五六七八九十]\s*房\s*[0-9一二两兩三四五六七八九十]?\s*(?:厅|廳))",
]
FLOOR_PATTERN = r"(高层|高層|中层|中層|低层|低層|顶层|頂層|地下|[0-9]{1,2}\s*(?:楼|樓))"
FLAT_PATTERN = r"([A-Z][0-9]?室|[0-9]{1,3}室|[A-Z]\d?\b)"
BLOCK_PATTERN = (
    r"([0-9A-Z一二三四五六七八九十]+(?:A|B|C|D)?座"
    r"|[0-9A-Z一二三四五六七八九十]+期\s*[0-9A-Z一二三四五六七八九十]+座"
    r"|大厦第[0-9A-Z一二三四五六七八九十]+座)"
)
ESTATE_STOPS = ["实用", "實用", "租 $", "租$", "租 "]
UNIT_PATTERN = (
    r"(.+?)(?:\s+[0-9A-Z一二三四五六七八九十]+(?:A|B|C|D)?座|\s+高层|\s+高層|\s+中层|\s+中層|\s+低层|\s+低層"
    r"|\s+[A-Z][0-9]?室|\s+[0-9]{1,3}室)"
)
ESTATE_PREFIX_PATTERN = r"^(?:主页|主頁|网上找房|網上搵樓)\s+"
BOOKMARK_SPLIT = r"\bbookmark\b|加入书签|加入書籤"
RENT_ANCHOR = r"(?:租\s*\$?\s*[0-9][0-9,]*)"
CONTEXT_CHARS = 260
TITLE_CHARS = 500
PROPERTY_KEYS = ["price", "rent", "saleprice", "grossarea", "saleablearea", "propertyname", "estate"]
DETAIL_URL_PARTS = ["/property/", "/detail/"]

# Source catalogue.
SITES = {
    "midland": {"name": "美联物业", "base": "https://www.midland.com.hk", "ids": [r"\b(M\d{6,})\b"]},
    "ricacorp": {
        "name": "利嘉阁",
        "base": "https://www.ricacorp.com",
        "ids": [r"\b(R[A-Z0-9]{5,})\b", r"\b([A-Z]{2,4}\d{3,})\b"],
    },
    "centanet": {
        "name": "中原地产",
        "base": "https://hk.centanet.com",
        "ids": [r"/detail/[^?_/]+_([A-Z]{2,}\d+)", r"\b([A-Z]{2,}\d{3,})\b"],
    },
    "hkp": {"name": "香港置业", "base": "https://www.hkp.com.hk", "ids": [r"\b(H\d{6,})\b"]},
}
STATE_DETAIL_URL = "https://www.ricacorp.com/zh-hk/property/detail/"

# Filters each source applies itself; all others are checked here.
NUMERIC_FILTERS = ["rent", "layout_bedrooms", "usable_area", "gross_area", "building_age", "price_per_sqft"]
TEXT_FILTERS = ["area_aliases", "allowed_estates", "required_keywords", "excluded_estates", "excluded_keywords"]
PUSHABLE = {
    "midland": ["rent", "layout_bedrooms", "usable_area", "gross_area", "price_per_sqft"],
    "hkp": ["rent", "layout_bedrooms", "usable_area", "gross_area", "price_per_sqft"],
    "ricacorp": [],
    "centanet": ["rent", "layout_bedrooms", "usable_area", "building_age", "price_per_sqft"],
}

# Report thresholds and labels.
VALUE_DISCOUNT_PCT = -5
DEEP_DISCOUNT_PCT = -10
STALE_DISCOUNT_PCT = -8
LOW_RENT_PERCENTILE = 0.35
STALE_MIN_AGE_DAYS = 14
WITHDRAWAL_DAYS = 30
WATCHLIST_ROWS = 25
ESTATE_ROWS = 15
BAND_TARGET = 5
RENT_TOLERANCE = 500
UNLABELLED = "未标明"
UNKNOWN_ESTATE = "(unknown)"
LAG_BUCKETS = ["0-7天", "8-14天", "15-30天", "30天以上", "未知"]
NOTE_NEW = "新增"
NOTE_DISCOUNT = "尺租低同户型均值 "
NOTE_BUDGET = "预算友好"
NOTE_CROSS = "跨来源确认"
NOTE_JUST = "刚出现"
NOTE_CONFIRM = "先确认仍可约看"
NOTE_JOIN = "、"

# Export columns.
LISTING_EXPORT = """canonical_id active first_seen_at first_delisted_at last_seen_at estate_name block floor flat
layout district last_rent_hkd usable_area_sqft last_price_per_sqft ever_rent_decreased first_rent_decrease_at
last_rent_decrease_at max_seen_rent_hkd min_seen_rent_hkd sources_count source_summary_json title""".split()
CHANGES_EXPORT = """canonical_id source_site source_listing_id source_url fetched_at estate_name block floor flat
layout rent_hkd usable_area_sqft price_per_sqft title""".split()
REPORT_LISTING_EXPORT = """canonical_id first_seen_at local_age_days estate_name block floor flat layout rent_hkd
usable_area_sqft price_per_sqft ever_rent_decreased first_rent_decrease_at last_rent_decrease_at max_seen_rent_hkd
min_seen_rent_hkd active_source_count psf_vs_layout_avg_pct action_note sample_source_site sample_source_url
title""".split()
MISSING_EXPORT = """first_missing_at source_site source_listing_id source_url canonical_id estate_name block floor
flat layout rent_hkd usable_area_sqft price_per_sqft ever_rent_decreased first_rent_decrease_at
last_rent_decrease_at max_seen_rent_hkd min_seen_rent_hkd active""".split()
CHANGE_EXPORT = """canonical_id estate_name block floor flat layout previous_rent_hkd rent_hkd rent_delta_hkd
rent_delta_pct local_age_days ever_rent_decreased first_rent_decrease_at last_rent_decrease_at max_seen_rent_hkd
min_seen_rent_hkd usable_area_sqft price_per_sqft sample_source_site sample_source_url title""".split()
BUDGET_EXPORT = """rent_band rent_lower rent_upper active_count active_delta_day new_count removed_count avg_rent
avg_psf""".split()
LAG_EXPORT = "lag_bucket source_missing_count share_pct avg_rent avg_psf".split()
