"""They define the results and must not be changed on their own."""

# Whitespace and digits as Unicode defines them; valid in Java and RE2 patterns.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
WS_CHARS = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
DIGIT = (
    r"[\p{Nd}\x{B2}-\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)

# Document kinds that can be parsed, with their MIME types.
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".bmp": "image/bmp",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".heic": "image/heic",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".hwp": "application/vnd.hancom.hwp",
    ".hwpx": "application/vnd.hancom.hwpx",
}
DEFAULT_MIME = "application/octet-stream"
MAX_FILE_BYTES = 50 * 1024 * 1024

# Element classification.
FOOTNOTE_PREFIXES = ("| 주:", "| 자료:", "주:", "자료:", "|주:", "|자료:")
AXIS_HINTS = ("조원", "천조", "(%)", "(pp)", "/4")
CHART_BR_COUNT = 3
MIN_DIGIT_SHARE = 0.01
PROSE_LENGTH = 50

# Spans as HTML limits them, and how many positions of one table its spans and its padding may fill.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
MAX_POSITIONS = 1 << 21

# Captions and names.
CAPTION_PREFIX = rf"^[<\[]?{WS}*(그림|표|차트|Figure|Table|Fig\.?){WS}*[^>\]]*[>\]]?{WS}*"
CAPTION_LOOKBACK = 9
HEADING_LENGTH = 50
SLUG_BANNED = r"[^0-9A-Za-z가-힣\- ]+"
SLUG_LENGTH = 40
UNTITLED = "untitled"

# Reports.
NO_TITLE = "(제목 없음)"
DASH = "—"
ELLIPSIS = "…"
DESCRIPTION_LENGTH = 80
TOP_TABLES, TOP_CHARTS, TOP_FIGURES = 10, 10, 5
TOP_CAPTION_LENGTH = 40
TABLE_FAILED = "table HTML parse failed: "
CHART_FAILED = "chart parse failed: "
CHART_LIKE = "chart-like table"
PARSE_ERROR = "ValueError"
PARSE_MESSAGE = "No tables found"
DEFAULT_MODEL = "document-parse"

# Paging, cost, checks.
CHUNK_PAGES = 100
PAGE_RATES = {"enhanced": 0.03, "standard": 0.01}
SECRET_RULES = ((r"up_[A-Za-z0-9]{10,}", "up_***REDACTED***"),)
MESSAGE_LENGTH = 500
SEARCH_LISTED = 10
RECENT_LISTED = 3
GOLDEN_TOLERANCE = 0.05
ZERO_TOLERANCE = 1e-9
HANGUL = "[가-힣]"
BROKEN_CHAR = "\ufffd"
MIN_HANGUL = 10000
VOLUME_THRESHOLDS = {
    "elements": 1000,
    "raw_tables": 20,
    "raw_charts": 130,
    "assets": 150,
    "charts": 30,
}
