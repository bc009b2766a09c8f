"""Lists, texts and limits that decide the results."""

# Extensions read as plain text.
TEXT_EXTENSIONS = [
    ".txt", ".md", ".py", ".js", ".ts", ".jsx", ".tsx", ".css", ".html",
    ".htm", ".xml", ".json", ".yaml", ".yml", ".toml", ".cfg", ".conf",
    ".sh", ".bat", ".ps1", ".rb", ".go", ".java", ".c", ".cpp", ".h",
    ".hpp", ".cs", ".rs", ".php", ".sql", ".r", ".csv", ".tsv",
]

# Extensions read as images.
IMAGE_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".raw",
    ".psd", ".webp", ".heic", ".heif",
]

# Directory names a scan does not enter.
EXCLUDED_DIRS = [
    "$RECYCLE.BIN", "System Volume Information", "Windows", "Program Files",
    "Program Files (x86)", "ProgramData", "AppData", "Application Data",
    "Cookies", "Local Settings", "My Documents", "NetHood", "PrintHood",
    "Recent", "SendTo", "Start Menu", "Templates", "My Music", "My Pictures",
    "My Videos",
]

# Extensions a scan leaves out.
EXCLUDED_EXTENSIONS = [
    ".exe", ".msi", ".dll", ".sys", ".tmp", ".log", ".ini", ".lnk", ".url",
    ".db", ".cache",
]

# Texts a CSV cell may hold for "no value".
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Characters that count as white space (Unicode White_Space plus
# the four ASCII separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts written into result columns.
COMMENT_BASELINE = "Duplicate of baseline scan file "
COMMENT_KEPT_FROM = "Already kept from "
COMMENT_KEPT_TO = " → "
COMMENT_SAME_DRIVE = "Duplicate of "
COMMENT_SAME_DRIVE_END = " (same drive)"
COMMENT_MARKED = "Duplicate — already in kept_hashes registry"
COMMENT_EXCLUDED = "Excluded by config"
COMMENT_INACCESSIBLE = "INACCESSIBLE: "
COMMENT_CLOUD_STUB = "OneDrive cloud-only stub — file not downloaded locally"
COMMENT_NO_RESULT = "LLM did not return a result for this item"
COMMENT_BAD_REPLY = "LLM parse error — manual review needed"
SUMMARY_UNREADABLE = "UNREADABLE: "
SUMMARY_ERROR = "LLM_ERROR: "

# Limits.
SPARSE_PDF_CHARS_PER_PAGE = 100
SHEET_ROW_CAP = 20
DEFAULT_BATCH_SIZE = 50
DEFAULT_MAX_WORDS = 2000

# What the plain rating rules go by.
RULE_DOCUMENTS = [".docx", ".pdf", ".xlsx"]
RULE_IMAGES = [".jpg", ".png", ".psd", ".raw", ".tiff"]
RULE_PROGRAMS = [".exe", ".msi", ".dll", ".sys"]
RULE_SYSTEM_DIRS = ["Windows", "Program Files", "AppData"]
RULE_USER_DIRS = ["users", "home"]
RULE_SMALL_BYTES = 1024

# Patterns of the code fences around a reply, case ignored.
FENCE_OPEN = r"^```(?:json)?\s*"
FENCE_CLOSE = r"\s*```$"
