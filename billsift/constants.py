"""Values that decide results. Change one and the output changes."""

# ---- Fixed values: field patterns -------------------------------------------
AMOUNT = r"\d{1,3}(?:,\d{3})*\.\d{2}"
GSTIN = r"\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]"
DATE = r"\d{2}[/-]\d{2}[/-]\d{4}"
PAN = r"[A-Z]{5}[0-9]{4}[A-Z]"
IFSC = r"[A-Z]{4}0[A-Z0-9]{6}"
ACCOUNT = r"\b\d{9,18}\b"
PERCENT = r"(\d+)%"
VALID_CHARACTER = r"[a-zA-Z0-9\s.,%$-]"
PAGE_FILE = r"^page(\d+)_"

# ---- Fixed values: keywords and labels --------------------------------------
INVOICE_TYPE_KEYS = ("TAX INVOICE",)
VENDOR_KEYWORDS = ("PVT", "LTD", "PRIVATE")
VENDOR_KEYWORDS_B = ("PVT", "LTD")
BUYER_ANCHORS = ("invoice to", "bill to")
BUYER_ANCHORS_B = ("invoice to",)

# ---- Fixed values: text handling --------------------------------------------
CURRENCY_MARKS = ("₹", "Rs.", "Rs", "â‚¹")
CURRENCY_PREFIX = "INR "
FORMULA_STARTS = ("=", "+", "-", "@")
SHORT_TEXT_CHARS = 50
MAX_FILE_BYTES = 20 * 1024 * 1024
DECRYPTION_FAILED = "[DECRYPTION_FAILED]"
RECORD_STAMP = "dd-MM-yyyy HH:mm"
STORE_STAMP = "yyyy-MM-dd HH:mm"

# ---- Fixed values: column width profile -------------------------------------
WIDTH_PADDING = 2
WIDTH_CAP = 60
WIDTH_COLUMNS = 26

# ---- Fixed values: text-recognition parameter grids -------------------------
GRID_DPI = (200, 300, 400)
GRID_TEXTLINE = (True, False)
GRID_DETECTION = (0.3, 0.5, 0.7)
GRID_BOX = (0.3, 0.5, 0.7)
GRID_FILTERS = (
    "original",
    "grayscale",
    "adaptive_threshold",
    "gaussian_blur",
    "bilateral_filter",
    "clahe",
    "median_blur",
    "sharpen",
)
ENGINE_SETTINGS = (
    "--oem 1 --psm 3",
    "--oem 1 --psm 4",
    "--oem 1 --psm 6",
    "--oem 1 --psm 11",
    "--oem 1 --psm 12",
    "--oem 3 --psm 3",
    "--oem 3 --psm 4",
    "--oem 3 --psm 6",
    "--oem 3 --psm 11",
    "--oem 3 --psm 12",
    "--oem 1 --psm 6 -l eng+osd",
    "--oem 1 --psm 13",
    "--oem 1 --psm 6 -c tessedit_char_whitelist=0123456789.,",
)

# ---- Our own values ---------------------------------------------------------
# Whole amounts: Indian or Western grouping, or no grouping at all.
# Possessive groups: Java reads others of unlike lengths by recursion.
STRICT_AMOUNT = r"(?<![\d,.])(?:\d{1,3}(?:,\d{2,3}+)++\.\d{2}|\d+\.\d{2})(?![\d.])"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# The same matches in linear time: a run is only tried from its start or from
# the end of the match before (``\G``), as a later start could only fail too.
PERCENT_ONCE = r"(?:\G|(?<!\d))(\d++)%"
EMAIL_ONCE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
)
# Of a run of digits only its start or its last three can begin the leftmost
# match, and no group of three after a comma, as the group before it would. The
# look at the first sign spares all others for most places.
AMOUNT_ONCE = (
    r"(?=\d)(?:\G|(?<!\d)|(?=\d{3}(?!\d)))(?:(?<=\G,)|(?!(?<=\d,)\d{3}(?!\d)))" + AMOUNT
)

# Every character for which Python's ``str.isspace`` holds.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A line from its first sign that is no blank to its last: one try a line, and what is given back is blank.
_BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE = rf"[^{_BLANKS}](?:[^\n]*[^{_BLANKS}])?+"


def java_regex(pattern: str, flags: str = "dU") -> str:
    """The Java form of a Python pattern.

    ``d`` keeps ``.`` and ``$`` to ``\\n`` only, ``U`` widens ``\\d``, ``\\s``
    and ``\\b`` to Unicode, ``iu`` ignores case, and Python counts
    ``\\x1c``-``\\x1f`` as blanks.
    """
    return f"(?{flags})" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")
