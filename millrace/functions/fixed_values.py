"""Constants that decide results and therefore have to be exactly these."""

# Date formats in the order they are tried, with the matching Spark pattern.
# Day-first formats precede month-first ones, so ambiguous columns are read as European.
DATE_FORMATS = [
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%Y/%m/%d", "yyyy/M/d"),
    ("%Y%m%d", "yyyyMMdd"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%d-%m-%Y", "d-M-yyyy"),
    ("%d.%m.%Y", "d.M.yyyy"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%m-%d-%Y", "M-d-yyyy"),
    ("%m.%d.%Y", "M.d.yyyy"),
    ("%d-%b-%Y", "d-MMM-yyyy"),
    ("%b %d %Y", "MMM d yyyy"),
    ("%b %d, %Y", "MMM d, yyyy"),
    ("%d %b %Y", "d MMM yyyy"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"),
    ("%d/%m/%Y %H:%M", "d/M/yyyy H:m"),
    ("%m/%d/%Y %H:%M", "M/d/yyyy H:m"),
]
DATE_THRESHOLD = 0.9

# Plausible Unix time stamps (2000-01-01 to 2050-01-01), seconds; milliseconds are 1000 times that.
UNIX_SECONDS_RANGE = (946684800, 2524608000)
UNIX_MILLIS_ABOVE = 9999999999

# Mixed-type coercion.
NUMBER_DECORATION = ",$%€£¥"
NULL_TOKENS = ["N/A", "NA", "-", "", "Unknown", "None"]
COERCE_THRESHOLD = 0.8

# Characters removed from headers, at the ends (byte-order marks) and anywhere (zero width).
HEADER_ENDS = "\ufeff\ufffe"
HEADER_INVISIBLE = ["\u200b", "\u200c", "\u200d", "\u2060", "\ufeff"]

# Column-name hints, first hit wins.
DOMAIN_HINTS = [
    ("age", ["age", "year", "born"]),
    ("price", ["price", "cost", "amount", "salary", "revenue"]),
    ("temporal", ["date", "time", "timestamp"]),
    ("identifier", ["id", "key", "uuid"]),
    ("text", ["name", "title", "description"]),
]

# Profile and recipe thresholds.
PROFILE_SAMPLE = 100_000
TUKEY = 1.5
SKEW_LIMIT = 1.0
HIGH_CARDINALITY = 0.5
TARGET_DISTINCT = 50
HIGH_MISSING_PCT = 50
DROP_ABOVE_NULL_PCT = 90.0
TOP_VALUES = 5

# Split defaults.
SPLIT_SEED = 42
SPLIT_RATIOS = (0.8, 0.2, 0.0)
SPLIT_TOLERANCE = 0.01

# Licences in the order they are tried: identifier, patterns, keywords, commercial use allowed.
# Text is matched with "-" and "_" replaced by blanks, so patterns holding a literal "-" never match.
LICENSES = [
    (
        "CC0-1.0",
        [r"CC0\s+1\.0", r"Creative\s+Commons\s+Zero", r"Public\s+Domain\s+Dedication", r"CC0"],
        ["cc0", "public domain", "no rights reserved"],
        True,
    ),
    ("MIT", [r"MIT\s+License", r"Permission\s+is\s+hereby\s+granted.*MIT"], ["mit license", "mit"], True),
    (
        "Apache-2.0",
        [r"Apache\s+License\s+2\.0", r"Apache\s+License,?\s+Version\s+2\.0"],
        ["apache 2.0", "apache license"],
        True,
    ),
    ("BSD-3-Clause", [r"BSD\s+3-Clause", r"BSD\s+License"], ["bsd", "berkeley software distribution"], True),
    (
        "CC-BY-4.0",
        [r"CC\s+BY\s+4\.0", r"Creative\s+Commons\s+Attribution\s+4\.0"],
        ["cc by", "attribution"],
        True,
    ),
    (
        "CC-BY-SA-4.0",
        [r"CC\s+BY-SA\s+4\.0", r"Creative\s+Commons\s+Attribution-ShareAlike"],
        ["cc by-sa", "share alike"],
        True,
    ),
    (
        "CC-BY-NC-4.0",
        [r"CC\s+BY-NC\s+4\.0", r"Creative\s+Commons\s+Attribution-NonCommercial"],
        ["cc by-nc", "non-commercial", "noncommercial"],
        False,
    ),
    (
        "GPL-3.0",
        [r"GNU\s+General\s+Public\s+License\s+v?3", r"GPL-3\.0", r"GPLv3"],
        ["gpl", "gnu general public license"],
        True,
    ),
    ("ODbL-1.0", [r"Open\s+Database\s+License", r"ODbL"], ["odbl", "open database"], True),
]
LICENSE_JSON_KEYS = ["license", "license_type", "license_name", "licence"]
PATTERN_CONFIDENCE = 0.9
KEYWORD_CONFIDENCE = 0.6
MENTION_CONFIDENCE = 0.3
UNKNOWN_CONFIDENCE = 0.1

# Compliance score weights and formats.
SCORE_WEIGHTS = {"license": 0.4, "downloadable": 0.3, "metadata": 0.2, "format": 0.1}
FORMAT_SCORES = [
    (1.0, ["csv", "parquet", "json", "jsonl", "arrow"]),
    (0.7, ["xlsx", "tsv", "txt"]),
    (0.5, ["zip", "tar", "gz"]),
]

# Catalogue search.
ID_BLACKLIST = ["cwe", "cve", "sast", "security", "benchmark", "vulnerability"]
SOURCE_TYPES = ["huggingface", "kaggle", "web_scrape"]
DATASET_PAGE = {
    "huggingface": "https://huggingface.co/datasets/",
    "kaggle": "https://www.kaggle.com/datasets/",
}
DEFAULT_EXTENSION = {"huggingface": "parquet", "kaggle": "csv", "web_scrape": "unknown"}
WEB_SCORE = 0.2
LAST_RESORT_BELOW = 3

# URL classification.
TRUSTED_DOMAINS = [
    "github.com", "raw.githubusercontent.com", "zenodo.org", "data.gov", "data.world", "figshare.com",
    "archive.ics.uci.edu", "kaggle.com", "huggingface.co", "datasets.huggingface.co", "drive.google.com",
    "dropbox.com", "s3.amazonaws.com", "storage.googleapis.com", "dataverse.harvard.edu", "openml.org",
    "datadryad.org",
]
DATASET_SUFFIXES = [
    ".csv", ".json", ".jsonl", ".parquet", ".tsv", ".txt", ".xlsx", ".xls", ".xml", ".sql", ".db", ".sqlite", ".h5",
    ".hdf5", ".feather", ".arrow", ".zip", ".tar.gz", ".pkl", ".pickle", ".npy", ".npz",
]
JUNK_PATTERNS = [
    r"blog", r"news", r"article", r"tutorial", r"medium\.com", r"towardsdatascience\.com", r"reddit\.com",
    r"stackoverflow\.com", r"youtube\.com", r"twitter\.com", r"linkedin\.com", r"facebook\.com",
]
PATH_KEYWORDS = ["dataset", "data", "download", "file", "csv", "json"]

# Links on pages.
PAGE_LINK_MARKS = [".csv", ".json", ".zip", ".parquet", "download"]
BROWSER_LINK_MARKS = [".csv", ".json", ".parquet", ".zip", ".xls", "download", "raw"]
LINK_PRIORITY = [".parquet", ".csv", ".json", ".jsonl", ".zip"]
LINK_TOP = 3
VALID_PAGE_CHARS = 100
BAD_TITLES = ["error", "404", "not found"]
METADATA_FORMATS = [".csv", ".json", ".parquet", ".zip", ".xlsx"]
METADATA_LICENSES = ["MIT", "Apache", "CC-BY", "CC0", "GPL", "BSD"]
DATA_LINK_PATTERN = r"\.(csv|json|zip|parquet)"
FILE_SIZE_PATTERN = r"(\d+\.?\d*)\s*(MB|KB|GB)"

# File checks.
SIZE_TOLERANCE = 0.95
MAX_ZIP_RATIO = 100
MAX_UNZIPPED_GB = 5
MAX_FILE_MB = 500
PARQUET_MAGIC = b"PAR1"
OLE_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
DATA_SUFFIXES = ["csv", "parquet", "xlsx", "xls", "json", "jsonl"]

# Failure monitor.
FAILURE_THRESHOLD = 0.3
FAILURE_WINDOW = 10
OPEN_SECONDS = 60
HALF_OPEN_PROBES = 3
