"""Job parameters and the fixed values the results depend on.

Everything time-dependent takes ``as_of`` (epoch microseconds) as a parameter;
nothing reads the wall clock.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (they must equal the reference's for equal results).
# ---------------------------------------------------------------------------
MAX_NUM_RESULTS = 200
DEFAULT_NUM_RESULTS = 15          # research call, and any unparsable value
DEFAULT_SEARCH_NUM_RESULTS = 20   # search-only call when the value is absent
MIN_CONTENT_LENGTH = 500
MAX_CONTENT_LENGTH = 500000
DEFAULT_MAX_CONTENT_LENGTH = 20000
VALID_TIME_RANGES = ("", "d", "w", "m", "y")
TIME_RANGE_UNITS = {"d": "DAY", "w": "WEEK", "m": "MONTH", "y": "YEAR"}
QUERY_ERROR = "query must be a non-empty string"
URL_ERROR = "url must be a non-empty string"
TIME_RANGE_ERROR = "time_range must be one of: '', 'd', 'w', 'm', 'y'"

RESULTS_PER_PAGE = 20
MAX_PAGES = 10
SOURCE_B_MAX = 100
SOURCE_B_ENGINES = ("duckduckgo",)   # engines label given to every source B row

TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "ref_src")

FETCH_MIN_CONTENT = 200
FETCH_RETRIES = 2
RETRY_BACKOFF_S = 1.5
POLITE_INTERVAL_S = 0.5

SEARCH_TTL_S = 600
FETCH_TTL_S = 21600
MAX_MEMO_ENTRIES = 20000

BREAKER_THRESHOLD = 3
BREAKER_COOLDOWN_S = 30.0

# Text extraction: regions removed with their text, and entities decoded
# (``&amp;`` last so that ``&amp;lt;`` stays ``&lt;``).
STRIPPED_TAGS = ("script", "style", "nav", "footer", "header", "aside", "form")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
            ("&apos;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
            ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"), ("&euro;", "€"),
            ("&pound;", "£"), ("&deg;", "°"), ("&reg;", "®"), ("&trade;", "™"), ("&times;", "×"), ("&szlig;", "ß"),
            ("&agrave;", "à"), ("&aacute;", "á"), ("&acirc;", "â"), ("&auml;", "ä"), ("&ccedil;", "ç"), ("&egrave;", "è"),
            ("&eacute;", "é"), ("&ecirc;", "ê"), ("&iacute;", "í"), ("&ntilde;", "ñ"), ("&oacute;", "ó"), ("&ocirc;", "ô"),
            ("&ouml;", "ö"), ("&uacute;", "ú"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Eacute;", "É"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"))
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr",
              "table", "article", "section", "blockquote", "pre", "title", "body", "html")

# Where a title is read, and the marks that text mode drops at a line's start.
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
MD_MARKS_RE = r"(?m)^[#>*_`~\-]{1,6}"

# Python's str.isspace() set; Spark's trim() only removes spaces.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")

# urllib's list of schemes that carry a network location.
USES_NETLOC = ("ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https",
               "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh",
               "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services")


@dataclass(frozen=True)
class FusionParams:
    """Source priority (order breaks ties inside a rank) and the caller's bound on any query's n."""

    sources: tuple[str, ...] = ("a", "b")
    max_results: int = MAX_NUM_RESULTS

    def priority_pairs(self) -> list[tuple[str, int]]:
        return [(s, i) for i, s in enumerate(self.sources)]


@dataclass(frozen=True)
class PagingParams:
    """Which recorded pages take part: by default all.  ``DOWNLOAD_LIMITS`` are those of a live call."""

    per_page: int = RESULTS_PER_PAGE
    max_pages: int | None = None      # pages 1 .. min(max_pages, ceil(n / per_page)), ending at the first empty batch
    source_b_max: int | None = None


DOWNLOAD_LIMITS = PagingParams(RESULTS_PER_PAGE, MAX_PAGES, SOURCE_B_MAX)


@dataclass(frozen=True)
class BreakerParams:
    threshold: int = BREAKER_THRESHOLD
    cooldown_s: float = BREAKER_COOLDOWN_S

