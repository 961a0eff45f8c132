"""Native URL column functions: path parsing, extension blacklist, spam filter, redirect decode.

All are Catalyst expressions (regex, string and binary functions), so they stay inside
whole-stage codegen and can be pushed below joins. ``parse_url`` is not used: it raises on
a space in the URL, and neither it nor ``try_parse_url`` drops ``;params`` from the last
path segment the way Python's ``urlparse`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ws import NON_WS

# Fixed values (must equal the reference's).
BLACKLISTED_EXTENSIONS = [".pdf", ".php", ".aspx", ".jsp", ".doc", ".docx", ".xlsx", ".jpg", ".jpeg", ".png"]
SPAM_MARKERS = ["livejasmin", "camgirl", "porn", "xvideos", "xnxx", "onlyfans", "zhihu.com"]
SEARCH_URL_PREFIX = "https://www.bing.com/search?q="
SEARCH_URL_SUFFIX = "&search=Submit+Query&form=QBLH&rdr=1&rdrig=01C9B2A878CF446E9A824FA0EDB1D7A3"
REDIRECT_HOST_MARK = "bing.com"
REDIRECT_PATH_PREFIX = "/ck/a"
REDIRECT_PARAM = "u"
REDIRECT_PAYLOAD_START = "aHR0c"
ALLOWED_STATUS = [301, 302, 307, 403, 404]

# RFC 3986 appendix B, with Python's rule for what counts as a scheme.
_SCHEME = "(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
_NETLOC_RE = f"^{_SCHEME}//([^/?#]*)"
_PATH_RE = f"^{_SCHEME}(?://[^/?#]*)?([^?#]*)"
_QUERY_RE = "^[^?#]*\\?([^#]*)"
# Schemes (empty included) whose last path segment can carry ``;params``, as Python's urllib has them.
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips",
                 "mms", "sftp", "tel"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_clean(url) -> Column:
    """What Python's URL splitter looks at: leading C0/space stripped, tabs and newlines removed."""
    return F.regexp_replace(F.regexp_replace(_c(url), "^[\\x00-\\x20]+", ""), "[\\t\\r\\n]", "")


def url_netloc(url) -> Column:
    return F.regexp_extract(url_clean(url), _NETLOC_RE, 1)


def url_path(url) -> Column:
    """Path as ``urlparse`` gives it: ``;params`` of the last segment removed."""
    u = url_clean(url)
    path = F.regexp_extract(u, _PATH_RE, 1)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme.isin(PARAM_SCHEMES), F.regexp_replace(path, ";[^/]*$", "")).otherwise(path)


def url_query(url) -> Column:
    return F.regexp_extract(url_clean(url), _QUERY_RE, 1)


def is_blacklisted_extension(url, extensions: list[str] = BLACKLISTED_EXTENSIONS) -> Column:
    """The lowercased URL path ends with one of the extensions."""
    alt = "|".join(e.replace(".", "\\.") for e in extensions)
    return F.lower(url_path(url)).rlike(f"(?:{alt})\\z")


def is_blacklisted_content_type(content_type) -> Column:
    """``application/pdf`` anywhere in the Content-Type header; NULL header = not listed."""
    return F.coalesce(_c(content_type), F.lit("")).contains("application/pdf")


def is_spam(url, markers: list[str] = SPAM_MARKERS) -> Column:
    """P5: any marker anywhere in the lowercased URL."""
    low = F.lower(_c(url))
    cond = F.lit(False)
    for m in markers:
        cond = cond | low.contains(m)
    return cond


def status_allowed(status, allowed: list[int] = ALLOWED_STATUS) -> Column:
    """2xx or one of the let-through statuses; NULL status (no column data) passes."""
    s = _c(status)
    return s.isNull() | s.between(200, 299) | s.isin(allowed)


def search_url(keyword, encode: bool = False) -> Column:
    """the result-page URL for a keyword; inserted raw, as the reference does, unless ``encode``."""
    k = F.url_encode(_c(keyword)) if encode else _c(keyword)
    return F.concat(F.lit(SEARCH_URL_PREFIX), k, F.lit(SEARCH_URL_SUFFIX))


def _first_param(query: Column, name: str) -> Column:
    """First non-blank value of ``name`` in a query string, as ``parse_qs(q)[name][0]``.

    Fields split on ``&``; a field without ``=`` or with an empty value is skipped; names and
    values are percent-decoded with ``+`` as space (a malformed escape stands for itself).
    """
    fields = F.split(query, "&")

    def dec(x):
        # a ``%`` without two hex digits stands for itself: escaped, so the rest still decodes
        return F.coalesce(F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")),
                          F.replace(x, F.lit("+"), F.lit(" ")))

    def value(f):
        return F.regexp_extract(f, "(?s)^[^=]*=(.*)$", 1)

    hits = F.filter(
        fields,
        lambda f: (F.instr(f, "=") > 0)
        & (dec(F.substring_index(f, "=", 1)) == F.lit(name))
        & (value(f) != ""),
    )
    return dec(value(F.get(hits, 0)))


def decode_redirect(url) -> Column:
    """unwrap a search-engine click redirect; anything that fails gives the URL back.

    Host contains ``bing.com`` and path starts ``/ck/a`` → first ``u`` value → first run of
    ``aHR0c`` + non-whitespace → padded on its raw length → URL-safe alphabet → stray
    characters dropped → base64 → strict UTF-8. Padding is checked as Python's decoder
    does: a data length ≡ 1 (mod 4) or too few ``=`` fails. A ``=`` before data characters is
    treated as a failure (Python may decode a prefix there).
    """
    u = _c(url)
    applies = url_netloc(u).contains(REDIRECT_HOST_MARK) & url_path(u).startswith(REDIRECT_PATH_PREFIX)
    value = _first_param(url_query(u), REDIRECT_PARAM)
    payload = F.regexp_extract(value, f"({REDIRECT_PAYLOAD_START}{NON_WS}*)", 1)
    pad = (F.lit(4) - F.length(payload) % 4) % 4
    padded = F.concat(payload, F.repeat(F.lit("="), pad))
    kept = F.regexp_replace(F.translate(padded, "-_", "+/"), "[^A-Za-z0-9+/=]", "")
    data = F.regexp_extract(kept, "^([A-Za-z0-9+/]*)", 1)
    n_pad = F.length(kept) - F.length(data)
    rem = F.length(data) % 4
    ok = (
        (F.length(payload) > 0)
        & kept.rlike("^[A-Za-z0-9+/]*=*$")
        & (rem != 1)
        & ((rem == 0) | (n_pad >= F.lit(4) - rem))
    )
    decoded = F.try_validate_utf8(F.try_to_binary(data, F.lit("base64")).cast("string"))
    return F.when(applies & ok & decoded.isNotNull(), decoded).otherwise(u)
