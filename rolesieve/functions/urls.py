"""Canonical posting URLs: the same page gives the same text whatever tracking it carries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .text import bind, strip

# Query keys that only track the click (fixed values, case matters).
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "refId", "trackingId", "trk", "trkInfo",
    "originalSubdomain", "original_referer",
)

# The scheme of any text that has one (RFC 3986 appendix B with a strict scheme).
SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"

# Schemes whose last path segment may hold ';parameters' / that take an authority (fixed values).
PARAMETER_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips", "mms",
    "sftp", "tel",
)
AUTHORITY_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
    "snews", "prospero", "rtsp", "rtsps", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh",
    "ws", "wss", "itms-services",
)


def _decode(c: Column) -> Column:
    """Form decoding; a '%' that starts no escape stays as it is."""
    decoded = F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(c.contains("%") | c.contains("+"), decoded).otherwise(c)


def _encode(c: Column) -> Column:
    """Form encoding with '~' left alone and '*' escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


# A query that decoding and encoding leave as it is, and the pairs of such a one that only track.
_PLAIN = r"[A-Za-z0-9._~-]"
PLAIN_QUERY = rf"\A{_PLAIN}+={_PLAIN}*(?:&{_PLAIN}+={_PLAIN}*)*+\z"
TRACKING_PAIR = rf"(?:\A|&)(?:[uU][tT][mM]_{_PLAIN}*|{'|'.join(TRACKING_KEYS)})=[^&]*"


def _clean_query(query: Column) -> Column:
    """The pairs that do not track, decoded and encoded; plain ones by one search, without a lambda a pair."""
    plain = F.ltrim(F.regexp_replace(query, TRACKING_PAIR, ""), F.lit("&"))
    return F.when(query.rlike(PLAIN_QUERY), plain).otherwise(_clean_pairs(query))


def _clean_pairs(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), p.alias("p")),
    )
    kept = F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING_KEYS) & ~F.lower(p["k"]).startswith("utm_"))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(_decode(_after(p["p"], "="))))), "&")


def _after(text: Column, sign: str) -> Column:
    """What follows the first ``sign``; '' without one."""
    return F.substr(text, F.length(F.substring_index(text, sign, 1)) + 2)


def _clean_path(scheme: Column, path: Column) -> Column:
    path = F.when(
        path.contains(";") & scheme.isin(*PARAMETER_SCHEMES),
        F.regexp_replace(path, r"(?s)^((?:.*/)?[^/;]*);[^/]*$", "$1"),
    ).otherwise(path)
    return F.coalesce(F.nullif(F.rtrim(path, F.lit("/")), F.lit("")), F.lit("/"))


def _build(u: dict[str, Column]) -> Column:
    """URL text from its text, scheme, host, path and query."""
    scheme, host, path = u["scheme"], u["host"], u["path"]
    slashes = (
        F.when(host != "", F.when(path.startswith("/"), F.concat(F.lit("//"), host)).otherwise(F.concat(F.lit("//"), host, F.lit("/"))))
        .when(path.startswith("//"), "//")
        .when((scheme != "") & scheme.isin(*AUTHORITY_SCHEMES) & path.startswith("/"), "//")
        .otherwise("")
    )
    query = F.when(u["kept"] != "", F.concat(F.lit("?"), u["kept"])).otherwise("")
    url = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), slashes, path, query)
    return F.when(host.contains("[") != host.contains("]"), u["text"]).otherwise(url)


def _has_host(u: dict[str, Column]) -> Column:
    return u["rest"].startswith("//")


# How a URL is cut, each part made of the ones before: at the first '#', then at the first '?', then behind
# the scheme.  Plain searches and one short regex.
_STEPS: tuple[tuple[str, Callable[[dict[str, Column]], Column]], ...] = (
    ("whole", lambda u: F.substring_index(u["text"], "#", 1)),
    ("front", lambda u: F.substring_index(u["whole"], "?", 1)),
    ("given", lambda u: F.regexp_extract(u["front"], SCHEME, 1)),
    ("rest", lambda u: F.when(u["given"] != "", F.substr(u["front"], F.length(u["given"]) + 2)).otherwise(u["front"])),
    ("named", lambda u: F.when(_has_host(u), F.substring_index(F.substr(u["rest"], F.lit(3)), "/", 1)).otherwise("")),
    ("scheme", lambda u: F.lower(u["given"])),
    ("host", lambda u: F.lower(u["named"])),
    ("path", lambda u: _clean_path(u["scheme"], F.when(_has_host(u), F.substr(u["rest"], F.length(u["named"]) + 3)).otherwise(u["rest"]))),
    ("query", lambda u: _after(u["whole"], "?")),
    ("kept", lambda u: F.when(u["query"] != "", _clean_query(u["query"])).otherwise("")),
)


def _url_text(c: Column) -> Column:
    return F.translate(strip(c), "\t\r\n", "")


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no trailing '/', no parameters, fragment or tracking keys.

    Null and blank give ''.  A URL with an unbalanced bracket in its host is returned trimmed.
    with_canonical_url() does the same to a frame in compiled code.
    """

    def built(u: dict[str, Column]) -> Column:
        if len(u) > len(_STEPS):
            return _build(u)
        name, step = _STEPS[len(u) - 1]
        return bind(step(u), lambda part: built(u | {name: part}))

    return F.coalesce(bind(_url_text(c), lambda t: F.when(t != "", built({"text": t}))), F.lit(""))


def with_canonical_url(df: DataFrame, url: Column, name: str = "job_url") -> DataFrame:
    """Adds canonical_url(url) to a frame, a projection a part: compiled, while a Column's lambdas are interpreted.

    The last projection is not fenced: use text.fenced() where rows are filtered by the URL.
    """
    kept = [c for c in df.columns if c != name]
    df = df.select("*", _url_text(url).alias("_url_text"))
    u = {"text": F.col("_url_text")}
    for part, step in _STEPS:
        df = df.select("*", step(u).alias(f"_url_{part}"))
        u[part] = F.col(f"_url_{part}")
    return df.select(*kept, F.when(F.coalesce(u["text"], F.lit("")) == "", "").otherwise(_build(u)).alias(name))
