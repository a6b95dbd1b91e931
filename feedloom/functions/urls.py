"""URL functions and host predicates, without user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, as a pattern over lower-case names; second-level suffixes; aggregators. Fixed values.
TRACKING = "^(utm_.*|ref|ref_src|fbclid|gclid|mc_cid|mc_eid|igshid|si|source)$"
TWO_LEVEL = ["co.uk", "co.jp", "co.kr", "co.nz", "com.au", "com.br", "com.cn", "com.tw", "org.uk", "gov.uk", "ac.uk", "ne.jp", "or.jp"]
AGGREGATORS = ["news.google.com"]
#: Publishers whose items are not wanted: hosts (and their subdomains), and words of names. Fixed values.
BLOCKED_HOSTS = [
    "tradingview.com", "finance.yahoo.com", "yahoo.com", "msn.com", "seekingalpha.com", "marketwatch.com", "benzinga.com",
    "fool.com", "barrons.com", "cnbc.com", "investorplace.com", "simplywall.st", "nasdaq.com", "streetinsider.com",
    "zacks.com", "investors.com", "finance.com", "morningstar.com", "investing.com",
]
BLOCKED_NAMES = [
    "tradingview", "yahoo finance", "yahoo! finance", "msn", "seeking alpha", "marketwatch", "benzinga", "motley fool",
    "barron's", "barrons", "cnbc", "investorplace", "simply wall st", "street insider", "zacks",
    "investor's business daily", "morningstar", "investing.com",
]
WEB = "^(?i)(https?)://([^/?#]*@)?(\\[[0-9A-Fa-f:.]+\\]|[^/?#:\\[\\s]+)(:[0-9]*)?((?:/[^?#\\s]*)?)(\\?[^#\\s]*)?(#\\S*)?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, WEB, group)


def host(url: Column) -> Column:
    """Lower-case host name without port; empty if the URL is not a web address."""
    return F.lower(part(url, 3))


def is_web(url: Column) -> Column:
    return F.rlike(url, F.lit(WEB))


def is_https(url: Column) -> Column:
    return F.coalesce(is_web(url) & (F.lower(part(url, 1)) == "https"), F.lit(False))


def canonical_url(url: Column) -> Column:
    """http as https, host in lower case, default port and tracking parameters dropped, no slash at the end of a path nor
    of a bare origin; fragments stay, anything but a web address is returned as it is. Kept parameters keep
    their spelling."""
    raw, scheme = part(url, 6), F.lower(part(url, 1))
    params = F.filter(F.split(F.substring(raw, 2, 1 << 30), "&"), lambda p: p != "")
    keep = F.filter(params, lambda p: ~F.rlike(F.lower(F.split(p, "=")[0]), F.lit(TRACKING)))
    query = F.when(F.size(keep) == F.size(params), raw).when(F.size(keep) == 0, "").otherwise(F.concat(F.lit("?"), F.array_join(keep, "&")))
    port = F.when((part(url, 4) == ":443") | (part(url, 4) == ":") | ((part(url, 4) == ":80") & (scheme == "http")), "").otherwise(part(url, 4))
    path = F.regexp_replace(part(url, 5), "/+$", "")
    tail = F.concat(query, part(url, 7))
    whole = F.concat(F.lit("https://"), part(url, 2), host(url), port, F.when((path == "") & (tail != ""), "/").otherwise(path), tail)
    return F.when(is_web(url), whole).otherwise(url)


def registrable_domain(name: Column) -> Column:
    """The last two labels of a host, three under a two-level suffix; addresses stay whole."""
    low = F.lower(F.trim(name))
    labels = F.split(low, "\\.")
    two, n = F.array_join(F.slice(labels, -2, 2), "."), F.size(labels)
    return F.when(F.rlike(low, F.lit("^\\d+\\.\\d+\\.\\d+\\.\\d+$")) | F.contains(low, F.lit(":")) | (n < 2), low).when((n >= 3) & two.isin(TWO_LEVEL), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)


def same_vendor(a: Column, b: Column) -> Column:
    """Whether two web addresses (ports count) share a registrable domain; never for aggregators."""
    ha, hb = (F.concat(host(x), F.regexp_replace(part(x, 4), "^:(443)?$", "")) for x in (a, b))
    known = (ha != "") & (hb != "") & ~ha.isin(AGGREGATORS) & ~hb.isin(AGGREGATORS)
    return F.coalesce(known & (registrable_domain(ha) == registrable_domain(hb)), F.lit(False))


def private_ipv4(name: Column) -> Column:
    """Whether a host is an IPv4 address of a private, local or reserved range."""
    octet = "(25[0-5]|2[0-4]\\d|[01]?\\d?\\d)"
    v4 = F.rlike(name, F.lit(f"^({octet}\\.){{3}}{octet}$"))
    return v4 & F.rlike(name, F.lit("^0*(127|10|0)\\.|^172\\.0?(1[6-9]|2\\d|3[01])\\.|^192\\.168\\.|^169\\.254\\.|^100\\.0?(6[4-9]|[7-9]\\d|1[01]\\d|12[0-7])\\."))


def is_public_url(url: Column) -> Column:
    """https, no user, and no local, metadata or private host; an IPv6 address that maps an IPv4 one is judged by that."""
    name = host(url)
    v6 = F.rlike(name, F.lit("^\\[(::1|fe[89ab][0-9a-f]?:.*|f[cd][0-9a-f]{2}:.*)\\]$"))
    mapped = F.regexp_extract(name, "^\\[::ffff:([0-9.]+)\\]$", 1)
    bad = F.contains(url, F.lit("@")) | (name == "localhost") | F.startswith(name, F.lit("metadata.")) | private_ipv4(name) | private_ipv4(mapped) | v6
    return F.coalesce(is_https(url) & ~bad, F.lit(False))


def blocked_host(url: Column) -> Column:
    name = host(url)
    return F.exists(F.array(*[F.lit(b) for b in BLOCKED_HOSTS]), lambda b: (name == b) | F.endswith(name, F.concat(F.lit("."), b)))


def _words(name: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), F.lit(" "))


def blocked_name(name: Column) -> Column:
    return F.coalesce(F.exists(F.array(*[_words(F.lit(b)) for b in BLOCKED_NAMES]), lambda b: F.contains(_words(name), b)), F.lit(False))


def safe_href(url: Column) -> Column:
    return F.when(F.rlike(F.coalesce(url, F.lit("")), F.lit("^(?i)https?://[^/?#\\s]")), url).otherwise("#")
