"""URLs, pages and fetch responses as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that track, phrases that mark closed pages, and domains of known standing.
TRACKING_KEYS = ["fbclid", "gclid", "msclkid", "mc_cid", "mc_eid"]
TRACKING_PREFIXES = ["utm_"]
PAYWALL = ["subscribe to continue", "subscription required", "sign in to continue", "register to continue", "paywall", "premium article", "for subscribers"]
BLOCKED = ["access denied", "request blocked", "temporarily unavailable", "enable javascript", "verify you are human", "captcha", "cloudflare"]
URL_HIGH = ["csis.org", "reuters.com", "apnews.com", "sec.gov", "bis.doc.gov", "commerce.gov", "energy.gov", "usgs.gov", "imf.org", "worldbank.org", "iea.org"]
URL_SUFFIXES = [".edu", ".gov", ".int", ".org"]
REGISTRY_HIGH = ["reuters.com", "apnews.com", "csis.org", "usgs.gov", "iea.org", "energy.gov", "commerce.gov", "sec.gov", "bis.doc.gov", "worldbank.org", "imf.org", "crisisgroup.org", "internationalcrisisgroup.org"]
REGISTRY_MEDIUM = ["stimson.org", "brookings.edu", "rand.org", "rusi.org", "chathamhouse.org", "spglobal.com", "mining.com", "argusmedia.com", "fastmarkets.com", "theconversation.com", "ft.com", "economist.com", "nytimes.com", "wsj.com", "theguardian.com"]
SUPPORTED = [".html", ".htm", ".pdf", ".txt", ".json", ".csv"]

PARTS = r"^(?i)(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, k)


def is_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(PARTS), F.lit(False))


def domain(url: Column) -> Column:
    """Host with port, in lower case; null for what is no URL."""
    return F.when(is_url(url), F.lower(_part(url, 2)))


def normal_path(path: Column) -> Column:
    """Without empty, . and .. segments, with a leading and without a trailing slash."""
    step = lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.concat_ws("/", kept))


def encoded(c: Column) -> Column:
    """Form encoding with the unreserved marks of RFC 3986."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(c), "\\*", "%2A"), "%7E", "~")


def clean_query(query: Column) -> Column:
    """Without tracking parameters, sorted by name and value, and encoded anew."""
    pair = lambda p: F.struct(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")), F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit("")).alias("v"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    tracks = lambda k: k.isin(TRACKING_KEYS) | _any([F.startswith(k, F.lit(p)) for p in TRACKING_PREFIXES])
    kept = F.array_sort(F.filter(pairs, lambda p: ~tracks(F.lower(p["k"]))))
    return F.concat_ws("&", F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def canonicalize_url(url: Column) -> Column:
    """One spelling per page; null for what is no URL."""
    scheme, host = F.lower(_part(url, 1)), F.regexp_replace(F.lower(_part(url, 2)), "^[^@]*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    query = clean_query(_part(url, 4))
    return F.when(is_url(url), F.concat(scheme, F.lit("://"), host, normal_path(_part(url, 3)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def in_domains(d: Column, known: list[str]) -> Column:
    """Equal to a known domain or below one."""
    return _any([(d == k) | F.endswith(d, F.lit("." + k)) for k in known])


def url_credibility(url: Column) -> Column:
    d = F.regexp_replace(domain(url), "^www\\.", "")
    return F.when(d.isin(URL_HIGH), F.lit(0.92)).when(_any([F.endswith(d, F.lit(s)) for s in URL_SUFFIXES]), F.lit(0.75)).otherwise(F.lit(0.5))


def registry_credibility(d: Column, publisher: Column, explicit: Column | None = None) -> Column:
    by_list = F.when(in_domains(d, REGISTRY_HIGH), F.lit(0.9)).when(in_domains(d, REGISTRY_MEDIUM), F.lit(0.7)).when(F.trim(publisher) != "", F.lit(0.6)).otherwise(F.lit(0.5))
    return F.coalesce(explicit, by_list) if explicit is not None else by_list


def detect_block(html: Column) -> Column:
    """paywalled, blocked or null, by phrases anywhere in the page; paywalls come first."""
    text = F.lower(html)
    return F.when(_any([F.contains(text, F.lit(p)) for p in PAYWALL]), F.lit("paywalled")).when(_any([F.contains(text, F.lit(p)) for p in BLOCKED]), F.lit("blocked"))


def fetch_class(status: Column, mime: Column, url: Column, body: Column) -> Column:
    """The acquisition status that a response stands for."""
    html = mime.isin("text/html", "application/xhtml+xml") | F.contains(F.lower(F.substring(body, 1, 100)), F.lit("<html"))
    supported = mime.rlike("^(text/|application/(json|pdf|xhtml\\+xml|csv))") | _any([F.endswith(F.lower(url), F.lit(s)) for s in SUPPORTED])
    return (
        F.when(status.isin(401, 403), F.lit("blocked"))
        .when(status == 402, F.lit("paywalled"))
        .when(status.isin(404, 410), F.lit("not_found"))
        .when(status.isNull() | ~status.between(200, 299), F.lit("fetch_failed"))
        .when(~F.coalesce(supported, F.lit(False)), F.lit("unsupported"))
        .when(F.coalesce(html, F.lit(False)) & detect_block(body).isNotNull(), detect_block(body))
        .otherwise(F.lit("acquired"))
    )


def meta_tags(html: Column) -> Column:
    """Map of a page's meta tags: property, name or itemprop in lower case -> content; the last of a name wins."""
    attr = lambda tag, name: F.trim(F.regexp_extract(tag, rf"(?i)(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']", 1))
    tags = F.regexp_extract_all(html, F.lit("(?i)<meta\\s+([^>]+)>"), F.lit(1))
    first = lambda t: F.coalesce(*(F.nullif(attr(t, n), F.lit("")) for n in ("property", "name", "itemprop")))
    rows = F.filter(F.transform(tags, lambda t: F.struct(F.lower(first(t)).alias("key"), attr(t, "content").alias("value"))), lambda r: r["key"].isNotNull() & (r["value"] != ""))
    keep = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda later: later["key"] == r["key"]))
    return F.map_from_entries(keep)


# Meta tags that name each field, in order.
META = {
    "title": ["og:title", "twitter:title", "title", "headline", "dc.title", "citation_title"],
    "author": ["author", "article:author", "dc.creator", "citation_author", "byl"],
    "publisher": ["og:site_name", "application-name", "dc.publisher", "citation_publisher", "publisher"],
    "published_at": ["article:published_time", "article:modified_time", "date", "dc.date", "dc.date.issued", "citation_publication_date", "pubdate"],
    "canonical_url": ["og:url", "twitter:url", "canonical"],
}


def html_metadata(html: Column) -> dict[str, Column]:
    """title, author, publisher, published_at, canonical_url; the title tag stands in for a missing title."""
    tags = meta_tags(html)
    out = {field: F.coalesce(*(F.nullif(F.try_element_at(tags, F.lit(k)), F.lit("")) for k in keys)) for field, keys in META.items()}
    title = F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "\\s+", " "))
    out["title"] = F.coalesce(out["title"], F.nullif(title, F.lit("")))
    return out


def plain_text(html: Column) -> Column:
    """A page's text by patterns alone: scripts, styles, heads and comments go, block ends become line ends, tags go.

    For pages whose layout does not matter; what is article and what is not, it doesn't tell.
    """
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|noscript|head|template)\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/section|/article|/ul|/ol|/table)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, mark in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(mark))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
