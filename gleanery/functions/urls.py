"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import let

#: Second-level labels under country suffixes.
SECOND_LEVEL = ["co", "com", "org", "net", "edu", "gov", "ac", "ltd", "plc"]
#: Parameters that only track visits (besides utm_*).
TRACKING = [
    "ref", "refs", "referrer", "source", "src", "gh_src", "lever-source", "lever-origin", "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "trk", "trackingid", "refid",
    "campaign", "medium", "via", "si", "igshid", "_hsenc", "_hsmi", "sc_cid", "jobsource", "source_id", "utm", "rx_source", "ashby_jid_source",
]
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), URL, group)


def authority(url: Column) -> Column:
    """host[:port] in lower case, without user information."""
    return F.lower(F.regexp_replace(part(url, 2), "^.*@", ""))


def host(url: Column) -> Column:
    """Host in lower case without a leading www.; '' for what is no URL."""
    return F.regexp_replace(F.regexp_replace(authority(url), ":[0-9]*$", ""), r"^www\.", "")


def registrable(host_or_url: Column) -> Column:
    """The last two labels, or three under a country suffix with a known second level."""

    def last_labels(labels: Column) -> Column:
        deep = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(SECOND_LEVEL)
        n = F.when(deep, 3).otherwise(F.least(F.size(labels), F.lit(2)))
        return F.when(F.size(labels) == 0, "").otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))), "."))

    c = F.coalesce(host_or_url, F.lit(""))
    name = F.when(c.contains("://"), host(c)).otherwise(F.lower(c))
    return let(F.filter(F.split(name, r"\."), lambda x: x != ""), last_labels)


def on_domains(name: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    return name.rlike(r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def canonical(url: Column) -> Column:
    """One spelling for addresses of the same page."""
    port = F.regexp_extract(authority(url), r":([0-9]+)$", 1)
    ported = let(port, lambda p: F.when((p == "") | p.isin("80", "443"), "").otherwise(F.concat(F.lit(":"), p)))
    path = F.regexp_replace(F.coalesce(F.nullif(part(url, 3), F.lit("")), F.lit("/")), "/{2,}", "/")
    path = let(path, lambda p: F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p))
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p.rlike("^[^=]+=.+"))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    pairs = F.filter(pairs, lambda p: ~(key(p).startswith("utm_") | key(p).isin(TRACKING)))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p"))))
    query = let(F.array_join(F.transform(pairs, lambda p: p["p"]), "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.concat(F.lit("https://"), host(url), ported, path, query)


def url_key(url: Column) -> Column:
    return F.sha2(canonical(url), 256)


def redacted(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def page_label(url: Column) -> Column:
    return F.concat(host(url), F.substring(part(url, 3), 1, 80))


#: Hosts of the board providers, and path names that are no company.
BOARD_HOSTS = {
    "greenhouse": r"^(?:job-)?boards(?:\.eu)?\.greenhouse\.io$",
    "lever": r"^jobs(?:\.eu)?\.lever\.co$",
    "ashby": r"^jobs\.ashbyhq\.com$",
    "smartrecruiters": r"^(?:jobs|careers)\.smartrecruiters\.com$",
    "workable": r"^apply\.workable\.com$",
    "recruitee": r"^[a-z0-9-]+\.recruitee\.com$",
}
RESERVED = ["embed", "api", "v1", "jobs", "j", "careers", "static", "assets", "www", "app", "login", "search", "job", "apply"]


def board(url: Column) -> Column:
    """struct(provider, slug) of a company board, null for other addresses."""
    name = F.regexp_replace(authority(url), ":[0-9]*$", "")
    segments = F.filter(F.split(part(url, 3), "/"), lambda x: x != "")

    def named(s: Column) -> Column:
        first, second = F.get(s["segments"], F.lit(0)), F.get(s["segments"], F.lit(1))
        embedded = (s["provider"] == "greenhouse") & (first == "embed") & (second == "job_board")
        slug = F.when(s["provider"] == "recruitee", F.substring_index(s["name"], ".", 1)).when(embedded, s["for"]).otherwise(first)
        return F.struct(s["provider"].alias("provider"), slug.alias("slug"))

    provider = let(name, lambda n: F.coalesce(*[F.when(n.rlike(p), F.lit(k)) for k, p in BOARD_HOSTS.items()]))
    parts = F.struct(name.alias("name"), provider.alias("provider"), segments.alias("segments"), F.regexp_extract(part(url, 4), r"(?:^|&)for=([^&]+)", 1).alias("for"))
    usable = lambda b: b["provider"].isNotNull() & b["slug"].rlike("^[A-Za-z0-9_.-]{2,80}$") & ~F.lower(b["slug"]).isin(RESERVED)
    return let(let(parts, named), lambda b: F.when(usable(b), b))


def slug_title(url: Column) -> Column:
    """Words of the last path segment: no trailing number, dashes as spaces."""
    segment = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), "/"), -1)
    return F.trim(F.regexp_replace(F.regexp_replace(segment, r"-[0-9]+$", ""), "[-_]+", " "))
