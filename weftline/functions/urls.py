"""URL expressions built from native string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null for a text without one."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(F.length(host) > 0, host)


def site_of(url: Column) -> Column:
    """The last two labels of the host (the host itself if it has only one)."""
    host = F.regexp_replace(host_of(url), r"\.+$", "")
    return F.regexp_extract(host, r"([^.]+\.)?[^.]+$", 0)


def normalize_url(url: Column) -> Column:
    """http and https only: scheme and host in lower case, an empty path is /, the fragment goes; null for anything else.

    Null, control characters, credentials and bad ports give null.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    place = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    port = F.regexp_extract(place, r":(\d*)$", 1)
    bad = (
        url.rlike(r"[\x00-\x1f\x7f]")
        | ~scheme.isin("http", "https")
        | (F.length(F.regexp_replace(place, r":\d*$", "")) == 0)
        | place.contains("@")
        | place.rlike(r":[^\d\]][^\]]*$")
        | (F.coalesce(F.when(port != "", port).try_cast("int"), F.lit(0)) > 65535)
    )
    return F.when(~bad, F.concat(scheme, F.lit("://"), place, F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query)))


def url_policy(url: Column, blocked: list[str] = (), rules: list[dict] = ()) -> Column:
    """Why a URL is excluded, or null.

    Blocked domains (themselves and what is below them) come first; then the
    rules in order: the first whose ``path_pattern`` is found in the path, and whose
    ``domains``, if any, hold the host, decides - ``exclude`` or ``allow``.
    """
    import re

    for r in rules:
        if set(r) - {"name", "action", "path_pattern", "domains"} or r.get("action") not in ("allow", "exclude") or not r.get("name") or not r.get("path_pattern"):
            raise ValueError(f"no URL rule: {r}")
        re.compile(r["path_pattern"])
    if len({r["name"] for r in rules}) != len(rules):
        raise ValueError("rule names must differ")
    host, good = host_of(url), normalize_url(url)
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)

    def below(domains: list[str]) -> Column:
        out = F.lit(False)
        for d in sorted({d.rstrip(".").lower() for d in domains}):
            out = out | (host == d) | host.endswith("." + d)
        return out

    out = F.when(good.isNull() | (F.length(url) > 16384), "invalid_url")
    for d in sorted({d.rstrip(".").lower() for d in blocked}):
        out = out.when((host == d) | host.endswith("." + d), f"blocked_domain:{d}")
    for r in rules:
        hit = path.rlike(r["path_pattern"])
        if r.get("domains"):
            hit = hit & below(r["domains"])
        out = out.when(hit, F.lit(f"url_rule:{r['name']}") if r["action"] == "exclude" else F.lit(None).cast("string"))
    return out
