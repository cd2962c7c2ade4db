"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domain_of(url: Column) -> Column:
    """What is left without ``http://`` or ``https://`` and anything from the first slash on."""
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/.*$", "")


def host_key(url: Column) -> Column:
    """Host in lower case without ``www.``"""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def link_key(url: Column) -> Column:
    """Path without query and hash; ``/`` if there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def rival_key(url: Column) -> Column:
    """Lower case without scheme and trailing slashes; ``www.`` stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^https?://", ""), "/+$", "")


def site_key(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1)), F.lit("://"), host_of(url))


def parse_rival_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[\n,]"), lambda x: F.trim(x)), lambda x: x != "")


#: Names and ranges that are not public.
_PRIVATE = r"^(localhost|.*\.local|.*\.internal|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|::1)$"


def is_public_url(url: Column) -> Column:
    return url.rlike("^(?i)https?://") & (host_of(url) != "") & ~host_of(url).rlike(_PRIVATE)


def url_safety(url: Column) -> Column:
    """``ok`` or why a URL must not be fetched."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    octets = F.transform(F.split(host_of(url), r"\."), lambda x: F.when(x.rlike("^[0-9]{1,3}$"), x.cast("int")))
    numeric = (F.size(octets) == 4) & F.forall(octets, lambda x: x.isNotNull())
    return (
        F.when(~F.coalesce(url.rlike("^(?i)https?://"), F.lit(False)), "scheme")
        .when(F.contains(authority, F.lit("@")), "userinfo")
        .when(F.contains(url, F.lit("\\")), "backslash")
        .when(F.contains(authority, F.lit("%")), "percent")
        .when(host_of(url) == "", "host")
        .when(host_of(url).isin("metadata.google.internal", "169.254.169.254"), "metadata")
        .when(host_of(url).rlike(_PRIVATE), "private")
        .when(numeric & F.exists(octets, lambda x: x > 255), "address")
        .otherwise("ok")
    )


#: Path and query signs of rented sections, by tier.
PARASITE_HIGH = [r"/sponsored/", r"/partner/", r"/partners/", r"/affiliate/", r"/brand-studio/", r"/paid-content/", r"/native-advertising/", r"\b(best|top)\b.+\b(deals?|products?|picks?|reviews?)\b"]
PARASITE_MEDIUM = [r"/advisor/", r"/underscored/", r"/select/", r"/commerce/"]
PARASITE_LOW = [r"(^|&)(ref|aff|partner)="]


def parasite_risk(url: Column) -> Column:
    """The highest tier whose signs a URL has."""
    path, query = F.lower(link_key(url)), F.lower(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    return F.when(path.rlike("|".join(PARASITE_HIGH)), "high").when(path.rlike("|".join(PARASITE_MEDIUM)), "medium").when(query.rlike("|".join(PARASITE_LOW)), "low").otherwise("none")
