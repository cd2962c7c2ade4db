"""What a search console and an agent's transcript say, as tables: inspections, properties, submitted sitemaps, tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_key
from ..operators.rules import inspection_category

INSPECTION = (
    "inspectionResult struct<inspectionResultLink:string, mobileUsabilityResult:struct<verdict:string>, indexStatusResult:struct<verdict:string,coverageState:string,robotsTxtState:string,indexingState:string,"
    "lastCrawlTime:string,pageFetchState:string,googleCanonical:string,userCanonical:string,sitemap:array<string>,referringUrls:array<string>,crawledAs:string>>"
)
#: Permissions, the weakest first.
PERMISSIONS = ["siteRestrictedUser", "siteFullUser", "siteOwner"]


def read_inspections(responses: DataFrame) -> DataFrame:
    """The fields of inspections (site, url, response as JSON text): states that are missing are UNKNOWN, lists empty, the rest null.

    A response that doesn't parse gives a row of defaults.
    """
    r = responses.select("site", "url", F.from_json("response", INSPECTION).alias("r"))
    i = lambda name: F.col(f"r.inspectionResult.indexStatusResult.{name}")
    known = lambda c, name: F.coalesce(c, F.lit("UNKNOWN")).alias(name)
    none = F.array().cast("array<string>")
    text = lambda name: F.coalesce(i(name), F.lit(""))
    category = inspection_category({"verdict": text("verdict"), "robots": text("robotsTxtState"), "fetch": text("pageFetchState"), "coverage": text("coverageState"), "google": text("googleCanonical"), "user": text("userCanonical")})
    return r.select(
        "site", "url", known(i("verdict"), "verdict"), known(i("coverageState"), "coverage_state"), known(i("robotsTxtState"), "robots_txt_state"), known(i("indexingState"), "indexing_state"), i("lastCrawlTime").alias("last_crawl"), i("pageFetchState").alias("page_fetch_state"),
        i("googleCanonical").alias("google_canonical"), i("userCanonical").alias("user_canonical"), F.coalesce(i("sitemap"), none).alias("sitemap"), F.coalesce(i("referringUrls"), none).alias("referring_urls"), known(i("crawledAs"), "crawled_as"),
        known(F.col("r.inspectionResult.mobileUsabilityResult.verdict"), "mobile_verdict"), F.col("r.inspectionResult.inspectionResultLink").alias("link"), category.alias("category"),
    )


def read_properties(listings: DataFrame) -> DataFrame:
    """(account, place, url, permission) of property lists (account, listing as JSON text); entries without an address are left out.

    A permission that is not a known one is ``unverified``.
    """
    entries = listings.select("account", F.posexplode(F.from_json("listing", "siteEntry array<struct<siteUrl:string,permissionLevel:string>>")["siteEntry"]).alias("place", "e"))
    level = F.col("e.permissionLevel")
    return entries.filter(F.trim(F.coalesce("e.siteUrl", F.lit(""))) != "").select("account", "place", F.col("e.siteUrl").alias("url"), F.when(level.isin(PERMISSIONS), level).otherwise("unverified").alias("permission"))


def _strength(permission: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, PERMISSIONS)), permission), F.lit(0))


def best_property(properties: DataFrame) -> DataFrame:
    """(account, url, permission): of each account the property with the strongest permission, the first listed of equals."""
    best = properties.groupBy("account").agg(F.max_by(F.struct("url", "permission"), F.struct(_strength(F.col("permission")), -F.col("place"))).alias("b"))
    return best.select("account", "b.*")


def property_host(key: Column) -> Column:
    """The host that a property is for: what follows ``sc-domain:``, or the host of its address without ``www.``"""
    return F.when(key.startswith("sc-domain:"), F.lower(F.substr(key, F.lit(11)))).otherwise(host_key(key))


def probe_key(url: Column) -> Column:
    """How a console files an address: a domain property; a key that begins with ``sc-`` is one already."""
    trimmed = F.trim(url)
    return F.when(trimmed.startswith("sc-"), trimmed).otherwise(F.concat(F.lit("sc-domain:"), host_key(F.when(F.contains(trimmed, F.lit("://")), trimmed).otherwise(F.concat(F.lit("https://"), trimmed)))))


def match_property(sites: DataFrame, properties: DataFrame) -> DataFrame:
    """(account, url, property, permission, verified): the property of ``sites`` (account, url): that of its key, else the first of its host.

    Both ways are one equi-join by host; the rank of a match says which it was.
    """
    key = probe_key(F.col("url"))
    asked = sites.select("account", "url", key.alias("_key"), property_host(key).alias("_host")).distinct()
    known = properties.select("account", F.col("url").alias("property"), "permission", "place", property_host(F.col("url")).alias("_host"))
    rank = F.struct((F.col("property") != F.col("_key")).cast("int"), "place")
    found = asked.join(known, ["account", "_host"]).groupBy("account", "url").agg(F.min_by(F.struct("property", "permission"), rank).alias("m"))
    return asked.join(found, ["account", "url"], "left").select("account", "url", F.coalesce("m.property", "_key").alias("property"), F.col("m.permission").alias("permission"), F.col("m").isNotNull().alias("verified"))


def read_sitemap_status(listings: DataFrame) -> DataFrame:
    """Submitted sitemaps of listings (site, listing as JSON text): a missing flag is false, a missing number 0; numbers may be text."""
    kind = "sitemap array<struct<path:string,lastSubmitted:string,lastDownloaded:string,isPending:boolean,isSitemapsIndex:boolean,warnings:string,errors:string,contents:array<struct<type:string,submitted:string>>>>"
    s = listings.select("site", F.explode(F.from_json("listing", kind)["sitemap"]).alias("s"))
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    return s.select(
        "site", F.coalesce("s.path", F.lit("")).alias("url"), F.col("s.lastSubmitted").alias("last_submitted"), F.col("s.lastDownloaded").alias("last_downloaded"), F.coalesce("s.isPending", F.lit(False)).alias("is_pending"),
        F.coalesce("s.isSitemapsIndex", F.lit(False)).alias("is_index"), number("s.warnings").alias("warnings"), number("s.errors").alias("errors"), F.coalesce(F.size("s.contents"), F.lit(0)).alias("contents"),
    )


_EVENT = "sessionID string, part struct<type:string,text:string,tool:string,state:struct<status:string,output:string,error:string>,tokens:struct<input:bigint,output:bigint>,cost:double>"


def read_transcript(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, totals) of transcript lines (run_id, line, text), each an event as JSON; what is none is passed over.

    ``calls`` (run_id, line, tool, status, ok, output) has each tool call, its error where it has no output; ``totals``
    (run_id, session_id, input_tokens, output_tokens, cost, text_chars) takes tokens and cost from the last event that ends
    a step and has them, and the length of all text.
    """
    e = lines.filter(F.trim("text").startswith("{")).select("run_id", "line", F.from_json("text", _EVENT).alias("e")).filter("e IS NOT NULL").select("run_id", "line", "e.sessionID", "e.part.*")
    status = F.coalesce("state.status", F.lit("unknown"))
    calls = e.filter("type = 'tool'").select("run_id", "line", F.coalesce("tool", F.lit("unknown")).alias("tool"), status.alias("status"), (status == "completed").alias("ok"), F.coalesce("state.output", "state.error", F.lit("")).alias("output"))
    last = lambda c: F.max_by(c, F.when((F.col("type") == "step-finish") & F.col(c).isNotNull(), F.col("line")))
    totals = e.groupBy("run_id").agg(F.max_by("sessionID", F.when(F.col("sessionID").isNotNull(), F.col("line"))).alias("session_id"), F.coalesce(last("tokens.input"), F.lit(0)).alias("input_tokens"), F.coalesce(last("tokens.output"), F.lit(0)).alias("output_tokens"), F.coalesce(last("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum(F.when(F.col("type") == "text", F.length("text"))), F.lit(0)).alias("text_chars"))
    return calls, totals
