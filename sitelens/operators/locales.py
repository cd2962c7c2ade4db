"""Language alternatives of pages: their codes, what a set of them lacks, and pages that don't name each other back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-letter language codes.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr "
    "ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv "
    "ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz va ve vi vo wa wo xh "
    "yi yo za zh zu"
).split()


def lang_code_issues(code: Column) -> Column:
    """What is wrong with a code, as an array: ``use_ja``, ``three_letters`` or ``unknown_language``, then ``bad_region`` or ``use_gb``.

    ``x-default`` is right. Case does not matter. What follows the first dash counts as a region, so a script such as Hans
    is a bad one.
    """
    parts = F.split(F.lower(code), "-")
    lang, region = F.get(parts, 0), F.get(parts, 1)
    language = F.when(lang == "jp", "use_ja").when(lang.isin(LANGUAGES), None).when(F.length(lang) == 3, "three_letters").otherwise("unknown_language")
    place = F.when(region.isNull() | (region == ""), None).when(~region.rlike("^[a-z]{2}$"), "bad_region").when(region == "uk", "use_gb")
    return F.when(code == "x-default", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(language, place)))


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", "")


def hreflang_audit(pages: DataFrame) -> DataFrame:
    """(url, tags_count, has_x_default, has_self_ref, issues, verdict) of pages (url, canonical, tags array<struct<lang,href>>).

    ``issues`` are structs (severity, issue, lang, href), the last two null for what concerns the whole set: ``no_self``
    (critical), ``no_x_default`` and wrong codes (high), ``mixed_protocols`` (medium). ``no_hreflang`` without tags.
    """
    own = F.array(_bare("url"), _bare(F.when(F.coalesce("canonical", F.lit("")) == "", F.col("url")).otherwise(F.col("canonical"))))
    tags = F.coalesce("tags", F.array().cast("array<struct<lang:string,href:string>>"))
    known = pages.select("url", tags.alias("tags"), own.alias("own"))
    has_self, has_default = F.exists("tags", lambda t: F.array_contains(F.col("own"), _bare(t["href"]))), F.exists("tags", lambda t: t["lang"] == "x-default")
    begins = lambda scheme: F.exists("tags", lambda t: F.coalesce(t["href"], F.lit("")).startswith(scheme))
    null = F.lit(None).cast("string")
    issue = lambda severity, name, lang=null, href=null: F.struct(F.lit(severity).alias("severity"), name.alias("issue") if isinstance(name, Column) else F.lit(name).alias("issue"), lang.alias("lang"), href.alias("href"))
    codes = F.flatten(F.transform("tags", lambda t: F.transform(lang_code_issues(t["lang"]), lambda i: issue("high", i, t["lang"], t["href"]))))
    whole = F.array_compact(F.array(F.when(~has_self, issue("critical", "no_self")), F.when(~has_default, issue("high", "no_x_default"))))
    mixed = F.array_compact(F.array(F.when(begins("https://") & begins("http://"), issue("medium", "mixed_protocols"))))
    some = F.size("tags") > 0
    issues = F.when(some, F.concat(whole, codes, mixed)).otherwise(F.array().cast("array<struct<severity:string,issue:string,lang:string,href:string>>"))
    found = known.select("url", F.size("tags").alias("tags_count"), has_default.alias("has_x_default"), has_self.alias("has_self_ref"), issues.alias("issues"))
    return found.withColumn("verdict", F.when(F.col("tags_count") == 0, "no_hreflang").when(F.size("issues") == 0, "valid").otherwise("issues_found"))


def missing_return_tags(pages: DataFrame) -> DataFrame:
    """(url, lang, href): alternatives that a page names, which are pages here and don't name it back.

    A page is known by its address without slashes at the end. The named pairs are joined to themselves the other way round.
    """
    named = pages.select("url", F.explode("tags").alias("t")).select("url", F.col("t.lang").alias("lang"), F.col("t.href").alias("href"), _bare("url").alias("a"), _bare(F.col("t.href")).alias("b")).filter("a <> b")
    known = pages.select(_bare("url").alias("b")).distinct()
    back = named.select(F.col("a").alias("b"), F.col("b").alias("a")).distinct()
    return named.join(known, "b", "left_semi").join(back, ["a", "b"], "left_anti").select("url", "lang", "href").distinct()
