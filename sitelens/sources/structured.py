"""Structured data of pages: blocks of JSON-LD as variants, their nodes as rows, and what each node lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that a node of a type must have.
REQUIRED_FIELDS = {
    "LocalBusiness": ["name", "@type"], "Organization": ["name", "@type"], "FAQPage": ["mainEntity"], "Article": ["headline", "author", "datePublished"], "BlogPosting": ["headline", "author", "datePublished"],
    "WebSite": ["name", "url"], "BreadcrumbList": ["itemListElement"], "Product": ["name", "offers"], "SoftwareApplication": ["name", "applicationCategory", "operatingSystem"],
}
#: Types that no longer make rich results.
DEPRECATED_TYPES = ["FAQPage", "HowTo", "ClaimReview", "EstimatedSalary", "VehicleListing", "SpecialAnnouncement"]
#: Types that pages of such addresses should have.
RECOMMENDED_TYPES = {"/faq": "FAQPage", "/blog/": "BlogPosting", "/contact": "ContactPage", "/product": "Product", "/glossary": "DefinedTermSet"}
_NONE = "array<variant>"


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, _NONE), F.array().cast(_NONE))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def json_ld_nodes(blocks: DataFrame, depth: int = 4) -> DataFrame:
    """(page_id, url, place, depth, types, fields, node) of blocks (page_id, url, place, block): one row for each object.

    A block is an object or a list; the ``@graph`` of an object holds further ones, down to ``depth``. A block that is no
    JSON, and what is no object, is left out. ``fields`` are the names of an object's own values, in order of name.
    """
    parsed = blocks.select("page_id", "url", "place", F.try_parse_json("block").alias("v")).filter("v IS NOT NULL")
    top = F.when(F.schema_of_variant("v").startswith("ARRAY"), _list(F.col("v"), "$")).otherwise(F.array("v"))
    levels = parsed.withColumn("l0", F.filter(top, _is_object))
    for k in range(depth):
        levels = levels.withColumn(f"l{k + 1}", F.filter(F.flatten(F.transform(f"l{k}", lambda n: _list(n, "$['@graph']"))), _is_object))
    at = lambda k: F.transform(f"l{k}", lambda n: F.struct(F.lit(k).alias("depth"), n.alias("node")))
    tagged = [at(k) for k in range(depth + 1)]
    nodes = levels.select("page_id", "url", "place", F.explode(F.concat(*tagged)).alias("x")).select("page_id", "url", "place", "x.*")
    kind = F.try_variant_get("node", "$['@type']", "variant")
    strings = F.transform(F.filter(F.when(F.schema_of_variant(kind).startswith("ARRAY"), F.try_variant_get("node", "$['@type']", _NONE)).otherwise(F.array(kind)), lambda t: F.coalesce(F.schema_of_variant(t) == "STRING", F.lit(False))), lambda t: F.try_variant_get(t, "$", "string"))
    return nodes.select("page_id", "url", "place", "depth", F.when(kind.isNull(), F.array().cast("array<string>")).otherwise(strings).alias("types"), F.array_sort(F.json_object_keys(F.to_json("node"))).alias("fields"), "node")


def schema_findings(nodes: DataFrame) -> DataFrame:
    """(page_id, url, place, depth, type, missing, valid, deprecated) of nodes of any depth: the first type of each, ``Unknown`` without one."""
    kind = F.coalesce(F.get("types", 0), F.lit("Unknown"))
    required = F.create_map(*[x for k, fields in REQUIRED_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, fields)))])
    missing = F.array_except(F.coalesce(F.try_element_at(required, kind), F.array().cast("array<string>")), "fields")
    return nodes.select("page_id", "url", "place", "depth", kind.alias("type"), missing.alias("missing"), (F.size(missing) == 0).alias("valid"), kind.isin(DEPRECATED_TYPES).alias("deprecated"))


def schema_validate(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """(page_id, url, nodes, invalid, deprecated, recommended, verdict) of ``pages`` (page_id, url), those without a node too.

    ``healthy`` if every outer node has what its type needs, ``missing_schemas`` without any; ``recommended`` are types that
    the address calls for and no outer node has. Nodes inside a graph are not judged.
    """
    outer = findings.filter("depth = 0").groupBy("page_id").agg(F.count("*").alias("nodes"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if("deprecated").alias("deprecated"), F.collect_set("type").alias("has"))
    url, has = F.lower("url"), F.coalesce("has", F.array().cast("array<string>"))
    called = [F.when(F.contains(url, F.lit(sign)) & ~F.array_contains(has, kind), F.lit(kind)) for sign, kind in RECOMMENDED_TYPES.items()]
    zero = lambda c: F.coalesce(c, F.lit(0))
    verdict = F.when(zero("nodes") == 0, "missing_schemas").when(F.col("invalid") == 0, "healthy").otherwise("invalid_schemas")
    return pages.select("page_id", "url").join(outer, "page_id", "left").select("page_id", "url", zero("nodes").alias("nodes"), zero("invalid").alias("invalid"), zero("deprecated").alias("deprecated"), F.array_compact(F.array(*called)).alias("recommended"), verdict.alias("verdict"))


def schema_type_counts(nodes: DataFrame) -> DataFrame:
    """(type, pages): on how many pages each type stands."""
    return nodes.select("page_id", F.explode("types").alias("type")).distinct().groupBy("type").agg(F.count("*").alias("pages"))
