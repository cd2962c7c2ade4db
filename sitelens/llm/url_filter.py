"""URL filtering by association rules that FP-growth mines from the tokens of labelled URLs."""

from __future__ import annotations

import itertools
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values: (verdict, host, path) of the rules that the query is given.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_LABEL = "verdict:"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null. Among equally long ones the last by name wins."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, every suffix of the host, path segments, file ending, query keys, fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -i, i), ".")))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    plain = F.transform(segments, lambda x: F.when(x.rlike(r"^\d+$"), F.lit("#")).otherwise(x))
    place = F.transform(plain, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.split_part(x, F.lit("="), F.lit(1))))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    rest = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.when(ending != "", F.concat(F.lit("ending:"), ending)), F.when(url.contains("#"), F.lit("fragment")))
    return F.array_distinct(F.array_compact(F.concat(F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")), place, keys, rest)))


def mine_rules(labelled: DataFrame, *, min_support: float = 0.005, min_confidence: float = 0.8, most_tokens: int = 3, widest: int = 12) -> DataFrame:
    """(antecedent array, verdict, confidence, support, rarest) from rows (tokens, verdict).

    Kept are the rules of at most ``most_tokens`` tokens, three at most, with the given support and confidence; ``rarest`` is the
    antecedent's token in the fewest rows. FP-growth would count every set of the tokens of a basket, so baskets of more than
    ``widest`` frequent tokens are dealt: tokens are put into groups in turn, and of each three groups a basket has a part, of
    some six tokens, in which FP-growth counts alone. A set of up to three tokens is whole in the part of its groups, and
    read off there; so the rules are those of whole baskets, while no part has many sets. Frequent tokens are at most (tokens a row) / ``min_support``.
    """
    assert most_tokens <= 3
    n = labelled.count()
    need = max(1, math.ceil(min_support * n - 1e-9))
    counts = labelled.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("rows")).filter(F.col("rows") >= need).persist()
    each = labelled.withColumn("row", F.monotonically_increasing_id()).select("row", F.concat(F.lit(_LABEL), F.col("verdict")).alias("label"), F.explode(F.array_distinct("tokens")).alias("token"))
    turn = (F.row_number().over(Window.orderBy(F.desc("rows"), "token")) - 1).alias("turn")  # of the frequent tokens alone
    kept = each.join(F.broadcast(counts.select("token", turn)), "token").groupBy("row").agg(F.first("label").alias("label"), F.collect_list(F.struct("turn", "token")).alias("own")).persist()
    width = kept.agg(F.max(F.size("own"))).first()[0] or 0
    groups = 3 if width <= widest else -(-width // 2)
    parts = F.array(*(F.array(*map(F.lit, x)) for x in itertools.combinations(range(groups), 3)))
    inside = F.filter("own", lambda x: F.array_contains("part", x["turn"] % groups))
    baskets = kept.select("label", "own", F.explode(parts).alias("part")).select("part", "label", inside.alias("own")).filter(F.size("own") > 0)
    tag = F.array_join(F.transform("part", lambda x: x.cast("string")), ",")
    items = F.transform(F.array_append(F.transform("own", lambda x: F.concat_ws(" ", x["turn"].cast("string"), x["token"])), F.col("label")), lambda t: F.concat_ws("|", tag, t))
    baskets = baskets.select(items.alias("items"))
    total = baskets.count()
    if not total:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double, rarest string")
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / total, minConfidence=min_confidence).fit(baskets)
    bare = lambda t: F.regexp_replace(t, r"^[0-9,]+\|", "")
    label = bare(F.element_at("consequent", 1))
    named = model.associationRules.filter(F.size("antecedent") <= most_tokens).select(F.transform("antecedent", bare).alias("antecedent"), label.alias("label"), F.split(F.substring_index(F.element_at("consequent", 1), "|", 1), ",").cast("array<int>").alias("part"), "confidence", "support")
    named = named.filter(F.col("label").startswith(_LABEL) & ~F.exists("antecedent", lambda t: t.startswith(_LABEL)))
    turns = F.transform("antecedent", lambda t: F.substring_index(t, " ", 1).cast("int"))
    # The part that a set is read from: its groups, filled up with the first others.
    own = F.array_distinct(F.transform(turns, lambda x: x % groups))
    home = F.array_sort(F.slice(F.concat(own, F.array_except(F.array(*map(F.lit, range(min(groups, 6)))), own)), 1, 3))
    rules = named.filter(home == F.col("part")).withColumn("rare", F.array_max(turns))
    token = lambda t: F.regexp_replace(t, "^[0-9]+ ", "")
    rarest = F.element_at(F.filter("antecedent", lambda t: F.substring_index(t, " ", 1).cast("int") == F.col("rare")), 1)
    return rules.select(F.transform("antecedent", token).alias("antecedent"), F.substring("label", len(_LABEL) + 1, 20).alias("verdict"), "confidence", (F.col("support") * total / n).alias("support"), token(rarest).alias("rarest"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, min_support: float = 0.005, min_confidence: float = 0.8, most_tokens: int = 3, default: str = "allow", most_rules: int = 50_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    The longest of ``rules`` that fits decides. URLs decided so are the labels from which FP-growth mines token
    combinations; any other URL gets the verdict of the mined rule of the highest confidence, then support, all of
    whose tokens it has, and ``default`` if there is none. Rules are found by their token in the fewest URLs (an inverted
    index, sent to all tasks if it has at most ``most_rules`` rules) and then checked whole. A null URL, or one without ``://``, has an empty host and path and gets ``default``.
    Repeated rows stay; other columns are ignored; without URLs that fit a rule all others get ``default``.
    """
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    read = read.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", F.when(F.col("host") != "", url_tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))
    mined = mine_rules(read.filter("fit is not null").select("tokens", F.col("fit.verdict").alias("verdict")), min_support=min_support, min_confidence=min_confidence, most_tokens=most_tokens)
    name = F.array_join(F.array_sort("antecedent"), " ")
    index = mined.select(F.col("rarest").alias("token"), "antecedent", F.struct("confidence", "support", "verdict", name.alias("name")).alias("mined"))
    index = index.persist()
    if index.count() <= most_rules:
        index = F.broadcast(index)
    decided = read.filter("fit is not null").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))
    open_ = read.filter("fit is null").select("page_id", "host", "path", "tokens").withColumn("row", F.monotonically_increasing_id())
    tried = open_.withColumn("token", F.explode_outer("tokens")).join(index, "token", "left").withColumn("mined", F.when(F.size(F.array_except("antecedent", "tokens")) == 0, F.col("mined")))
    judged = tried.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("mined").alias("mined"))
    return decided.unionByName(judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined.verdict", F.lit(default)).alias("verdict")))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
