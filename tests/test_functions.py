import pytest
from pyspark.sql import functions as F

from sitelens.functions import bands, text, urls
from sitelens.functions.numbers import half_up


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "folded"), [("boxes", "box"), ("cats", "cat"), ("glass", "glass"), ("bus", "bus"), ("dishes", "dish")])
def test_fold_plural(spark, word, folded):
    assert one(spark, text.fold_plural(F.col("w")), w=word) == folded


def test_tokens(spark):
    assert one(spark, text.topic_tokens(F.col("t")), t="The 2024 Blue-whale guide of a") == ["blue", "whale", "guide"]
    assert one(spark, text.keyword_tokens(F.col("t")), t="How much is it's e-mail 42") == ["how", "is", "e-mail"]
    assert one(spark, text.ngrams(F.array(*map(F.lit, "abc")))) == ["a b", "b c", "a b c"]
    assert one(spark, text.ngrams(F.array(F.lit("a")))) == []


def test_slug_and_lead(spark):
    assert one(spark, text.slug(F.col("t")), t=" L'Été à Paris! ") == "lete-a-paris"
    assert one(spark, text.leading_content_word(F.col("t")), t="how to fix it") == "fix"


@pytest.mark.parametrize(("url", "answer"), [("https://example.org/a", "ok"), ("ftp://x", "scheme"), ("https://u@h/", "userinfo"), ("http://10.1.2.3/", "private"), ("http://169.254.169.254/", "metadata"), ("http://999.1.1.1/", "address"), ("http://a%62.c/", "percent")])
def test_url_safety(spark, url, answer):
    assert one(spark, urls.url_safety(F.col("u")), u=url) == answer


def test_bands(spark):
    assert one(spark, bands.band_choice(F.lit("action"), F.col("c")), c=0.76) == "act"
    assert one(spark, bands.band_choice(F.lit("intent"), F.col("c")), c=0.81) == "review"
    assert one(spark, bands.gate_floor(F.col("q")), q="trust_bar") == 0.5
    assert one(spark, half_up(F.col("c"), 2), c=0.125) == 0.13
