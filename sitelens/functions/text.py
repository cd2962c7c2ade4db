"""Text functions as column expressions: tokenisers, n-grams, overlaps, wording, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up

#: Words that say nothing about a page's topic.
STOP_WORDS = (
    "about above after again against all also and any are because been before being below between both but can could did does doing done down during each "
    "few for from further had has have having her here hers him his how its itself just may might more most much must not now off once only other our ours out over own "
    "per same she should since some such than that the their theirs them then there these they this those through too under until up use used using very was we were what when "
    "where which while who whom why will with would you your yours"
).split()
#: Words that no query is about.
NOISE = (
    "the and for with that this from have has was were you your our their they will not but all into about over than then them these those such its it's his her she him out off "
    "own same too very just also any each few more most other some only now here get learn read see use used one two page site website home click new via www http https com html amp nbsp "
    "to at by as up down us me my we it be am or if so an nor yet once again must may might shall let lets much many like"
).split()
#: Words that mark a phrase as a question, a comparison, a purchase.
QUERY_MARKERS = "how what when where who why which does do is are should can need want near vs versus best top cheap cheapest free price cost review reviews alternative alternatives compare".split()
COMPARISON_MARKERS = "best vs versus compare alternative alternatives top cheapest".split()
COMMERCIAL_MARKERS = "price cost cheap cheapest free quote buy hire book order near review reviews discount plan plans pricing".split()
#: Words that may begin a term without saying what it is about.
LEADING_NOISE = "the a an and or of for to in on at by with from is are was were be my your our their we you it as that this these those how what when where who why which".split()
#: Phrases that fill a text.
FILLER_PHRASES = (
    "it's important to note that", "in this article, we'll explore", "in this article we will explore", "in today's fast-paced world", "in today's digital age", "in today's competitive landscape",
    "needless to say", "at the end of the day", "when it comes to", "when all is said and done", "in the realm of", "in the world of", "the bottom line is", "without further ado",
    "first and foremost", "last but not least", "for what it's worth", "it goes without saying", "as we all know", "the truth is that", "the fact of the matter is", "more often than not",
    "let's dive in", "let's dive into", "let's take a closer look", "let's take a deeper look",
)


def _one_of(words) -> Column:
    return F.array(*map(F.lit, words))


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, size: int) -> Column:
    clean = normalise(text)
    return F.when(F.length(clean) > size, F.concat(F.substring(clean, 1, size - 1), F.lit("…"))).otherwise(clean)


def _split(text: Column, pattern: str) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), pattern)


def topic_tokens(text: Column) -> Column:
    return F.filter(_split(text, "[^a-z0-9]+"), lambda t: F.length(t).between(3, 28) & ~t.isin(STOP_WORDS) & ~t.rlike("^[0-9]+$"))


def keyword_tokens(text: Column) -> Column:
    return F.filter(_split(text, "[^a-z0-9'-]+"), lambda t: (F.length(t) > 1) & ~t.isin(NOISE) & ~t.rlike("^[0-9]+$"))


#: Words that don't tell one opportunity from another.
OPPORTUNITY_STOP = "a an the and or of for to in on at by with from is are be my your our it this that you we i s vs".split()


def opportunity_tokens(text: Column) -> Column:
    """Words of three letters or more, repeats kept; anything but letters, digits, space and dash parts words."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " "), r"[\s-]+"), lambda t: (F.length(t) > 2) & ~t.isin(OPPORTUNITY_STOP))


def opportunity_slug(text: Column) -> Column:
    """The opportunity tokens with dashes, or if there are none the text with anything else a dash."""
    words = F.array_join(opportunity_tokens(text), "-")
    return F.when(words != "", words).otherwise(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"))


def pair_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(_split(text, "[^a-z0-9]+"), lambda t: F.length(t) > 3))


def fold_plural(word: Column) -> Column:
    return F.when((F.length(word) > 3) & word.rlike("(s|x|z|ch|sh)es$"), F.substr(word, F.lit(1), F.length(word) - 2)).when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(_split(text, "[^a-z0-9]+"), lambda t: F.length(t) > 2), fold_plural))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which a lambda's variable holds, so that it is made once a row however often it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def ngrams(tokens: Column, low: int = 2, high: int = 3) -> Column:
    """Contiguous n-grams, short ones first, repeats kept. Each length comes from the one before and one more word."""

    def longer(t: Column, last: Column, n: int) -> Column:
        left = F.size(t) - n + 1
        grown = F.when(left > 0, F.zip_with(F.slice(last, F.lit(1), left), F.slice(t, F.lit(n), left), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
        return _let(grown, lambda g: kept(t, g, n))

    def kept(t: Column, own: Column, n: int) -> Column:
        if n == high:
            return own
        return F.concat(own, longer(t, own, n + 1)) if n >= low else longer(t, own, n + 1)

    return _let(tokens, lambda t: kept(t, t, 1))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token lists as sets, 3 decimals; 0 if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(half_up(shared / (F.size(x) + F.size(y) - shared), 3))


def has_marker(term: Column, markers) -> Column:
    return F.arrays_overlap(F.split(term, " "), _one_of(markers))


def slug(text: Column, size: int = 72) -> Column:
    """Lower case, accents and apostrophes gone, anything else a dash."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ'’", "aaaaaaceeeeiiiinooooouuuuyy")
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, size), "-+$", "")


def leading_content_word(term: Column) -> Column:
    words = F.filter(_split(term, "[^a-z0-9]+"), lambda t: t != "")
    content = F.filter(words, lambda t: (F.length(t) > 2) & ~F.array_contains(_one_of(LEADING_NOISE), t))
    return F.coalesce(F.get(content, 0), F.get(words, 0), F.lower(term))


def count_figures(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9]+([.,][0-9]+)*%?"))


def raw_contains_value(raw: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (digits != "") & F.contains(F.regexp_replace(raw, "[^0-9]", ""), digits)
