"""Queries of the column functions and of keyword mining, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import text as X
from ..functions import urls as U
from ..functions.numbers import half_up
from ..functions.numbers import half_up_sql as h
from ..operators import keywords as K
from ..operators import rules as R
from .catalog import query
from .fixtures import frame, table, with_adapters


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _split(x: str, pattern: str) -> str:
    return f"string_split_regex(lower({x}), '{pattern}')"


def topic(x: str) -> str:
    return f"list_filter({_split(x, '[^a-z0-9]+')}, lambda t: length(t) BETWEEN 3 AND 28 AND NOT list_contains({_list(X.STOP_WORDS)}, t) AND NOT regexp_full_match(t, '[0-9]+'))"


def keyword(x: str) -> str:
    return f"list_filter({_split(x, '[^a-z0-9''-]+')}, lambda t: length(t) > 1 AND NOT list_contains({_list(X.NOISE)}, t) AND NOT regexp_full_match(t, '[0-9]+'))"


def grams(t: str, low: int = 2, high: int = 3) -> str:
    parts = [f"list_transform(range(1, len({t}) - {n - 2}), lambda i: " + " || ' ' || ".join(f"{t}[i + {k}]" for k in range(n)) + ")" for n in range(low, high + 1)]
    return f"list_concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def jaccard(a: str, b: str) -> str:
    s = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {h(f'{s} / CAST(len(list_distinct({a})) + len(list_distinct({b})) - {s} AS DOUBLE)', 3)} END"


FOLD = "CASE WHEN length({0}) > 3 AND regexp_matches({0}, '(s|x|z|ch|sh)es$') THEN substring({0}, 1, length({0}) - 2) WHEN length({0}) > 3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN substring({0}, 1, length({0}) - 1) ELSE {0} END"


def word_set(x: str) -> str:
    return f"list_distinct(list_transform(list_filter({_split(x, '[^a-z0-9]+')}, lambda t: length(t) > 2), lambda w: {FOLD.format('w')}))"


def marker(term: str, words) -> str:
    return f"list_has_any(string_split({term}, ' '), {_list(words)})"


def pages_query(name: str, columns, sql: dict[str, str], source: str = "fx_pages", key: str = "page_id", inner: str | None = None):
    """A query that computes columns of each row of an adapter; they are made when it runs, as columns need a session."""
    text = f"SELECT {key}, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM {inner or source}"
    query(name, with_adapters(text))(lambda spark, folder: frame(spark, folder, source).select(key, *[c.alias(k) for k, c in columns().items()]))


pages_query("topic_tokens", lambda: {"tokens": F.array_join(X.topic_tokens(F.col("title")), " ")}, {"tokens": f"array_to_string({topic('title')}, ' ')"})
pages_query("keyword_tokens", lambda: {"tokens": F.array_join(X.keyword_tokens(F.col("title")), " ")}, {"tokens": f"array_to_string({keyword('title')}, ' ')"})
pages_query("pair_tokens", lambda: {"tokens": F.array_join(F.array_sort(X.pair_tokens(F.col("title"))), " ")}, {"tokens": f"array_to_string(list_sort(list_distinct(list_filter({_split('title', '[^a-z0-9]+')}, lambda t: length(t) > 3))), ' ')"})
pages_query("word_set", lambda: {"tokens": F.array_join(F.array_sort(X.word_set(F.col("title"))), " ")}, {"tokens": f"array_to_string(list_sort({word_set('title')}), ' ')"})
pages_query("ngrams", lambda: {"grams": F.array_join(X.ngrams(X.keyword_tokens(F.col("title"))), "|")}, {"grams": f"array_to_string({grams('tk')}, '|')"}, inner=f"(SELECT *, {keyword('title')} AS tk FROM fx_pages) p")
pages_query("jaccard", lambda: {"overlap": X.jaccard(X.topic_tokens(F.col("title")), X.topic_tokens(F.col("h1")))}, {"overlap": jaccard("a", "b")}, inner=f"(SELECT *, {topic('title')} AS a, {topic('h1')} AS b FROM fx_pages) p")
pages_query("normalise_text", lambda: {"clean": X.normalise(F.col("title"))}, {"clean": "trim(regexp_replace(title, '\\s+', ' ', 'g'))"})
pages_query("clip", lambda: {"short": X.clip(F.col("title"), 30)}, {"short": "CASE WHEN length(c) > 30 THEN concat(substring(c, 1, 29), '…') ELSE c END"}, inner="(SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS c FROM fx_pages) p")
pages_query("wording_flags", lambda: {"question": X.has_marker(F.lower(F.col("title")), X.QUERY_MARKERS), "comparison": X.has_marker(F.lower(F.col("title")), X.COMPARISON_MARKERS), "commercial": X.has_marker(F.lower(F.col("title")), X.COMMERCIAL_MARKERS)}, {"question": marker("lower(title)", X.QUERY_MARKERS), "comparison": marker("lower(title)", X.COMPARISON_MARKERS), "commercial": marker("lower(title)", X.COMMERCIAL_MARKERS)})
_SLUG = "regexp_replace(regexp_replace(translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ''’', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
pages_query("slug_for", lambda: {"slug": X.slug(F.col("title"))}, {"slug": f"regexp_replace(substring({_SLUG}, 1, 72), '-+$', '')"})
pages_query("leading_content_word", lambda: {"word": X.leading_content_word(F.col("title"))}, {"word": f"coalesce(list_filter(w, lambda t: length(t) > 2 AND NOT list_contains({_list(X.LEADING_NOISE)}, t))[1], w[1], lower(title))"}, inner=f"(SELECT *, list_filter({_split('title', '[^a-z0-9]+')}, lambda t: t <> '') AS w FROM fx_pages) p")
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
pages_query("url_keys", lambda: {"host_key": U.host_key(F.col("url")), "link_key": U.link_key(F.col("url")), "rival_key": U.rival_key(F.col("url")), "site_key": U.site_key(F.col("url")), "domain_of": U.domain_of(F.col("url"))}, {"host_key": rf"regexp_replace({_HOST}, '^www\.', '')", "link_key": f"CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END", "rival_key": "regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '/+$', '')", "site_key": f"concat(lower(regexp_extract(url, '^([A-Za-z]+)://', 1)), '://', {_HOST})", "domain_of": "regexp_replace(regexp_replace(url, '^https?://', ''), '/.*$', '')"})
pages_query("is_public_url", lambda: {"public": U.is_public_url(F.col("url"))}, {"public": f"regexp_matches(url, '^(?i)https?://') AND {_HOST} <> '' AND NOT regexp_full_match({_HOST}, '{U._PRIVATE[1:-1]}')"})
_RISK = f"CASE WHEN regexp_matches(lower({_PATH}), '{'|'.join(U.PARASITE_HIGH)}') THEN 'high' WHEN regexp_matches(lower({_PATH}), '{'|'.join(U.PARASITE_MEDIUM)}') THEN 'medium' WHEN regexp_matches(lower(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)), '{'|'.join(U.PARASITE_LOW)}') THEN 'low' ELSE 'none' END"
pages_query("parasite_risk_of", lambda: {"risk": U.parasite_risk(F.col("url"))}, {"risk": _RISK})


@query("parasite_risk", with_adapters(f"SELECT site, count(*) AS urls, count(*) FILTER (r = 'high') AS high, list_extract(['none', 'low', 'medium', 'high'], CAST(max(CASE r WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END) AS INT)) AS site_risk FROM (SELECT site, {_RISK} AS r FROM fx_pages) x GROUP BY site"))
def _parasite(spark, folder):
    rank = F.array_position(F.array(*map(F.lit, ["none", "low", "medium", "high"])), U.parasite_risk(F.col("url"))).cast("int")
    rows = frame(spark, folder, "fx_pages").select("site", rank.alias("k")).groupBy("site").agg(F.count("*").alias("urls"), F.count_if(F.col("k") == 4).alias("high"), F.max("k").alias("k"))
    return rows.select("site", "urls", "high", F.element_at(F.array(*map(F.lit, ["none", "low", "medium", "high"])), F.col("k")).alias("site_risk"))


@query("fold_plural", with_adapters(f"SELECT DISTINCT w AS word, {FOLD.format('w')} AS folded FROM (SELECT unnest({_split('title', '[^a-z0-9]+')}) AS w FROM fx_pages) x WHERE w <> ''"))
def _fold(spark, folder):
    words = frame(spark, folder, "fx_pages").select(F.explode(F.split(F.lower("title"), "[^a-z0-9]+")).alias("word")).filter("word <> ''").distinct()
    return words.select("word", X.fold_plural(F.col("word")).alias("folded"))


@query("count_figures", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+([.,][0-9]+)*%?')) AS INTEGER) AS figures FROM documents")
def _figures(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.count_figures(F.col("text")).alias("figures"))


@query("parse_rival_list", "SELECT conv_id, turn, trim(x) AS rival FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '[\\n,]')) AS x FROM conversations) y WHERE trim(x) <> ''")
def _rivals(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.explode(U.parse_rival_list(F.col("text"))).alias("rival"))


_BAND = "CASE WHEN p >= coalesce(MAP {" + ", ".join(f"'{k}': {v}" for k, v in B.DECISIVE_BY_QUESTION.items()) + "}[question_id], 0.8) THEN 'act' WHEN p >= 0.2 THEN 'review' ELSE 'escalate' END"
_FLOOR = "coalesce(MAP {" + ", ".join(f"'{k}': {v}" for k, v in B.GATE_FLOOR_BY_QUESTION.items()) + "}[question_id], 0.5)"


@query("answer_bands", with_adapters(f"SELECT item_id, question_id, {_BAND} AS choice_band, CASE WHEN p >= 0.8 OR p <= 0.2 THEN 'act' ELSE 'review' END AS noul_band, CAST({_FLOOR} AS DOUBLE) AS gate_floor, CASE WHEN p * 100 >= 85 THEN 'A' WHEN p * 100 >= 72 THEN 'B' WHEN p * 100 >= 58 THEN 'C' WHEN p * 100 >= 42 THEN 'D' ELSE 'E' END AS grade, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN p >= 0.55 THEN 'P1' WHEN p >= 0.3 THEN 'P2' ELSE 'P3' END AS priority, CASE WHEN p >= 0.9 THEN 'needs a human' WHEN p >= 0.8 THEN 'decisive' WHEN p >= 0.2 THEN 'to verify' ELSE 'needs a human' END AS band_word FROM fx_answers"))
def _bands(spark, folder):
    p, q = F.col("p"), F.col("question_id")
    return frame(spark, folder, "fx_answers").select("item_id", "question_id", B.band_choice(q, p).alias("choice_band"), B.band_noul(p).alias("noul_band"), B.gate_floor(q).alias("gate_floor"), B.grade(p * 100).alias("grade"), B.confidence_label(p).alias("confidence"), B.priority_label(p).alias("priority"), B.band_word(F.when(p >= 0.8, "act").when(p >= 0.2, "review").otherwise("escalate"), p >= 0.9).alias("band_word"))


@query("side_mass", with_adapters(f"SELECT item_id, {h('CASE WHEN p > 0.5 THEN p ELSE 0.0 END + (1 - p) / 2', 6)} AS above, {h('CASE WHEN p > 0.5 THEN 0.0 ELSE p END + (1 - p) / 2', 6)} AS below FROM fx_answers WHERE question_id = 'our_coverage'"))
def _sides(spark, folder):
    p = F.col("p")
    levels = F.map_from_arrays(F.array(F.when(p > 0.5, "3").otherwise("0"), F.when(p > 0.5, "1").otherwise("2"), F.lit("x")), F.array(p, (1 - p) / 2, F.lit(0.0)))
    levels = F.create_map(F.when(p > 0.5, "3").otherwise("0"), p, F.lit("2"), (1 - p) / 2, F.lit("1"), (1 - p) / 2)
    mass = B.side_mass(levels, 4)
    return frame(spark, folder, "fx_answers").filter("question_id = 'our_coverage'").select("item_id", half_up(mass["above"], 6).alias("above"), half_up(mass["below"], 6).alias("below"))


@query("raw_contains_value", "SELECT doc_id, regexp_replace(CAST(n_chars AS VARCHAR), '[^0-9]', '', 'g') <> '' AND contains(regexp_replace(text, '[^0-9]', '', 'g'), regexp_replace(CAST(n_chars AS VARCHAR), '[^0-9]', '', 'g')) AS found FROM documents")
def _raw(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.raw_contains_value(F.col("text"), F.col("n_chars").cast("string")).alias("found"))


# ---- keywords --------------------------------------------------------------------------------------------------------


def prose(spark, folder):
    rows = frame(spark, folder, "fx_prose")
    return rows.withColumn("headings", F.array("h1", "heading"))


_STATS = f"""stat AS (SELECT w.site, word, CAST(sum(n) AS BIGINT) AS word_freq, max(t) > 0 AS in_title FROM (
  SELECT site, unnest({keyword('prose')}) AS word, 1 AS n, 0 AS t FROM fx_prose UNION ALL
  SELECT site, unnest(list_distinct({keyword("title || ' ' || h1")})) AS word, 0 AS n, 1 AS t FROM fx_prose) w GROUP BY w.site, word),
size AS (SELECT site, count(*) AS pages FROM fx_prose GROUP BY site),
named AS (SELECT stat.*, length(word) >= 3 AND (regexp_matches(word, '[0-9]') OR (in_title AND word_freq <= greatest(3.0, pages * 0.25))) AS proper_name FROM stat JOIN size USING (site))"""
_OCC = f"""tok AS (SELECT *, {keyword('title')} AS tt, {keyword('h1')} AS th, {keyword('heading')} AS tg, {keyword('prose')} AS tp FROM fx_prose),
occ AS (
  SELECT site, path, unnest(list_distinct({grams('tt')})) AS term, 1 AS title, 0 AS heading, 0 AS prose FROM tok UNION ALL
  SELECT site, path, unnest(list_distinct({grams('th')})), 0, 1, 0 FROM tok WHERE h1 <> '' UNION ALL
  SELECT site, path, unnest(list_distinct({grams('th')})), 0, 1, 0 FROM tok WHERE h1 <> '' UNION ALL
  SELECT site, path, unnest(list_distinct({grams('tg')})), 0, CASE WHEN heading = h1 OR link_density < 0.25 THEN 1 ELSE 0 END, 0 FROM tok WHERE heading <> '' UNION ALL
  SELECT site, path, unnest({grams('tp')}), 0, 0, 1 FROM tok WHERE link_density < 0.25)"""
_MINED = f"""{_STATS}, {_OCC},
cnt AS (SELECT site, term, count(*) AS frequency, count(DISTINCT path) AS page_count, CAST(sum(heading) AS BIGINT) AS in_headings, CAST(sum(title) AS BIGINT) AS in_title, sum(prose) AS in_prose FROM occ GROUP BY site, term),
ent AS (SELECT DISTINCT c.site, c.term FROM (SELECT site, term, unnest(string_split(term, ' ')) AS word FROM cnt) c JOIN named n ON n.site = c.site AND n.word = c.word AND n.proper_name),
flg AS (SELECT cnt.*, {marker('cnt.term', X.QUERY_MARKERS)} AS question, {marker('cnt.term', X.COMPARISON_MARKERS)} AS comparison, {marker('cnt.term', X.COMMERCIAL_MARKERS)} AS commercial, ent.term IS NOT NULL AS named_entity, CAST(len(string_split(cnt.term, ' ')) AS INTEGER) AS words FROM cnt LEFT JOIN ent ON ent.site = cnt.site AND ent.term = cnt.term WHERE length(cnt.term) >= 6 AND (in_title > 0 OR in_headings > 0 OR in_prose > 0)),
mined AS (SELECT site, term, words, frequency, page_count, in_headings, in_title, question, comparison, commercial, named_entity, NOT named_entity AND NOT (question OR comparison OR commercial) AS broad,
  CAST(frequency + 2 * page_count + 4 * in_headings + 5 * in_title + CASE WHEN question THEN 3 ELSE 0 END + CASE WHEN comparison THEN 3 ELSE 0 END + CASE WHEN commercial THEN 2 ELSE 0 END + CASE WHEN named_entity THEN 2 ELSE 0 END + words * 1.5 AS DOUBLE) AS weight
  FROM flg WHERE in_headings > 0 OR in_title > 0 OR page_count >= 2 OR frequency >= 3 OR question OR comparison OR commercial OR named_entity),
best AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY weight DESC, term) AS r FROM mined) m WHERE r <= 40)"""
_SEEDS = "SELECT DISTINCT source AS site, lower(substring(text, 1, 18)) AS term FROM documents UNION SELECT DISTINCT source AS site, lower(substring(text, 21, 12)) AS term FROM documents"


def seeds(spark, folder):
    d = table(spark, folder, "documents")
    return d.select(F.col("source").alias("site"), F.lower(F.substring("text", 1, 18)).alias("term")).union(d.select("source", F.lower(F.substring("text", 21, 12)))).distinct()


query("corpus_stats", with_adapters(f"WITH {_STATS} SELECT site, word, word_freq, in_title, proper_name FROM named"))(lambda s, f: K.corpus_stats(prose(s, f)))
query("mine_keywords", with_adapters(f"WITH {_MINED} SELECT * FROM best"))(lambda s, f: K.mine_keywords(prose(s, f)))
query("keyword_weight", with_adapters(f"WITH {_MINED} SELECT site, term, weight FROM best"))(lambda s, f: K.mine_keywords(prose(s, f)).select("site", "term", "weight"))
_RUNS = f"""runs AS (
  SELECT site, path, unnest({grams('tt', 1, 9)}) AS term, 'title' AS slot FROM tok UNION ALL
  SELECT site, path, unnest({grams('th', 1, 9)}), 'heading' FROM tok WHERE h1 <> '' UNION ALL
  SELECT site, path, unnest({grams('th', 1, 9)}), 'heading' FROM tok WHERE h1 <> '' UNION ALL
  SELECT site, path, unnest({grams('tg', 1, 9)}), CASE WHEN heading = h1 OR link_density < 0.25 THEN 'heading' ELSE 'other' END FROM tok WHERE heading <> '' UNION ALL
  SELECT site, path, unnest({grams('tp', 1, 9)}), 'prose' FROM tok WHERE link_density < 0.25)"""
_MEASURED = "meas AS (SELECT s.site, s.term, count(*) FILTER (slot = 'title') AS title_hits, count(*) FILTER (slot = 'heading') AS heading_hits, count(*) FILTER (slot = 'prose') AS prose_hits, count(slot) AS frequency, count(DISTINCT path) AS page_count FROM seed s LEFT JOIN runs o ON o.site = s.site AND o.term = s.term GROUP BY s.site, s.term)"
query("measure_terms", with_adapters(f"WITH {_OCC}, {_RUNS}, seed AS ({_SEEDS}), {_MEASURED} SELECT * FROM meas"))(lambda s, f: K.measure_terms(prose(s, f), seeds(s, f)))
query("merge_seeds", with_adapters(f"""WITH {_MINED}, {_RUNS}, asked AS ({_SEEDS}), seed AS (SELECT site, term FROM (SELECT a.site, a.term, row_number() OVER (PARTITION BY a.site ORDER BY a.term) AS r FROM asked a LEFT JOIN best m ON m.site = a.site AND m.term = a.term WHERE m.term IS NULL AND a.term <> '') x WHERE r <= 24), {_MEASURED},
nent AS (SELECT DISTINCT c.site, c.term FROM (SELECT site, term, unnest(string_split(term, ' ')) AS word FROM seed) c JOIN named n ON n.site = c.site AND n.word = c.word AND n.proper_name)
SELECT m.site, m.term, m.weight, a.term IS NOT NULL AS seed, 'mined' AS origin FROM best m LEFT JOIN asked a ON a.site = m.site AND a.term = m.term
UNION ALL SELECT q.site, q.term, CASE WHEN frequency = 0 THEN 1.0 ELSE {h("CAST(frequency + page_count * 2 + heading_hits * 4 + title_hits * 5 AS DOUBLE) + CASE WHEN " + marker('q.term', X.QUERY_MARKERS) + " THEN 3 ELSE 0 END + CASE WHEN " + marker('q.term', X.COMPARISON_MARKERS) + " THEN 3 ELSE 0 END + CASE WHEN " + marker('q.term', X.COMMERCIAL_MARKERS) + " THEN 2 ELSE 0 END + CASE WHEN nent.term IS NOT NULL THEN 2 ELSE 0 END + len(string_split(q.term, ' ')) * CAST(1.5 AS DOUBLE)", 2)} END, true, 'seed' FROM meas q LEFT JOIN nent ON nent.site = q.site AND nent.term = q.term"""))(lambda s, f: K.merge_seeds(prose(s, f), K.mine_keywords(prose(s, f)), seeds(s, f)))
query("seed_clusters", f"WITH seed AS ({_SEEDS}) SELECT site, coalesce(list_filter(string_split(term, ' '), lambda w: length(w) > 3 AND NOT list_contains({_list(X.QUERY_MARKERS)}, w))[1], term) AS anchor, count(*) AS n, min(term) AS first_term FROM seed GROUP BY 1, 2")(lambda s, f: K.seed_clusters(seeds(s, f)))
_TOPIC = f"""tk AS (SELECT *, {topic('title')} AS a, {topic('h1')} AS b, {topic('heading')} AS g, {topic('prose')} AS c, length(path) % 6 + 1 AS level FROM fx_prose),
sc AS (SELECT site, path, phrase, CAST(sum(w) AS BIGINT) AS score FROM (
  SELECT site, path, unnest(list_concat({grams('a', 2, 2)}, a)) AS phrase, 5 AS w FROM tk UNION ALL
  SELECT site, path, unnest(list_concat({grams('b', 2, 2)}, b)), 5 + 4 FROM tk UNION ALL
  SELECT site, path, unnest(list_concat({grams('g', 2, 2)}, g)), CASE WHEN level <= 2 THEN 4 ELSE 2 END FROM tk UNION ALL
  SELECT site, path, unnest({grams('c', 2, 2)}), 1 FROM tk) x GROUP BY site, path, phrase),
rk AS (SELECT *, sum(score) OVER (PARTITION BY site, path) AS total, row_number() OVER (PARTITION BY site, path ORDER BY score DESC, phrase) AS r FROM sc),
top AS (SELECT * FROM rk WHERE r = 1),
sec AS (SELECT site, path, array_to_string(list(phrase ORDER BY r)[1:3], '|') AS secondary FROM (SELECT rk.* FROM rk JOIN top USING (site, path) WHERE rk.r > 1 AND NOT contains(top.phrase, rk.phrase) AND NOT contains(rk.phrase, top.phrase)) y GROUP BY site, path)"""


def outlined(spark, folder):
    level = (F.length("path") % 6 + 1).alias("level")
    return frame(spark, folder, "fx_prose").withColumn("outline", F.array(F.struct(F.lit(1).alias("level"), F.col("h1").alias("text")), F.struct(level, F.col("heading").alias("text"))))


query("page_topic", with_adapters(f"WITH {_TOPIC} SELECT tk.site, tk.path, coalesce(phrase, '') AS \"primary\", coalesce(secondary, '') AS secondary, coalesce({h('score / CAST(total AS DOUBLE)', 3)}, 0.0) AS concentration, {jaccard('a', 'b')} AS title_h1_overlap FROM tk LEFT JOIN top ON top.site = tk.site AND top.path = tk.path LEFT JOIN sec ON sec.site = tk.site AND sec.path = tk.path"))(lambda s, f: K.page_topic(outlined(s, f)).withColumn("secondary", F.array_join("secondary", "|")))
_PAIRSET = f"list_distinct(list_filter({_split(chr(39).join(['title || ', ' ', ' || h1']), '[^a-z0-9]+')}, lambda t: length(t) > 3))"
query("overlapping_page_pairs", with_adapters(f"WITH p AS (SELECT DISTINCT site, path, {_PAIRSET} AS w FROM fx_evidence), j AS (SELECT a.site, a.path AS a, b.path AS b, len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) AS j FROM p a JOIN p b ON a.site = b.site AND a.path < b.path WHERE len(a.w) > 0 AND len(b.w) > 0) SELECT site, a, b, {h('j', 4)} AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY a, b) AS r FROM j WHERE j >= 0.4) x WHERE r <= 40"))(lambda s, f: K.overlapping_page_pairs(frame(s, f, "fx_evidence").dropDuplicates(["site", "path"])))
query("best_existing_path", f"WITH seed AS ({_SEEDS}), t AS (SELECT site, term, unnest({word_set('term')}) AS word FROM seed), p AS (SELECT DISTINCT source AS site, lower(substring(text, 1, 30)) AS path FROM documents), q AS (SELECT site, path, unnest({word_set('path')}) AS word FROM p), n AS (SELECT t.site, term, path, count(*) AS n FROM t JOIN q ON t.site = q.site AND t.word = q.word GROUP BY 1, 2, 3), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, term ORDER BY n DESC, path) AS r FROM n) x WHERE r = 1) SELECT seed.site, seed.term, b.path FROM seed LEFT JOIN b ON b.site = seed.site AND b.term = seed.term")(lambda s, f: K.best_existing_path(seeds(s, f), table(s, f, "documents").select(F.col("source").alias("site"), F.lower(F.substring("text", 1, 30)).alias("path")).distinct()))
