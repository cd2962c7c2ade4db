"""Queries of judgements, decisions, keywords, gaps and rivals over typed answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bands import DECISIVE_BY_QUESTION, GATE_FLOOR_BY_QUESTION, SCORE_MASS_BY_QUESTION, SEVERITY_WEIGHT
from ..functions.numbers import half_up_sql as h
from ..functions.text import LEADING_NOISE, OPPORTUNITY_STOP
from ..operators import judgements as J
from .catalog import query
from .fixtures import frame, table, with_adapters

_D = lambda x: f"CAST({x} AS DOUBLE)"
_LIST = lambda words: "(" + ", ".join(repr(w) for w in words) + ")"
_ONE = lambda q, c: f"max(CASE WHEN question_id = '{q}' THEN {c} END)"


def judged(name: str, sql: str):
    """A query over the adapters, which it gets by name as functions of nothing."""

    def keep(f):
        query(name, with_adapters(sql))(lambda spark, folder: f(lambda n: frame(spark, folder, f"fx_{n}")))
        return f

    return keep


# ---- pages -----------------------------------------------------------------------------------------------------------

_PV = f"pv AS (SELECT site, item_id, {_ONE('page_type', 'choice')} AS page_type, {_ONE('page_type', 'confidence')} AS sure, {_ONE('intent', 'choice')} AS intent, {_ONE('action', 'choice')} AS action, coalesce({_ONE('importance', 'score')} / 3, 0.5) AS importance FROM fx_typed WHERE scope = 'page' GROUP BY site, item_id)"
_BAR = lambda q: f"coalesce(MAP {{{', '.join(f'{k!r}: {v}' for k, v in SCORE_MASS_BY_QUESTION.items())}}}[{q}], 0.8)"
_SD = f"sd AS (SELECT scope, site, item_id, question_id, greatest(sum(CASE WHEN CAST(label AS INTEGER) >= 2 THEN p ELSE 0.0 END), sum(CASE WHEN CAST(label AS INTEGER) < 2 THEN p ELSE 0.0 END)) >= {_BAR('question_id')} AS firm FROM fx_probs WHERE type = 'score' GROUP BY scope, site, item_id, question_id)"
_FLOOR = "coalesce(MAP {" + ", ".join(f"'{k}': {v}" for k, v in GATE_FLOOR_BY_QUESTION.items()) + "}[q], 0.5)"
_ACT = "coalesce(MAP {" + ", ".join(f"'{k}': {v}" for k, v in DECISIVE_BY_QUESTION.items()) + "}[q], 0.8)"
_CL = f"""cl AS (SELECT site, item_id, q, type, kind, CASE WHEN kind = 'finding' THEN CASE WHEN q = 'action' THEN choice ELSE q END END AS finding,
  CASE WHEN kind = 'finding' THEN CASE WHEN q IN ('title_fit', 'meta_fit', 'h1_fit', 'answer_first', 'competitor_distinctiveness') OR (q = 'action' AND choice = 'rewrite' AND importance >= 0.66) THEN 'serious' ELSE 'moderate' END END AS severity,
  {h("CASE type WHEN 'score' THEN score / 3 WHEN 'noul' THEN noul ELSE confidence END", 2)} AS probability FROM (
  SELECT a.*, a.question_id AS q, importance, CASE
    WHEN a.question_id IN ('page_type', 'intent', 'action') AND confidence < coalesce(MAP {{'action': 0.75, 'page_type': 0.85, 'intent': 0.82}}[a.question_id], 0.8) THEN 'reason'
    WHEN a.question_id IN {_LIST(J.SCORE_CHECKS)} AND NOT (coalesce(page_type = 'legal_or_policy' AND sure >= 0.85, false) AND a.question_id NOT IN {_LIST(J.STRUCTURAL)}) THEN
      CASE WHEN NOT coalesce(firm, false) THEN 'reason' WHEN a.score / 3 < 0.45 AND NOT (importance < 0.34 AND a.question_id IN ('helpfulness', 'trust')) THEN 'finding' END
    WHEN a.question_id IN {_LIST(J.GATES)} THEN CASE WHEN noul > 0.2 AND noul < 0.8 THEN 'reason' WHEN noul < CASE a.question_id WHEN 'competitor_distinctiveness' THEN 0.45 ELSE 0.5 END AND NOT (a.question_id = 'clear_next_step' AND coalesce(pv.intent NOT IN ('commercial', 'transactional'), false)) THEN 'finding' END
    WHEN a.question_id = 'action' AND (choice = 'rewrite' OR (choice = 'merge_or_remove' AND words < 600)) THEN 'finding' END AS kind
  FROM fx_typed a JOIN pv ON pv.site = a.site AND pv.item_id = a.item_id LEFT JOIN sd ON sd.scope = a.scope AND sd.site = a.site AND sd.item_id = a.item_id AND sd.question_id = a.question_id
    LEFT JOIN fx_items i ON i.site = a.site AND i.item_id = a.item_id WHERE a.scope = 'page') x WHERE kind IS NOT NULL)"""
_PJ = f"pj AS (SELECT pv.site, pv.item_id, coalesce(page_type, 'unknown') AS page_type, coalesce(intent, 'unknown') AS intent, coalesce(action, 'unknown') AS action, {h('importance', 2)} AS importance, coalesce(r, '') AS reasons, CASE WHEN coalesce(n, 0) = 0 THEN 'act' WHEN n > 2 THEN 'escalate' ELSE 'review' END AS band, coalesce(n, 0) > 0 AS needs_human FROM pv LEFT JOIN (SELECT site, item_id, array_to_string(list_sort(list(q)), ',') AS r, count(*) AS n FROM cl WHERE kind = 'reason' GROUP BY site, item_id) w ON w.site = pv.site AND w.item_id = pv.item_id)"
_PAGE = f"{_PV}, {_SD}, {_CL}, {_PJ}"
_page = lambda fx: J.page_answers(fx("typed"), fx("probs"), fx("items"))
_pages = lambda fx: J.page_judgements(fx("typed"), _page(fx))
for _name, _type in (("score_findings", "score"), ("gate_findings", "noul"), ("action_findings", "choice")):
    judged(_name, f"WITH {_PAGE} SELECT site, item_id, finding, severity, probability FROM cl WHERE kind = 'finding' AND type = '{_type}'")(lambda fx, t=_type: J.findings_of(_page(fx), t))
judged("page_judgements", f"WITH {_PAGE} SELECT * FROM pj")(_pages)
judged("needs_human", f"WITH {_PAGE} SELECT site, count(*) AS pages, count(*) FILTER (needs_human) AS flagged, {h('count(*) FILTER (NOT needs_human) / CAST(count(*) AS DOUBLE)', 3)} AS decisive_share FROM pj GROUP BY site")(lambda fx: J.needs_human(_pages(fx)))
judged("cannibal_findings", f"SELECT site, item_id, item_id + 1 AS b, 'cannibalization' AS finding, 'serious' AS severity, {h('noul', 2)} AS probability FROM fx_typed WHERE question_id = 'h1_fit' AND noul >= 0.6")(lambda fx: J.cannibal_findings(fx("typed").filter("question_id = 'h1_fit'").select("site", F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), "noul")))
_WEIGHT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_WEIGHT.items()) + " END"
judged("findings_union", f"WITH {_PAGE} SELECT site, item_id, finding, severity, source, {_WEIGHT} AS weight FROM (SELECT DISTINCT site, CAST(NULL AS BIGINT) AS item_id, 'noindex' AS finding, 'critical' AS severity, 'rule' AS source FROM fx_items WHERE item_id % 9 = 0 UNION ALL SELECT site, item_id, finding, severity, 'judge' FROM cl WHERE kind = 'finding') u")(
    lambda fx: J.findings_union(fx("items").filter("item_id % 9 = 0").select("site", F.lit("noindex").alias("finding"), F.lit("critical").alias("severity")).distinct(), _page(fx).filter("kind = 'finding'"), SEVERITY_WEIGHT))

# ---- decisions -------------------------------------------------------------------------------------------------------

_TC = f"tc AS (SELECT t.site, t.item_id, t.choice AS change, {h('confidence', 3)} AS p, t.other AS runner_up, r.p AS runner_up_p FROM fx_typed t JOIN (SELECT site, item_id, label, p FROM fx_probs WHERE scope = 'page' AND question_id = 'highest_impact_change') r ON r.site = t.site AND r.item_id = t.item_id AND r.label = t.other AND t.other <> t.choice WHERE t.scope = 'page' AND t.question_id = 'highest_impact_change' AND t.choice <> 'nothing_missing' AND (confidence >= 0.88 OR (confidence - r.p >= {_D(0.2)} AND confidence >= 0.5)))"
_changes = lambda fx: J.top_changes(fx("typed"), fx("probs"))
judged("top_changes", f"WITH {_TC} SELECT * FROM tc")(_changes)
_ASKED = "EXISTS (SELECT 1 FROM fx_typed a WHERE a.scope = 'page' AND a.site = tc.site AND a.item_id = tc.item_id AND a.question_id = {0})"
_FIRST = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in J.FALSIFIER.items()) + "}[change]"
_SECOND = "CASE change " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in J.FALSIFIER_FALLBACK.items()) + " END"
judged("change_falsifier", f"WITH {_TC} SELECT site, item_id, change, CASE WHEN {_ASKED.format(_FIRST)} THEN {_FIRST} WHEN {_ASKED.format(_SECOND)} THEN {_SECOND} ELSE 'page_type' END AS falsifier FROM tc")(lambda fx: J.change_falsifier(_changes(fx), fx("typed")))
_FACTS = {"figures": "item_id % 13", "authors": "item_id % 3", "external_links": "item_id % 8", "inbound": "item_id % 9", "outbound": "item_id % 4", "subheadings": "item_id % 5", "internal_links": "item_id % 21", "title_words": "item_id % 12", "opening_words": "item_id % 60", "first_words": "item_id % 30", "subjects": "1 + item_id % 4"}
_SAID = {"answer_in_the_first_two_sentences": "first_words || ' words in the first two sentences, ' || opening_words || ' in the opening'", "add_self_contained_facts": "figures || ' figures in ' || words || ' words'", "add_proof_and_sources": "authors || ' named authors, ' || external_links || ' outbound links'", "name_an_author": "authors || ' named authors in ' || words || ' words'", "link_onward": "outbound || ' links to crawled pages, ' || inbound || ' from them'", "break_it_into_sections": "subheadings || ' subheadings in ' || words || ' words'", "name_one_action": "internal_links || ' internal links, ' || outbound || ' to crawled pages'", "retitle_for_the_searcher": "title_words || ' words in the title, ' || (item_id % 101) || ' percent of them in the H1'", "narrow_or_split_the_page": "subjects || ' subject phrases in ' || words || ' words'"}
judged("change_witness", f"WITH {_TC} SELECT site, item_id, change, CASE change {' '.join(f'WHEN {k!r} THEN {v}' for k, v in _SAID.items())} END AS witness FROM (SELECT tc.site, tc.item_id, change, words, {', '.join(f'tc.{v} AS {k}' if v[0] == 'i' else f'1 + tc.item_id % 4 AS {k}' for k, v in _FACTS.items())} FROM tc JOIN fx_items i ON i.site = tc.site AND i.item_id = tc.item_id) x")(
    lambda fx: J.change_witness(_changes(fx), fx("items").select("site", "item_id", "words", *[F.expr(v).alias(k) for k, v in _FACTS.items()], ((F.col("item_id") % 101) / 100).alias("title_h1_overlap"))))
_DEC = f"dec AS (SELECT tc.site, tc.item_id, change, {h(f'{_D(0.55)} * coalesce(importance, 0.5) + {_D(0.45)} * coalesce(inbound_share, 0.0)', 4)} AS priority FROM tc LEFT JOIN pv ON pv.site = tc.site AND pv.item_id = tc.item_id LEFT JOIN fx_items i ON i.site = tc.site AND i.item_id = tc.item_id)"
decided = lambda fx: J.decisions(_changes(fx), fx("typed"), fx("items"))
DECIDED_SQL = f"{_PV}, {_TC}, {_DEC}"
judged("decisions", f"WITH {DECIDED_SQL} SELECT * FROM dec")(decided)
judged("run_snapshot", f"WITH {_PAGE}, {_TC}, jd AS (SELECT * FROM pj WHERE item_id % 7 <> 0), fn AS (SELECT site, item_id, count(*) AS n FROM cl WHERE kind = 'finding' GROUP BY site, item_id) SELECT i.site, i.item_id, jd.item_id IS NOT NULL AS reachable, jd.item_id IS NOT NULL AND (change IS NOT NULL OR coalesce(n, 0) > 0) AS raised, change AS change_key, CASE WHEN band IS NULL THEN NULL WHEN band = 'escalate' OR needs_human THEN 'needs a human' WHEN band = 'act' THEN 'decisive' ELSE 'to verify' END AS band_word, coalesce(n, 0) AS findings, coalesce(CASE WHEN i.item_id % 2 = 0 THEN i.item_id % 5 END, 0) AS rule_findings, i.words FROM fx_items i LEFT JOIN jd ON jd.site = i.site AND jd.item_id = i.item_id LEFT JOIN tc ON tc.site = i.site AND tc.item_id = i.item_id LEFT JOIN fn ON fn.site = i.site AND fn.item_id = i.item_id")(
    lambda fx: J.run_snapshot(fx("items"), _pages(fx).filter("item_id % 7 <> 0"), _changes(fx), _page(fx).filter("kind = 'finding'"), fx("items").filter("item_id % 2 = 0").select("site", "item_id", (F.col("item_id") % 5).alias("rule_findings"))))
judged("link_suggestions", f"WITH {_PAGE}, f AS (SELECT DISTINCT site, item_id FROM cl WHERE finding IN ('clear_next_step', 'rewrite')), c AS (SELECT f.site, f.item_id, o.item_id AS target, o.intent = p.intent AS same_intent, row_number() OVER (PARTITION BY f.site, f.item_id ORDER BY o.intent = p.intent DESC, o.importance DESC, o.item_id) AS k FROM f JOIN pj p ON p.site = f.site AND p.item_id = f.item_id JOIN pj o ON o.site = f.site AND o.item_id <> f.item_id) SELECT site, item_id, target, same_intent FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY item_id) AS r FROM c WHERE k = 1) x WHERE r <= 20")(lambda fx: J.link_suggestions(_page(fx), _pages(fx)))

# ---- keywords --------------------------------------------------------------------------------------------------------

_GREY = lambda q: f"CASE WHEN {q} > 0.2 AND {q} < 0.8 THEN "
_KW = "kw0 AS (SELECT site, item_id, " + ", ".join(f"{_ONE(q, c)} AS {n}" for n, q, c in (("intent", "intent", "choice"), ("intent_sure", "intent", "confidence"), ("cluster", "cluster", "choice"), ("cluster_sure", "cluster", "confidence"), ("buyer", "is_buyer_query", "noul"), ("real", "is_real_query", "noul"), ("gap", "coverage_gap", "noul"), ("trust", "trust_bar", "noul"), ("hard", "difficulty_proxy", "score"))) + " FROM fx_typed WHERE scope = 'keyword' GROUP BY site, item_id)"
_KR = "list_filter([CASE WHEN intent_sure < 0.8 THEN 'intent' END, CASE WHEN cluster_sure < 0.8 THEN 'cluster' END, " + ", ".join(f"{_GREY(c)}'{n}' END" for c, n in (("buyer", "is_buyer_query"), ("real", "is_real_query"), ("gap", "coverage_gap"), ("trust", "trust_bar"))) + ", CASE WHEN hard IS NOT NULL AND NOT coalesce(firm, false) THEN 'difficulty_proxy' END], lambda x: x IS NOT NULL)"
_KJ = f"kj AS (SELECT site, item_id, coalesce(intent, 'unknown') AS intent, coalesce(cluster, 'unknown') AS cluster, coalesce(buyer, 0.0) AS is_buyer_query, coalesce(real, 0.0) AS is_real_query, coalesce(gap, 0.0) AS coverage_gap, coalesce(trust, 0.5) AS trust_bar, coalesce({h('hard / 3', 3)}, 0.5) AS difficulty_proxy, array_to_string(rs, ',') AS reasons, CASE WHEN len(rs) = 0 THEN 'act' WHEN len(rs) > 1 THEN 'escalate' ELSE 'review' END AS band, len(rs) > 0 AS needs_human FROM (SELECT k.*, {_KR} AS rs FROM kw0 k LEFT JOIN (SELECT * FROM sd WHERE scope = 'keyword') s ON s.site = k.site AND s.item_id = k.item_id) y)"
_OPP = h(f"{_D(0.4)} * CASE WHEN is_buyer_query >= 0.5 THEN 1.0 ELSE 0.0 END * CASE WHEN is_real_query >= 0.5 THEN 1.0 ELSE 0.0 END + {_D(0.35)} * coverage_gap + {_D(0.15)} * least(CAST(in_headings AS DOUBLE) / 3, {_D(1)}) + {_D(0.1)} * least(CAST(page_count AS DOUBLE) / 4, {_D(1)})", 3)
_KO = f"ko AS (SELECT kj.*, term, in_headings, page_count, {_OPP} AS opportunity FROM kj JOIN fx_items i ON i.site = kj.site AND i.item_id = kj.item_id)"
_KEY = f"{_SD}, {_KW}, {_KJ}, {_KO}"
_ABLE = "is_real_query >= 0.5 AND is_buyer_query >= 0.2 AND band <> 'escalate'"
_words = lambda fx: J.keyword_judgements(fx("typed"), fx("probs"))
_keys = lambda fx: J.keyword_opportunity(_words(fx), fx("items"))
judged("keyword_judgements", f"WITH {_KEY} SELECT * FROM kj")(_words)
judged("keyword_opportunity", f"WITH {_KEY} SELECT site, item_id, opportunity FROM ko")(lambda fx: _keys(fx).select("site", "item_id", "opportunity"))
_TOP = "(SELECT site, item_id, opportunity, row_number() OVER (PARTITION BY site ORDER BY opportunity DESC, item_id) AS r FROM ko WHERE {0}) x"
judged("actionable_keywords", f"WITH {_KEY} SELECT site, item_id, opportunity FROM {_TOP.format(_ABLE)} WHERE r <= 12")(lambda fx: J.actionable_keywords(_keys(fx)))
judged("gap_candidates", f"WITH {_KEY} SELECT x.site, x.item_id, opportunity FROM {_TOP.format('is_real_query >= 0.5')} JOIN fx_items i ON i.site = x.site AND i.item_id = x.item_id WHERE r <= 8 AND (is_seed OR x.site IN (SELECT site FROM fx_titles))")(lambda fx: J.gap_candidates(_keys(fx), fx("items").filter("is_seed"), fx("titles")))
judged("rejection_summary", f"WITH {_KEY} SELECT site, CASE WHEN is_real_query < 0.5 THEN 'chrome' WHEN band = 'escalate' THEN 'greyZone' ELSE 'notBuyer' END AS why, count(*) AS n, string_agg(term, '|' ORDER BY term) AS terms FROM ko WHERE NOT ({_ABLE}) GROUP BY 1, 2")(lambda fx: J.rejection_summary(_keys(fx)).withColumn("terms", F.array_join("terms", "|")))
judged("pattern_counts", f"WITH {_PAGE}, {_KW}, {_KJ} SELECT site, pattern, label, n, {h('n / CAST(sum(n) OVER (PARTITION BY site, pattern) AS DOUBLE)', 3)} AS share FROM (SELECT site, pattern, label, count(*) AS n FROM (SELECT site, 'page_type' AS pattern, page_type AS label FROM pj UNION ALL SELECT site, 'intent', intent FROM pj UNION ALL SELECT site, 'action', action FROM pj UNION ALL SELECT site, 'keyword_intent', intent FROM kj UNION ALL SELECT site, 'keyword_cluster', cluster FROM kj) u GROUP BY 1, 2, 3) v")(lambda fx: J.pattern_counts(_pages(fx), _words(fx)))
_LABEL = "CASE WHEN band = 'escalate' THEN 'needs a human' ELSE 'to verify' END"
judged("not_decided", f"WITH {_PAGE}, {_TC}, {_KW}, {_KJ}, op AS (SELECT pj.* FROM pj LEFT JOIN tc ON tc.site = pj.site AND tc.item_id = pj.item_id WHERE tc.item_id IS NULL) SELECT op.site, 'page' AS source, op.item_id, CASE WHEN choice IS NULL THEN 'no answer' WHEN choice = 'nothing_missing' THEN 'nothing missing' ELSE 'uncertain' END AS reason, 'to verify' AS label FROM op LEFT JOIN (SELECT * FROM fx_typed WHERE scope = 'page' AND question_id = 'highest_impact_change') t ON t.site = op.site AND t.item_id = op.item_id UNION ALL SELECT pj.site, 'page', pj.item_id, pj.reasons, {_LABEL} FROM pj WHERE needs_human AND (site, item_id) NOT IN (SELECT (site, item_id) FROM op) UNION ALL SELECT site, 'keyword', item_id, reasons, {_LABEL} FROM kj WHERE needs_human")(
    lambda fx: J.not_decided(fx("typed"), _changes(fx), _pages(fx), _words(fx)))
_CONF = f"cf AS (SELECT scope, site, item_id, {h('CAST(sum(CAST(p AS DECIMAL(18,6))) AS DOUBLE) / count(*)', 3)} AS confidence FROM (SELECT scope, site, item_id, question_id, max(p) AS p FROM fx_probs GROUP BY ALL) m GROUP BY scope, site, item_id)"
_TOK = lambda c: f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\\s-]', ' ', 'g'), '[\\s-]+'), lambda t: length(t) > 2 AND t NOT IN {_LIST(OPPORTUNITY_STOP)})"
_RIV = f"rv AS (SELECT site, item_id, regexp_replace(regexp_replace(rival, '^https?://', ''), '/.*$', '') AS rival, title, array_to_string(list_filter(w, lambda x: list_contains(tw, x)), '|') AS shared, {h('s', 4)} AS strength, CAST(substr(rival, 14, 1) AS INTEGER) * 20 AS score, CAST(CAST(substr(rival, 14, 1) AS INTEGER) AS DOUBLE) / 10 AS worth_copying FROM (SELECT *, row_number() OVER (PARTITION BY site, item_id ORDER BY s DESC, rival, place) AS r FROM (SELECT i.site, i.item_id, i.w, t.w AS tw, t.rival, t.place, t.title, len(list_filter(i.w, lambda x: list_contains(t.w, x))) / CAST(len(i.w) AS DOUBLE) AS s FROM (SELECT *, {_TOK('term')} AS w FROM fx_items) i JOIN (SELECT *, {_TOK('title')} AS w FROM fx_titles) t ON t.site = i.site WHERE len(i.w) > 0) a WHERE s >= 0.34) b WHERE r = 1)"
_SLUG = f"CASE WHEN len({_TOK('term')}) > 0 THEN array_to_string({_TOK('term')}, '-') ELSE regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g') END"
_DEST = f"ds AS (SELECT site, item_id, CASE WHEN page_count > 0 THEN concat('/b/', CAST(item_id % 8 AS VARCHAR)) ELSE concat('/', CASE WHEN cluster IN ('other', 'unknown') THEN 'guides' ELSE replace(cluster, '_', '-') END, '/', {_SLUG}) END AS destination, CASE WHEN page_count > 0 THEN 'extend' ELSE 'new' END AS kind FROM ko)"
_PAGES_OF = "CASE cluster || '|' || intent " + " ".join(f"WHEN '{c}|{i}' THEN '{v}'" for c, row in J.PAGE_OF_CLUSTER.items() for i, v in row.items()) + " ELSE CASE intent " + " ".join(f"WHEN '{i}' THEN '{v}'" for i, v in J.PAGE_OF_INTENT.items()) + " ELSE 'guide page' END END"
_STATE = "CASE WHEN page_count = 0 THEN CASE WHEN coverage_gap >= 0.5 THEN 'gap: nothing' ELSE 'gap: mentioned' END WHEN page_count = 1 THEN 'thin: one page' WHEN coverage_gap < 0.4 THEN 'ok: covered' WHEN in_headings >= 2 THEN 'thin: split section' ELSE 'gap: scattered' END"
_PWORD = "CASE WHEN priority >= 0.55 THEN 'P1' WHEN priority >= 0.3 THEN 'P2' ELSE 'P3' END"
_CWORD = "CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END"


def _carriers(fx):
    i = fx("items").filter("page_count > 0")
    one = lambda name, x: i.select("site", "item_id", F.concat(F.lit(f"/{name}/"), F.col("item_id") % 8).alias("path"), F.lit(x).alias("importance"))
    return one("a", 0.4).unionByName(one("b", 0.6))


judged("match_rival", f"WITH {_RIV} SELECT * FROM rv")(lambda fx: J.match_rival(fx("items"), fx("titles"), fx("titles").select("site", "rival", (F.substring("rival", 14, 1).cast("int") * 20).alias("score"), (F.substring("rival", 14, 1).cast("double") / 10).alias("worth_copying")).distinct()).withColumn("shared", F.array_join("shared", "|")))
judged("destination_of", f"WITH {_KEY}, {_DEST} SELECT * FROM ds")(lambda fx: J.destination_of(_keys(fx), _carriers(fx)))
judged("our_state_of", f"WITH {_KEY} SELECT site, item_id, {_STATE} AS our_state FROM ko")(lambda fx: _keys(fx).select("site", "item_id", J.our_state(F.col("page_count"), F.col("coverage_gap"), F.col("in_headings")).alias("our_state")))
judged("content_type_of", f"WITH {_KEY} SELECT site, item_id, {_PAGES_OF} AS write FROM kj")(lambda fx: _words(fx).select("site", "item_id", J.content_type_of(F.col("cluster"), F.col("intent")).alias("write")))
judged("opportunity_board", f"WITH {_KEY}, {_CONF}, {_RIV}, {_DEST}, bd AS (SELECT ko.site, ko.item_id, {h(f'{_D(0.5)} * opportunity + {_D(0.3)} * coverage_gap + {_D(0.2)} * CASE WHEN is_buyer_query >= 0.5 THEN 1.0 ELSE 0.0 END', 3)} AS priority, coalesce(confidence, 0.0) AS confidence, {_STATE} AS our_state, {_PAGES_OF} AS write, destination, kind, rival FROM ko LEFT JOIN cf ON cf.scope = 'keyword' AND cf.site = ko.site AND cf.item_id = ko.item_id JOIN ds ON ds.site = ko.site AND ds.item_id = ko.item_id LEFT JOIN rv ON rv.site = ko.site AND rv.item_id = ko.item_id) SELECT *, {_PWORD} AS priority_word, {_CWORD} AS confidence_word FROM bd")(
    lambda fx: J.opportunity_board(_keys(fx), fx("probs"), fx("titles"), _carriers(fx)))

# ---- gaps ------------------------------------------------------------------------------------------------------------

_NOULS = ("is_real_query", "is_buyer_query", "rival_serves", "our_serves", "our_own_subject")
_GP = "gp0 AS (SELECT site, item_id, " + ", ".join(f"coalesce({_ONE(q, 'noul')}, 0.5) AS {q}" for q in _NOULS) + f", {_ONE('our_coverage', 'score')} AS coverage, {_ONE('deliverable', 'choice')} AS deliverable, {_ONE('deliverable', 'confidence')} AS sure FROM fx_typed WHERE scope = 'gap' GROUP BY site, item_id)"
_BUCKET = "CASE WHEN our_serves < 0.5 THEN CASE WHEN rival_serves >= 0.5 THEN 'missing' ELSE 'untapped' END WHEN rival_serves >= 0.5 THEN 'shared' WHEN our_own_subject >= 0.5 THEN 'unique' WHEN coalesce(coverage, 0.0) >= 3 THEN 'strong' ELSE 'weak' END"
_SL = "regexp_replace(substring(regexp_replace(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 72), '-+$', '')"
_PRI = f"({_D(0.26)} * is_buyer_query + {_D(0.2)} * rival_serves + {_D(0.14)} * CASE WHEN our_serves < 0.5 THEN 1.0 ELSE 0.0 END + {_D(0.1)} * CASE WHEN bucket = 'weak' THEN 1.0 ELSE 0.0 END + {_D(0.08)} * our_own_subject) * CAST(CASE bucket " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in J.BUCKET_WEIGHT.items()) + f" END AS DOUBLE) * CASE WHEN is_real_query <= 0.2 THEN 0.0 ELSE least({_D(1)}, (is_real_query - {_D(0.2)}) / ({_D(0.5)} - {_D(0.2)})) END"
_GAP = f"""{_GP}, gp AS (SELECT g.*, term, existing, first_path, page_count, rival_pages, {_BUCKET} AS bucket, coalesce(CASE deliverable WHEN 'how_to' THEN 'how-to' WHEN 'refresh_existing' THEN 'refresh' ELSE deliverable END, 'none') AS content_type FROM gp0 g JOIN fx_items i ON i.site = g.site AND i.item_id = g.item_id),
gr AS (SELECT site, item_id, term, bucket, content_type, CASE WHEN content_type = 'none' THEN '' WHEN content_type = 'refresh' AND first_path IS NOT NULL THEN coalesce(existing, first_path) WHEN content_type = 'product' THEN coalesce(existing, '/' || {_SL}) ELSE '/' || {_SL} END AS target_path, {h(f'greatest({_D(0)}, least({_D(1)}, {_PRI}))', 6)} AS priority,
  CASE WHEN bucket <> 'untapped' AND coverage / 3 >= 0.99 THEN 'act' WHEN sure < 0.2 THEN 'escalate' WHEN sure < 0.8 THEN 'review' WHEN rival_serves >= 0.8 OR rival_serves <= 0.2 THEN 'act' ELSE 'review' END AS band,
  is_real_query < 0.5 OR (bucket = 'missing' AND our_serves > 0.35) OR (bucket = 'untapped' AND rival_serves > 0.65) OR (our_serves > 0.2 AND our_serves < 0.8) OR rival_pages = 0 AS needs_human,
  array_to_string(list_filter([CASE WHEN rival_pages = 0 THEN 'no rival crawled' WHEN rival_serves >= 0.5 THEN 'rival serves' ELSE 'rival does not serve' END, CASE WHEN our_serves >= 0.5 THEN 'we serve on ' || CAST(page_count AS VARCHAR) ELSE 'we do not serve' END, CASE WHEN is_buyer_query >= 0.5 THEN 'buyer' END], lambda x: x IS NOT NULL), ', ') AS reasons, is_real_query, rival_serves, our_own_subject >= 0.5 AS own_subject, first_path FROM gp)"""
_gaps = lambda fx: J.gap_rows(fx("typed"), fx("items").select("site", "item_id", "term", "existing", "first_path", "page_count", "rival_pages"))
judged("gap_rows", f"WITH {_GAP} SELECT * FROM gr")(_gaps)
judged("target_path", f"WITH {_GAP} SELECT site, item_id, target_path FROM gr")(lambda fx: _gaps(fx).select("site", "item_id", "target_path"))
judged("opportunity_from_gaps", f"WITH {_GAP}, {_CONF} SELECT gr.site, gr.item_id, bucket, CASE WHEN bucket IN ('strong', 'shared') THEN 'ok' WHEN bucket = 'weak' THEN 'thin' ELSE 'gap' END AS tone, content_type AS write, target_path AS destination, CASE WHEN first_path IS NULL THEN 'new' ELSE 'extend' END AS kind, priority, {_PWORD} AS priority_word, coalesce(confidence, 0.0) AS confidence, {_CWORD} AS confidence_word, needs_human OR band = 'escalate' AS grey_zone FROM gr LEFT JOIN cf ON cf.scope = 'gap' AND cf.site = gr.site AND cf.item_id = gr.item_id WHERE content_type <> 'none'")(lambda fx: J.opportunity_from_gaps(_gaps(fx), fx("probs")))
_LEAD = f"coalesce(list_filter(w, lambda t: length(t) > 2 AND NOT list_contains([{', '.join(repr(x) for x in LEADING_NOISE)}], t))[1], w[1], lower(term))"
_SUB = f"""{_GAP}, s1 AS (SELECT *, {_LEAD} AS lead, CASE WHEN bucket IN ('shared', 'strong') THEN 'refresh' ELSE content_type END AS kind, CASE WHEN is_real_query >= 0.5 AND is_seed THEN 1 WHEN rival_serves >= 0.5 THEN 2 ELSE 3 END AS tier FROM (SELECT gr.*, is_seed, list_filter(string_split_regex(lower(gr.term), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM gr JOIN fx_items i ON i.site = gr.site AND i.item_id = gr.item_id WHERE content_type <> 'none') a),
s2 AS (SELECT *, row_number() OVER (PARTITION BY site, kind, own_subject, lead ORDER BY priority DESC, term, item_id) AS r FROM s1),
sn AS (SELECT site, string_agg(title, '|' ORDER BY k) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY rival, place) AS k FROM fx_titles) t WHERE k <= 4 GROUP BY site),
sb AS (SELECT g.site, concat_ws(':', kind, CASE WHEN own_subject THEN 'own' ELSE 'theirs' END, lead) AS subject, kind, label, phrases, terms, CASE WHEN kind = 'refresh' AND own_page IS NOT NULL THEN own_page ELSE target END AS target_path, tier <= 2 AND kind <> 'refresh' AND NOT held AS is_new_page, ['typed', 'rival', 'own text'][tier] AS tier, our_state, band, {h('priority', 4)} AS priority, CASE WHEN rivalled THEN coalesce(seen, '') ELSE '' END AS rivals FROM (
  SELECT site, kind, own_subject, lead, count(*) AS terms, max(priority) AS priority, max(CASE WHEN r = 1 THEN term END) AS label, max(CASE WHEN r = 1 THEN bucket END) AS our_state, max(CASE WHEN r = 1 THEN band END) AS band, max(CASE WHEN r = 1 THEN target_path END) AS target, max(CASE WHEN r = 1 THEN first_path END) AS own_page, string_agg(term, '|' ORDER BY r) FILTER (r <= 4) AS phrases, min(tier) AS tier, bool_or(first_path IS NOT NULL) AS held, bool_or(rival_serves >= 0.5) AS rivalled FROM s2 GROUP BY site, kind, own_subject, lead) g LEFT JOIN sn ON sn.site = g.site)"""
_subjects = lambda fx: J.subjects(_gaps(fx), fx("items").filter("is_seed"), fx("titles"))
judged("subjects", f"WITH {_SUB} SELECT * FROM sb")(_subjects)
judged("pages_to_build", f"WITH {_SUB} SELECT site, subject, label, priority, CAST(CASE WHEN is_new_page THEN row_number() OVER (PARTITION BY site, is_new_page ORDER BY priority DESC, subject) END AS INTEGER) AS place FROM sb")(lambda fx: J.pages_to_build(_subjects(fx)))

# ---- rivals, registry, payloads --------------------------------------------------------------------------------------

_CARDS = f"rc AS (SELECT site, item_id, reachable, CASE WHEN reachable THEN sc ELSE 0 END AS score, CASE WHEN NOT reachable THEN 'E' WHEN sc >= 85 THEN 'A' WHEN sc >= 72 THEN 'B' WHEN sc >= 58 THEN 'C' WHEN sc >= 42 THEN 'D' ELSE 'E' END AS grade, CASE WHEN reachable THEN bm END AS business_model, CASE WHEN reachable THEN ag END AS ai_gap, CASE WHEN reachable THEN coalesce(wc, 0.0) ELSE 0.0 END AS worth_copying FROM (SELECT i.site, i.item_id, i.item_id % 5 <> 0 AS reachable, CAST({h(f'greatest({_D(0)}, least({_D(100)}, coalesce((vp / 3 + tf / 3) / 2, 0.5) * 100 - i.item_id % 40 + CASE WHEN i.item_id % 2 = 0 THEN 6 ELSE 0 END))')} AS INTEGER) AS sc, bm, ag, wc FROM fx_items i LEFT JOIN (SELECT site, item_id, {_ONE('value_prop', 'score')} AS vp, {_ONE('topical_focus', 'score')} AS tf, {_ONE('worth_copying', 'noul')} AS wc, {_ONE('business_model', 'choice')} AS bm, {_ONE('ai_gap', 'choice')} AS ag FROM fx_typed WHERE scope = 'competitor' GROUP BY site, item_id) c ON c.site = i.site AND c.item_id = i.item_id) z)"
_i = F.col
_cards = lambda fx: J.rival_scorecards(fx("items").select("site", "item_id", (_i("item_id") % 5 != 0).alias("reachable"), (_i("item_id") % 2 == 0).alias("https"), (_i("item_id") % 40).alias("penalty")), fx("typed"), _titles(fx))
_titles = lambda fx: fx("items").select("site", (_i("item_id") % 50).alias("item_id"), _i("item_id").alias("place"), F.when(_i("item_id") % 7 == 0, "").otherwise(_i("term")).alias("title"))
judged("rival_scorecards", f"WITH {_CARDS}, tt AS (SELECT site, item_id % 50 AS item_id, term, item_id % 7 = 0 AS bare, row_number() OVER (PARTITION BY site, item_id % 50 ORDER BY item_id) AS r FROM fx_items), tp AS (SELECT site, item_id, string_agg(term, '|' ORDER BY r) AS topics FROM tt WHERE r <= 12 AND NOT bare GROUP BY site, item_id) SELECT rc.*, CASE WHEN reachable THEN coalesce(topics, '') ELSE '' END AS topics FROM rc LEFT JOIN tp ON tp.site = rc.site AND tp.item_id = rc.item_id")(lambda fx: _cards(fx).withColumn("topics", F.array_join("topics", "|")))
judged("rival_counts", f"WITH {_CARDS} SELECT site, count(*) FILTER (reachable) AS reachable, count(*) FILTER (reachable AND worth_copying >= 0.5) AS worth_copying, max(CASE WHEN reachable THEN score END) AS best FROM rc GROUP BY site")(lambda fx: J.rival_counts(_cards(fx)))
_CAP = "cp AS (SELECT root AS site, path AS rival, CASE WHEN r > 5 THEN 'past_the_cap' WHEN reachable THEN 'judged' ELSE 'unreachable' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS r FROM fx_runs WHERE run_no = 1) x)"
_capped = lambda fx: J.rival_cap(fx("runs").filter("run_no = 1").select(_i("root").alias("site"), _i("path").alias("rival"), "reachable"), 9)
judged("rival_cap", f"WITH {_CAP} SELECT * FROM cp")(_capped)
judged("rival_cap_counts", f"WITH {_CAP} SELECT site, count(*) AS requested, count(*) FILTER (state <> 'past_the_cap') AS attempted, count(*) FILTER (state = 'judged') AS judged, count(*) FILTER (state = 'unreachable') AS unreachable, count(*) FILTER (state = 'past_the_cap') AS past_the_cap FROM cp GROUP BY site")(lambda fx: J.rival_cap_counts(_capped(fx)))
judged("threshold_coverage", f"SELECT DISTINCT question_id, type FROM fx_typed WHERE NOT (type = 'choice' AND question_id IN {_LIST(DECISIVE_BY_QUESTION)}) AND NOT (type = 'score' AND question_id IN {_LIST(SCORE_MASS_BY_QUESTION)}) AND NOT (type = 'noul' AND question_id IN {_LIST(GATE_FLOOR_BY_QUESTION)})")(lambda fx: J.threshold_coverage(fx("typed").select("question_id", "type")))
_REG = "reg AS (SELECT DISTINCT scope, question_id, type, concat(question_id, CASE WHEN length(question_id) % 2 = 0 THEN ', Untrusted text' ELSE '' END) AS instructions, CASE WHEN type = 'choice' THEN choice END AS options, CASE WHEN type = 'score' AND length(question_id) % 3 = 0 THEN 'very good' ELSE 'the page names it' END AS level, CASE WHEN length(question_id) % 5 = 0 THEN '' ELSE 'text' END AS fields FROM fx_typed WHERE item_id % 50 = 1 UNION ALL SELECT 'page', 'unheard_of', 'noul', 'Untrusted text', NULL, 'the page names it', 'text')"
_LINT = {"no untrusted clause": "NOT contains(lower(instructions), 'untrusted')", "fewer than two options": "type = 'choice'", "no way out": "type = 'choice' AND NOT regexp_matches(options, '^(other|none|unclear|unknown|cannot_tell|not_.*|nothing_.*|mixed.*)$')", "level is a degree": "type = 'score' AND level = 'very good'", "level is vague": "type = 'score' AND level = 'very good'", "no field": "fields = ''", "not mapped to fields": "scope = 'page' AND question_id NOT IN ('page_type', 'intent', 'importance', 'action', 'helpfulness', 'specificity', 'citable', 'trust', 'highest_impact_change', 'h1_fit', 'answer_first', 'title_fit', 'meta_fit', 'clear_next_step', 'structure_ease', 'content_freshness', 'competitor_distinctiveness')"}
_unmapped = lambda fx: fx("typed").sparkSession.sql("SELECT 'page' AS scope, 'unheard_of' AS question_id, 'noul' AS type, 'Untrusted text' AS instructions, CAST(NULL AS STRING) AS options, array('the page names it', 'the page names it') AS levels, 'text' AS fields")
judged("rubric_lint", f"WITH {_REG} " + " UNION ALL ".join(f"SELECT scope, question_id, '{k}' AS problem FROM reg WHERE {v}" for k, v in _LINT.items()) + " UNION ALL SELECT 'falsifier', f.v, 'not asked: ' || f.k FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in J.FALSIFIER.items()) + ") f(k, v) WHERE f.v NOT IN (SELECT question_id FROM reg WHERE scope = 'page')")(
    lambda fx: J.rubric_lint(fx("typed").filter("item_id % 50 = 1").select("scope", "question_id", "type", F.concat("question_id", F.when(F.length("question_id") % 2 == 0, ", Untrusted text").otherwise("")).alias("instructions"), F.when(_i("type") == "choice", _i("choice")).alias("options"), F.when((_i("type") == "score") & (F.length("question_id") % 3 == 0), F.array(F.lit("very good"), F.lit("the page names it"))).otherwise(F.array(F.lit("the page names it"), F.lit("the page names it"))).alias("levels"), F.when(F.length("question_id") % 5 == 0, "").otherwise("text").alias("fields")).distinct().unionByName(_unmapped(fx))))


_LIMIT = 1500
_PAGE = """doc AS (SELECT source AS site, doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN 'a business' END AS business, CASE WHEN doc_id % 8 <> 1 THEN substring(text, 1, 60) END AS title, substring(text, 61, 40) AS h1, substring(text, 41, 600) AS opening, text,
  string_split(coalesce(text, ''), '. ') AS paragraphs, n_chars AS words, CASE WHEN doc_id % 2 = 0 THEN list_transform(range(1, 1 + doc_id % 30), lambda i: struct_pack(level := CAST(i % 6 + 1 AS INTEGER), text := concat('Head ', CAST(i AS VARCHAR)))) ELSE [] END AS outline, list_transform(range(1, 1 + doc_id % 50), lambda i: concat('Title ', CAST(i AS VARCHAR))) AS titles, doc_id % 5 AS kind FROM documents),
got AS (SELECT site, item_id, CASE WHEN kind IN (0, 4) THEN nullif(business, '') END AS business, CASE WHEN kind IN (0, 2, 3) THEN nullif(title, '') END AS title, CASE WHEN kind IN (0, 2, 3) THEN nullif(h1, '') END AS h1, CASE WHEN kind IN (0, 1, 2) THEN nullif(substring(opening, 1, 500), '') END AS opening, CASE WHEN kind IN (0, 1, 2) THEN nullif(substring(text, 1, 4000), '') END AS text,
  CASE WHEN kind = 1 THEN paragraphs[1:8] END AS paragraphs, CASE WHEN kind IN (1, 2, 4) THEN words END AS words, CASE WHEN kind IN (0, 3) AND len(outline) > 0 THEN outline[1:24] END AS outline, CASE WHEN kind = 4 AND len(titles) > 0 THEN titles END AS titles FROM doc)"""
_CUTS = {"text": [2000, 1000, 600, 400, 250, 150, 80, 0], "paragraphs": [4, 2, 1], "outline": [12, 6, 3], "titles": [40, 20, 10, 5, 2], "opening": [400, 200, 100, 50]}
_NAME = {"outline": "heading_outline"}
_cut = lambda n, c: n if c is None else f"substring({n}, 1, {c})" if n in ("text", "opening") else f"{n}[1:{c}]"
_steps, _before = [], "a0 AS (SELECT *, length(CAST(json_merge_patch('{}', to_json({'business': business, 'page': CASE WHEN title IS NOT NULL OR h1 IS NOT NULL OR words IS NOT NULL THEN {'title': title, 'h1': h1, 'words': words} END})) AS VARCHAR)) + " + " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE length(CAST(to_json({n}) AS VARCHAR)) + {len(_NAME.get(n, n)) + 4} END" for n in _CUTS) + " AS total FROM got)"
for _k, (_n, _caps) in enumerate(_CUTS.items()):
    _len = lambda c: f"CASE WHEN {_n} IS NULL THEN 0 ELSE length(CAST(to_json({_cut(_n, c)}) AS VARCHAR)) + {len(_NAME.get(_n, _n)) + 4} END"  # noqa: B023, E731
    _rest = f"total - ({_len(None)})"
    _at = "CASE " + " ".join(f"WHEN {_rest} + {_len(c)} <= {_LIMIT} THEN {k}" for k, c in enumerate([None, *_caps])) + f" ELSE {len(_caps)} END"
    _new = "CASE " + " ".join(f"WHEN at_{_n} = {k} THEN {_rest} + {_len(c)}" for k, c in enumerate([None, *_caps])) + " END"
    _steps.append(f"b{_k + 1} AS (SELECT *, {_at} AS at_{_n} FROM a{_k}), a{_k + 1} AS (SELECT * EXCLUDE (total), {_new} AS total FROM b{_k + 1})")
_KEPT = ", ".join(f"CASE at_{n} " + " ".join(f"WHEN {k} THEN {_cut(n, c)}" for k, c in enumerate([None, *caps])) + f" END AS k_{n}" for n, caps in _CUTS.items())
_TRIM = "array_to_string(list_filter([" + ", ".join("CASE " + " ".join(f"WHEN at_{n} = {k + 1} AND {'length' if n in ('text', 'opening') else 'len'}({n}) > {c} THEN '{'site' if n == 'titles' else 'page'}.{_NAME.get(n, n)}'" for k, c in enumerate(caps)) + " END" for n, caps in _CUTS.items()) + "], lambda x: x IS NOT NULL), ',')"
_PAYLOAD = "CAST(json_merge_patch('{}', to_json({'business': business, 'page': CASE WHEN title IS NOT NULL OR h1 IS NOT NULL OR opening IS NOT NULL OR text IS NOT NULL OR paragraphs IS NOT NULL OR words IS NOT NULL OR outline IS NOT NULL THEN {'title': title, 'h1': h1, 'opening': k_opening, 'text': k_text, 'paragraphs': k_paragraphs, 'words': words, 'heading_outline': k_outline} END, 'site': CASE WHEN titles IS NOT NULL THEN {'titles': k_titles} END})) AS VARCHAR)"


@query("judgement_payloads", f"WITH {_PAGE}, {_before}, {', '.join(_steps)}, fin AS (SELECT *, {_KEPT} FROM a{len(_CUTS)}) SELECT site, item_id, {_PAYLOAD} AS payload, CAST(length({_PAYLOAD}) AS INTEGER) AS chars, {_TRIM} AS trimmed, length({_PAYLOAD}) > {_LIMIT} AS over_budget FROM fin")
def _payloads(spark, folder):
    d = table(spark, folder, "documents")
    i = F.col("doc_id")
    upto = lambda n, make: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), make)).otherwise(F.array())
    heads = F.when(i % 2 == 0, upto(i % 30, lambda k: F.struct((k % 6 + 1).cast("int").alias("level"), F.concat(F.lit("Head "), k).alias("text")))).otherwise(F.array())
    page = F.struct(F.when(i % 8 != 1, F.substring("text", 1, 60)).alias("title"), F.substring("text", 61, 40).alias("h1"), F.substring("text", 41, 600).alias("opening"), F.col("text"), F.split(F.coalesce("text", F.lit("")), r"\. ").alias("paragraphs"), F.col("n_chars").alias("words"), heads.cast("array<struct<level:int,text:string>>").alias("heading_outline"))
    items = d.select(F.col("source").alias("site"), i.alias("item_id"), F.when(i % 3 == 0, "a business").alias("business"), page.alias("page"), upto(i % 50, lambda k: F.concat(F.lit("Title "), k)).cast("array<string>").alias("titles"))
    questions = F.when(i % 5 == 0, F.array(*map(F.lit, ["intent", "no_such_question"]))).when(i % 5 == 1, F.array(*map(F.lit, ["paragraph_citability", "specificity"]))).when(i % 5 == 2, F.array(F.lit("helpfulness"))).when(i % 5 == 3, F.array(*map(F.lit, ["title_fit", "h1_fit"]))).otherwise(F.array(F.lit("importance")))
    asked = d.select(F.col("source").alias("site"), i.alias("item_id"), F.explode(questions).alias("question_id"))
    return J.judgement_payloads(items, asked, _LIMIT).select("site", "item_id", "payload", "chars", F.array_join("trimmed", ",").alias("trimmed"), "over_budget")
