"""HTML audit, keyword, index and search queries over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import lexicons as X
from quillmeter.operators import search as R
from quillmeter.operators import siteaudit as G
from quillmeter.plans.registry import Tables, query
from quillmeter.plans.sqltext import all_of, any_of, case, lit, text_list, title_case

SITE = "ththre"


def named_pages(t: Tables) -> DataFrame:
    """Pages with a file name made of the words of their url."""
    stem = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[^A-Za-z0-9]+", "-")
    return t.pages.select("page_id", "url", F.concat(stem, F.lit(".html")).alias("filename"), "html")


MARKUP = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g')"
NAMED = rf"""(SELECT page_id, url, html, {MARKUP} AS m,
  regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9]+', '-', 'g') || '.html' AS filename FROM pages)"""


def _text(c: str) -> str:
    out = rf"regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')"
    for a, b in G.ENTITIES:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return out


def _first(tag: str) -> str:
    return _text(rf"regexp_extract(m, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1)")


def _count(tag: str) -> str:
    return rf"len(regexp_extract_all(m, '(?i)<{tag}\b'))"


HEADINGS = f"""(SELECT page_id, url, NULLIF({_first('title')}, '') AS title, NULLIF({_first('h1')}, '') AS h1,
  {_count('h1')} AS h1_count FROM {NAMED})"""


@query("g1_headings", f"SELECT * FROM {HEADINGS}")
def headings(t: Tables) -> DataFrame:
    return G.headings(t.pages)


AUDITED = f"""(SELECT *, array_to_string(list_filter([CASE WHEN missing_title THEN 'title' END,
    CASE WHEN missing_description THEN 'description' END, CASE WHEN h1_count = 0 THEN 'no_h1' END,
    CASE WHEN h1_count > 1 THEN 'multiple_h1' END, CASE WHEN h2_count > 1 THEN 'multiple_h2' END], lambda x: x IS NOT NULL), ';') AS issues
FROM (SELECT page_id, url, {_first('title')} = '' AS missing_title,
  regexp_replace(regexp_extract(regexp_extract(m, '(?is)(<meta\\b[^>]*name=["'']description["''][^>]*>)', 1),
    '(?is)content=["'']([^"'']*)["'']', 1), '^\\s+|\\s+$', '', 'g') = '' AS missing_description,
  {_count('h1')} AS h1_count, {_count('h2')} AS h2_count FROM {NAMED}))"""


@query("g2_seo_issues", f"SELECT * FROM {AUDITED}")
def seo_issues(t: Tables) -> DataFrame:
    return G.seo_issues(t.pages)


@query("g3_audit_totals", f"""SELECT count(*) AS pages, count(*) FILTER (WHERE missing_title OR missing_description OR h1_count = 0) AS missing_seo_or_h1,
  count(*) FILTER (WHERE h1_count > 1) AS multiple_h1, count(*) FILTER (WHERE h2_count > 1) AS multiple_h2 FROM {AUDITED}""")
def audit_totals(t: Tables) -> DataFrame:
    return G.audit_totals(G.seo_issues(t.pages))


PHRASES = sorted(X.KEYWORD_VOLUMES.items(), key=lambda kv: -kv[1])
WORDS = r"list_filter(string_split_regex(lower(h1), '\s+'), lambda w: w <> '')"
KEPT = f"list_filter(({WORDS})[1:3], lambda w: w NOT IN {tuple(X.KEYWORD_STOP_WORDS)!r})"
KEYWORD = f"""CASE WHEN h1 IS NOT NULL THEN COALESCE({case([(f"contains(lower(h1), {lit(p)})", lit(p)) for p, _ in PHRASES])},
  CASE WHEN len({WORDS}) >= 2 AND len({KEPT}) > 0 THEN array_to_string({KEPT}, ' ') END, substr(lower(h1), 1, 50)) END"""
VOLUME = case(
    [("keyword IS NULL OR keyword = ''", "0")]
    + [(f"contains(keyword, {lit(p)}) OR contains({lit(p)}, keyword)", str(v)) for p, v in X.KEYWORD_VOLUMES.items()]
    + [(any_of("keyword", ws), str(int(v * 0.3))) for p, v in PHRASES if (ws := [w for w in p.split() if len(w) > 3])]
    + [(any_of("keyword", ws), str(v)) for ws, v in X.VOLUME_DEFAULTS], str(X.OTHER_VOLUME))
KEYWORDS = f"(SELECT page_id, url, keyword, CAST({VOLUME} AS BIGINT) AS volume FROM (SELECT page_id, url, {KEYWORD} AS keyword FROM {HEADINGS}))"


def page_keywords(t: Tables) -> DataFrame:
    return G.headings(t.pages).select("page_id", "url", G.main_keyword("h1").alias("keyword")).withColumn(
        "volume", G.search_volume("keyword"))


@query("g4_main_keyword", f"SELECT page_id, keyword FROM {KEYWORDS}")
def main_keyword(t: Tables) -> DataFrame:
    return page_keywords(t).select("page_id", "keyword")


@query("g5_search_volume", f"SELECT * FROM {KEYWORDS}")
def search_volume(t: Tables) -> DataFrame:
    return page_keywords(t)


def _suggestion_sql() -> str:
    parts, at = [], 0
    for words, branches in X.SUGGESTION_GROUPS:
        rules = []
        for groups, phrases in branches:
            items = ", ".join(f"{{'neg': {-v}, 'at': {at + i}, 'p': {lit(p)}}}" for i, (p, v) in enumerate(phrases))
            at += len(phrases)
            rules.append((all_of("low", groups), f"[{items}]"))
        parts.append(f"CASE WHEN {any_of('low', words)} THEN {case(rules)} END")
    return f"list_sort(flatten(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)))[1:3]"


# Headings of the given pages hold no business words, so each gets one phrase of the volume table.
HEADED = f"(SELECT page_id, lower(h1 || ' ' || list_extract({text_list(X.KEYWORD_VOLUMES)}, page_id % {len(X.KEYWORD_VOLUMES)} + 1)) AS low FROM {HEADINGS})"


@query("g6_keyword_suggestions", f"""SELECT page_id, i AS rank, s[i].p AS suggestion, CAST(-s[i].neg AS BIGINT) AS volume
FROM (SELECT page_id, {_suggestion_sql()} AS s FROM {HEADED}), range(1, 4) r(i) WHERE i <= len(s)""")
def suggestions(t: Tables) -> DataFrame:
    phrases = F.array(*map(F.lit, X.KEYWORD_VOLUMES))
    phrase = F.element_at(phrases, (F.col("page_id") % len(X.KEYWORD_VOLUMES) + 1).cast("int"))
    rows = G.headings(t.pages).select("page_id", F.concat_ws(" ", "h1", phrase).alias("h1"))
    return G.keyword_suggestions(rows, "page_id")


@query("g7_top_by_volume", f"""SELECT page_id, url, keyword, volume, row_number() OVER (ORDER BY volume DESC, page_id) AS rank
FROM {KEYWORDS} ORDER BY volume DESC, page_id LIMIT 50""")
def top_by_volume(t: Tables) -> DataFrame:
    return G.top_by_volume(page_keywords(t), "volume", "page_id")


@query("g8_volume_bands", f"""SELECT count(*) FILTER (WHERE volume > 10000) AS over_10k,
  count(*) FILTER (WHERE volume > 50000) AS over_50k, count(*) FILTER (WHERE volume > 100000) AS over_100k FROM {KEYWORDS}""")
def volume_bands(t: Tables) -> DataFrame:
    return G.volume_bands(page_keywords(t), "volume")


BASE = "replace(replace(filename, '.html', ''), '-', ' ')"
TITLE = rf"""COALESCE(NULLIF(CASE WHEN regexp_matches(html, '(?is)<title>.*?</title>') THEN
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '^\s+|\s+$', '', 'g'),
    '(?i)\s*[-|]\s*{SITE}.*$', '', 'g'), '(?i)\s*[-|]\s*Online.*$', '', 'g'), '^\s+|\s+$', '', 'g')
  ELSE regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') END, ''),
  {title_case(BASE)})"""
KW_PARTS = " || ".join(
    [f"[lower({BASE})]", r"list_filter(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+'), lambda w: length(w) > 2)"]
    + [f"CASE WHEN {any_of(f'lower({BASE})', n)} THEN {text_list(k)} ELSE [] END" for n, k in X.NAME_KEYWORDS])
B = f"lower({BASE})"
PARTS = f"string_split({B}, ' to ')"
DESCRIPTION = case(
    [(f"len({PARTS}) = 2", f"'Convert ' || {title_case(PARTS + '[1]')} || ' to ' || {title_case(PARTS + '[2]')} || ' online for free'")]
    + [(all_of(B, g), lit(d)) for g, d in X.DESCRIPTIONS]
    + [(f"contains({B}, 'extract')", f"'Extract files from ' || {title_case('replace(' + BASE + ', ' + lit('extractor') + ', ' + lit('') + ')')} || ' archives'"),
       (f"{any_of(B, ['zip', 'rar'])} AND contains({B}, 'to')", f"'Convert ' || {title_case(BASE)} || ' archives online'"),
       (any_of(B, ["zip", "rar"]), f"'Work with ' || {title_case(BASE)} || ' archives online'")],
    "title || ' - Online free tool'")
CATEGORY = case([(any_of("lower(filename)", w), lit(c)) for w, c in X.CATEGORY_WORDS], lit(X.OTHER_CATEGORY))
ENTRIES = f"""(SELECT page_id, url, filename, title, list_filter(k, lambda x, i: list_position(k, x) = i) AS keywords, {CATEGORY} AS category, {DESCRIPTION} AS description
  FROM (SELECT *, {KW_PARTS} AS k FROM (SELECT page_id, url, filename, {TITLE} AS title FROM {NAMED}
    WHERE filename NOT IN {tuple(X.EXCLUDED_PAGES)!r} AND filename NOT LIKE '%-convert.html' AND filename NOT LIKE 'blog-%')))"""


def entries(t: Tables) -> DataFrame:
    return G.index_entries(named_pages(t), SITE)


@query("g9_index_entries", f"SELECT page_id, filename, title, array_to_string(keywords, ',') AS keywords FROM {ENTRIES}")
def index_entries(t: Tables) -> DataFrame:
    return entries(t).select("page_id", "filename", "title", F.array_join("keywords", ",").alias("keywords"))


@query("g10_categories", f"SELECT page_id, filename, category, description FROM {ENTRIES}")
def categories(t: Tables) -> DataFrame:
    return entries(t).select("page_id", "filename", "category", "description")


@query("g11_listed_pages", f"""SELECT page_id, filename FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN list_extract({text_list(X.EXCLUDED_PAGES)}, page_id % {len(X.EXCLUDED_PAGES)} + 1)
  WHEN page_id % 5 = 1 THEN 'blog-' || filename WHEN page_id % 5 = 2 THEN replace(filename, '.html', '-convert.html') ELSE filename END AS filename FROM {NAMED})
WHERE filename NOT IN {tuple(X.EXCLUDED_PAGES)!r} AND filename NOT LIKE '%-convert.html' AND filename NOT LIKE 'blog-%'""")
def listed_pages(t: Tables) -> DataFrame:
    k, f = F.col("page_id") % 5, F.col("filename")
    fixed = F.element_at(F.array(*map(F.lit, X.EXCLUDED_PAGES)), (F.col("page_id") % len(X.EXCLUDED_PAGES) + 1).cast("int"))
    renamed = named_pages(t).select("page_id", F.when(k == 0, fixed).when(k == 1, F.concat(F.lit("blog-"), f)).when(
        k == 2, F.replace(f, F.lit(".html"), F.lit("-convert.html"))).otherwise(f).alias("filename"))
    return G.listed_pages(renamed)


@query("g12_missing_from_index", "SELECT page_id, url FROM pages WHERE NOT EXISTS (SELECT 1 FROM pages o WHERE o.url = pages.url AND contains(o.html, 'Nicht'))")
def missing_from_index(t: Tables) -> DataFrame:
    existing = t.pages.where(F.col("html").contains("Nicht"))
    return G.missing_from_index(t.pages.select("page_id", "url"), existing)


@query("g13_feedback_section", """SELECT page_id, regexp_matches(html || CASE WHEN page_id % 3 = 0 THEN '<div class="FEEDBACK-section">' ELSE '' END,
  '(?i)Reviews &amp; Comments|Reviews & Comments|feedback-section|Share Feedback') AS has_feedback FROM pages""")
def feedback_section(t: Tables) -> DataFrame:
    html = F.concat("html", F.when(F.col("page_id") % 3 == 0, '<div class="FEEDBACK-section">').otherwise(""))
    return t.pages.select("page_id", G.has_feedback_section(html).alias("has_feedback"))


SEARCHES = ["the", "example com en", "with and", "pdf merge", "th", "a", "net de page 2", "convert que"]


def _score_sql(words: str, parts: str) -> str:
    return f"""SELECT query, page_id, title, CAST({parts} AS BIGINT) AS score, q FROM (
  SELECT *, {words} AS w FROM (SELECT e.page_id, e.title, e.category, s.query, lower(trim(s.query, ' ')) AS q, lower(e.title) AS t,
    lower(e.description) AS d, list_transform(e.keywords, lambda k: lower(k)) AS k FROM {ENTRIES} e, unnest({text_list(SEARCHES)}) s(query)))"""


PAIRS = "list_sum(list_transform(w, lambda x: len(list_filter(k, lambda y: contains(y, x) OR contains(x, y)))))"
SMART = _score_sql(
    "list_filter(string_split(q, ' '), lambda x: length(x) > 2)",
    f"""CASE WHEN t = q THEN 100 ELSE 0 END + CASE WHEN contains(t, q) THEN 50 ELSE 0 END + 15 * len(list_filter(w, lambda x: contains(t, x)))
  + 30 * len(list_filter(k, lambda x: x = q)) + 20 * len(list_filter(k, lambda x: x <> q AND contains(q, x)))
  + 15 * len(list_filter(k, lambda x: NOT contains(q, x) AND contains(x, q))) + 10 * COALESCE({PAIRS}, 0)
  + 5 * len(list_filter(w, lambda x: contains(d, x)))""")


def _smart_sql(k: int) -> str:
    return f"""SELECT * FROM (SELECT query, page_id, title, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, page_id) AS rank
  FROM ({SMART}) WHERE score > 0 AND q <> '') WHERE rank <= {k}"""


@query("h1_smart_search", _smart_sql(8))
def smart_search(t: Tables) -> DataFrame:
    return R.smart_search(entries(t), SEARCHES, "page_id", 8)


@query("h3_voice_search", _smart_sql(5))
def voice_search(t: Tables) -> DataFrame:
    return R.smart_search(entries(t), SEARCHES, "page_id", 5)


TIERED = _score_sql(
    r"list_filter(string_split_regex(q, '\s+'), lambda x: length(x) >= 3)",
    f"""CASE WHEN t = q THEN 100 WHEN contains(t, q) THEN 80 WHEN contains(q, t) THEN 70 ELSE 0 END + CASE WHEN contains(d, q) THEN 30 ELSE 0 END
  + CASE WHEN contains(lower(category), q) THEN 20 ELSE 0 END + 40 * len(list_filter(k, lambda x: x = q))
  + 20 * len(list_filter(k, lambda x: x <> q AND (contains(x, q) OR contains(q, x)))) + 15 * len(list_filter(w, lambda x: contains(t, x)))
  + 10 * len(list_filter(w, lambda x: contains(d, x))) + 10 * COALESCE({PAIRS}, 0)""")


@query("h2_tiered_search", f"""SELECT * FROM (SELECT query, page_id, title, score, CASE WHEN score >= 70 THEN 1 ELSE 2 END AS tier,
  row_number() OVER (PARTITION BY query ORDER BY CASE WHEN score >= 70 THEN 1 ELSE 2 END, score DESC, page_id) AS rank
  FROM ({TIERED}) WHERE score > 0 AND length(q) >= 2) WHERE rank <= 10""")
def tiered_search(t: Tables) -> DataFrame:
    return R.tiered_search(entries(t), SEARCHES, "page_id")
