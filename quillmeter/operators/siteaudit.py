"""HTML audit, keyword analysis and search index entries (survey group G)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmeter.functions import lexicons as X
from quillmeter.functions.exprs import any_contains, col, first_rule, labels_where, let, long_count

ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def markup(html: str | Column) -> Column:
    """The page without comments, scripts and styles: a parser would not look inside them."""
    return F.regexp_replace(col(html), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")


def plain_text(fragment: Column) -> Column:
    """Text of a fragment: tags removed, entities decoded, outer space trimmed."""
    text = strip_space(F.regexp_replace(fragment, r"<[^>]+>", ""))
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def _first(body: Column, tag: str) -> Column:
    return F.regexp_extract(body, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def headings(pages: DataFrame, html: str = "html") -> DataFrame:
    """G1: title, first H1 and number of H1; the html column is not kept."""
    m = F.col("__m")
    return pages.withColumn("__m", markup(html)).withColumns(
        {
            "title": F.nullif(plain_text(_first(m, "title")), F.lit("")),
            "h1": F.nullif(plain_text(_first(m, "h1")), F.lit("")),
            "h1_count": F.regexp_count(m, F.lit(r"(?i)<h1\b")).cast("long"),
        }
    ).drop("__m", html)


def seo_issues(pages: DataFrame, html: str = "html") -> DataFrame:
    """Missing title or description, no H1, several H1 or H2."""
    m = F.col("__m")
    meta = F.regexp_extract(m, r"""(?is)(<meta\b[^>]*name=["']description["'][^>]*>)""", 1)
    content = strip_space(F.regexp_extract(meta, r"""(?is)content=["']([^"']*)["']""", 1))
    h1, h2 = F.col("h1_count"), F.col("h2_count")
    return pages.withColumn("__m", markup(html)).withColumns(
        {
            "missing_title": plain_text(_first(m, "title")) == "",
            "missing_description": content == "",
            "h1_count": F.regexp_count(m, F.lit(r"(?i)<h1\b")).cast("long"),
            "h2_count": F.regexp_count(m, F.lit(r"(?i)<h2\b")).cast("long"),
        }
    ).drop("__m", html).withColumn(
        "issues",
        labels_where(
            [
                (F.col("missing_title"), "title"), (F.col("missing_description"), "description"),
                (h1 == 0, "no_h1"), (h1 > 1, "multiple_h1"), (h2 > 1, "multiple_h2"),
            ]
        ),
    )


def audit_totals(audited: DataFrame) -> DataFrame:
    """One row of totals over the audited pages."""
    return audited.agg(
        F.count(F.lit(1)).alias("pages"),
        long_count(F.col("missing_title") | F.col("missing_description") | (F.col("h1_count") == 0)).alias("missing_seo_or_h1"),
        long_count(F.col("h1_count") > 1).alias("multiple_h1"),
        long_count(F.col("h2_count") > 1).alias("multiple_h2"),
    )


def _by_volume() -> list[tuple[str, int]]:
    return sorted(X.KEYWORD_VOLUMES.items(), key=lambda kv: -kv[1])


def main_keyword(h1: str | Column) -> Column:
    """The phrase of highest volume in the heading, else its first words without stop words."""
    return let(col(h1), lambda text: let(F.lower(text), lambda low: _main_keyword(text, low)))


def _main_keyword(text: Column, low: Column) -> Column:
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    kept = F.filter(F.slice(words, 1, 3), lambda w: ~w.isin(*X.KEYWORD_STOP_WORDS))
    known = first_rule([(low.contains(k), k) for k, _ in _by_volume()])
    few = F.when((F.size(words) >= 2) & (F.size(kept) > 0), F.array_join(kept, " "))
    return F.when(text.isNotNull() & (text != ""), F.coalesce(known, few, F.substring(low, 1, 50)))


def search_volume(keyword: str | Column) -> Column:
    """Containment either way, then 30 % of a phrase sharing a long word, then class defaults."""
    return let(F.lower(col(keyword)), _volume)


def _volume(k: Column) -> Column:
    direct = [(k.contains(p) | F.lit(p).contains(k), v) for p, v in X.KEYWORD_VOLUMES.items()]
    partial = [
        (any_contains(k, long_words), int(v * X.PARTIAL_SHARE))
        for p, v in _by_volume() if (long_words := [w for w in p.split() if len(w) > 3])
    ]
    classes = [(any_contains(k, words), v) for words, v in X.VOLUME_DEFAULTS]
    return F.when(k.isNull() | (k == ""), 0).otherwise(first_rule(direct + partial + classes, X.OTHER_VOLUME)).cast("long")


def _all_of(text: Column, groups: list[list[str]]) -> Column:
    return reduce(lambda a, b: a & b, (any_contains(text, g) for g in groups))


def keyword_suggestions(pages: DataFrame, keep: str, h1: str = "h1", k: int = 3) -> DataFrame:
    """Up to k suggested phrases per page, by volume. Rules are expressions: no join, no shuffle."""
    best = let(F.lower(F.col(h1)), lambda low: F.slice(_suggestions(low), 1, k))
    return pages.select(keep, F.posexplode(best).alias("pos", "s")).select(
        keep, (F.col("pos") + 1).cast("long").alias("rank"), F.col("s.p").alias("suggestion"),
        (-F.col("s.neg")).cast("long").alias("volume"),
    )


def _suggestions(low: Column) -> Column:
    at, options = 0, []
    for words, branches in X.SUGGESTION_GROUPS:
        rules = []
        for groups, phrases in branches:
            found = [F.struct(F.lit(-v).alias("neg"), F.lit(at + i).alias("at"), F.lit(p).alias("p")) for i, (p, v) in enumerate(phrases)]
            at += len(phrases)
            rules.append((_all_of(low, groups), F.array(*found)))
        options.append(F.when(any_contains(low, words), first_rule(rules)))
    return F.array_sort(F.flatten(F.array_compact(F.array(*options))))


def top_by_volume(pages: DataFrame, volume: str, tie: str, k: int = 50) -> DataFrame:
    """K pages of highest volume with their rank. Each task keeps k rows; only k are ranked."""
    best = pages.orderBy(F.col(volume).desc(), F.col(tie)).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col(volume).desc(), F.col(tie))).cast("long"))


def volume_bands(pages: DataFrame, volume: str) -> DataFrame:
    """Pages above 10 K, 50 K and 100 K."""
    v = F.col(volume)
    return pages.agg(
        long_count(v > 10_000).alias("over_10k"), long_count(v > 50_000).alias("over_50k"),
        long_count(v > 100_000).alias("over_100k"),
    )


def title_case(c: Column) -> Column:
    """Every run of letters starts with a capital."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


def base_name(filename: str | Column) -> Column:
    return F.replace(F.replace(col(filename), F.lit(".html"), F.lit("")), F.lit("-"), F.lit(" "))


def page_title(html: str | Column, filename: str | Column, site: str) -> Column:
    """<title> without the site name (a plain text) and 'Online …' tail, else H1, else the file name."""
    raw = strip_space(F.regexp_extract(col(html), r"(?is)<title>(.*?)</title>", 1))
    cut = F.regexp_replace(F.regexp_replace(raw, rf"(?i)\s*[-|]\s*{re.escape(site)}.*$", ""), r"(?i)\s*[-|]\s*Online.*$", "")
    h1 = strip_space(F.regexp_replace(F.regexp_extract(col(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", ""))
    has_title = F.regexp_like(col(html), F.lit(r"(?is)<title>.*?</title>"))
    found = F.when(has_title, strip_space(cut)).otherwise(h1)
    return F.coalesce(F.nullif(found, F.lit("")), title_case(base_name(filename)))


def index_keywords(filename: str | Column, title: str | Column, most: int | None = None) -> Column:
    """Name, title words longer than two letters, words added by name; distinct, at most ``most`` if given."""
    base = F.lower(base_name(filename))
    words = F.filter(F.regexp_extract_all(F.lower(col(title)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 2)
    none = F.array().cast("array<string>")
    extra = [F.when(any_contains(base, n), F.array(*map(F.lit, ks))).otherwise(none) for n, ks in X.NAME_KEYWORDS]
    found = F.array_distinct(F.concat(F.array(base), words, *extra))
    return found if most is None else F.slice(found, 1, most)


def page_category(filename: str | Column) -> Column:
    """G10."""
    return first_rule([(any_contains(F.lower(col(filename)), w), c) for w, c in X.CATEGORY_WORDS], X.OTHER_CATEGORY)


def page_description(filename: str | Column, title: str | Column) -> Column:
    """G10: 'Convert A to B' names first, then the fixed descriptions, then archives, then the title."""
    return let(base_name(filename), lambda p: let(F.lower(p), lambda low: _description(p, low, col(title))))


def _description(plain: Column, base: Column, title: Column) -> Column:
    parts = F.split(base, " to ")
    archive = any_contains(base, ["zip", "rar"])
    rules = [
        (F.size(parts) == 2, F.concat(F.lit("Convert "), title_case(parts[0]), F.lit(" to "),
                                      title_case(F.get(parts, F.lit(1))), F.lit(" online for free"))),
        *[(_all_of(base, g), text) for g, text in X.DESCRIPTIONS],
        (base.contains("extract"), F.concat(F.lit("Extract files from "), title_case(F.replace(plain, F.lit("extractor"), F.lit(""))), F.lit(" archives"))),
        (archive & base.contains("to"), F.concat(F.lit("Convert "), title_case(plain), F.lit(" archives online"))),
        (archive, F.concat(F.lit("Work with "), title_case(plain), F.lit(" archives online"))),
    ]
    return first_rule(rules, F.concat(title, F.lit(" - Online free tool")))


def listed_pages(pages: DataFrame, filename: str = "filename") -> DataFrame:
    """Without excluded names, '-convert' pages and blog posts."""
    f = F.col(filename)
    return pages.where(
        ~f.isin(*X.EXCLUDED_PAGES) & ~f.endswith(X.EXCLUDED_ENDING) & ~f.startswith(X.EXCLUDED_BEGINNING)
    )


def index_entries(pages: DataFrame, site: str, html: str = "html", filename: str = "filename") -> DataFrame:
    """Search entries of the listed pages."""
    return (
        listed_pages(pages, filename)
        .withColumn("title", page_title(html, filename, site))
        .drop(html)
        .withColumns(
            {
                "keywords": index_keywords(filename, "title"),
                "category": page_category(filename),
                "description": page_description(filename, "title"),
            }
        )
    )


def missing_from_index(entries: DataFrame, existing: DataFrame, on: str = "url") -> DataFrame:
    """Entries whose url the existing index lacks."""
    return entries.join(existing.select(on), on, "left_anti")


def has_feedback_section(html: str | Column) -> Column:
    """G13."""
    return F.regexp_like(col(html), F.lit("(?i)" + "|".join(X.FEEDBACK_MARKS)))
