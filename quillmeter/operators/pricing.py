"""Prices, currencies and page billing (survey group F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions.exprs import any_contains, col, first_rule, half_up, lookup

# Units of each currency for one USD.
RATES = {
    "USD": 1.0, "INR": 95.0, "EUR": 0.92, "GBP": 0.79, "JPY": 150.5, "AUD": 1.52,
    "CAD": 1.35, "SGD": 1.34, "AED": 3.67, "SAR": 3.75, "RUB": 92.0,
}

# Credits charged by each tool; other tools cost 1.
TOOL_CREDITS = {
    "background-remover-premium": 1, "background-remover-hd": 1, "pdf-ocr": 2, "pdf-ocr-batch": 1,
    "pdf-advanced-edit": 5, "pdf-batch-process": 1, "image-hd-process": 1, "image-ultra-hd": 3,
    "pdf-export-word": 2, "pdf-export-excel": 2, "pdf-export-powerpoint": 2, "pdf-export-images": 1,
    "pdf-redact": 3, "pdf-watermark": 2, "pdf-signature": 2, "pdf-merge": 1, "pdf-split": 1,
    "pdf-compress": 1, "pdf-protect": 1, "pdf-forms-detect": 2, "pdf-forms-fill": 2,
}

# Country code to currency.
COUNTRY_CURRENCY = {
    "IN": "INR", "US": "USD", "GB": "GBP", "JP": "JPY", "AU": "AUD", "CA": "CAD", "SG": "SGD",
    "AE": "AED", "SA": "SAR", "RU": "RUB",
    **dict.fromkeys(
        ["DE", "FR", "ES", "IT", "NL", "PT", "BE", "AT", "GR", "FI", "IE", "LU", "MT", "CY", "SK",
         "SI", "EE", "LV", "LT"], "EUR"),
}

# Language marks of Accept-Language by currency.
INR_MARKS = ["en-in", "hi", "ta", "te", "kn", "ml", "gu", "pa", "bn", "or", "as"]
EUR_MARKS = [
    "de", "fr", "es", "it", "nl", "pt", "pl", "cs", "sk", "hu", "ro", "bg", "hr", "sr", "sl", "et",
    "lv", "lt", "fi", "sv", "da", "no", "is", "ga", "mt", "el", "cy",
]
LOCALE_MARKS = {
    "AUD": ["en-au"], "CAD": ["en-ca", "fr-ca"], "SGD": ["en-sg", "zh-sg", "ms-sg", "ta-sg"],
    "AED": ["ar-ae"], "SAR": ["ar-sa"],
}

# Credits per page by kind of document, by engine slab and by conversion.
PAGE_CREDITS = {"clean_table": 2.0, "bank_statement": 2.5, "invoice": 3.0, "heavy_scanned": 6.0, "id_card": 6.0}
SLAB_CREDITS = {"docai": (5, 2), "adobe": (15, 5)}
SLAB_PAGES = 5
TEXT_PAGE_CREDITS, OCR_PAGE_CREDITS, PREMIUM_MIN_CREDITS = 2.0, 5.0, 30


def convert_price(usd: str | Column, currency: str | Column) -> Column:
    """two decimals, halves up; an unknown currency uses rate 1."""
    return half_up(col(usd) * lookup(RATES, currency, 1.0), 2)


def smallest_unit(usd: str | Column, currency: str | Column) -> Column:
    """amount in the smallest unit of the currency; unsupported currencies are charged in INR."""
    final = F.when(F.upper(col(currency)).isin(*RATES), col(currency)).otherwise("INR")
    factor = F.when(final == "JPY", 1.0).otherwise(100.0)
    return F.floor(convert_price(usd, final) * factor + 0.5).cast("long")


def currency_from_language(header: str | Column, strict_locale: bool = False) -> Column:
    """first matching language rule. ``strict_locale`` tests full locales before bare languages."""
    lang = F.lower(col(header))
    locales = [(any_contains(lang, marks), cur) for cur, marks in LOCALE_MARKS.items()]
    plain_english = lang.contains("en") & ~lang.contains("en-in") & ~lang.contains("en-gb")
    rules = [
        (any_contains(lang, INR_MARKS), "INR"),
        (lang.contains("en-us") | plain_english, "USD"),
        (lang.contains("en-gb"), "GBP"),
        (lang.contains("ja"), "JPY"),
        (lang.contains("ru"), "RUB"),
        (any_contains(lang, EUR_MARKS), "EUR"),
    ]
    return first_rule(locales + rules if strict_locale else rules + locales)


def country_currency(code: str | Column) -> Column:
    """currency of a country code, null when unknown."""
    return lookup(COUNTRY_CURRENCY, F.upper(col(code)))


def detect_currency(explicit: Column, language: Column, country: Column, strict_locale: bool = False) -> Column:
    """supported explicit currency, else language, else country, else USD."""
    asked = F.when(F.upper(explicit).isin(*RATES), F.upper(explicit))
    return F.coalesce(asked, currency_from_language(language, strict_locale), country_currency(country), F.lit("USD"))


def tool_credits(tool: str | Column) -> Column:
    """F5."""
    return lookup(TOOL_CREDITS, tool, 1)


def page_credits(doc_type: Column, id_card: Column, scanned: Column, bank: Column, invoice: Column) -> Column:
    """by the words of the type first, then by flags."""
    t = F.lower(doc_type)
    return first_rule(
        [
            (any_contains(t, ["bank", "statement"]), PAGE_CREDITS["bank_statement"]),
            (any_contains(t, ["invoice", "bill", "report"]), PAGE_CREDITS["invoice"]),
            (any_contains(t, ["id", "identity", "card"]), PAGE_CREDITS["id_card"]),
            (any_contains(t, ["scanned", "heavy"]), PAGE_CREDITS["heavy_scanned"]),
            (id_card, PAGE_CREDITS["id_card"]),
            (scanned, PAGE_CREDITS["heavy_scanned"]),
            (bank, PAGE_CREDITS["bank_statement"]),
            (invoice, PAGE_CREDITS["invoice"]),
        ],
        PAGE_CREDITS["clean_table"],
    )


def slab_credits(page: str | Column, engine: str | Column) -> Column:
    """credits of one page; the first five pages cost more. Unknown engines are not billed."""
    e = F.lower(col(engine))
    early, late = ({k: v[i] for k, v in SLAB_CREDITS.items()} for i in (0, 1))
    return F.when(col(page) <= SLAB_PAGES, lookup(early, e)).otherwise(lookup(late, e))


def bill_documents(pages: DataFrame, doc: str, page: str, engine: str) -> DataFrame:
    """total credits per document."""
    priced = pages.withColumn("__credits", slab_credits(page, engine)).where(F.col("__credits").isNotNull())
    return priced.groupBy(doc).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("__credits").cast("long")).alias("credits")
    )


def billing_breakdown(pages: DataFrame, doc: str, page: str, engine: str) -> DataFrame:
    """F8: counts by slab and credits per (document, engine), per document and in total (``rollup``)."""
    priced = pages.select(
        doc, F.lower(engine).alias("engine"), (F.col(page) <= SLAB_PAGES).alias("__early"),
        slab_credits(page, engine).cast("long").alias("__credits"),
    ).where(F.col("__credits").isNotNull())
    return priced.rollup(doc, "engine").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if("__early").alias("slab_1_5_count"),
        F.count_if(~F.col("__early")).alias("slab_6_plus_count"),
        F.sum("__credits").alias("credits"),
    )


def required_credits(pages: Column, is_ocr: Column) -> Column:
    """2 credits per text page, 5 per OCR page."""
    return pages * F.when(is_ocr, OCR_PAGE_CREDITS).otherwise(TEXT_PAGE_CREDITS)


def can_access_premium(credits: Column) -> Column:
    """F9."""
    return credits >= PREMIUM_MIN_CREDITS
