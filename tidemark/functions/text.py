"""Text functions as column expressions: tokens, scrubbing of dates, ids, and wiki markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell nothing about a text's topic.
STOP_WORDS = (
    "a an and are as at be been but by for from has have had he her his in is it its of on or that the their they this to was were will with which after over into than then "
    "there these those when while who would could also more most other some such only own same so not no nor s t d ll m o re ve y said says say new first two one three about "
    "up down out off all any both each few market markets regime volatility shift state period window news article articles report reports reported"
).split()
#: Words whose overlap doesn't ground a claim.
CLAIM_STOP_WORDS = (
    "the and for with that this from have has had was were are been will would could may might its their they which when while after before market markets investor investors "
    "volatility risk financial economic economy price prices increase decrease significant major amid following reported announced according also more than into over under"
).split()
#: Months, and their short forms.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SHORT_MONTHS = "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"


def tokens(text: Column, drop_stop_words: bool = True) -> Column:
    """Words of at least three characters, a letter first, in lower case; with or without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9\-']+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)) if drop_stop_words else words


def content_tokens(text: Column) -> Column:
    """The distinct words of at least four characters that aren't in the shorter list."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9\-']+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(CLAIM_STOP_WORDS)))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: What identifies a time, in the order in which it goes.
IDENTIFYING = [r"\b(?:19|20)\d\d\b", rf"(?i)\b(?:{MONTHS}|{SHORT_MONTHS})\b", r"(?i)\bQ[1-4]\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b"]


def strip_identifying(text: Column) -> Column:
    """Without years, months, quarters and numeric dates, in this order, and with single spaces."""
    for p in IDENTIFYING:
        text = F.regexp_replace(text, p, " ")
    return squeeze(text)


def count_stripped(text: Column) -> Column:
    """How many words strip_identifying takes away."""
    return F.size(tokens(text, False)) - F.size(tokens(strip_identifying(text), False))


#: Kinds of dates in the order in which they are replaced, with pattern and replacement.
DATE_KINDS: list[tuple[str, str, str]] = [
    ("iso", r"\b\d{4}-\d{2}-\d{2}\b", "[date]"),
    ("month_day", rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?\b", "[date]"),
    ("day_month", rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\b", "[date]"),
    ("month", rf"\b(?:{MONTHS}|{SHORT_MONTHS})\b", "[month]"),
    ("relative", r"(?i)\b(?:last|next|this|the following|the previous)\s+(?:year|month|week|quarter)\b", "[relative period]"),
    ("year", r"\b(?:19|20)\d{2}\b", "[year]"),
]


def strip_dates(text: Column) -> Column:
    for _, pattern, to in DATE_KINDS:
        text = F.regexp_replace(text, pattern, to)
    return text


def date_leaks(text: Column) -> dict[str, Column]:
    """How often each kind of date is found, by kind."""
    return {kind: F.regexp_count(text, F.lit(pattern)) for kind, pattern, _ in DATE_KINDS}


def item_id(source: Column, published: Column, url: Column, title: Column) -> Column:
    """First 16 hex digits of sha256 over source, time (ISO, UTC), url and title. The text is left out: see content_id."""
    iso = F.concat(F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.substring(F.sha2(F.concat_ws("|", source, iso, F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))), 256), 1, 16)


def content_id(item: Column, text: Column) -> Column:
    """An id that texts with one item_id don't share."""
    return F.substring(F.sha2(F.concat_ws("|", item, F.coalesce(text, F.lit(""))), 256), 1, 16)


def body(title: Column, text: Column) -> Column:
    return F.regexp_replace(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))), r"^\s+|\s+$", "")


def domain(url: Column) -> Column:
    """Host without a leading www., else empty."""
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), F.lit(""))


def page_title(day: Column) -> Column:
    return F.concat(F.lit("Portal:Current events/"), F.date_format(day, "yyyy MMMM d"))


def slug(text: Column, most: int = 40) -> Column:
    """Lower-case letters, digits, _ and -, other runs as one -, none at the ends; at most so many characters."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(out, 1, most), F.lit("")), F.lit("run"))


#: Links with and without a label, and the steps that take markup away, in order.
LABELLED_LINK = r"\[(https?://[^\s\]]+)\s+\(?([^\]]*?)\)?\]"
BARE_LINK = r"\[(https?://[^\s\]]+)\]"
MARKUP_STEPS = [
    (r"(?s)<!--.*?-->", " "), (r"(?is)<ref[^>]*>.*?</ref>|<ref[^>]*/>", " "), (r"\[https?://[^\s\]]+\s+[^\]]*\]", " "), (r"\[https?://[^\s\]]+\]", " "),
    *[(r"\{\{[^{}]*\}\}", " ")] * 4,
    (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), (r"\[\[([^\]|]+)\]\]", "$1"), (r"<[^>]+>", " "), (r"'{2,5}", ""),
]
ENTITIES = [("&nbsp;", " "), ("&ndash;", "-"), ("&mdash;", "-"), ("&amp;", "&"), ("&quot;", '"')]


def links(raw: Column) -> Column:
    """External links, labelled ones first, as an array of (publisher, url); a link without a label has its domain as publisher."""
    named = F.arrays_zip(F.regexp_extract_all(raw, F.lit(LABELLED_LINK), F.lit(2)).alias("l"), F.regexp_extract_all(raw, F.lit(LABELLED_LINK), F.lit(1)).alias("u"))
    bare = F.regexp_extract_all(raw, F.lit(BARE_LINK), F.lit(1))
    entry = lambda label, url: F.struct(F.coalesce(F.nullif(F.trim(label), F.lit("")), domain(url)).alias("publisher"), url.alias("url"))
    return F.concat(F.transform(named, lambda x: entry(x["l"], x["u"])), F.transform(bare, lambda u: entry(F.lit(""), u)))


def clean_markup(raw: Column) -> Column:
    """Plain text of wiki markup: comments, references, links, templates (nested up to four deep), tags, quotes and entities go."""
    out = raw
    for pattern, to in MARKUP_STEPS:
        out = F.regexp_replace(out, pattern, to)
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.regexp_replace(squeeze(out), r"^[ *;:\-]+|[ *;:\-]+$", "")


def front_matter_stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def word_slice(text: Column, n: int | None, *key: Column, seed: int = 7) -> Column:
    """n words of a text in a row, from a place that a hash of seed and key chooses; the whole text where n is None or the text has no more."""
    if n is None:
        return squeeze(text)
    words = F.split(squeeze(text), " ")
    spare = F.size(words) - n
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(n)), *[k.cast("string") for k in key]))
    start = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.greatest(spare, F.lit(1))
    return F.when(spare <= 0, squeeze(text)).otherwise(F.array_join(F.slice(words, (start + 1).cast("int"), n), " "))
