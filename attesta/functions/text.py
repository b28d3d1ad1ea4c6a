"""Column functions on text. Null and blank text are the same to all of them unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that spreadsheets garble and what stands for it in plain ASCII.
SMART_PUNCTUATION = {"—": "-", "–": "-", "−": "-", "…": "...", "\u00a0": " ", "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "™": "TM", "®": "(R)", "©": "(C)"}
# References and typographic marks that quotes and pages spell differently.
GATE_MARKS = {"&nbsp;": " ", "&amp;": "&", "&#8217;": "'", "&rsquo;": "'", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-"}
# Cells that mean "nothing".
PLACEHOLDERS = ("x", "n/a", "na", "-", "none")
# Words that set sibling editions of one brand apart.
VARIANT_WORDS = ("europe", "european", "usa", "us", "america", "americas", "asia", "apac", "emea", "china", "japan", "india", "uk", "canada", "mena", "africa", "pacific", "nordic", "east", "west", "north", "south", "eu", "na", "spring", "summer", "autumn", "fall", "winter")
# Words that say nothing about which event a name means.
NAME_STOP_WORDS = ("the", "and", "of", "for", "on", "in", "a", "an", "conference", "summit", "expo", "exhibition", "congress", "forum", "show", "annual", "international", "week", "event")
GENERIC_EVENT_WORDS = ("conference", "annual", "international", "meeting", "summit", "expo", "symposium", "congress", "ieee", "acm", "association", "society", "institute", "global", "world", "national", "european", "american", "asia", "usa", "forum", "workshop", "convention", "exhibition", "show", "event", "2026", "2027", "2028")
# Names of calls, in the order in which they are looked for.
CALL_LABELS = ("abstract", "full paper", "call for paper", "paper submission", "case study", "poster", "workshop", "tutorial", "panel", "late-breaking", "late breaking", "lightning", "speaker", "speaking", "presentation", "nomination", "entry", "proposal", "talk", "session")
SOFT_404 = "page not found|404 error|page you (?:are|were) looking for|no longer available|cannot be found|doesn't exist|does not exist"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null as the empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def blank(c: Column | str) -> Column:
    return F.trim(text(c)) == ""


def let(value: Column, body) -> Column:
    """body(value), the value being worked out once. Inside a lambda Spark works out all else again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(c: Column, values: Iterable[str]) -> Column:
    """Whether any of the values is a substring, as one alternation that stays in generated code."""
    return c.rlike("|".join(r"\Q" + v + r"\E" for v in values))


def scrub_placeholder(c: Column | str) -> Column:
    """Trimmed, and empty where the cell only stands for "nothing"."""
    t = F.trim(text(c))
    return F.when(F.lower(t).isin(*PLACEHOLDERS), "").otherwise(t)


def squash(c: Column | str) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text(c)), "[^\\p{L}\\p{N}]", "")


def market_key(c: Column | str) -> Column:
    """Comparison key of a vocabulary name (ASCII letters and digits)."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def slug(c: Column | str, max_len: int = 48, strip_years: bool = False) -> Column:
    """Lower-case words joined by hyphens, cut at a word border within max_len."""
    s = F.regexp_replace(text(c), r"\s*\(.*?\)\s*", " ")
    if strip_years:
        s = F.regexp_replace(s, r"(?<!\d)(19|20)\d{2}(?!\d)", " ")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(s, 1, max_len)
    at_word = F.when(cut.contains("-"), F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut)
    return F.when(F.length(s) <= max_len, s).otherwise(at_word)


def normalize_evidence(c: Column | str) -> Column:
    """Text made comparable: ordinals bare, dashes plain, noise and runs of space gone."""
    t = F.lower(text(c))
    t = F.translate(t, "–—\u00a0", "-- ")
    t = F.regexp_replace(t, r"(\d)(st|nd|rd|th)\b", "$1")
    t = F.regexp_replace(t, "[^a-z0-9/\\-: ]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def gate_text(c: Column | str) -> Column:
    """Text of a quote made comparable: references and typographic marks plain, space run together, lower case."""
    t = text(c)
    for mark, plain in GATE_MARKS.items():
        t = F.replace(t, F.lit(mark), F.lit(plain))
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def visible_text(html: Column | str) -> Column:
    """Text of a page without script, style, tags and the commonest references."""
    t = F.regexp_replace(text(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for reference, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(reference), F.lit(plain))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def real_words(c: Column | str) -> Column:
    """How many words of four letters or more a human would read."""
    t = F.regexp_replace(text(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    for noise in (r"<[^>]+>", r"data:[^)\s]+", r"https?://\S+", r"&[a-z]+;"):
        t = F.regexp_replace(t, noise, " ")
    return F.regexp_count(t, F.lit("[A-Za-z]{4,}"))


def readable(c: Column | str) -> Column:
    """struct(ok, reason): whether a fetched page can stand as a source."""
    t = text(c)
    head = F.substring(t, 1, 1500)
    words = real_words(t)
    reason = (
        F.when(t == "", "page could not be read")
        .when(F.length(F.trim(t)) < 200, "page returned almost no text")
        .when(head.rlike(f"(?i){SOFT_404}"), F.concat(F.lit("soft 404: "), F.lower(F.regexp_extract(head, f"(?i)({SOFT_404})", 1))))
        .when(words < 40, "page has almost no readable text")
    )
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def call_label(quote: Column | str) -> Column:
    """The first known kind of call that the quote names, or empty."""
    q, found = F.lower(text(quote)), None
    for label in CALL_LABELS:
        found = F.when(q.contains(label), label) if found is None else found.when(q.contains(label), label)
    return found.otherwise("")


def event_named(quote: Column | str, name: Column | str) -> Column:
    """Whether one of the first six telling words of the event's name stands in the quote."""
    q = F.lower(text(quote))
    words = F.filter(F.split(F.lower(text(name)), "[^a-z0-9]+"), lambda w: (F.length(w) > 3) & ~w.isin(*GENERIC_EVENT_WORDS))
    return let(q, lambda t: F.exists(F.slice(words, 1, 6), lambda w: F.contains(t, w)))


def name_tokens(c: Column | str) -> Column:
    """Distinct words of a name without four-digit numbers."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]+)")), lambda w: ~w.rlike(r"^\d{4}$")))


def overlap_share(a: Column, b: Column) -> Column:
    """Common words as a share of the smaller set; null if either is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))


def related(a: Column | str, b: Column | str, floor: float = 0.5) -> Column:
    """Names that plausibly mean one event; nothing to judge on counts as related."""
    return F.coalesce(overlap_share(name_tokens(a), name_tokens(b)) >= floor, F.lit(True))


def same_event(a: Column | str, b: Column | str) -> Column:
    """Related, and no region or season word that disagrees."""
    variants = words_array(VARIANT_WORDS)
    va, vb = (F.array_sort(F.array_intersect(name_tokens(x), variants)) for x in (a, b))
    return related(a, b) & ~((F.size(va) > 0) & (F.size(vb) > 0) & (va != vb))


def agrees(a: Column | str, b: Column | str) -> Column:
    """Like related on words of four letters or more, but nothing to judge on is no agreement."""
    long = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]+)")), lambda w: F.length(w) > 3))
    return F.coalesce(overlap_share(long(a), long(b)) >= 0.5, F.lit(False))


def matching_tokens(c: Column | str) -> Column:
    """Words of a name for record linkage: no years, asides, stop words or single letters; sorted."""
    t = F.regexp_replace(F.lower(text(c)), r"\b(19|20)\d{2}\b", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), "[^a-z0-9]+", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.trim(t), " +"), lambda w: (F.length(w) > 1) & ~w.isin(*NAME_STOP_WORDS))))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def list_text(c: Column) -> Column:
    """A list as text: sorted, distinct, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(c)), ",")


def has_member(list_column: Column | str, value: Column | str) -> Column:
    """Exact membership in a comma list."""
    return F.array_contains(F.split(text(list_column), ","), value if isinstance(value, Column) else F.lit(value))


def salvage_json(c: Column | str) -> Column:
    """The JSON object of a model's answer: fences dropped, the first of a list, else the outermost {...}; null if none can be read."""
    t = F.trim(F.regexp_replace(text(c), r"(?m)^```(?:json)?|```$", ""))
    cut = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    listed = F.filter(F.from_json(F.when(t.startswith("["), t), "array<string>"), lambda x: x.startswith("{"))
    as_object = lambda j: F.when(j.startswith("{") & F.from_json(j, "map<string,string>").isNotNull(), j)
    return F.when(t.startswith("["), as_object(F.get(listed, F.lit(0)))).otherwise(F.coalesce(as_object(t), as_object(cut)))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(0).cast("int")


def sentence_with(page: Column | str, needle: Column | str) -> Column:
    """The sentence of the page that holds the needle, white space run together."""
    flat = F.regexp_replace(text(page), r"\s+", " ")
    return let(F.lower(text(needle)), lambda n: F.coalesce(F.get(F.filter(F.split(flat, r"(?<=[.!?]) "), lambda s: F.contains(F.lower(s), n)), F.lit(0)), F.lit("")))


def shingle_hashes(c: Column | str, size: int = 6) -> Column:
    """Distinct hashes of the runs of `size` words, as of `shingles`."""
    words = F.filter(F.split(F.lower(text(c)), r"\s+"), lambda w: w != "")
    runs = let(words, lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - size, F.lit(0)) + 1), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, size), " "))))
    return F.when(F.size(words) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def shingles(c: Column | str, size: int = 6) -> Column:
    """Distinct runs of `size` words."""
    words = F.filter(F.split(F.lower(text(c)), r"\s+"), lambda w: w != "")
    last = F.size(words) - size
    runs = let(words, lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(ws, i, size), " ")))
    return F.when(last >= 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))
