"""Column functions on quotes, citations and forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import url
from attesta.functions.dates import MONTHS
from attesta.functions.records import opportunity_of
from attesta.functions.text import blank, call_label, contains_any, event_named, let, normalize_evidence, text

# Wording of forms that take contributions.
SUBMISSION_WORDS = ("submit", "submission", "proposal", "propose", "abstract", "cfp", "call for", "call-for", "speaker", "nominat", "best-of-show", "best of show", "awards entry", "award entry", "call for entries", "enter the awards", "submit an entry", "paper", "poster", "speaking")
# Kinds of call by kind of opportunity.
CALLS_OF = {
    "speaking": ("abstract", "full paper", "call for paper", "paper submission", "paper", "case study", "poster", "workshop", "tutorial", "panel", "late-breaking", "late breaking", "lightning", "speaker", "speaking", "presentation", "proposal", "talk", "session"),
    "awards": ("nomination", "entry", "award"),
    "exhibiting": ("exhibit", "booth", "sponsor"),
    "registration": ("register", "registration"),
}
# Marks of deliberate clears, and words that tell no call from another.
CLEAR_MARKERS = ("[retired]", "[R1 withdrawal]")
LABEL_STOP = ("the", "for", "and", "call", "deadline", "submission", "submissions")


def is_submission_form(action: Column | str, context: Column | str) -> Column:
    """Whether a form takes contributions, and not sign-ups or searches."""
    return contains_any(F.lower(F.concat_ws(" ", text(action), text(context))), SUBMISSION_WORDS)


def forms_in(html: Column | str) -> Column:
    """Array of struct(action, context) of a page's forms, in order, at most twelve."""
    blocks = F.slice(F.regexp_extract_all(text(html), F.lit(r"(?is)(<form\b.*?</form>)")), 1, 12)
    action = lambda b: F.regexp_extract(b, r"""(?is)^<form\b[^>]*?\baction\s*=\s*["']([^"']*)["']""", 1)
    context = lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"<[^>]+>", " "), r"\s+", " "))
    return F.transform(blocks, lambda b: F.struct(action(b).alias("action"), context(b).alias("context")))


def clickable_targets(html: Column | str) -> Column:
    """Addresses behind buttons: data attributes, formaction and scripted clicks; distinct."""
    h = text(html)
    attribute = F.regexp_extract_all(h, F.lit(r"""(?i)\b(?:data-href|data-url|data-link|data-target-url|data-goto|data-navigate|formaction)\s*=\s*["']([^"']+)["']"""))
    scripted = F.regexp_extract_all(h, F.lit(r"""(?i)(?:location\.href|window\.location(?:\.href)?|location\.assign|window\.open)\s*[=(]\s*['"]([^'"]+)['"]"""))
    return F.array_distinct(F.concat(attribute, scripted))


def is_deliberate_clear(detail: Column | str) -> Column:
    """P16"""
    d = F.trim(text(detail))
    return d.startswith(CLEAR_MARKERS[0]) | d.startswith(CLEAR_MARKERS[1])


def date_key(c: Column | str) -> Column:
    """Comparison key of a date as written: case, dashes, points and month names evened out; nothing parsed."""
    s = F.regexp_replace(F.lower(F.translate(text(c), "‐‑‒–—―−", "-------")), "[,.]", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*-\s*", "-"), r"\s+", " "))
    names = F.split(s, " ")

    def spelled(w: Column) -> Column:
        found = F.when(w == "sept", "september")
        for m in MONTHS:
            if m != "may":
                found = found.when(w == m[:3], m)
        return found.otherwise(w)

    return F.array_join(F.transform(names, spelled), " ")


def month_day_pairs(c: Column | str) -> Column:
    """Sorted distinct struct(month, day) that a text names, the year left out.

    Where a numeric date can be read both ways, both stand.
    """
    t = F.lower(text(c))
    month = "(?:" + "|".join(f"{m}|{m[:3]}" if m != "september" else f"{m}|sept|sep" for m in MONTHS) + ")"
    ordinal = "(?:st|nd|rd|th)?"
    number = lambda word: F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(word, 1, 3)).cast("int")
    pair = lambda m, d: F.struct(m.cast("int").alias("month"), d.cast("int").alias("day"))
    tokens = lambda p: F.regexp_extract_all(t, F.lit(p))
    named = F.transform(tokens(rf"\b({month}\.?\s+\d{{1,2}}{ordinal})\b"), lambda x: pair(number(x), F.regexp_extract(x, r"(\d{1,2})", 1)))
    reverse = F.transform(tokens(rf"\b(\d{{1,2}}{ordinal}\s+{month})\b"), lambda x: pair(number(F.regexp_extract(x, r"\s([a-z]+)$", 1)), F.regexp_extract(x, r"^(\d{1,2})", 1)))
    iso = F.transform(tokens(r"\b(20\d{2}[-/.]\d{1,2}[-/.]\d{1,2})\b"), lambda x: pair(F.regexp_extract(x, r"[-/.](\d{1,2})[-/.]", 1), F.regexp_extract(x, r"(\d{1,2})$", 1)))

    def both(x: Column) -> Column:
        a, b = F.regexp_extract(x, r"^(\d{1,2})", 1).cast("int"), F.regexp_extract(x, r"[-/.](\d{1,2})[-/.]", 1).cast("int")
        return F.when(a > 12, F.array(pair(b, a))).when(b > 12, F.array(pair(a, b))).otherwise(F.array(pair(a, b), pair(b, a)))

    slashed = F.flatten(F.transform(tokens(r"\b(\d{1,2}[-/.]\d{1,2}[-/.]20\d{2})\b"), both))
    return F.array_sort(F.array_distinct(F.concat(named, reverse, iso, slashed)))


def verify_call_label(page: Column | str, quote: Column | str, label: Column | str, window: int = 1500) -> Column:
    """The label if each of its telling words stands near the quote, else what the quote itself says."""
    call, low = F.lower(F.trim(text(label))), F.lower(text(page))
    at = F.instr(low, F.substring(F.lower(text(quote)), 1, 60))
    near = F.when(at > 0, F.substring(low, F.greatest(at - window, F.lit(1)), F.lit(2 * window))).otherwise(low)
    words = F.filter(F.split(call, "[^a-z0-9]+"), lambda w: (F.length(w) > 3) & ~w.isin(*LABEL_STOP))
    held = let(normalize_evidence(near), lambda n: (F.size(words) > 0) & F.forall(words, lambda w: F.contains(n, w)))
    return F.when(call == "", "").when(held, call).otherwise(call_label(quote))


def quote_around(page: Column | str, needle: Column | str, reach: int = 60) -> Column:
    """The words of a page around a needle, white space run together; empty if it is not there."""
    flat, low = F.regexp_replace(text(page), r"\s+", " "), F.lower(F.regexp_replace(text(page), r"\s+", " "))
    n = F.lower(text(needle))
    at = F.instr(low, n)
    return F.when((at > 0) & (n != ""), F.trim(F.substring(flat, F.greatest(at - reach, F.lit(1)), F.length(n) + 2 * reach))).otherwise("")


def date_quote(page: Column | str, d: Column, reach: int = 80) -> Column:
    """The words of a page around a date as people write it, whole words, never a bare day number; empty if none."""
    forms = ["MMMM d", "MMMM dd", "MMM d", "d MMMM", "d MMM", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy"]
    flat = F.regexp_replace(text(page), r"\s+", " ")

    def around(needle: Column) -> Column:
        at = F.instr(F.lower(flat), F.lower(needle))
        start = F.greatest(at - reach, F.lit(1))
        piece = F.substring(flat, start, F.lit(2 * reach))
        whole = F.when(start > 1, F.regexp_replace(piece, r"^\S*\s", "")).otherwise(piece)
        ended = F.when(start + 2 * reach <= F.length(flat), F.regexp_replace(whole, r"\s\S*$", "")).otherwise(whole)
        return F.when(needle.isNotNull() & (at > 0), F.trim(ended))

    return F.coalesce(*[around(F.date_format(d, f)) for f in forms], F.lit(""))


def closure_evidence(page: Column | str) -> Column:
    """The words around the first wording on a page that closes the call; empty if none does."""
    from attesta.operators.decisions import first_closure

    def around(flat: Column) -> Column:
        piece = let(first_closure(flat), lambda m: F.substring(flat, F.greatest(m["start"] - 60, F.lit(0)) + 1, m["end"] - F.greatest(m["start"] - 60, F.lit(0)) + 60))
        return F.coalesce(F.trim(piece), F.lit(""))

    return let(F.regexp_replace(text(page), r"\s+", " "), around)


def judged_fix(event: Column | str, cited: Column | str, ours: Column | str, quote: Column | str, name: Column | str) -> Column:
    """struct(verdict, reason): whether a better citation may be offered; CONFIRMED or REVIEW."""
    own, given = (F.regexp_replace(url.path_of(u), "/+$", "") for u in (ours, cited))
    label, theirs, kind = call_label(quote), call_label(cited), opportunity_of(event)
    fits = None
    for k, labels in CALLS_OF.items():
        fits = F.when(kind == k, label.isin(*labels)) if fits is None else fits.when(kind == k, label.isin(*labels))
    reason = (
        F.when(own == "", "our page is the homepage")
        .when((given != "") & (F.length(own) * 2 < F.length(given)), "our page is shallower than the cited one")
        .when(label == "", "our page does not name the call")
        .when(~F.coalesce(fits, F.lit(False)), "our page names a call of another kind")
        .when((theirs != "") & (theirs != label), "the cited page is of another call")
        .when(url.on_shared_platform(ours) & ~event_named(quote, name), "shared platform and the quote does not name the event")
    )
    return F.struct(F.when(reason.isNull(), "CONFIRMED").otherwise("REVIEW").alias("verdict"), F.coalesce(reason, F.lit("same call, and the quote carries the date")).alias("reason"))


def duration(seconds: Column) -> Column:
    """75 as 1m 15s."""
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def safe_filename(c: Column | str) -> Column:
    """Letters, digits, dashes and underscores; never empty."""
    s = F.regexp_replace(F.regexp_replace(text(c), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(blank(s), "sheet").otherwise(s)
