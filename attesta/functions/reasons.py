"""Sentences and outcomes that explain a verdict, each worked out from the verdict's own basis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import citations, dates, scoring, url
from attesta.functions.text import blank, call_label, let, text

# Wording of a status, of its basis, and of what the call is doing.
STATUS_WORDS = {"open": "Open", "closed": "Closed", "upcoming": "Upcoming", "unclear": "Unclear", "none": "No opportunity"}
BASIS_WORDS = {
    "explicit_open": "the page states the call is open",
    "explicit_closed": "the page states the call is closed or the deadline has passed",
    "explicit_upcoming": "the page states the call is announced but not yet open",
    "inferred_from_live_submission_form": "a live submission form was found and nothing says it's closed",
    "opportunity_signals_no_live_form": "a call/speakers page exists but no live form or explicit status was found",
    "no_opportunity_found": "the pages checked state there is no speaking/submission opportunity",
    "insufficient_evidence": "not enough evidence was found on the crawled pages to judge",
    "deadline_after_event_conflict": "the submission deadline is dated after the event itself - the page appears to mix editions, so a human should confirm",
    "inferred_open_but_deadline_past": "a live form was found but its deadline year has already passed - likely a stale page, so a human should confirm",
}
CALL_STATES = {
    "explicit_closed": "Call closed",
    "explicit_open": "Call open",
    "explicit_upcoming": "Announced, not yet open",
    "no_opportunity_found": "No speaking opportunity offered",
    "inferred_from_live_submission_form": "Call open",
    "opportunity_signals_no_live_form": "Call page exists, no live form",
    "insufficient_evidence": "Undetermined",
    "deadline_after_event_conflict": "Undetermined - page mixes editions",
    "inferred_open_but_deadline_past": "Undetermined - page looks stale",
}
# Wording of floor space and passes, of speaking, and of dates that are not for submitting.
NOT_SPEAKING = r"(?i)\b(booth|stand|exhibit\w*|floor space|delegate pass|attendee pass|table top|tabletop)\b"
SPEAKING = r"(?i)\b(speak\w*|present\w*|session|keynote|panel|thought leader\w*)\b"
OTHER_PURPOSE = r"(?i)\bnotif\w*|\bwithdraw\w*|\bregist(?:er|ration)\b|\bearly[- ]bird\b|\bhotel\b|\bvisa\b|\bpayment\b|\baccept(?:ance|ed) (?:letter|notice)"


def worded(c: Column | str, words: dict[str, str], otherwise: Column | str) -> Column:
    """The wording of a code."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), text(c)), otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def reason_sentence(status: Column, basis: Column, target: Column, form: Column, platform: Column, deadline: Column, deadline_confidence: Column, held: Column, held_confidence: Column, several_editions: Column) -> Column:
    """One paragraph: verdict, why, where to submit, the dates as read, and a caution."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    plain = F.when(blank(basis), "reason unrecorded").otherwise(text(basis))
    label = F.when(yes(form), F.concat(F.lit("Submit via"), F.when(blank(platform), "").otherwise(F.concat(F.lit(" "), platform, F.lit(" form"))))).otherwise("Submission URL")
    quoted = lambda name, value, sure: F.when(~blank(value), F.concat(F.lit(f'{name} "'), value, F.lit('" ('), text(sure), F.lit(").")))
    parts = [
        F.concat(worded(status, STATUS_WORDS, F.initcap(text(status))), F.lit(" - "), worded(basis, BASIS_WORDS, plain), F.lit(".")),
        F.when(~blank(target), F.concat(label, F.lit(": "), target, F.lit("."))),
        F.when(text(status).isin("upcoming", "unclear") & ~blank(target), "Submission page located - watching for the next open window."),
        quoted("Deadline", deadline, deadline_confidence),
        quoted("Event dates", held, held_confidence),
        F.when(yes(several_editions), "Caution: crawled pages disagree on dates — facts may span multiple editions."),
    ]
    return F.concat_ws(" ", *parts)


def call_state(basis: Column | str) -> Column:
    """struct(state, why): what the call is doing, apart from whether its address can be reached."""
    plain = F.when(blank(basis), "no basis recorded").otherwise(text(basis))
    return F.struct(worded(basis, CALL_STATES, "Undetermined").alias("state"), worded(basis, BASIS_WORDS, plain).alias("why"))


def sponsor_quote_outcome(sentence: Column | str, located: Column) -> Column:
    """Ok, blank, not-on-page or not-about-speaking. located: the page's own words, null if absent.

    A price for floor space is not a price for speaking.
    """
    space = located.rlike(NOT_SPEAKING) & ~located.rlike(SPEAKING)
    return F.when(blank(sentence), "blank").when(located.isNull(), "not-on-page").when(space, "not-about-speaking").otherwise("ok")


def citation_outcome(sentence: Column | str, located: Column, deadline: Column | str) -> Column:
    """struct(status, quote, call) of a sentence chosen as the citation of a deadline.

    In order: nothing chosen, not on the page, about another purpose, no readable deadline to
    compare with, no date at all, another date (the sentence is kept, to be reported), ok.
    """
    day = dates.parse_deadline(deadline)
    pick = lambda status, quote=F.lit(""), call=F.lit(""): F.struct(F.lit(status).alias("status"), quote.alias("quote"), call.alias("call"))

    def compared(pairs: Column) -> Column:
        same = F.exists(pairs, lambda p: (p["month"] == F.month(day)) & (p["day"] == F.dayofmonth(day)))
        return F.when(same, pick("ok", located, call_label(located))).when(F.size(pairs) > 0, pick("no-date", located)).otherwise(pick("undated"))

    return (
        F.when(blank(sentence), pick("blank"))
        .when(located.isNull(), pick("not-on-page"))
        .when(located.rlike(OTHER_PURPOSE), pick("wrong-purpose"))
        .when(day.isNull(), pick("unparseable-target"))
        .otherwise(let(citations.month_day_pairs(located), compared))
    )


def hop(start: Column | str, target: Column | str, anchor: Column | str, tokens: Column, city: Column | str, year: Column) -> Column:
    """Whether to leave a directory page for one event's own page, once: it fits better by a point or more."""
    other = url.normalize_url(target) != url.normalize_url(start)
    here, there = (scoring.score_event_link(u, a, tokens, city, year) for u, a in ((start, F.lit("")), (target, anchor)))
    return ~blank(target) & F.coalesce(other, F.lit(False)) & (there >= here + 1)


def looks_like_directory(has_name: Column, basis: Column, links: Column) -> Column:
    """A page on which no event was found, with many links."""
    weak = ~F.coalesce(has_name, F.lit(False)) | F.coalesce(basis.isin("insufficient_evidence", "no_opportunity_found"), F.lit(True))
    return weak & (links >= 20)
