"""Ordered decisions: each returns a verdict with its reason, and absence never disproves.

Every function takes Columns and the reference date, none reads a clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import dates, text, url
from attesta.functions.text import blank, contains_any, let, text as t

# Markers of pages that refuse robots, and statuses that do.
BLOCK_MARKERS = ("just a moment", "cf-chl", "cf-browser-verification", "attention required", "access denied", "are you a robot", "captcha", "enable javascript and cookies", "request unsuccessful", "ddos protection")
BLOCK_STATUSES = (401, 403, 407, 429, 503)
MIN_USABLE_CHARS = 400
# Wording of closed and open calls.
CLOSED_WORDING = (
    r"deadline (?:has )?(?:now )?(?:expired|passed|closed)|submissions? (?:are |is |will )?(?:no longer|not) (?:be )?(?:accepted|being accepted)"
    r"|call for (?:papers|abstracts|speakers|presentations) (?:is |has )?(?:now )?closed|submissions? (?:are |is )?(?:now )?closed|closed for submissions"
    r"|thank(?:s| you)? (?:all )?(?:the )?authors who (?:have )?submitted"
)
OPEN_WORDING = r"call for (?:papers|abstracts|speakers|presentations) (?:is )?(?:now )?open|submissions? (?:are |is )?(?:now )?open|submit your (?:paper|abstract|proposal|talk)|now accepting (?:papers|abstracts|submissions|proposals)"
# Wording of conditions, of deadlines that are not the call's, and hosts that no citation may have.
CONDITIONAL = r"\b(?:once|if|when|after|unless|should|until|in the event|please note that)\b"
OTHER_DEADLINE = r"\b(?:registration|early[- ]bird|hotel|booth|exhibit\w*|payment|visa|badge)\s+deadline\b"

PROXY_HOSTS = ("vertexaisearch.cloud.google.com", "grounding-api-redirect", "webcache.googleusercontent.com", "translate.google.com", "r.jina.ai", "12ft.io", "outlook.safelinks.protection.outlook.com")
SOCIAL_HOSTS = ("facebook.com", "m.facebook.com", "fb.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "threads.net", "t.me", "tiktok.com", "reddit.com", "medium.com", "youtube.com", "youtu.be")
# Wording of consent walls, of checks for robots, and of pages that need scripts; marks of pages that are not there.
CONSENT_WORDING = r"(?i)accept all cookies|reject all|manage (your )?(cookie|consent|preferences)|we (use|value) (your )?(cookies|privacy)|cookie (policy|banner|settings)|consent to the use of cookies|privacy preference cent"
ROBOT_WORDING = (
    r"(?i)just a moment|checking your browser|verify(ing)? you are (a )?human|are you a robot|captcha|cloudflare|ddos protection|access denied|request unsuccessful"
    r"|incapsula|imperva|akamai|bot detection|unusual traffic|security check"
)
SCRIPT_WORDING = r"(?i)enable javascript|javascript is (required|disabled)|requires javascript|please enable js|<noscript>|loading\.\.\.$"
GONE_MARKS = ("404", "page not found", "cannot be found", "doesn't exist", "does not exist")


def verdict(name: Column | str, reason: Column | str, layer: str = "") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(name).alias("verdict"), lit(reason).alias("reason"), F.lit(layer).alias("layer"))


def quality(error: Column, fetched: Column, status: Column, body: Column, chars: Column) -> Column:
    """PASS, PARTIAL, BLOCKED or ERROR of one fetch; hard failures first."""
    return (
        F.when(~blank(error), verdict("ERROR", F.concat(F.lit("crawl raised an error: "), error)))
        .when(~F.coalesce(fetched, F.lit(False)), verdict("BLOCKED", "no response"))
        .when(status.isin(*BLOCK_STATUSES), verdict("BLOCKED", F.concat(F.lit("refused with status "), status.cast("string"))))
        .when(status >= 500, verdict("BLOCKED", F.concat(F.lit("server error status "), status.cast("string"))))
        .when(contains_any(F.lower(t(body)), BLOCK_MARKERS), verdict("BLOCKED", "page that refuses robots"))
        .when(status.between(400, 499), verdict("PARTIAL", F.concat(F.lit("page unavailable, status "), status.cast("string"))))
        .when(F.coalesce(chars, F.lit(0)) < MIN_USABLE_CHARS, verdict("PARTIAL", F.concat(F.lit("thin content: "), F.coalesce(chars, F.lit(0)).cast("string"))))
        .otherwise(verdict("PASS", F.concat(F.lit("usable content: "), chars.cast("string"))))
    )


def result_quality(error: Column, pages: Column, basis: Column, has_core: Column) -> Column:
    """The same for a finished record without fetch signals."""
    return (
        F.when(~blank(error), verdict("ERROR", "pipeline error"))
        .when(F.coalesce(pages, F.lit(0)) == 0, verdict("BLOCKED", "no pages were crawled"))
        .when((basis == "insufficient_evidence") & ~F.coalesce(has_core, F.lit(False)), verdict("PARTIAL", "too little was extracted"))
        .otherwise(verdict("PASS", "core facts extracted"))
    )


def first_closure(flat: Column) -> Column:
    """struct(start, end) of the first wording in a text that closes the call; null if none does.

    Wording under a condition within the 90 characters before it (in the same sentence), or near
    another deadline than the call's, closes nothing.
    """
    marks = F.regexp_extract_all(flat, F.lit(f"(?i)({CLOSED_WORDING})"))
    gaps = F.split(flat, f"(?i){CLOSED_WORDING}", -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(marks)), marks, lambda gap, mark: F.struct(F.length(gap).alias("gap"), F.length(mark).alias("mark")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def placed(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["mark"]).alias("at"), F.array_append(acc["found"], F.struct(start.alias("start"), (start + x["mark"]).alias("end"))).alias("found"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), placed, lambda acc: acc["found"])

    def real(m: Column) -> Column:
        near = F.greatest(m["start"] - 60, F.lit(0))
        before = F.substring(flat, F.greatest(m["start"] - 90, F.lit(0)) + 1, F.least(m["start"], F.lit(90)))
        return ~before.rlike(rf"(?is){CONDITIONAL}[^.]{{0,80}}$") & ~F.substring(flat, near + 1, m["end"] - near + 20).rlike(f"(?i){OTHER_DEADLINE}")

    # most pages have no such wording at all, and are not looked at again
    return F.when(flat.rlike(f"(?i){CLOSED_WORDING}"), F.get(F.filter(found, real), F.lit(0)))


def page_status(page: Column | str) -> Column:
    """Closed, open or null, from explicit wording. A condition, or another deadline, closes nothing."""
    said = lambda flat: F.when(first_closure(flat).isNotNull(), "closed").when(flat.rlike(f"(?i){OPEN_WORDING}"), "open")
    return let(F.regexp_replace(t(page), r"\s+", " "), said)


def consolidated_status(closed: Column, opened: Column, upcoming: Column, form: Column, opportunity: Column, denied: Column) -> Column:
    """D3: struct(status, basis); status words outrank dates and forms."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    pick = lambda s, b: F.struct(F.lit(s).alias("status"), F.lit(b).alias("basis"))
    return (
        F.when(yes(closed), pick("closed", "explicit_closed"))
        .when(yes(opened), pick("open", "explicit_open"))
        .when(yes(upcoming), pick("upcoming", "explicit_upcoming"))
        .when(yes(form), pick("open", "inferred_from_live_submission_form"))
        .when(yes(opportunity), pick("unclear", "opportunity_signals_no_live_form"))
        .when(yes(denied), pick("none", "no_opportunity_found"))
        .otherwise(pick("unclear", "insufficient_evidence"))
    )


def edition_consistency(status: Column, basis: Column, close: Column, event: Column, today: dt.date) -> Column:
    """Doubts a verdict whose deadline year and event year cannot both hold."""
    deadline, held = dates.lone_year(close), dates.lone_year(event)
    pick = lambda b: F.struct(F.lit("unclear").alias("status"), F.lit(b).alias("basis"))
    stale = (status == "open") & (basis == "inferred_from_live_submission_form") & (deadline < today.year)
    return F.when(deadline > held, pick("deadline_after_event_conflict")).when(stale, pick("inferred_open_but_deadline_past")).otherwise(F.struct(status.alias("status"), basis.alias("basis")))


def issues(status: Column, deadline_text: Column, start_text: Column, model: Column, city: Column, submission_url: Column, today: dt.date) -> Column:
    """Contradictions within a claim, in fixed order."""
    deadline, start = dates.parse_loose(deadline_text), dates.parse_loose(start_text)
    s, now = F.lower(F.trim(t(status))), F.lit(today)
    found = [
        F.when((deadline < now) & s.isin("open", "upcoming"), F.concat(F.lit("PASSED_DEADLINE ("), F.datediff(now, deadline).cast("string"), F.lit(" days past)"))),
        F.when((deadline >= now) & (s == "closed"), "CLOSED_BUT_DEADLINE_FUTURE"),
        F.when(deadline > start, "DEADLINE_AFTER_EVENT_START"),
        F.when((model == "Fixed Deadline") & blank(deadline_text), "FIXED_MODEL_NO_DEADLINE"),
        F.when(blank(city), "NO_CITY"),
        F.when(~t(submission_url).startswith("http"), "NO_SUBMISSION_URL"),
    ]
    return F.array_compact(F.array(*found))


def gated_claim_status(status: Column, deadline_text: Column, today: dt.date) -> Column:
    """A call whose deadline has passed is shown as closed."""
    s = F.coalesce(F.nullif(F.trim(t(status)), F.lit("")), F.lit("Unknown"))
    return F.when((dates.parse_loose(deadline_text) < F.lit(today)) & F.lower(s).isin("open", "upcoming"), "Closed").otherwise(s)


def is_past_edition(event_is_past: Column, edition: Column, today: dt.date) -> Column:
    return F.coalesce(event_is_past == 1, F.lit(False)) | F.coalesce((F.regexp_extract(t(edition), r"^\s*(\d+)\s*$", 1).try_cast("int") < today.year), F.lit(False))


def gated_status(status: Column, event_is_past: Column, edition: Column, today: dt.date) -> Column:
    """The status of a record after the past-date gate; none and blank stay."""
    raw = F.lower(t(status))
    return F.when(raw.isin("", "none"), raw).when(is_past_edition(event_is_past, edition, today), "closed").otherwise(raw)


def confidence(state: Column, detail: Column, projected: Column, deadline: Column, quality_: Column, status: Column) -> Column:
    """Whether a customer can act on a deadline."""
    s, d = F.lower(t(state)), F.lower(t(detail))
    gone = d.contains("404") | d.contains("does not exist")
    return (
        F.when(s == "contradicted", F.when(gone, "Check link").otherwise("Disputed"))
        .when(F.lower(F.trim(t(projected))).isin("true", "yes", "1", "y"), "Unconfirmed")
        .when(s == "verified", "Confirmed")
        .when(s.isin("not_found", "unverified"), "Unconfirmed")
        .when(~blank(deadline) & (t(quality_) == "PASS"), "Confirmed")
        .when(F.lower(F.trim(t(status))).isin("open", "upcoming"), "Unconfirmed")
        .otherwise("")
    )


def bucket(gated: Column, submission_url: Column) -> Column:
    """D12"""
    return F.when(gated == "closed", "Closed").when(gated == "open", "Open").when(gated == "upcoming", "Upcoming").when(~blank(submission_url), "Monitoring").otherwise("Verify")


def cross_check_status(claim_status: Column, claim_edition: Column, status: Column, basis: Column, edition: Column, close: Column, quality_: Column, today: dt.date) -> Column:
    """D14 (layer L0s): a status our crawl read in words, against the claim; null declines."""
    ours, theirs, live = F.lower(t(status)), F.lower(t(claim_status)), ("open", "upcoming")
    ed, own = F.substring(F.trim(t(claim_edition)), 1, 4), F.substring(F.trim(t(edition)), 1, 4)
    other_edition = ed.rlike(r"^\d+$") & own.rlike(r"^\d+$") & (ed != own)
    stale = F.coalesce(dates.parse_deadline(close) < F.lit(today), F.lit(False))
    usable = (t(quality_) == "PASS") & t(basis).startswith("explicit_") & (ours != "") & (theirs != "") & ~other_edition & ~stale
    same = (ours == theirs) | (ours.isin(*live) & theirs.isin(*live))
    return F.when(usable, F.when(same, verdict("verified", F.concat(F.lit("page states "), ours), "L0s")).otherwise(verdict("contradicted", F.concat(F.lit("page states "), ours, F.lit(", not "), theirs), "L0s")))


def cross_check(claim_deadline: Column, claim_edition: Column, close: Column, quality_: Column, today: dt.date) -> Column:
    """D15 (layer L0): our crawled deadline against the claim's; only a firm and current one contradicts."""
    ed = F.substring(F.trim(t(claim_edition)), 1, 4)

    def decide(d: Column) -> Column:
        theirs, ours = d["theirs"], d["ours"]
        firm = ours.isNotNull() & ~F.coalesce(ed.rlike(r"^\d{4}$") & (F.year(ours) < ed.try_cast("int")), F.lit(False)) & (ours >= F.lit(today))
        usable = ~blank(close) & theirs.isNotNull() & (t(quality_) == "PASS")
        contrary = verdict("contradicted", F.concat(F.lit("our crawl reports "), F.trim(t(close))), "L0")
        return F.when(usable, F.when(dates.find_date(close, theirs), verdict("verified", "our crawl reports the same date", "L0")).when(firm, contrary))

    return let(F.struct(dates.parse_deadline(claim_deadline).alias("theirs"), dates.parse_deadline(close).alias("ours")), decide)


def check_link(status: Column) -> Column:
    """D16 (layer L1): only a page that is gone contradicts."""
    return F.when(status.isin(404, 410), verdict("contradicted", F.concat(F.lit("cited page does not exist (status "), status.cast("string"), F.lit(")")), "L1"))


def verify_against_page(page: Column, claim_deadline: Column, claim_status: Column, cited: Column, today: dt.date) -> Column:
    """D17 (layer L2): a claim against the text of a page. Only the cited page can contradict a date."""
    claimed = F.lower(t(claim_status))
    # the page's status and the claimed date, and then the rival dates, are each worked out once
    read = F.struct(page_status(page).alias("said"), dates.parse_deadline(claim_deadline).alias("date"), t(page).alias("page"))

    def decide(r: Column) -> Column:
        said, theirs = r["said"], r["date"]
        return (
            F.when(blank(r["page"]), verdict("not_found", "page could not be read", "L2"))
            .when((said == "closed") & claimed.isin("open", "upcoming"), verdict("contradicted", "page states the call is closed", "L2"))
            .when((said == "closed") & theirs.isNull(), verdict("verified", "page states the call is closed", "L2"))
            .when(theirs.isNull(), verdict("not_found", "claim has no date to look for", "L2"))
            .when(dates.find_date(r["page"], theirs), verdict("verified", "date stands on the page", "L2"))
            .otherwise(let(dates.rival_dates(r["page"], theirs, today), silent))
        )

    def silent(rivals: Column) -> Column:
        return (
            F.when((F.size(rivals) > 0) & cited, verdict("contradicted", F.concat(F.lit("cited page gives "), F.array_join(F.slice(rivals, 1, 1), "")), "L2"))
            .when(F.size(rivals) > 0, verdict("not_found", "another page gives another date", "L2"))
            .otherwise(verdict("not_found", "page gives no deadline", "L2"))
        )

    return let(read, decide)


def resolve(*layers: Column) -> Column:
    """The first layer that decides; a claim that none decides is unverified."""
    return F.coalesce(*layers, verdict("unverified", "no layer could decide", ""))


def exportable(verdict_: Column, quote: Column, source: Column, event: Column) -> Column:
    """struct(ok, reason): whether a contradiction may leave the system."""
    reason = (
        F.when(t(verdict_) != "contradicted", "not a contradiction")
        .when(blank(quote), "no quote captured")
        .when(url.on_shared_platform(source) & ~text.event_named(quote, event), "shared platform and the quote does not name the event")
        .when(text.call_label(quote) == "", "quote does not name the call")
    )
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def is_proxy(link: Column | str) -> Column:
    """Whether an address only leads through a search, cache or mail proxy to the page."""
    return contains_any(F.lower(t(link)), PROXY_HOSTS)


def is_social(link: Column | str) -> Column:
    """Whether an address is a post and no page of its own."""
    return url.bare_host(link).isin(*SOCIAL_HOSTS) | url.host(link).isin(*SOCIAL_HOSTS)


def citation_guard(known: Column, proposed: Column, current: Column, readable: Column, quote: Column, page: Column) -> Column:
    """What becomes of a proposed citation, in order of the rules."""
    on_page = F.contains(text.normalize_evidence(page), text.normalize_evidence(F.substring(t(quote), 1, 60)))
    return (
        F.when(~known, "rejected: unknown id")
        .when(blank(proposed), "kept: nothing proposed")
        .when(is_proxy(proposed), "rejected: proxy")
        .when(is_social(proposed), "rejected: social")
        .when(url.is_homepage(proposed) & ~blank(current) & (url.url_depth(current) > 0), "rejected: homepage over a deeper page")
        .when(~F.coalesce(readable, F.lit(False)), "rejected: unreadable")
        .when(~blank(quote) & ~F.coalesce(on_page, F.lit(False)), "rejected: quote not on page")
        .otherwise("accepted")
    )


def proposal_class(proposed: Column) -> Column:
    """CONFIDENT, REVIEW or REJECT for a replacement submission link."""
    path = F.lower(F.concat(url.path_of(proposed), F.lit("?"), url.query_of(proposed)))
    submits = path.rlike("submit|submission|abstract|proposal|cfp|call-for")
    form = url.detect_platform(proposed).isNotNull()
    return (
        F.when(url.is_homepage(proposed) | blank(proposed), "REJECT")
        .when(path.rlike("/(events|conferences|calendar|list|search)(/|\\?|$)") & ~submits, "REJECT")
        .when(form, F.when(path.rlike("summary|register|registration"), "REVIEW").otherwise("CONFIDENT"))
        .when(submits, "CONFIDENT")
        .otherwise("REVIEW")
    )


def authorize(active: Column, floor: Column, features: Column, quota: Column, used: Column, version: Column, feature: Column) -> Column:
    """struct(status, reason) of a request for a licence; a null `active` is an unknown key."""
    pick = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return (
        F.when(active.isNull(), pick(401, "unknown license key"))
        .when(active == 0, pick(403, "license revoked or suspended"))
        .when(~blank(floor) & dates.version_lt(version, floor), pick(426, "client version below the floor"))
        .when(~blank(feature) & ~text.has_member(features, t(feature)), pick(403, "feature not in plan"))
        .when((quota >= 0) & (used >= quota), pick(402, "token quota reached"))
        .otherwise(pick(200, "ok"))
    )


def reconciled_field(theirs: Column, ours: Column, is_date: bool = False) -> Column:
    """Confirmed, changed or gap_filled; null where nothing is to say."""
    a, b = (F.lower(F.regexp_replace(F.trim(t(c)), r"\s+", " ")) for c in (theirs, ours))
    same = a == b
    if is_date:
        x, y = dates.date_signature(theirs), dates.date_signature(ours)
        same = F.coalesce(x == y, same)
    return F.when((a == "") & (b == ""), F.lit(None)).when(a == "", "gap_filled").when(b == "", F.lit(None)).when(same, "confirmed").otherwise("changed")


def page_kind(page: Column | str) -> Column:
    """Empty, unreadable (and why), bot-check, js-only, consent-wall, thin or readable; the first that fits."""
    p = t(page)
    ok, n, head = text.readable(p), F.length(p), F.substring(p, 1, 1500)
    return (
        F.when(blank(p), "empty")
        .when(~ok["ok"], F.concat(F.lit("unreadable: "), ok["reason"]))
        .when(head.rlike(ROBOT_WORDING), "bot-check")
        .when((n < 1200) & head.rlike(SCRIPT_WORDING), "js-only")
        .when((n < 1500) & head.rlike(CONSENT_WORDING), "consent-wall")
        .when(n < 400, "thin")
        .otherwise("readable")
    )


def silence(resolves: Column, status: Column, n_bytes: Column) -> Column:
    """Which kind of nothing came back: gone, refused, our_bug, thin or unknown.

    Only a name that does not resolve, or 404 and 410, says that a page is gone; a refusal says
    nothing about it, and a page that a plain request gets in full is a fault of ours.
    """
    return (
        F.when(~F.coalesce(resolves, F.lit(True)), "gone")
        .when(status.isin(404, 410), "gone")
        .when(status.isin(401, 403, 429), "refused")
        .when(status.isNull() | (status >= 400), "unknown")
        .when(n_bytes > 2000, "our_bug")
        .otherwise("thin")
    )


def second_opinion(status: Column, body: Column | str) -> Column:
    """Dead, http and the status, empty or ALIVE, by what a browser got; a short page that says so is dead too."""
    chars = F.length(F.trim(t(body)))
    soft = contains_any(F.substring(F.lower(t(body)), 1, 4000), GONE_MARKS) & (chars < 2500)
    return F.when(status.isin(404, 410) | soft, "dead").when(status >= 400, F.concat(F.lit("http "), status.cast("string"))).when(chars < 200, "empty").otherwise("ALIVE")


def alerts(changes: DataFrame, deadlines: DataFrame, today: dt.date) -> DataFrame:
    """(key, severity, kind). changes: key, field, new_value, change_type; deadlines: key, deadline.

    Only changes that were applied raise alerts: a conflict with a human's value does not.
    """
    applied = F.col("change_type") == "updated"
    alert = lambda severity, kind: F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"))
    kind = (
        F.when(F.col("change_type") == "new_record", alert("MEDIUM", "new_conference"))
        .when(applied & (F.col("field") == "cfp_status") & (F.lower("new_value") == "open"), alert("HIGH", "cfp_open"))
        .when(applied & (F.col("field") == "conference_dates"), alert("MEDIUM", "dates_changed"))
        .when(applied & (F.col("field") == "submission_url"), alert("LOW", "submission_url_changed"))
    )
    found = changes.withColumn("a", kind).where("a is not null").select("key", "a.severity", "a.kind")
    soon = deadlines.where(dates.closing_within(F.col("deadline"), 30, today)).select("key", F.lit("HIGH").alias("severity"), F.lit("deadline_soon").alias("kind"))
    return found.unionByName(soon)


def failures(df: DataFrame, offender: str, checks: dict[str, tuple[bool, Column]]) -> DataFrame:
    """(check_id, fatal, offender) of every row that fails a check, in one pass over df.

    checks: id -> (fatal, condition that a good row meets); a null condition passes.
    """
    found = F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(True)), F.struct(F.lit(name).alias("check_id"), F.lit(fatal).alias("fatal"))) for name, (fatal, good) in checks.items()]))
    return df.select(F.explode(found).alias("f"), F.col(offender).cast("string").alias("offender")).select("f.*", "offender")
