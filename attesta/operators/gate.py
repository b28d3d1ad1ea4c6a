"""The acceptance gate of a delivery and the invariants of what is held.

Every check is one condition on a row, so that all of them are read from one scan; what needs
other rows (duplicates) or other tables (pages, claims, holds) is a join beside it. Findings are
rows: (check_id, fatal, offender). An advisory finding is reported and rejects nothing.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import dates, url
from attesta.functions.text import blank, gate_text, text
from attesta.operators.decisions import failures

# Widths of a delivery, the columns a wide one ends in, and the vocabularies of its cells.
WIDTHS = (38, 43)
SPONSOR_COLUMNS = ("ORGANIZER", "SPONSOR_REQUIRED", "SPONSOR_URL", "SPONSOR_COST", "SPONSOR_QUOTE")
SPONSOR_VALUES = ("yes", "no", "unknown", "")
FORMATS = ("In-Person", "Virtual", "Hybrid")
OPPORTUNITIES = ("Speaking", "Awards", "Exhibiting", "Registration")
NOT_A_VALUE = (
    "n/a", "na", "n.a.", "tbd", "tba", "unknown", "none", "null", "various", "multiple", "multiple cities", "multiple states", "multiple locations",
    "multiple regional cities", "varies", "to be announced", "to be determined", "-", "--",
)
VALUE_COLUMNS = ("CITY", "STATE_PROVINCE", "COUNTRY", "CONFERENCE DATES", "SUBMISSION DEADLINE", "START DATE", "LOCATION")
# Wording of many events in one row, of ended events, of moving ones, of live calls and of venues.
SERIES_WORDING = r"(?i)\bmultiple\b|\bvarious\b|\bregional\b|\bnationwide\b|\bseveral\b"
ENDED_WORDING = (
    r"(?i)permanently ended|permanently concluded|no future editions|final edition|last edition|"
    r"discontinued|no longer (?:being )?(?:held|running)|has been cancell?ed|"
    r"ceased operations|will not (?:be held|return)|final year"
)
MOVING_WORDING = r"(?i)cycle dictates|rotat|alternat|moves to|held instead in"
LIVE_WORDING = r"(?i)(?<!last )\b(active|now open|now accepting|currently accepting)\b"
VENUE_WORDING = r"(?i)\b(messe|expo|centre|convention|fira|pavilion|arena|showplace|koelnmesse|terminal|ahoy|sniec|lvcc|iicc|nec)\b"
# Venues and postcodes that got into canonical keys.
KEY_VENUES = (
    r"-(?:hilton|hyatt|marriott|intercontinental|sheraton|westin|radisson|novotel|big-sight|marina-bay-sands|intex-\w+|makuhari-messe"
    r"|convention-cent(?:er|re)|exhibition-cent(?:er|re)|expo-cent(?:er|re))\b"
)
KEY_POSTCODE = r"-(?:\d{5}|[a-z]\d{1,2}[a-z]?-?\d[a-z]{2})(?:-|$)"


def row_checks(columns: list[str], today: dt.date) -> dict[str, tuple[bool, Column]]:
    """Check id -> (fatal, what a good row meets), for all checks that look at one row alone."""
    g = lambda name: F.trim(text(F.col(f"`{name}`"))) if name in columns else F.lit("")
    low = lambda name: F.lower(g(name))
    iso = lambda name: g(name).rlike(r"^\d{4}-\d{2}-\d{2}$")
    deadline, details, evidence, city = g("SUBMISSION DEADLINE"), g("STATUS DETAILS"), g("DEADLINE_EVIDENCE_URL"), g("CITY")
    projected, grounded, now = low("IS_PROJECTED"), g("GROUNDING_CONFIDENCE"), F.lit(today.isoformat())
    word = F.lower(F.trim(F.substring_index(grounded, "(", 1)))
    prose = F.concat_ws(" ", details, g("NOTES"))
    ended = F.concat_ws(" ", prose, g("DEADLINE_QUOTE")).rlike(ENDED_WORDING)
    bare = lambda u: F.lower(F.regexp_replace(u, "/+$", ""))
    front_door = (bare(evidence) == bare(g("MAIN_INFO_URL"))) | F.regexp_replace(url.path_of(evidence), "/+$", "").isin("")
    checks = {
        "4": (True, ~((projected == "true") & details.rlike(LIVE_WORDING) & ~details.rlike(ENDED_WORDING))),
        "5": (True, ~(g("OPPORTUNITY_TYPE").isin("Exhibiting", "Registration") & (deadline != ""))),
        "5b": (True, g("OPPORTUNITY_TYPE").isin(*OPPORTUNITIES)),
        "6": (True, ~(iso("SUBMISSION DEADLINE") & (deadline < now) & (low("CFP MODEL TYPE") != "rolling form") & low("STATUS").isin("open", "upcoming"))),
        "6b": (True, ~(iso("SUBMISSION DEADLINE") & iso("START DATE") & (deadline > g("START DATE")))),
        "R2": (True, ~(iso("SUBMISSION DEADLINE") & (deadline >= now) & (projected == "false") & (evidence == ""))),
        "R8a": (True, (g("GATED_STATUS") == "") & (g("ISSUES") == "")),
        "R8b": (True, ~city.rlike(VENUE_WORDING)),
        "R8d": (True, (g("EDITION") == "") | g("EDITION").rlike(r"^(19|20)\d{2}$")),
        "R11": (True, (grounded == "") | ~projected.isin("true", "false") | (word == F.when(projected == "true", "projected").otherwise("verified"))),
        "R12": (True, g("FORMAT").isin("", *FORMATS)),
        "R16": (True, ~(prose.rlike(ENDED_WORDING) & ~prose.rlike(MOVING_WORDING) & ((g("LIFECYCLE_EVIDENCE_URL") == "") | (g("LIFECYCLE_QUOTE") == "")))),
        "2.1b": (True, ~(ended & ((projected == "false") | F.contains(F.lower(grounded), F.lit("verified"))))),
        "2.6": (True, ~reduce(lambda a, b: a | b, [low(c).isin(*NOT_A_VALUE) for c in VALUE_COLUMNS])),
        "5.4": (True, ~F.concat_ws(" ", city, g("STATE_PROVINCE")).rlike(SERIES_WORDING)),
        "R3b": (False, ~((deadline != "") & (evidence != "") & front_door)),
        "STUB": (False, ~F.contains(details, F.lit("Audit Exception"))),
    }
    if "SPONSOR_REQUIRED" in columns:  # narrow deliveries say nothing of sponsors
        required = low("SPONSOR_REQUIRED")
        checks["R18a"] = (True, required.isin(*SPONSOR_VALUES) & ~((g("SPONSOR_COST") != "") & required.isin("no", "")))
        checks["R18b"] = (True, ~((required == "yes") & (g("SPONSOR_URL") == "")))
    return checks


def structure_failures(ragged: DataFrame) -> DataFrame:
    """Check 1: records of another width than their header, and headers of no known width or of wrong last columns.

    ragged: path, line, width, header_width, cells, as from read_ragged.
    """
    last = F.transform(F.slice("cells", -5, 5), lambda c: F.trim(c))
    header = F.col("line") == 1
    wrong = (header & (~F.col("width").isin(*WIDTHS) | ((F.col("width") == max(WIDTHS)) & (last != F.array(*[F.lit(c) for c in SPONSOR_COLUMNS]))))) | (~header & (F.col("width") != F.col("header_width")))
    return ragged.where(wrong).select(F.lit("1").alias("check_id"), F.lit(True).alias("fatal"), F.concat(F.lit("line "), F.col("line").cast("string")).alias("offender"))


def citation_failures(delivery: DataFrame, pages: DataFrame, offender: str) -> DataFrame:
    """Checks 2 and 3: cited pages that are gone, and quotes that do not stand on their page.

    pages: url, status, page; one row for each address. A page that refuses us (403) proves
    nothing, nor does one without text. A missing quote whose date is on the page is a paraphrase.
    """
    cited = delivery.select(F.col(f"`{offender}`").cast("string").alias("offender"), F.trim(text("DEADLINE_EVIDENCE_URL")).alias("url"), F.trim(text("DEADLINE_QUOTE")).alias("quote"), dates.parse_deadline(F.col("`SUBMISSION DEADLINE`")).alias("day"))
    read = cited.where("url <> ''").join(pages.select("url", "status", "page"), "url")
    gone = F.col("status").isin(404, 410)
    absent = ~gone & (F.col("status") != 403) & (F.col("quote") != "") & ~blank("page") & ~F.contains(gate_text("page"), gate_text("quote"))
    kind = F.when(F.coalesce(dates.find_date("page", F.col("day")), F.lit(False)), "3 paraphrase").otherwise("3 absent")
    return read.select(F.when(gone, "2").when(absent, kind).alias("check_id"), F.lit(True).alias("fatal"), "offender").where("check_id is not null")


def repeated_keys(delivery: DataFrame, key: str, check_id: str) -> DataFrame:
    """Check R8c, invariant 5: keys that stand more than once."""
    named = delivery.groupBy(F.trim(text(key)).alias("offender")).agg(F.count("*").alias("n")).where("n > 1")
    return named.select(F.lit(check_id).alias("check_id"), F.lit(True).alias("fatal"), "offender")


def loaded_failures(records: DataFrame) -> DataFrame:
    """Checks 7 and 8, on records as they are shown: key, edition, claim_edition, research_status, confidence.

    7: a record that wears the claim of another edition; 8: an open record without a label.
    """
    own, theirs = F.substring(text("edition"), 1, 4), F.substring(text("claim_edition"), 1, 4)
    borrowed = own.rlike(r"^\d+$") & theirs.rlike(r"^\d+$") & (own != theirs)
    unlabelled = (text("research_status").startswith("Open") | text("research_status").startswith("Upcoming")) & blank("confidence")
    return failures(records, "key", {"7": (True, ~borrowed), "8": (True, ~unlabelled)})


def acceptance(delivery: DataFrame, today: dt.date, offender: str = "CONFERENCE", pages: DataFrame | None = None) -> DataFrame:
    """(check_id, fatal, offender) of all checks of a delivery; nothing found is accepted."""
    found = failures(delivery, f"`{offender}`", row_checks(delivery.columns, today))
    found = found.unionByName(repeated_keys(delivery, "EVENT_ID", "R8c"))
    return found if pages is None else found.unionByName(citation_failures(delivery, pages, offender))


def invariants(held: DataFrame, delivered: DataFrame, holds: DataFrame, link_checks: DataFrame) -> DataFrame:
    """(check_id, fatal, offender) of the invariants 1 to 8 on the rows held.

    held: event_id, name, edition, verify_state and, once it exists, key_year; delivered: event_id;
    holds: event_id of rows held on purpose. Number 8 only watches.
    """
    finding = lambda d, n: d.select(F.lit(n).alias("check_id"), F.lit(True).alias("fatal"), F.col("event_id").cast("string").alias("offender"))
    ids, sent = held.select("event_id").distinct(), delivered.select("event_id").distinct()
    missing = finding(sent.join(ids, "event_id", "left_anti"), "1")
    extra = finding(ids.join(sent.unionByName(holds.select("event_id")), "event_id", "left_anti"), "2")
    key, edition = text("event_id"), F.trim(text("edition"))
    named = F.regexp_extract(text("name"), r"\b(20\d\d)\b", 1)
    checks = {
        "3": (True, ~(key.rlike(KEY_VENUES) | key.rlike(KEY_POSTCODE))),
        "4": (True, ~text("verify_state").isin("", "unverified")),
        "8": (False, (named == "") | ~edition.rlike(r"^\d+$") | (named == edition)),
    }
    if "key_year" in held.columns:
        year = F.trim(text("key_year"))
        checks["7"] = (True, (year != "") & F.startswith(key, F.concat(year, F.lit("-"))))
    empty = link_checks.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    unswept = empty.select(F.lit("6").alias("check_id"), F.lit(True).alias("fatal"), F.lit("link_checks").alias("offender"))
    return failures(held, "event_id", checks).unionByName(missing).unionByName(extra).unionByName(repeated_keys(held, "event_id", "5")).unionByName(unswept)


def verdict_of(findings: DataFrame) -> DataFrame:
    """One row: whether a delivery is accepted, its fatal and its advisory findings."""
    return findings.agg((F.count_if("fatal") == 0).alias("accepted"), F.count_if("fatal").alias("fatal"), F.count_if(~F.col("fatal")).alias("advisory"))

