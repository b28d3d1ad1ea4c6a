"""What people read and decide on: review rows, queues, the weekly review, and joins that feed them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import dates, url
from attesta.functions.text import blank, col, text
from attesta.operators import reports

# How a market is shown, the fields of a review row and the delivery columns they show.
MARKET_LABELS = {
    "robotics": "Robotics", "Robotics": "Robotics", "AdditiveMfg": "Additive Mfg", "ConsumerElectronics": "Consumer Electronics", "BioMedTech": "BioMedTech",
    "Cybersecurity": "Cybersecurity", "Semiconductor": "Semiconductor", "Utility": "Utility", "Bioeconomy": "Bioeconomy",
}
SHOWN = {
    "n": "CONFERENCE", "f": "FORMAT", "dates": "CONFERENCE DATES", "start": "START DATE", "dl": "SUBMISSION DEADLINE", "s": "STATUS", "det": "STATUS DETAILS", "q": "DEADLINE_QUOTE",
    "ev": "DEADLINE_EVIDENCE_URL", "trk": "TRACK", "op": "OPPORTUNITY_TYPE", "org": "ORGANIZER", "sponcost": "SPONSOR_COST", "sponurl": "SPONSOR_URL", "sponq": "SPONSOR_QUOTE",
}
# How a detail starts that answers a row for good, what links are for, and the mark of rows without a track.
ANSWERED = ("[R1 withdrawal]", "[retired]", "[upgraded")
LINK_LABELS = {"submission_url": "Submit link", "deadline_evidence_url": "Evidence link", "main_info_url": "Event site", "url": "Event site"}
NO_TRACK = "(none)"


def first_filled(*columns: Column) -> Column:
    """The first that is not blank, else the empty text."""
    return F.coalesce(*[F.when(~blank(c), c) for c in columns], F.lit(""))


def review_rows(delivery: DataFrame, dead: DataFrame, checks: DataFrame, today: dt.date) -> DataFrame:
    """The 29 fields of each delivered row as a reviewer sees it.

    dead: url; checks: event_id, v, u, q. Each link that is shown has a flag of its own: a blank
    link is not a dead one. Only a stated yes shows a sponsor mark.
    """
    g = lambda name: F.trim(text(F.col(f"`{name}`"))) if name in delivery.columns else F.lit("")
    market = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MARKET_LABELS.items() for x in pair]), g("Market")), g("Market"))
    fields = {out: g(name) for out, name in SHOWN.items()} | {
        "m": market,
        "loc": F.array_join(F.filter(F.array(g("CITY"), g("STATE_PROVINCE"), g("COUNTRY")), lambda x: x != ""), ", "),
        "c": F.substring_index(g("GROUNDING_CONFIDENCE"), " (", 1),
        "proj": g("IS_PROJECTED") == "true",
        "url": first_filled(g("CONFERENCE URL"), g("MAIN_INFO_URL")),
        "sub": first_filled(g("CFP_SUBMISSION_URL"), g("SUBMISSION URL")),
        "spon": F.lower(g("SPONSOR_REQUIRED")) == "yes",
    }
    shown = delivery.select(g("EVENT_ID").alias("event_id"), *[c.alias(n) for n, c in fields.items()])
    prose = delivery.select(g("EVENT_ID").alias("event_id"), g("START DATE").alias("start"), F.concat_ws(" ", g("STATUS DETAILS"), g("NOTES")).alias("prose"))
    states = reports.edition_states(prose, "event_id", "start", "prose", today).select("event_id", F.col("state").alias("st"))
    shown = shown.join(states, "event_id", "left").join(checks.select("event_id", *[F.col(c).alias(f"chk_{c}") for c in "vuq"]), "event_id", "left")
    gone = dead.where(~blank("url")).select("url").distinct()
    for link, flag in (("sub", "dead"), ("ev", "evdead"), ("url", "urldead")):
        shown = shown.join(gone.select(F.col("url").alias(link), F.lit(True).alias(flag)), link, "left")
    marks = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in ("dead", "evdead", "urldead")]
    checked = [F.coalesce(F.col(f"chk_{c}"), F.lit("")).alias(n) for c, n in (("v", "chk"), ("u", "chku"), ("q", "chkq"))]
    return shown.select(*fields, F.coalesce("st", F.lit("Active")).alias("st"), *marks, *checked)


def answered(detail: Column | str) -> Column:
    """Whether a row's detail says that it needs no further look."""
    return text(detail).rlike("^(" + "|".join(r"\Q" + a + r"\E" for a in ANSWERED) + ")")


def queue_reason(state: Column, detail: Column, deadline: Column, known: Column, today: dt.date) -> Column:
    """Why a row is not in the weekly queue, first reason first; queued if nothing speaks against it."""
    day = dates.parse_deadline(deadline)
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unmatched")
        .when(text(state) == "verified", "verified")
        .when(answered(detail), "answered")
        .when(day.isNull(), "no date")
        .when(day < F.lit(today), "passed")
        .otherwise("queued")
    )


def weekly_queue(rows: DataFrame, reason: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(queued rows, rows by reason); raises if more than `most` would be queued."""
    reasoned = rows.withColumn("reason", reason)
    tally = reasoned.groupBy("reason").agg(F.count("*").alias("n"))
    queued = tally.where("reason = 'queued'").agg(F.sum("n")).first()[0] or 0
    if queued > most:
        raise ValueError(f"{queued} rows would be queued, more than {most}")
    return reasoned.where("reason = 'queued'").drop("reason"), tally


def review_filters(markets: list[str] = (), statuses: list[str] = (), tracks: list[str] = (), edition: str = "", workflow: list[str] = (), window: int | str | None = None, search: str = "", today: dt.date | None = None) -> Column:
    """P5: the conjunction of a reviewer's filters on markets, status, track, edition, workflow, deadline, name.

    window: days ahead, "past due" or "undated"; tracks may hold "(none)"; the search is a
    literal part of the name or the address. Filters that are not given let everything pass.
    """
    keep = F.lit(True)
    if markets:
        keep = keep & F.arrays_overlap("markets", F.array(*[F.lit(m) for m in markets]))
    if statuses:
        keep = keep & F.lower(text("status")).isin(*[s.lower() for s in statuses])
    if tracks:
        own = F.filter(F.transform(F.split(text("track"), ";"), lambda t: F.trim(t)), lambda t: t != "")
        named = F.arrays_overlap(own, F.array(*[F.lit(t) for t in tracks]))
        keep = keep & F.when(F.size(own) == 0, F.lit(NO_TRACK in tracks)).otherwise(named)
    if edition:
        keep = keep & (text("edition") == edition)
    if workflow:
        keep = keep & F.col("workflow").isin(*workflow)
    if window is not None:
        days = dates.days_until(F.col("deadline"), today)
        keep = keep & {"past due": days < 0, "undated": days.isNull()}.get(window, days.between(0, window) if isinstance(window, int) else F.lit(False))
    if search.strip():
        wanted = F.lit(search.strip().lower())
        keep = keep & (F.contains(F.lower(text("name")), wanted) | F.contains(F.lower(text("url")), wanted))
    return F.coalesce(keep, F.lit(False))


def rank_order(bucket: Column, days: Column, name: Column | str, buckets: tuple[str, ...]) -> list[Column]:
    """O2: by bucket in their given order, then days to the deadline (unknown last), then name."""
    place = F.array_position(F.array(*[F.lit(b) for b in buckets]), bucket)
    return [place, F.coalesce(days, F.lit(9999)), F.lower(text(name))]


def deadline_order(days: Column) -> Column:
    """O3: soonest first, then the passed ones, the latest of them first; undated last."""
    return F.when(days.isNull(), 1_000_000_000).when(days < 0, 100_000_000 - days).otherwise(days)


def deep_first(candidates: DataFrame, key: str, address: str, position: str) -> DataFrame:
    """Candidates of each key numbered anew: deep pages before homepages, else in their old order."""
    order = Window.partitionBy(key).orderBy(url.is_homepage(address).cast("int"), position)
    return candidates.withColumn("place", F.row_number().over(order))


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """O1: the n newest finished runs."""
    return runs.where("finished_at is not null").orderBy(F.desc("id")).limit(n)


def weekly_review(rows: DataFrame, dead: DataFrame, proposed: DataFrame, today: dt.date) -> DataFrame:
    """(section, label, name): what is to decide this week and what changed.

    rows: name, deadline, verify_state, verify_detail and the four links; dead: url; proposed:
    name, url. Sections: proposed, contradicted (a deadline ahead), open, verified, dead (by what the link is for).
    """
    ahead = F.coalesce(dates.parse_deadline("deadline") >= F.lit(today), F.lit(False))
    state = text("verify_state")
    nothing = F.lit("")
    one = lambda d, section: d.select(F.lit(section).alias("section"), nothing.alias("label"), "name")
    links = rows.select("name", F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.trim(text(c)).alias("url")) for c, label in LINK_LABELS.items()])).alias("l")).select("name", "l.*").where("url <> ''")
    withheld = links.join(dead.select("url").distinct(), "url", "left_semi").select(F.lit("dead").alias("section"), "label", "name").distinct()
    return (
        one(proposed.where(~blank("url")), "proposed")
        .unionByName(one(rows.where((state == "contradicted") & ahead), "contradicted"))
        .unionByName(one(rows.where((state != "verified") & ~answered("verify_detail") & ahead), "open"))
        .unionByName(one(rows.where(state == "verified"), "verified"))
        .unionByName(withheld)
    )


def sponsor_candidates(rows: DataFrame) -> DataFrame:
    """Rows whose sponsorship is required and has a page, but no quote yet."""
    return rows.where((F.lower(F.trim(text("sponsor_required"))) == "yes") & ~blank("sponsor_url") & blank("sponsor_quote"))


def evidence_of_claims(evidence: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Each piece of evidence with the claim it is for."""
    return evidence.join(claims, key)


def with_memberships(events: DataFrame, memberships: DataFrame, key: str) -> DataFrame:
    """Events with their sorted markets; an event on no list has an empty one."""
    sets = memberships.groupBy(key).agg(F.array_sort(F.collect_set("market")).alias("markets"))
    return events.join(sets, key, "left").withColumn("markets", F.coalesce("markets", F.array().cast("array<string>")))


def canonical_map(seeds: DataFrame) -> DataFrame:
    """(raw_id, canonical_id): the first canonical id of each raw one, by file and row. seeds: file, row, raw_id, canonical_id."""
    given = seeds.where(~blank("raw_id") & ~blank("canonical_id"))
    return given.groupBy(F.trim("raw_id").alias("raw_id")).agg(F.min_by(F.trim("canonical_id"), F.struct("file", "row")).alias("canonical_id"))


def with_canonical_ids(delivery: DataFrame, mapped: DataFrame, raw: str, out: str) -> DataFrame:
    """Delivered rows with the canonical id of their own, or their own where none is known."""
    named = mapped.select(F.col("raw_id").alias("_raw"), F.col("canonical_id").alias("_canonical"))
    joined = delivery.join(named, F.trim(text(raw)) == named["_raw"], "left")
    return joined.withColumn(out, F.coalesce("_canonical", F.trim(text(raw)))).drop("_raw", "_canonical")


def backfilled_editions(records: DataFrame, edition: str, held: str, closes: str) -> DataFrame:
    """Blank editions from the dates already there; applied again it changes nothing."""
    return records.withColumn(edition, F.when(blank(edition), F.coalesce(dates.edition_year(held, closes), col(edition))).otherwise(col(edition)))


def backfilled_memberships(memberships: DataFrame, records: DataFrame, key: str, legacy: str) -> DataFrame:
    """Memberships with those of the legacy single column added, each once."""
    old = records.where(~blank(legacy)).select(key, F.trim(legacy).alias("market"), F.lit("backfill").alias("source_list"))
    return memberships.unionByName(old.join(memberships, [key, "market"], "left_anti").distinct())
