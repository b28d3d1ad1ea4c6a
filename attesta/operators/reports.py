"""Reports derived at reading time: states, views, digests, coverage; each a DataFrame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import citations, dates, records, url
from attesta.functions.text import blank, let, text
from attesta.operators.decisions import page_status, verdict
from attesta.operators.gate import ENDED_WORDING, MOVING_WORDING

# What is cleared with a retired deadline and with a withdrawn citation, and how the detail starts.
CLEARED = {"[retired]": ("deadline",), "[R1 withdrawal]": ("deadline_evidence_url", "deadline_quote")}
BANDS = ((100, "100%"), (90, "90-99%"), (70, "70-89%"), (40, "40-69%"), (0, "under 40%"))


def edition_states(rows: DataFrame, event: str, start: str, prose: str, today: dt.date) -> DataFrame:
    """(event, state): Archived but for the latest edition of a series; then Discontinued, Watching or Active.

    Rows of one event are one edition in several markets.
    """
    year = F.when(F.col(event).rlike(r"^(19|20)\d{2}-"), F.substring(event, 1, 4)).otherwise("0")
    each = rows.groupBy(event).agg(F.min(start).alias("start"), F.max(F.col(prose).rlike(ENDED_WORDING)).alias("ended"), F.max(F.col(prose).rlike(MOVING_WORDING)).alias("moves"))
    latest = F.row_number().over(Window.partitionBy(records.series(event)).orderBy(year.desc(), F.desc(event))) == 1
    ran = F.coalesce(F.try_to_date("start") < F.lit(today), F.lit(False))
    state = F.when(~latest, "Archived").when(F.col("ended") & ~F.col("moves"), "Discontinued").when(ran, "Watching").otherwise("Active")
    return each.select(event, state.alias("state"))


def review_views(status: Column, deadline: Column, start: Column, state: Column, check: Column, dead: Column, today: dt.date) -> Column:
    """The views a row stands in; they overlap. A passed deadline closes an open row first."""
    days, until = dates.days_until(deadline, today), dates.days_until(start, today)
    shown = F.when((days < 0) & status.isin("Open", "Upcoming"), "Closed").otherwise(status)
    views = {
        "urgent": days.between(0, 7), "soon": days.between(0, 30), "openevent": (shown == "Open") & until.between(0, 120), "open": shown == "Open", "watching": state == "Watching",
        "checked": check == "verified", "unconfirmed": check.isin("contradicted", "no_quote", "unreadable"), "broken": dead, "all": F.lit(True),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in views.items()]))


def digest(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) of states that moved: newly_dead, newly_contradicted or recovered."""
    b = before.select(key, F.col("state").alias("was"))
    moved = after.join(b, key, "left").where(text("state") != text("was"))
    gone = F.contains(F.lower(text("detail")), F.lit("does not exist"))
    change = F.when(F.col("state") == "contradicted", F.when(gone, "newly_dead").otherwise("newly_contradicted")).when((F.col("was") == "contradicted") & F.col("state").isin("verified", "not_found"), "recovered")
    return moved.select(key, change.alias("change")).where("change is not null")


def coverage(results: DataFrame) -> DataFrame:
    """(url, verdict, path, bypass): what read each site; a site left alone on purpose is no failure.

    results: url, verdict, resolution_path, trace (array of struct(action, reason)).
    """
    skipped = F.exists("trace", lambda e: (e["action"] == "skipped") & F.contains(text(e["reason"]), F.lit("anti-bot")))
    falls = F.filter("trace", lambda e: e["action"] == "fallback")
    last = F.get(F.reverse(falls), F.lit(0))["reason"]
    manual = F.col("verdict").isin("BLOCKED", "ERROR") & skipped
    return results.select("url", "verdict", F.when(manual, "manual-antibot").otherwise(F.coalesce("resolution_path", F.lit("unresolved"))).alias("path"), F.when(F.size(falls) == 0, "").when(F.contains(text(last), F.lit("cdp")), "cdp").otherwise("playwright-fallback").alias("bypass"))


def gold_compare(found: Column, gold: Column) -> Column:
    """struct(found, has, year_match): our deadline text beside the true date; the match is null unless both stand."""
    ours = ~blank(found)
    return F.struct(ours.alias("found"), gold.isNotNull().alias("has"), F.when(ours & gold.isNotNull(), F.contains(text(found), F.year(gold).cast("string"))).alias("year_match"))


def audit(field: Column, claimed: Column, page: Column, today: dt.date) -> Column:
    """What a page says of one claim: verified, contradicted or no_quote."""
    value = F.when(F.contains(F.lower(text(page)), F.lower(F.substring(text(claimed), 1, 60))), verdict("verified", "value stands on the page")).otherwise(verdict("no_quote", "value not found"))

    def status(said: Column) -> Column:
        return F.when(said.isNull(), verdict("no_quote", "no call status")).when(said == F.lower(text(claimed)), verdict("verified", "page states the status")).otherwise(verdict("contradicted", "page states another status"))

    def deadline(date: Column) -> Column:
        closed = F.when(page_status(page) == "closed", verdict("contradicted", "page states the call is closed")).otherwise(verdict("no_quote", "deadline not stated"))
        rival = let(dates.rival_dates(page, date, today), lambda r: F.when(F.size(r) > 0, verdict("contradicted", "page gives another deadline")).otherwise(closed))
        return F.when(dates.find_date(page, date), verdict("verified", "page states the date")).otherwise(rival)

    by_field = F.when(field == "deadline", let(dates.parse_deadline(claimed), deadline)).when(field == "status", let(page_status(page), status)).otherwise(value)
    return F.when(blank(claimed), verdict("no_quote", "nothing claimed")).otherwise(by_field)


def confidence_band(confidence: Column) -> Column:
    """A18"""
    found = None
    for least, name in BANDS:
        found = F.when(confidence >= least, name) if found is None else found.when(confidence >= least, name)
    return found


def kpis(events: DataFrame, first_seen: Column, cutoff: dt.date) -> DataFrame:
    """Watched, pipeline, confirmed open, to check and new events, in one row."""
    c = F.col
    return events.agg(F.count("*").alias("watched"), F.count_if(c("bucket").isin("Open", "Upcoming")).alias("pipeline"), F.count_if((c("bucket") == "Open") & (c("confidence") == "Confirmed")).alias("open_confirmed"), F.count_if(c("confidence") == "Check link").alias("check_link"), F.count_if(first_seen >= F.lit(cutoff)).alias("new"))


def run_counters(results: DataFrame, run: str, verdict_: str) -> DataFrame:
    """Results of each run by verdict."""
    return results.groupBy(run).agg(*[F.count_if(F.col(verdict_) == v).alias(v.lower()) for v in ("PASS", "PARTIAL", "BLOCKED", "ERROR")])


def trace_counts(results: DataFrame, key: str, trace: str) -> DataFrame:
    """Steps of each trace by action."""
    return results.select(key, F.explode(trace).alias("e")).groupBy(key, F.col("e.action").alias("action")).agg(F.count("*").alias("n"))


def repeated_paths(urls: DataFrame, column: str) -> DataFrame:
    """Paths that stand on more than one host: a sign of addresses that were made up."""
    each = urls.select(url.path_of(column).alias("path"), url.host(column).alias("host")).where("path not in ('', '/')").distinct()
    return each.groupBy("path").agg(F.count("*").alias("hosts")).where("hosts > 1")


def owned_hosts(urls: DataFrame, column: str, series: str) -> DataFrame:
    """Hosts of one series alone."""
    return urls.groupBy(url.bare_host(column).alias("host")).agg(F.min(series).alias("lo"), F.max(series).alias("hi")).where("lo = hi AND host <> ''").select("host", F.col("lo").alias(series))


def distinct_dates(pages: DataFrame, site: str, order: str, value: str) -> DataFrame:
    """Dates of a site that differ by more than their spelling, each as first written."""
    return pages.where(~blank(value)).withColumn("k", citations.date_key(value)).groupBy(site, "k").agg(F.min_by(value, order).alias(value)).drop("k")


def submission_target(stated: Column, external: Column, form: Column, opportunity: Column, has_call: Column) -> Column:
    """struct(url, confidence): where to submit: as stated, a platform, a form, else the best page."""
    pick = lambda u, c: F.struct(u.alias("url"), F.lit(c).alias("confidence"))
    return F.when(~blank(stated), pick(stated, "confirmed")).when(~blank(external), pick(external, "confirmed")).when(~blank(form), pick(form, "confirmed")).when(F.coalesce(has_call, F.lit(False)) & ~blank(opportunity), pick(opportunity, "inferred"))


def retire(df: DataFrame, retired: DataFrame, key: str, cleared: list[str], marker: str) -> DataFrame:
    """Listed records lose the cleared fields and say so in their detail.

    A retired deadline clears the deadline, a withdrawn citation its address and quote (CLEARED).
    """
    hit = F.col("_retired").isNotNull()
    joined = df.join(retired.select(key, F.lit(True).alias("_retired")).distinct(), key, "left")
    return joined.select(*[(F.when(hit, F.lit("")).otherwise(F.col(c)) if c in cleared else F.when(hit & ~text(c).startswith(marker), F.concat(F.lit(marker + " "), text(c))).otherwise(F.col(c)) if c == "detail" else F.col(c)).alias(c) for c in df.columns])


def merge_duplicates(df: DataFrame, pairs: DataFrame, key: str, human: list[str]) -> DataFrame:
    """(loser, winner) records made one; human fields go over only where the winner's are blank."""
    losers = df.join(pairs, df[key] == pairs["loser"]).select("winner", *[F.col(c).alias(f"_l_{c}") for c in human])
    given = losers.groupBy("winner").agg(*[F.min(F.when(~blank(f"_l_{c}"), F.col(f"_l_{c}"))).alias(f"_l_{c}") for c in human])
    there = pairs.join(df.select(F.col(key).alias("winner")), "winner", "left_semi").select(F.col("loser").alias(key))
    kept = df.join(there, key, "left_anti").join(given, F.col(key) == given["winner"], "left")
    return kept.select(*[(F.when(blank(c), F.coalesce(f"_l_{c}", c)).otherwise(F.col(c)) if c in human else F.col(c)).alias(c) for c in df.columns])


def fan_out(rows: DataFrame, key: str, columns: list[str], states: DataFrame) -> DataFrame:
    """(key, column, url, state): addresses of several columns checked once each and brought back."""
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("url")) for c in columns])).alias("l")).select(key, "l.*").where(~blank("url"))
    return long.join(states, "url", "left").select(key, "column", "url", F.coalesce("state", F.lit("unknown")).alias("state"))


def untried_links(links: DataFrame, tried: DataFrame, row: str, pattern: str) -> DataFrame:
    """Same-host links with a fitting label that were not tried yet, counted by row."""
    fit = links.where(url.bare_host("href").eqNullSafe(url.bare_host("page")) & F.lower(text("label")).rlike(pattern)).select(row, "href").distinct()
    return fit.join(tried.select(row, "href"), [row, "href"], "left_anti").groupBy(row).agg(F.count("*").alias("untried"))


def batch_manifest(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(key, state): which files of a batch are done, failed or still to do, so that a run resumes."""
    last = done.groupBy(key).agg(F.max_by("state", "at").alias("state"))
    return files.select(key).distinct().join(last, key, "left").select(key, F.coalesce("state", F.lit("to do")).alias("state"))
