"""Queries of the reports and of citations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from attesta.functions import citations
from attesta.operators import reports
from attesta.plans.registry import query
from attesta.session import table

TODAY = dt.date(1998, 6, 1)
def k():
    """The key that stands for a claim."""
    return F.col("o_orderkey")


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))


@query("""WITH e AS (SELECT year(o_orderdate) || '-series-' || (o_custkey % 300) AS event, o_orderdate::DATE AS d, CASE o_orderkey % 9 WHEN 0 THEN 'Series discontinued' WHEN 1 THEN 'discontinued here, moves to Rome' ELSE '' END AS p FROM orders),
g AS (SELECT event, min(d) AS start, bool_or(contains(p, 'discontinued')) AS ended, bool_or(contains(p, 'moves to')) AS moves, row_number() OVER (PARTITION BY event[6:] ORDER BY event DESC) AS n FROM e GROUP BY event)
SELECT event, CASE WHEN n > 1 THEN 'Archived' WHEN ended AND NOT moves THEN 'Discontinued' WHEN start < DATE '2001-07-01' THEN 'Watching' ELSE 'Active' END AS state FROM g""")
def edition_states(spark, sf):
    """The state of each edition of a series."""
    o = _orders(spark, sf)
    event = F.concat(F.year("d").cast("string"), F.lit("-series-"), (F.col("o_custkey") % 300).cast("string"))
    prose = F.when(k() % 9 == 0, "Series discontinued").when(k() % 9 == 1, "discontinued here, moves to Rome").otherwise("")
    rows = o.select(event.alias("event"), F.date_format("d", "yyyy-MM-dd").alias("start"), prose.alias("prose"))
    return reports.edition_states(rows, "event", "start", "prose", dt.date(2001, 7, 1))


@query("""WITH o AS (SELECT o_orderkey AS k, date_diff('day', DATE '1998-06-01', o_orderdate::DATE) AS days, o_orderstatus AS s FROM orders), v AS (SELECT *, CASE WHEN days < 0 AND s <> 'F' THEN 'F' ELSE s END AS shown FROM o)
SELECT view, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN days BETWEEN 0 AND 7 THEN 'urgent' END, CASE WHEN days BETWEEN 0 AND 30 THEN 'soon' END, CASE WHEN shown = 'O' AND days + 60 BETWEEN 0 AND 120 THEN 'openevent' END, CASE WHEN shown = 'O' THEN 'open' END, CASE WHEN k % 6 = 0 THEN 'watching' END, CASE WHEN k % 5 = 0 THEN 'checked' END, CASE WHEN k % 5 = 1 THEN 'unconfirmed' END, CASE WHEN k % 7 = 0 THEN 'broken' END, 'all'], lambda x: x IS NOT NULL)) AS view FROM v) GROUP BY 1""")
def review_views(spark, sf):
    """Rows in each of the overlapping review views."""
    status = F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "P", "Upcoming").otherwise("Closed")
    views = reports.review_views(status, F.col("d"), F.date_add("d", 60), F.when(k() % 6 == 0, "Watching"), F.when(k() % 5 == 0, "verified").when(k() % 5 == 1, "no_quote"), k() % 7 == 0, TODAY)
    return _orders(spark, sf).select(F.explode(views).alias("view")).groupBy("view").agg(F.count("*").alias("n"))


@query("""SELECT change, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'newly_dead' ELSE 'newly_contradicted' END WHEN o_orderkey % 3 <> 1 AND o_orderkey % 4 = 0 THEN 'recovered' END AS change FROM orders) WHERE change IS NOT NULL GROUP BY 1""")
def weekly_digest(spark, sf):
    """What moved since the last sweep."""
    o = table(spark, sf, "orders")
    before = o.select("o_orderkey", F.when(k() % 4 == 0, "contradicted").otherwise("unverified").alias("state"))
    after = o.select("o_orderkey", F.when(k() % 3 == 1, "contradicted").otherwise("verified").alias("state"), F.when(k() % 5 == 0, "cited page does not exist").otherwise("").alias("detail"))
    return reports.digest(before, after, "o_orderkey").groupBy("change").agg(F.count("*").alias("n"))


@query("""SELECT verdict, path, bypass, count(*) AS n FROM (SELECT CASE WHEN page_id % 3 = 0 THEN 'BLOCKED' ELSE 'PASS' END AS verdict, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'manual-antibot' WHEN page_id % 5 = 0 THEN 'unresolved' ELSE 'core' END AS path, CASE WHEN page_id % 4 = 0 THEN 'cdp' WHEN page_id % 4 = 1 THEN 'playwright-fallback' ELSE '' END AS bypass FROM pages) GROUP BY ALL""")
def coverage(spark, sf):
    """What read each site, and which were left alone on purpose."""
    i = F.col("page_id")
    step = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))
    trace = F.concat(F.array(step("fetch", "start")), F.when(i % 2 == 0, F.array(step("skipped", "hard anti-bot"))).otherwise(F.array()), F.when(i % 4 == 0, F.array(step("fallback", "x"), step("fallback", "via cdp"))).when(i % 4 == 1, F.array(step("fallback", "rendered"))).otherwise(F.array()))
    p = table(spark, sf, "pages").select("url", F.when(i % 3 == 0, "BLOCKED").otherwise("PASS").alias("verdict"), F.when(i % 5 != 0, "core").alias("resolution_path"), trace.alias("trace"))
    return reports.coverage(p).groupBy("verdict", "path", "bypass").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderkey % 3 <> 0 AS found, o_orderkey % 4 <> 0 AS has, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 THEN o_orderkey % 5 <> 0 END AS year_match FROM orders""")
def gold_compare(spark, sf):
    """Our deadlines beside the true ones."""
    text = F.when(k() % 3 == 0, "").when(k() % 5 == 0, "some day in 1812").otherwise(F.date_format("d", "MMM yyyy"))
    g = reports.gold_compare(text, F.when(k() % 4 != 0, F.col("d")))
    return _orders(spark, sf).select("o_orderkey", g["found"].alias("found"), g["has"].alias("has"), g["year_match"].alias("year_match"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'no_quote' WHEN 2 THEN 'contradicted' WHEN 3 THEN 'verified' WHEN 4 THEN 'verified' ELSE 'no_quote' END AS verdict FROM orders""")
def evidence_audit(spark, sf):
    """What a page says of each claim, by field."""
    field = F.when(k() % 6 < 2, "deadline").when(k() % 6 < 4, "status").otherwise("venue")
    claimed = F.when(k() % 6 < 2, F.date_format("d", "yyyy-MM-dd")).when(k() % 6 == 2, "open").when(k() % 6 == 3, "closed").when(k() % 6 == 4, "Grand Hotel").otherwise("")
    page = F.when(k() % 6 == 0, F.concat(F.lit("Due "), F.date_format("d", "d MMMM yyyy"))).when(k() % 6 == 1, "Welcome").when(k() % 6 < 4, "Submissions are closed").otherwise("At the GRAND hotel")
    return _orders(spark, sf).select("o_orderkey", reports.audit(field, claimed, page, TODAY)["verdict"].alias("verdict"))


@query("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 101 >= 100 THEN '100%' WHEN o_orderkey % 101 >= 90 THEN '90-99%' WHEN o_orderkey % 101 >= 70 THEN '70-89%' WHEN o_orderkey % 101 >= 40 THEN '40-69%' ELSE 'under 40%' END AS band FROM orders) GROUP BY 1""")
def confidence_bands(spark, sf):
    """A18"""
    return table(spark, sf, "orders").groupBy(reports.confidence_band(k() % 101).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS watched, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS pipeline, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 3 = 0) AS open_confirmed, count(*) FILTER (o_orderkey % 3 = 1) AS check_link, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-06-01') AS new FROM orders""")
def kpis(spark, sf):
    """A6"""
    bucket = F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "P", "Upcoming").otherwise("Closed")
    o = _orders(spark, sf).select(bucket.alias("bucket"), F.when(k() % 3 == 0, "Confirmed").when(k() % 3 == 1, "Check link").otherwise("").alias("confidence"), "d")
    return reports.kpis(o, F.col("d"), dt.date(2001, 6, 1))


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS pass, count(*) FILTER (event_type = 'click') AS partial, count(*) FILTER (event_type = 'signup') AS blocked, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""")
def run_counters(spark, sf):
    """A12"""
    names = F.create_map(*[F.lit(x) for x in ("view", "PASS", "click", "PARTIAL", "signup", "BLOCKED", "error", "ERROR")])
    return reports.run_counters(table(spark, sf, "events").withColumn("v", names[F.col("event_type")]), "user_id", "v")


@query("""SELECT user_id, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2""")
def trace_counts(spark, sf):
    """Steps by action of traces of events; a trace is kept by day, so that none grows without bound."""
    step = F.struct(F.col("event_type").alias("action"), F.col("ts"))
    traces = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(step).alias("trace"))
    counts = reports.trace_counts(traces, "user_id", "trace")
    return counts.groupBy("user_id", "action").agg(F.sum("n").alias("n"))


@query(r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages) SELECT path, count(*) AS hosts FROM p WHERE path NOT IN ('', '/') GROUP BY 1 HAVING count(*) > 1""")
def repeated_paths(spark, sf):
    """A14"""
    return reports.repeated_paths(table(spark, sf, "pages"), "url")


@query(r"""SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\.', '') AS host, min(page_id % 2) AS series FROM pages GROUP BY 1 HAVING count(DISTINCT page_id % 2) = 1""")
def owned_hosts(spark, sf):
    """A16"""
    return reports.owned_hosts(table(spark, sf, "pages").withColumn("series", F.col("page_id") % 2), "url", "series")


@query("""SELECT o_custkey, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%b. %Y') ELSE upper(strftime(o_orderdate, '%B %Y')) END, o_orderkey) AS written FROM orders GROUP BY o_custkey, strftime(o_orderdate, '%Y-%m')""")
def distinct_dates(spark, sf):
    """Dates that differ by more than spelling, as first written."""
    o = _orders(spark, sf).select("o_custkey", "o_orderkey", F.when(k() % 2 == 0, F.date_format("d", "MMM. yyyy")).otherwise(F.upper(F.date_format("d", "MMMM yyyy"))).alias("written"))
    return reports.distinct_dates(o, "o_custkey", "o_orderkey", "written")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'stated' WHEN 1 THEN 'platform' WHEN 2 THEN 'form' WHEN 3 THEN 'page' END AS url, CASE o_orderkey % 5 WHEN 3 THEN 'inferred' WHEN 4 THEN NULL ELSE 'confirmed' END AS confidence FROM orders""")
def submission_targets(spark, sf):
    """D5"""
    t = reports.submission_target(F.when(k() % 5 == 0, "stated"), F.when(k() % 5 <= 1, "platform"), F.when(k() % 5 == 2, "form"), F.lit("page"), k() % 5 == 3)
    return table(spark, sf, "orders").select("o_orderkey", t["url"].alias("url"), t["confidence"].alias("confidence"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 10 = 0 THEN '[retired] ' || o_orderstatus ELSE o_orderstatus END AS detail FROM orders""")
def retired(spark, sf):
    """Retired claims lose their date and say why."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("detail"))
    return reports.retire(o, o.where(k() % 10 == 0), "o_orderkey", ["o_orderpriority"], citations.CLEAR_MARKERS[0])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 AND c_custkey % 3 = 0 AND l.seg IS NOT NULL THEN l.seg WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS seg FROM customer LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 10 = 2) l ON l.k = c_custkey + 1 WHERE c_custkey % 10 <> 2""")
def merged_duplicates(spark, sf):
    """Duplicates merged into the record before them; human values fill blanks only."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    rows = c.select("c_custkey", F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"))
    return reports.merge_duplicates(rows, c.where(k % 10 == 2).select(k.alias("loser"), (k - 1).alias("winner")), "c_custkey", ["seg"])


@query("""WITH l AS (SELECT o_orderkey, 'a' AS col, 'u' || (o_custkey % 50) AS url FROM orders UNION ALL SELECT o_orderkey, 'b', CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'u' || (o_custkey % 70) END FROM orders)
SELECT col AS "column", CASE WHEN CAST(url[2:] AS INT) < 40 THEN CASE WHEN CAST(url[2:] AS INT) % 2 = 0 THEN 'dead' ELSE 'alive' END ELSE 'unknown' END AS state, count(*) AS n FROM l WHERE url <> '' GROUP BY ALL""")
def link_fan_out(spark, sf):
    """Each distinct address checked once, its state brought back to every row and column."""
    c = F.col("o_custkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("u"), (c % 50).cast("string")).alias("a"), F.when(k() % 2 == 0, "").otherwise(F.concat(F.lit("u"), (c % 70).cast("string"))).alias("b"))
    states = spark.range(40).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") % 2 == 0, "dead").otherwise("alive").alias("state"))
    return reports.fan_out(rows, "o_orderkey", ["a", "b"], states).groupBy("column", "state").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS row, count(*) AS untried FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 = 1 AND o_orderkey % 5 <> 0 GROUP BY 1""")
def untried_links(spark, sf):
    """J21"""
    href = F.concat(F.when(k() % 3 == 0, "https://other.org/").otherwise("https://www.site.org/"), k().cast("string"))
    links = table(spark, sf, "orders").select(F.col("o_custkey").alias("row"), href.alias("href"), F.lit("https://site.org").alias("page"), F.when(k() % 4 == 1, "Call for Papers").otherwise("Venue").alias("label"), k())
    return reports.untried_links(links.drop("o_orderkey"), links.where(k() % 5 == 0).select("row", "href"), "row", "call for|submit")


@query("""SELECT o_custkey AS file, CASE WHEN arg_max(o_orderstatus, o_orderkey) FILTER (o_orderkey % 2 = 0) = 'F' THEN 'failed' WHEN count(*) FILTER (o_orderkey % 2 = 0) > 0 THEN 'done' ELSE 'to do' END AS state FROM orders GROUP BY 1""")
def batch_manifest(spark, sf):
    """Which files of a batch are done, failed or to do."""
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "file")
    done = o.where(k() % 2 == 0).select("file", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("state"), k().alias("at"))
    return reports.batch_manifest(o, done, "file")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'our page is the homepage' WHEN 1 THEN 'our page is shallower than the cited one' WHEN 2 THEN 'our page does not name the call' WHEN 3 THEN 'our page names a call of another kind' WHEN 4 THEN 'the cited page is of another call' ELSE 'same call, and the quote carries the date' END AS reason FROM orders""")
def judged_fixes(spark, sf):
    """Whether a better citation may be offered, and why not."""
    ours = F.when(k() % 6 == 0, "https://a.org/").when(k() % 6 == 1, "https://a.org/x").otherwise("https://a.org/dates/2026")
    cited = F.when(k() % 6 == 1, "https://a.org/call/2026/dates").when(k() % 6 == 4, "https://a.org/poster").otherwise("https://a.org/cfp")
    quote = F.when(k() % 6 == 2, "July 6").when(k() % 6 == 3, "Nomination deadline July 6").otherwise("Abstract deadline July 6")
    return table(spark, sf, "orders").select("o_orderkey", citations.judged_fix(F.lit("2026-a-rome"), cited, ours, quote, F.lit("A"))["reason"].alias("reason"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '3-15|9-14' WHEN 1 THEN '5-8|8-5' WHEN 2 THEN '9-28' ELSE '' END AS pairs, CASE WHEN o_orderkey % 2 = 0 THEN 'august 10-13 2026' ELSE 'may 2026' END AS date_key, CASE WHEN o_orderkey % 2 = 0 THEN 'late breaking poster' ELSE 'poster' END AS label, o_orderkey % 2 = 0 AS form FROM orders""")
def date_mentions(spark, sf):
    """Months and days a text names, date keys, labels that the page bears out, forms."""
    t = F.when(k() % 4 == 0, "Closes March 15th; 14 Sept").when(k() % 4 == 1, "due 5/8/2026").when(k() % 4 == 2, "28.9.2026 or 2026-09-28").otherwise("soon")
    pairs = F.array_join(F.transform(citations.month_day_pairs(t), lambda p: F.concat_ws("-", p["month"].cast("string"), p["day"].cast("string"))), "|")
    written = F.when(k() % 2 == 0, "AUG. 10 – 13, 2026").otherwise("May 2026")
    page = F.when(k() % 2 == 0, "Late breaking poster deadline: 1 July").otherwise("Poster deadline: 1 July")
    label = citations.verify_call_label(page, F.lit("Poster deadline: 1 July"), F.lit("Late breaking poster"))
    return table(spark, sf, "orders").select("o_orderkey", pairs.alias("pairs"), citations.date_key(written).alias("date_key"), label.alias("label"), citations.is_submission_form(F.when(k() % 2 == 0, "/cfp").otherwise("/newsletter"), F.lit("Your mail")).alias("form"))
