"""Queries on claims: dates, decisions, verification. Claims are made from orders and customers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from attesta.functions import dates, records, text, url
from attesta.operators import decisions, merge
from attesta.plans.registry import query
from attesta.session import table

TODAY = dt.date(1998, 6, 1)
def k():
    """The key that stands for a claim."""
    return F.col("o_orderkey")

SPELLED_SQL = """CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) WHEN 2 THEN day(o_orderdate) || ' ' || strftime(o_orderdate, '%B') || ' ' || year(o_orderdate)
 WHEN 3 THEN strftime(o_orderdate, '%b') || '. ' || day(o_orderdate) || 'th, ' || year(o_orderdate) WHEN 4 THEN 'closes ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 5 THEN 'early ' || year(o_orderdate) WHEN 6 THEN '' ELSE day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) END"""


def spelled():
    """A date of each order, spelled in one of eight ways."""
    d = F.col("o_orderdate")
    day, month, year = (F.date_format(d, p) for p in ("d", "M", "yyyy"))
    iso, long, short = (F.date_format(d, p) for p in ("yyyy-MM-dd", "MMMM", "MMM"))
    forms = [iso, F.concat_ws("/", month, day, year), F.concat_ws(" ", day, long, year), F.concat(short, F.lit(". "), day, F.lit("th, "), year), F.concat(F.lit("closes "), iso), F.concat(F.lit("early "), year), F.lit(""), F.concat_ws("/", day, month, year)]
    found = F.when(k() % 8 == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        found = found.when(k() % 8 == i, f)
    return found


def _spelled(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", spelled().alias("t"))


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN iso WHEN 1 THEN iso WHEN 7 THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') END END AS loose,
 CASE o_orderkey % 8 WHEN 0 THEN iso WHEN 1 THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE iso END WHEN 2 THEN iso WHEN 3 THEN iso WHEN 7 THEN iso END AS deadline,
 CASE WHEN o_orderkey % 8 = 0 THEN iso END AS iso_only,
 CASE WHEN o_orderkey % 8 IN (0, 1) THEN iso WHEN o_orderkey % 8 = 7 THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE iso END WHEN o_orderkey % 8 <> 6 AND year(o_orderdate) >= 2000 THEN year(o_orderdate) || '-07-01' END AS matching,
 CASE WHEN o_orderkey % 8 <> 6 AND year(o_orderdate) >= 2000 THEN year(o_orderdate) END::INT AS lone
FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)""")
def date_parsers(spark, sf):
    """T31a-e, T28: what each parser makes of the same texts; they differ on purpose."""
    s = _spelled(spark, sf)
    out = {"loose": dates.parse_loose("t"), "deadline": dates.parse_deadline("t"), "iso_only": dates.parse_iso("t"), "matching": dates.parse_for_matching("t")}
    return s.select("o_orderkey", *[F.date_format(c, "yyyy-MM-dd").alias(n) for n, c in out.items()], dates.lone_year("t").alias("lone"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2027' WHEN o_orderkey % 3 = 1 THEN '2031' END AS edition, CASE WHEN o_orderkey % 3 = 0 THEN 2026 WHEN o_orderkey % 3 = 1 THEN 2031 END::INT AS first, CASE WHEN o_orderkey % 3 = 0 THEN false WHEN o_orderkey % 3 = 1 THEN false END AS past, date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::INT AS serial, strftime(o_orderdate, '%Y-%m-%d') AS back FROM orders""")
def years_and_serials(spark, sf):
    """Years in texts, past-ness, spreadsheet days there and back."""
    o = table(spark, sf, "orders")
    t = F.when(k() % 3 == 0, "May 3-5, 2026 (moved to 2027)").when(k() % 3 == 1, "Edition 2031, hall 20261").otherwise("market day, soon")
    serial = dates.excel_serial(F.to_date("o_orderdate"))
    return o.select("o_orderkey", dates.edition_year(F.lit("no year"), t).alias("edition"), dates.first_year(t).alias("first"), dates.event_past(t, dt.date(2026, 12, 1)).alias("past"), serial.alias("serial"), F.date_format(dates.from_excel_serial(serial), "yyyy-MM-dd").alias("back"))


WRITTEN = ("MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "dd MMM yyyy", "MM/dd/yyyy", "yyyy-MM-dd", "yyyy")
WRITTEN_SQL = ("strftime(p, '%B') || ' ' || day(p) || ', ' || year(p)", "day(p) || ' ' || strftime(p, '%B') || ' ' || year(p)", "strftime(p, '%b') || ' ' || day(p) || ', ' || year(p)", "strftime(p, '%d %b %Y')", "strftime(p, '%m/%d/%Y')", "strftime(p, '%Y-%m-%d')", "year(p)::VARCHAR")
BOTH_SQL = " OR ".join(f"contains(page, {e.replace('p,', 'd,').replace('(p)', '(d)')})" for e in WRITTEN_SQL[:-1])


@query("WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE + (o_orderkey % 3 - 1)::INT * 400 AS p FROM orders), t AS (SELECT o_orderkey, d, 'Key: ' || CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(WRITTEN_SQL)) + f" END || '. More' AS page FROM o) SELECT o_orderkey, {BOTH_SQL} AS found FROM t")
def find_dates(spark, sf):
    """Whether a claimed date stands in a page in another rendering; two pages of three name another day."""
    d = F.to_date("o_orderdate")
    other, page = F.date_add(d, ((k() % 3 - 1) * 400).cast("int")), None
    for i, form in enumerate(WRITTEN):
        spelled_ = F.concat(F.lit("Key: "), F.date_format(other, form), F.lit(". More"))
        page = F.when(k() % 7 == i, spelled_) if page is None else page.when(k() % 7 == i, spelled_)
    return table(spark, sf, "orders").select("o_orderkey", dates.find_date(page, d).alias("found"))


STATUS_SQL = "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Upcoming' ELSE 'Closed' END"
LOOSE_SQL = "CASE WHEN o_orderkey % 8 IN (0, 1) THEN o_orderdate::DATE WHEN o_orderkey % 8 = 7 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END"


def _claims(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "P", "Upcoming").otherwise("Closed")
    return _spelled(spark, sf).select("o_orderkey", status.alias("status"), "t", F.col("o_totalprice").alias("price"), "o_orderdate")


@query(f"""WITH c AS (SELECT o_orderkey, {STATUS_SQL} AS s, {LOOSE_SQL} AS d, o_orderkey % 8 = 6 AS nodate FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN d < DATE '1998-06-01' AND s <> 'Closed' THEN 'PASSED_DEADLINE (' || date_diff('day', d, DATE '1998-06-01') || ' days past)' END, CASE WHEN d >= DATE '1998-06-01' AND s = 'Closed' THEN 'CLOSED_BUT_DEADLINE_FUTURE' END,
 CASE WHEN d > DATE '2000-01-01' THEN 'DEADLINE_AFTER_EVENT_START' END, CASE WHEN nodate THEN 'FIXED_MODEL_NO_DEADLINE' END, CASE WHEN o_orderkey % 5 = 0 THEN 'NO_CITY' END, CASE WHEN o_orderkey % 6 = 0 THEN 'NO_SUBMISSION_URL' END], lambda x: x IS NOT NULL), '|') AS issues,
 CASE WHEN d < DATE '1998-06-01' AND s <> 'Closed' THEN 'Closed' ELSE s END AS gated FROM c""")
def claim_issues(spark, sf):
    """Contradictions within a claim, and its status after the date gate."""
    c = _claims(spark, sf)
    city, link = F.when(k() % 5 != 0, "Berlin"), F.when(k() % 6 != 0, "https://x.example/cfp")
    found = decisions.issues(F.col("status"), F.col("t"), F.lit("1/1/2000"), F.lit("Fixed Deadline"), city, link, TODAY)
    return c.select("o_orderkey", F.array_join(found, "|").alias("issues"), decisions.gated_claim_status(F.col("status"), F.col("t"), TODAY).alias("gated"))


@query(f"""WITH c AS (SELECT o_orderkey AS k, {STATUS_SQL} AS s, {LOOSE_SQL} AS d FROM orders), i AS (SELECT k, unnest(list_filter([CASE WHEN d < DATE '1998-06-01' AND s <> 'Closed' THEN 'PASSED_DEADLINE' END, CASE WHEN d >= DATE '1998-06-01' AND s = 'Closed' THEN 'CLOSED_BUT_DEADLINE_FUTURE' END, CASE WHEN k % 5 = 0 THEN 'NO_CITY' END], lambda x: x IS NOT NULL)) AS issue FROM c)
SELECT issue, count(*) AS n FROM i GROUP BY 1""")
def issue_histogram(spark, sf):
    """How often each issue stands in an import."""
    c = _claims(spark, sf)
    found = decisions.issues(F.col("status"), F.col("t"), F.lit(""), F.lit("Rolling Form"), F.when(k() % 5 != 0, "Berlin"), F.lit("http"), TODAY)
    return c.select(F.explode(found).alias("i")).groupBy(F.substring_index("i", " ", 1).alias("issue")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Check link' ELSE 'Disputed' END WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Unconfirmed' ELSE 'Confirmed' END WHEN 2 THEN 'Unconfirmed' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Unconfirmed' WHEN o_orderkey % 8 <> 6 THEN 'Confirmed' WHEN o_orderstatus IN ('O', 'P') THEN 'Unconfirmed' ELSE '' END END AS confidence,
 CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderkey % 7 = 0 OR year(o_orderdate) < 1998 THEN 'closed' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'upcoming' END AS gated FROM orders""")
def confidence(spark, sf):
    """Whether a deadline can be acted on, and the status after the edition gate."""
    c = _claims(spark, sf)
    state = F.when(k() % 5 == 0, "contradicted").when(k() % 5 == 1, "verified").when(k() % 5 == 2, "not_found")
    detail, projected = F.when(k() % 2 == 0, "cited page 404").otherwise("another date"), F.when(k() % 3 == 0, "TRUE").otherwise("")
    return c.select(
        "o_orderkey",
        decisions.confidence(state, detail, projected, F.col("t"), F.lit("PASS"), F.col("status")).alias("confidence"),
        decisions.gated_status(F.col("status"), F.when(k() % 7 == 0, 1).otherwise(0), F.date_format("o_orderdate", "yyyy"), TODAY).alias("gated"),
    )


#: Sentences of pages; each order's page is one of the first column and one of the second.
OPENINGS = ("Venue and travel.", "Submit your abstract today!", "Once the papers are in, we read.", "If you wonder:", "The registration deadline and", "Early-bird deadline expired, hotel rooms remain.", "Submissions are open.")
CLOSINGS = ("Call for papers is now closed.", "submissions are closed, write to us.", "Deadline has passed for all.", "Submissions will not be accepted", "We meet in May.", "thank you authors who have submitted", "now accepting proposals", "deadline has expired")
CLOSED_SQL = r"(deadline (has )?(now )?(expired|passed|closed)|submissions? (are |is |will )?(no longer|not) (be )?(accepted|being accepted)|call for (papers|abstracts|speakers|presentations) (is |has )?(now )?closed|submissions? (are |is )?(now )?closed|closed for submissions|thank(s| you)? (all )?(the )?authors who (have )?submitted)"
OPEN_SQL = r"call for (papers|abstracts|speakers|presentations) (is )?(now )?open|submissions? (are |is )?(now )?open|submit your (paper|abstract|proposal|talk)|now accepting (papers|abstracts|submissions|proposals)"


def _chosen(values, n, k_=None):
    found = None
    for i, v in enumerate(values):
        found = F.when(k() % n == i, v) if found is None else found.when(k() % n == i, v)
    return found


def _chosen_sql(values, n):
    return f"CASE o_orderkey % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def page_text():
    return F.concat_ws("  ", _chosen(OPENINGS, 7), _chosen(CLOSINGS, 8))


@query(f"""WITH p AS (SELECT o_orderkey, lower(concat_ws(' ', {_chosen_sql(OPENINGS, 7)}, {_chosen_sql(CLOSINGS, 8)})) AS t FROM orders),
c AS (SELECT *, regexp_matches(t, '{CLOSED_SQL}') AS closing, regexp_matches(t, '\\b(once|if|when|after|unless|should|until|in the event|please note that)\\b[^.]{{0,80}}{CLOSED_SQL}') AS conditional, regexp_matches(t, '\\b(registration|early[- ]bird|hotel|booth|exhibit[a-z]*|payment|visa|badge) +deadline\\b') AS other FROM p)
SELECT o_orderkey, CASE WHEN closing AND NOT conditional AND NOT other THEN 'closed' WHEN regexp_matches(t, '{OPEN_SQL}') THEN 'open' END AS status FROM c""".replace("\\\\", "\\"))
def page_status(spark, sf):
    """Closed or open by explicit wording; rules and other deadlines close nothing."""
    return table(spark, sf, "orders").select("o_orderkey", decisions.page_status(page_text()).alias("status"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_orderstatus AS s FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 6 = 0 AND NOT (k % 5 = 0 AND d < DATE '1998-06-01') AND NOT (k % 5 = 1 AND d + 40 < DATE '1998-06-01') THEN CASE WHEN (k % 2 = 0 AND s IN ('O', 'P')) OR (k % 2 = 1 AND s = 'F') THEN 'verified' ELSE 'contradicted' END
 WHEN k % 5 = 0 THEN 'verified' WHEN k % 5 = 1 AND d + 40 >= DATE '1998-06-01' THEN 'contradicted' WHEN k % 4 = 0 THEN 'contradicted' WHEN k % 3 = 0 THEN 'verified' ELSE 'not_found' END AS verdict,
 CASE WHEN k % 6 = 0 AND NOT (k % 5 = 0 AND d < DATE '1998-06-01') AND NOT (k % 5 = 1 AND d + 40 < DATE '1998-06-01') THEN 'L0s' WHEN k % 5 = 0 THEN 'L0' WHEN k % 5 = 1 AND d + 40 >= DATE '1998-06-01' THEN 'L0' WHEN k % 4 = 0 THEN 'L1' ELSE 'L2' END AS layer FROM b""")
def layered_verification(spark, sf):
    """The first layer that decides each claim; absence never disproves."""
    d = F.to_date("o_orderdate")
    iso = F.date_format(d, "yyyy-MM-dd")
    s = table(spark, sf, "orders")
    claimed = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("upcoming")
    close = F.when(k() % 5 == 0, F.date_format(d, "MMMM d, yyyy")).when(k() % 5 == 1, F.date_format(F.date_add(d, 40), "yyyy-MM-dd"))
    ours, basis = F.when(k() % 2 == 0, "open").otherwise("closed"), F.when(k() % 6 == 0, "explicit_open").otherwise("inferred")
    l0s = decisions.cross_check_status(claimed, F.lit(""), ours, basis, F.lit(""), close, F.lit("PASS"), TODAY)
    l0 = decisions.cross_check(iso, F.lit(""), close, F.lit("PASS"), TODAY)
    l1 = decisions.check_link(F.when(k() % 4 == 0, 404).otherwise(200))
    page = F.when(k() % 3 == 0, F.concat(F.lit("Deadline is "), F.date_format(d, "d MMM yyyy"))).otherwise("Welcome to the venue")
    l2 = decisions.verify_against_page(page, iso, claimed, F.lit(True), TODAY)
    # like the status check, the date check of a stale record declines only if it cannot confirm
    return s.select("o_orderkey", decisions.resolve(l0s, l0, l1, l2).alias("v")).select("o_orderkey", "v.verdict", "v.layer")


VERDICTS = ("contradicted", "verified", "contradicted")
QUOTES = ("Abstract deadline: July 6, 2026 for talks", "The date is July 6, 2026", " ", "Photonics poster deadline: July 6", "Global Congress speakers by July", "Nominations close in May", "Workshop on optics of PHOTONICS")
SOURCES = ("https://ras.papercept.net/x", "https://photonics.example/cfp", "https://easychair.org/cfp/p", "https://EDAS.info/N1", "https://a.example/?easychair")


@query(f"""WITH q AS (SELECT o_orderkey, {_chosen_sql(VERDICTS, 3)} AS v, {_chosen_sql(QUOTES, 7)} AS q, lower({_chosen_sql(SOURCES, 5)}) AS s FROM orders), l AS (SELECT *, coalesce([x for x in {list(text.CALL_LABELS)} if contains(lower(q), x)][1], '') AS label, len([x for x in {list(url.SHARED_PLATFORMS)} if contains(s, x)]) > 0 AS shared, contains(lower(q), 'photonics') AS named FROM q),
r AS (SELECT *, CASE WHEN v <> 'contradicted' THEN 'not a contradiction' WHEN trim(q) = '' THEN 'no quote captured' WHEN shared AND NOT named THEN 'shared platform and the quote does not name the event' WHEN label = '' THEN 'quote does not name the call' ELSE '' END AS reason FROM l) SELECT o_orderkey, reason = '' AS ok, reason, label FROM r""")
def exportable(spark, sf):
    """Whether a contradiction may leave the system, and the first reason if not."""
    quote, source = _chosen(QUOTES, 7), _chosen(SOURCES, 5)
    e = decisions.exportable(_chosen(VERDICTS, 3), quote, source, F.lit("Photonics Global Congress 2026"))
    return table(spark, sf, "orders").select("o_orderkey", e["ok"].alias("ok"), e["reason"].alias("reason"), text.call_label(quote).alias("label"))


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'rejected: unknown id' WHEN 1 THEN 'kept: nothing proposed' WHEN 2 THEN 'rejected: proxy' WHEN 3 THEN 'rejected: social' WHEN 4 THEN 'rejected: homepage over a deeper page' WHEN 5 THEN 'rejected: unreadable' WHEN 6 THEN 'rejected: quote not on page' ELSE 'accepted' END AS fate FROM orders""")
def citation_merge(spark, sf):
    """What becomes of each proposed citation."""
    proposed = F.when(k() % 8 == 1, "").when(k() % 8 == 2, "https://r.jina.ai/https://e.example/cfp").when(k() % 8 == 3, "https://www.linkedin.com/p/1").when(k() % 8 == 4, "https://e.example/").otherwise("https://e.example/cfp/dates")
    quote = F.when(k() % 8 == 6, "Something else entirely").otherwise("Deadline: 15th March")
    fate = decisions.citation_guard(k() % 8 != 0, proposed, F.lit("https://e.example/a/b"), k() % 8 != 5, quote, F.lit("The DEADLINE:   15 march!"))
    return table(spark, sf, "orders").select("o_orderkey", fate.alias("fate"))


PROPOSED = ("https://e.example/", "", "https://e.example/events/", "https://e.example/events/cfp", "https://sessionize.com/e-2026", "https://sessionize.com/e/register", "https://e.example/submit-abstract", "https://e.example/about/team", "https://e.example/search?q=proposal", "https://e.example/list?page=2", "https://e.example/calendar", "https://easychair.org/my/summary", "https://e.example/x/CFP#a")
PATH_SQL = r"lower(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) || '?' || regexp_extract(u, '^[^?#]*\?([^#]*)', 1))"


@query(f"""WITH u AS (SELECT o_orderkey, {_chosen_sql(PROPOSED, 13)} AS u FROM orders), p AS (SELECT *, {PATH_SQL} AS p FROM u), s AS (SELECT *, regexp_matches(p, 'submit|submission|abstract|proposal|cfp|call-for') AS submits, len([x for x in {list(url.PLATFORMS)} if contains(lower(u), x)]) > 0 AS form FROM p)
SELECT o_orderkey, CASE WHEN u = '' OR p IN ('?', '/?') THEN 'REJECT' WHEN regexp_matches(p, '/(events|conferences|calendar|list|search)(/|[?]|$)') AND NOT submits THEN 'REJECT' WHEN form THEN CASE WHEN regexp_matches(p, 'summary|register|registration') THEN 'REVIEW' ELSE 'CONFIDENT' END WHEN submits THEN 'CONFIDENT' ELSE 'REVIEW' END AS class FROM s""")
def link_proposals(spark, sf):
    """What to do with a replacement link."""
    return table(spark, sf, "orders").select("o_orderkey", decisions.proposal_class(_chosen(PROPOSED, 13)).alias("class"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Ulm' WHEN 1 THEN 'Reno' WHEN 2 THEN 'Monaco' ELSE '' END AS city, CASE o_orderkey % 4 WHEN 0 THEN 'Fixed Deadline' WHEN 1 THEN 'Rolling Form' WHEN 2 THEN 'Invite Only' ELSE 'Not Announced' END AS model, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'kept' END AS cell FROM orders""")
def places_and_models(spark, sf):
    """Settlements out of venues, models out of spellings, placeholders out of cells."""
    location = F.when(k() % 4 == 0, "Messe Ulm, Ulm, Germany").when(k() % 4 == 1, "Expo Hall, Reno, Nevada, USA").when(k() % 4 == 2, "Harbour Expo, Monaco").otherwise("TBD")
    state = F.when(k() % 4 == 0, "Ulm").when(k() % 4 == 1, "Nevada").when(k() % 4 == 2, "Monaco").otherwise("")
    country = F.when(k() % 4 == 0, "Germany").when(k() % 4 == 1, "USA").when(k() % 4 == 2, "Monaco").otherwise("")
    model = F.when(k() % 4 == 0, "fixed-deadline").when(k() % 4 == 1, "ROLLING").when(k() % 4 == 2, "Curated / Invite").otherwise("who knows")
    city = F.when(k() % 4 == 0, "Messe Ulm").otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", records.clean_city(location, city, state, country).alias("city"), records.call_model(F.regexp_replace(model, "Curated / Invite", "curated invite")).alias("model"), text.scrub_placeholder(F.when(k() % 2 == 0, " N/A ").otherwise("kept ")).alias("cell"))


@query("""WITH o AS (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE upper(c_name) || ' ' END AS tn, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'x' ELSE c_mktsegment END AS ts FROM customer WHERE c_custkey % 7 <> 0)
SELECT c_custkey, 'not_crawled' AS field, NULL AS category FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 'name', CASE WHEN c_custkey % 6 = 0 THEN 'gap_filled' ELSE 'confirmed' END FROM o UNION ALL SELECT c_custkey, 'segment', CASE c_custkey % 4 WHEN 0 THEN 'gap_filled' WHEN 1 THEN 'changed' ELSE 'confirmed' END FROM o
UNION ALL SELECT c_custkey, 'start', CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE 'confirmed' END FROM o""")
def reconciliation(spark, sf):
    """A customer's sheet against our records, field by field; dates by year and month."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    theirs = c.select("c_custkey", F.when(k % 6 != 0, F.concat(F.upper("c_name"), F.lit(" "))).otherwise("").alias("tn"), F.when(k % 4 == 1, "x").when(k % 4 != 0, F.col("c_mktsegment")).alias("ts"), F.when(k % 3 == 0, "June 2026").otherwise("12 May 2026").alias("td"))
    ours = c.where(k % 7 != 0).select("c_custkey", "c_name", "c_mktsegment", F.lit("2026-05-30").alias("start"), F.lit(True).alias("there"))
    both = theirs.join(ours, "c_custkey", "left")
    entry = lambda n, a, b, is_date=False: F.struct(F.lit(n).alias("field"), decisions.reconciled_field(F.col(a), F.col(b), is_date).alias("category"))
    none = F.array(F.struct(F.lit("not_crawled").alias("field"), F.lit(None).cast("string").alias("category")))
    fields = F.filter(F.array(entry("name", "tn", "c_name"), entry("segment", "ts", "c_mktsegment"), entry("start", "td", "start", True)), lambda e: e["category"].isNotNull())
    return both.select("c_custkey", F.explode(F.when(F.col("there").isNull(), none).otherwise(fields)).alias("e")).select("c_custkey", "e.*")


CLOSES = ("May 2027", "2024-03-01", "2024 or 2028", "May 2026", "soon", "", "20261", "1 June 2025 (was 2025)")
HELD = ("June 2026", "some day", "2024/2026", "Autumn 2025", "")
STATES = ("open inferred_from_live_submission_form", "open explicit_open", "closed explicit_closed")
YEARS_SQL = r"list_distinct(list_filter(list_transform(string_split_regex({}, '[^0-9]+'), lambda x: x), lambda x: regexp_full_match(x, '20[0-9]{{2}}')))"


@query(f"""WITH g AS (SELECT o_orderkey, {YEARS_SQL.format(_chosen_sql(CLOSES, 8))} AS c, {YEARS_SQL.format(_chosen_sql(HELD, 5))} AS h, split_part({_chosen_sql(STATES, 3)}, ' ', 1) AS status, split_part({_chosen_sql(STATES, 3)}, ' ', 2) AS basis FROM orders), y AS (SELECT *, CASE WHEN len(c) = 1 THEN c[1]::INT END AS cy, CASE WHEN len(h) = 1 THEN h[1]::INT END AS hy FROM g),
b AS (SELECT *, CASE WHEN cy > hy THEN 'deadline_after_event_conflict' WHEN status = 'open' AND basis = 'inferred_from_live_submission_form' AND cy < 2026 THEN 'inferred_open_but_deadline_past' END AS doubt FROM y) SELECT o_orderkey, CASE WHEN doubt IS NULL THEN status ELSE 'unclear' END AS status, coalesce(doubt, basis) AS basis FROM b""")
def edition_guard(spark, sf):
    """Verdicts whose years cannot both hold become unclear; ambiguous years change nothing."""
    state = _chosen(STATES, 3)
    g = decisions.edition_consistency(F.substring_index(state, " ", 1), F.substring_index(state, " ", -1), _chosen(CLOSES, 8), _chosen(HELD, 5), dt.date(2026, 1, 1))
    return table(spark, sf, "orders").select("o_orderkey", g["status"].alias("status"), g["basis"].alias("basis"))


@query("""SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'open' ELSE 'closed' END AS kept FROM orders""")
def keep_first_membership(spark, sf):
    """Memberships are recorded once, whatever the crawl's quality."""
    o = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, "open").otherwise("closed").alias("kept"), "o_orderkey")
    return merge.insert_or_ignore(o.limit(0), o, ["o_custkey", "kept"], ["o_orderkey"]).select("o_custkey", "kept")
