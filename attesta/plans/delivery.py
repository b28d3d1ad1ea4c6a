"""Queries on a delivery: the gate, invariants, review rows and what feeds them.

The delivery is made from orders by expressions that Spark and DuckDB both read; what is checked
is stated apart in SQL, so that both sides work out each rule from the same cells.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from attesta.functions import citations, reasons, scoring, text, vocabulary
from attesta.operators import aggregates, decisions, gate, review
from attesta.plans.registry import query
from attesta.session import table
from attesta.sources import sinks

TODAY, TODAY_SQL = dt.date(1998, 6, 1), "DATE '1998-06-01'"


def pick(n: int, *values: str, key: str = "o_orderkey") -> str:
    """SQL that takes one of the values by the remainder of a key; the last stands for all others."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {key} % {n} {cases} ELSE '{values[-1]}' END"


DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
CITED = "CAST(DATE '1998-01-01' + CAST(o_orderkey % 50 AS INT) AS STRING)"
PAGE = "'https://a.org/cfp/' || CAST(o_orderkey % 50 AS STRING)"
#: Cells of the delivery, as SQL over orders.
CELLS = {
    "CONFERENCE": "'Event ' || CAST(o_orderkey AS STRING)",
    "EVENT_ID": "CASE WHEN o_orderkey % 41 = 0 THEN '1998-twice-' || CAST(o_orderkey % 1000 AS STRING) ELSE CAST(year(o_orderdate) AS STRING) || '-e-' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey AS STRING) END",
    "OPPORTUNITY_TYPE": pick(7, "Speaking", "Awards", "Exhibiting", "Registration", "speaking", "", "Speaking"),
    "SUBMISSION DEADLINE": f"CASE o_orderkey % 5 WHEN 0 THEN {CITED} WHEN 1 THEN '' WHEN 3 THEN 'TBD' ELSE {DAY} END",
    "START DATE": f"CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) + 30 AS STRING) WHEN 1 THEN '1995-03-04' ELSE '' END",
    "CONFERENCE DATES": pick(6, "1-3 May", "Various", "2 June 1998", " multiple ", "", "9 July"),
    "IS_PROJECTED": pick(4, "true", "false", "True", ""),
    "GROUNDING_CONFIDENCE": pick(6, "Verified (page)", "Projected (pattern)", "Verified", "", "projected (guess)", "Unsure"),
    "STATUS": pick(3, "Open", "Upcoming", "Closed"),
    "STATUS DETAILS": pick(13, "The call is now open.", "The last active edition was in 1996.", "This fair was discontinued.", "Currently accepting talks", "", "Audit Exception: no source", "It will not return; the cycle dictates Rome.", "Interactive hall", "Reactivated", "Active since May; has been cancelled", "plain"),
    "NOTES": pick(17, "final year", "", "moves to Rome", "see site", ""),
    "CFP MODEL TYPE": pick(4, "Fixed Deadline", "Rolling Form", "rolling form ", ""),
    "DEADLINE_EVIDENCE_URL": f"CASE WHEN o_orderkey % 5 = 0 THEN {PAGE} WHEN o_orderkey % 11 = 2 THEN 'https://a.org/' WHEN o_orderkey % 11 = 3 THEN 'https://a.org/main' WHEN o_orderkey % 11 = 4 THEN 'https://b.org/x?y=1' ELSE '' END",
    "MAIN_INFO_URL": pick(3, "https://a.org/main/", "https://a.org", ""),
    "DEADLINE_QUOTE": pick(9, 'send your "abstract" - by', "Nothing here", "", "See the final edition", "send  your ABSTRACT", ""),
    "CITY": pick(19, "Messe Ulm", "Multiple Cities", "n/a", "Berlin", "Exponent Bay", "necropolis", "Menlo Park", "Varies", "", "Lisbon", "Porto"),
    "STATE_PROVINCE": pick(8, "", "regional", "Bavaria", "-", ""),
    "COUNTRY": pick(6, "Germany", "USA", "", "various", "Japan"),
    "LOCATION": pick(5, "Hall 1", "TBA", "", "Harbour"),
    "EDITION": pick(5, "1998", "34", "", "1998 spring", "2001"),
    "FORMAT": pick(6, "In-Person", "Virtual", "hybrid", "", "Hybrid", "online"),
    "GATED_STATUS": pick(23, "closed", ""),
    "ISSUES": pick(29, "NO_CITY", ""),
    "LIFECYCLE_EVIDENCE_URL": pick(4, "https://a.org/end", ""),
    "LIFECYCLE_QUOTE": pick(8, "It ended.", "", "", "", "It is over.", ""),
    "ORGANIZER": pick(3, "Org A", "", "Org B"),
    "SPONSOR_REQUIRED": pick(6, "Yes", "no", "Unknown", "", "maybe", "yes"),
    "SPONSOR_URL": pick(4, "https://a.org/sponsor", ""),
    "SPONSOR_COST": pick(5, "5000", ""),
    "SPONSOR_QUOTE": pick(7, "Speaking needs a package.", ""),
    "Market": pick(5, "robotics", "AdditiveMfg", "Utility", "Other", ""),
    "TRACK": pick(3, "Speaking", "Awards", ""),
    "CONFERENCE URL": pick(4, "https://a.org/home", "", "https://b.org/home"),
    "SUBMISSION URL": pick(6, "https://a.org/submit", "", "https://b.org/submit", ""),
    "CFP_SUBMISSION_URL": pick(7, "https://c.org/cfp", "", ""),
}
#: Cited pages: status and text of each of fifty addresses.
PAGES_OF = {
    "url": "'https://a.org/cfp/' || CAST(id AS STRING)",
    "status": "CASE id % 10 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 410 ELSE 200 END",
    "page": "CASE id % 4 WHEN 0 THEN 'Please send  your “abstract” – by ' || CAST(DATE '1998-01-01' + CAST(id AS INT) AS STRING) || '.' WHEN 1 THEN 'Nothing&nbsp;here' WHEN 2 THEN '' ELSE 'All about 1998-02-01 &amp; more' END",
}
DELIVERY_SQL = "WITH d AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in CELLS.items()) + " FROM orders)"
G_SQL = DELIVERY_SQL + """, g AS (SELECT *, trim("SUBMISSION DEADLINE") AS dl, trim("START DATE") AS st, trim("STATUS DETAILS") AS det, trim("DEADLINE_EVIDENCE_URL") AS ev, trim("CITY") AS city, lower(trim("IS_PROJECTED")) AS proj, trim("GROUNDING_CONFIDENCE") AS gc,
 regexp_full_match(trim("SUBMISSION DEADLINE"), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS dated, lower(trim("SPONSOR_REQUIRED")) AS req FROM d)"""
ENDED_SQL = "regexp_matches({}, '" + gate.ENDED_WORDING + "')"
LIVE_SQL = r"regexp_matches(regexp_replace(lower(det), 'last (active|now open|now accepting|currently accepting)', '', 'g'), '\b(active|now open|now accepting|currently accepting)\b')"
NOT_VALUES_SQL = "(" + ", ".join(f"'{v}'" for v in gate.NOT_A_VALUE) + ")"
#: Check id -> (fatal, what a bad row of g meets).
BAD_SQL = {
    "4": (True, f"proj = 'true' AND {LIVE_SQL} AND NOT {ENDED_SQL.format('det')}"),
    "5": (True, "trim(\"OPPORTUNITY_TYPE\") IN ('Exhibiting', 'Registration') AND dl <> ''"),
    "5b": (True, "trim(\"OPPORTUNITY_TYPE\") NOT IN ('Speaking', 'Awards', 'Exhibiting', 'Registration')"),
    "6": (True, "dated AND dl < '1998-06-01' AND lower(trim(\"CFP MODEL TYPE\")) <> 'rolling form' AND lower(\"STATUS\") IN ('open', 'upcoming')"),
    "6b": (True, "dated AND regexp_full_match(st, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND dl > st"),
    "R2": (True, "dated AND dl >= '1998-06-01' AND proj = 'false' AND ev = ''"),
    "R8a": (True, "\"GATED_STATUS\" <> '' OR \"ISSUES\" <> ''"),
    "R8b": (True, r"regexp_matches(lower(city), '\b(messe|expo|centre|convention|fira|pavilion|arena|showplace|koelnmesse|terminal|ahoy|sniec|lvcc|iicc|nec)\b')"),
    "R8d": (True, "\"EDITION\" <> '' AND NOT regexp_full_match(\"EDITION\", '(19|20)[0-9]{2}')"),
    "R11": (True, "gc <> '' AND proj IN ('true', 'false') AND lower(trim(split_part(gc, '(', 1))) <> CASE proj WHEN 'true' THEN 'projected' ELSE 'verified' END"),
    "R12": (True, "\"FORMAT\" NOT IN ('', 'In-Person', 'Virtual', 'Hybrid')"),
    "R16": (True, ENDED_SQL.format("det || ' ' || \"NOTES\"") + " AND NOT regexp_matches(lower(det || ' ' || \"NOTES\"), 'cycle dictates|rotat|alternat|moves to|held instead in') AND (\"LIFECYCLE_EVIDENCE_URL\" = '' OR \"LIFECYCLE_QUOTE\" = '')"),
    "2.1b": (True, ENDED_SQL.format("det || ' ' || \"NOTES\" || ' ' || \"DEADLINE_QUOTE\"") + " AND (proj = 'false' OR contains(lower(gc), 'verified'))"),
    "2.6": (True, " OR ".join(f'lower(trim("{c}")) IN {NOT_VALUES_SQL}' for c in gate.VALUE_COLUMNS)),
    "5.4": (True, r"regexp_matches(lower(city || ' ' || trim(\"STATE_PROVINCE\")), '\b(multiple|various|regional|nationwide|several)\b')".replace('\\"', '"')),
    "R3b": (False, "dl <> '' AND ev <> '' AND (rtrim(lower(ev), '/') = rtrim(lower(trim(\"MAIN_INFO_URL\")), '/') OR rtrim(regexp_extract(ev, '^https?://[^/?#]*([^?#]*)', 1), '/') = '')"),
    "STUB": (False, "contains(det, 'Audit Exception')"),
    "R18a": (True, "req NOT IN ('yes', 'no', 'unknown', '') OR (\"SPONSOR_COST\" <> '' AND req IN ('no', ''))"),
    "R18b": (True, "req = 'yes' AND \"SPONSOR_URL\" = ''"),
}


def norm_sql(c: str) -> str:
    for mark, plain in {"&nbsp;": " ", "&amp;": "&", "“": '"', "”": '"', "–": "-"}.items():
        c = f"replace({c}, '{mark}', '{plain}')"
    return f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


PAGES_OF_SQL = "p AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in PAGES_OF.items()) + " FROM range(50) AS r(id))"
ABSENT_SQL = f"p.status NOT IN (403, 404, 410) AND trim(\"DEADLINE_QUOTE\") <> '' AND trim(page) <> '' AND NOT contains({norm_sql('page')}, {norm_sql('\"DEADLINE_QUOTE\"')})"


def _delivery(spark, sf):
    return table(spark, sf, "orders").selectExpr(*[f"{e} AS `{c}`" for c, e in CELLS.items()])


def _cited_pages(spark):
    return spark.range(50).selectExpr(*[f"{e} AS {c}" for c, e in PAGES_OF.items()])


@query(G_SQL + ", " + PAGES_OF_SQL + " " + " UNION ALL ".join(f"SELECT '{n}' AS check_id, {str(fatal).lower()} AS fatal, \"CONFERENCE\" AS offender FROM g WHERE {bad}" for n, (fatal, bad) in BAD_SQL.items())
+ " UNION ALL SELECT 'R8c', true, \"EVENT_ID\" FROM d GROUP BY \"EVENT_ID\" HAVING count(*) > 1 UNION ALL SELECT '2', true, \"CONFERENCE\" FROM g JOIN p ON ev = url WHERE p.status IN (404, 410)"
+ f" UNION ALL SELECT CASE WHEN dated AND contains(page, dl) THEN '3 paraphrase' ELSE '3 absent' END, true, \"CONFERENCE\" FROM g JOIN p ON ev = url WHERE {ABSENT_SQL}")
def acceptance_gate(spark, sf):
    """Every row of a delivery that fails a check of the gate, cited pages included."""
    return gate.acceptance(_delivery(spark, sf), TODAY, pages=_cited_pages(spark))


HELD = {
    "event_id": f"CASE c_custkey % 9 WHEN 0 THEN '2026-fair-hilton-paris-' || CAST(c_custkey AS STRING) WHEN 1 THEN '2026-fair-w1a-1aa' WHEN 2 THEN '2026-fair-75001-paris-' || CAST(c_custkey AS STRING) ELSE '2026-fair-' || CAST(c_custkey AS STRING) || '-ulm' END",
    "name": pick(6, "Fair 2026", "Fair 2027", "Fair", "Fair 12026", "The 2026 Fair", "Fair 2025", key="c_custkey"),
    "edition": pick(4, "2026", "2025", "", "2026 spring", key="c_custkey"),
    "verify_state": pick(5, "verified", "unverified", "", "contradicted", "not_found", key="c_custkey"),
    "key_year": pick(7, "2025", "", "2026", key="c_custkey"),
}
HELD_SQL = "WITH h AS (SELECT c_custkey, " + ", ".join(f"{e} AS {c}" for c, e in HELD.items()) + " FROM customer), s AS (SELECT DISTINCT CASE WHEN c_custkey % 11 = 0 THEN 'missing-' || CAST(c_custkey AS STRING) ELSE event_id END AS event_id FROM h WHERE c_custkey % 5 <> 0), x AS (SELECT event_id FROM h WHERE c_custkey % 10 = 0)"


@query(HELD_SQL + r""" SELECT '1' AS check_id, true AS fatal, event_id AS offender FROM s WHERE event_id NOT IN (SELECT event_id FROM h) UNION ALL SELECT DISTINCT '2', true, event_id FROM h WHERE event_id NOT IN (SELECT event_id FROM s) AND event_id NOT IN (SELECT event_id FROM x)
 UNION ALL SELECT '3', true, event_id FROM h WHERE c_custkey % 9 < 3 UNION ALL SELECT '4', true, event_id FROM h WHERE verify_state IN ('', 'unverified') UNION ALL SELECT '5', true, event_id FROM h GROUP BY event_id HAVING count(*) > 1
 UNION ALL SELECT '6', true, 'link_checks' UNION ALL SELECT '7', true, event_id FROM h WHERE key_year = '' OR NOT starts_with(event_id, key_year || '-')
 UNION ALL SELECT '8', false, event_id FROM h WHERE regexp_matches(name, '\b20[0-9][0-9]\b') AND regexp_full_match(edition, '[0-9]+') AND regexp_extract(name, '\b(20[0-9][0-9])\b', 1) <> edition""")
def invariants(spark, sf):
    """The invariants 1 to 8 of the rows held; the sweep of links has not run."""
    held = table(spark, sf, "customer").selectExpr("c_custkey", *[f"{e} AS {c}" for c, e in HELD.items()])
    sent = held.where("c_custkey % 5 <> 0").selectExpr("CASE WHEN c_custkey % 11 = 0 THEN 'missing-' || CAST(c_custkey AS STRING) ELSE event_id END AS event_id")
    return gate.invariants(held.drop("c_custkey"), sent, held.where("c_custkey % 10 = 0"), table(spark, sf, "region").where("r_regionkey < 0"))


SHOWN_AS = {"key": "c_custkey", "edition": pick(4, "2026", "2025-26", "", "next", key="c_custkey"), "claim_edition": pick(3, "2026", "2025", "", key="c_custkey"), "research_status": pick(5, "Open (2026)", "Upcoming", "Closed", "Opening soon", "", key="c_custkey"), "confidence": pick(7, "Confirmed", "", " ", "Unconfirmed", key="c_custkey")}


@query("WITH r AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in SHOWN_AS.items()) + r""" FROM customer) SELECT '7' AS check_id, true AS fatal, key::VARCHAR AS offender FROM r WHERE regexp_full_match(edition[:4], '\d+') AND regexp_full_match(claim_edition[:4], '\d+') AND edition[:4] <> claim_edition[:4]
 UNION ALL SELECT '8', true, key::VARCHAR FROM r WHERE (research_status LIKE 'Open%' OR research_status LIKE 'Upcoming%') AND trim(confidence) = ''""")
def loaded_gate(spark, sf):
    """D28, checks 7 and 8: records that wear another edition's claim, and open ones without a label."""
    return gate.loaded_failures(table(spark, sf, "customer").selectExpr(*[f"{e} AS {c}" for c, e in SHOWN_AS.items()]))


DEAD = ("https://a.org/submit", "https://c.org/cfp", "https://a.org/cfp/7", "https://a.org/main", "https://b.org/home")
CHECKS = "CASE o_orderkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'contradicted' ELSE 'no_quote' END"
FILLED_SQL = "coalesce(nullif(trim(\"{}\"), ''), nullif(trim(\"{}\"), ''), '')"


@query(DELIVERY_SQL + f""", x AS (SELECT DISTINCT unnest({list(DEAD)}) AS u), c AS (SELECT DISTINCT ON (id) id, v FROM (SELECT {CELLS["EVENT_ID"]} AS id, {CHECKS} AS v FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 41 <> 0)),
e AS (SELECT "EVENT_ID" AS id, min("START DATE") AS st, bool_or({ENDED_SQL.format('"STATUS DETAILS" || \' \' || "NOTES"')}) AS ended, bool_or(regexp_matches(lower("STATUS DETAILS" || ' ' || "NOTES"), 'cycle dictates|rotat|alternat|moves to|held instead in')) AS moves,
 row_number() OVER (PARTITION BY regexp_replace("EVENT_ID", '^(19|20)[0-9]{{2}}-', '') ORDER BY "EVENT_ID" DESC) AS n FROM d GROUP BY "EVENT_ID"),
s AS (SELECT id, CASE WHEN n > 1 THEN 'Archived' WHEN ended AND NOT moves THEN 'Discontinued' WHEN try_cast(st AS DATE) < {TODAY_SQL} THEN 'Watching' ELSE 'Active' END AS state FROM e),
b AS (SELECT *, {FILLED_SQL.format("CONFERENCE URL", "MAIN_INFO_URL")} AS u, {FILLED_SQL.format("CFP_SUBMISSION_URL", "SUBMISSION URL")} AS sub FROM d)
SELECT "CONFERENCE" AS n, CASE "Market" WHEN 'robotics' THEN 'Robotics' WHEN 'AdditiveMfg' THEN 'Additive Mfg' ELSE "Market" END AS m, array_to_string(list_filter([trim("CITY"), trim("STATE_PROVINCE"), trim("COUNTRY")], lambda y: y <> ''), ', ') AS loc, "FORMAT" AS f, trim("CONFERENCE DATES") AS dates, "START DATE" AS start,
 "SUBMISSION DEADLINE" AS dl, "STATUS" AS s, split_part("GROUNDING_CONFIDENCE", ' (', 1) AS c, "IS_PROJECTED" = 'true' AS proj, "STATUS DETAILS" AS det, "DEADLINE_QUOTE" AS q, u AS url, sub, "DEADLINE_EVIDENCE_URL" AS ev, "TRACK" AS trk, "OPPORTUNITY_TYPE" AS op, "ORGANIZER" AS org,
 lower("SPONSOR_REQUIRED") = 'yes' AS spon, "SPONSOR_COST" AS sponcost, "SPONSOR_URL" AS sponurl, "SPONSOR_QUOTE" AS sponq, s.state AS st, sub IN (SELECT u FROM x) AS dead, "DEADLINE_EVIDENCE_URL" IN (SELECT u FROM x) AS evdead, b.u IN (SELECT u FROM x) AS urldead,
 coalesce(c.v, '') AS chk, CASE WHEN c.v IS NULL THEN '' ELSE 'https://a.org/seen' END AS chku, CASE WHEN c.v IS NULL THEN '' ELSE 'seen ' || c.v END AS chkq FROM b LEFT JOIN s ON s.id = "EVENT_ID" LEFT JOIN c ON c.id = "EVENT_ID" """)
def review_rows(spark, sf):
    """The 29 fields of each row as a reviewer sees it."""
    dead = spark.createDataFrame([(u,) for u in DEAD], "url string")
    checks = table(spark, sf, "orders").where("o_orderkey % 4 = 1 AND o_orderkey % 41 <> 0").selectExpr(f"{CELLS['EVENT_ID']} AS event_id", f"{CHECKS} AS v", "'https://a.org/seen' AS u", f"'seen ' || {CHECKS} AS q")
    return review.review_rows(_delivery(spark, sf), dead, checks, TODAY)


@query(G_SQL + "SELECT \"CONFERENCE\" AS name FROM g WHERE req = 'yes' AND \"SPONSOR_URL\" <> '' AND \"SPONSOR_QUOTE\" = ''")
def sponsor_candidates(spark, sf):
    """Rows whose sponsorship is required and has a page, but no quote yet."""
    rows = _delivery(spark, sf).select(F.col("CONFERENCE").alias("name"), *[F.col(c).alias(c.lower()) for c in ("SPONSOR_REQUIRED", "SPONSOR_URL", "SPONSOR_QUOTE")])
    return review.sponsor_candidates(rows).select("name")


WEEK = {
    "name": CELLS["CONFERENCE"], "deadline": CELLS["SUBMISSION DEADLINE"], "verify_state": pick(4, "verified", "contradicted", "not_found", "", key="o_custkey"), "verify_detail": pick(7, "[retired] gone", "see [retired]", "[upgraded 1998]", "", key="o_custkey"),
    "submission_url": CELLS["SUBMISSION URL"], "deadline_evidence_url": CELLS["DEADLINE_EVIDENCE_URL"], "main_info_url": CELLS["MAIN_INFO_URL"], "url": CELLS["CONFERENCE URL"],
}
WEEK_SQL = "WITH w AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in WEEK.items()) + " FROM orders), a AS (SELECT *, coalesce(try_cast(deadline AS DATE) >= DATE '1998-06-01', false) AS ahead, regexp_matches(verify_detail, '^\\[(R1 withdrawal\\]|retired\\]|upgraded)') AS answered FROM w)"
LINKS_SQL = " UNION ".join(f"SELECT '{label}' AS label, name, trim({c}) AS u FROM w" for c, label in review.LINK_LABELS.items())


@query(WEEK_SQL + f", l AS ({LINKS_SQL}) SELECT 'proposed' AS section, '' AS label, name FROM w WHERE name LIKE '%77' UNION ALL SELECT 'contradicted', '', name FROM a WHERE verify_state = 'contradicted' AND ahead"
f" UNION ALL SELECT 'open', '', name FROM a WHERE verify_state <> 'verified' AND NOT answered AND ahead UNION ALL SELECT 'verified', '', name FROM a WHERE verify_state = 'verified' UNION ALL SELECT DISTINCT 'dead', label, name FROM l WHERE u IN {DEAD}")
def weekly_review(spark, sf):
    """What is to decide this week, what is open, and dead links by what they are for."""
    rows = table(spark, sf, "orders").selectExpr(*[f"{e} AS {c}" for c, e in WEEK.items()])
    proposed = rows.where("name LIKE '%77'").select("name", F.lit("https://a.org/new").alias("url"))
    return review.weekly_review(rows, spark.createDataFrame([(u,) for u in DEAD], "url string"), proposed, TODAY)


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 8 = 0 THEN 'unmatched' WHEN s = 'verified' THEN 'verified' WHEN regexp_matches(v, '^\\[(R1 withdrawal\\]|retired\\]|upgraded)') THEN 'answered' WHEN try_cast(dl AS DATE) IS NULL THEN 'no date' WHEN try_cast(dl AS DATE) < DATE '1998-06-01' THEN 'passed' ELSE 'queued' END AS reason FROM (SELECT o_custkey, """.replace("\\\\", "\\") + f"{WEEK['verify_state']} AS s, {WEEK['verify_detail']} AS v, {WEEK['deadline']} AS dl FROM orders)) GROUP BY 1")
def weekly_queue(spark, sf):
    """Why rows are or are not in the weekly queue, first reason first."""
    rows = table(spark, sf, "orders").selectExpr("o_custkey % 8 <> 0 AS known", *[f"{WEEK[c]} AS {c}" for c in ("verify_state", "verify_detail", "deadline")])
    reason = review.queue_reason(F.col("verify_state"), F.col("verify_detail"), F.col("deadline"), F.col("known"), TODAY)
    return review.weekly_queue(rows, reason, most=10**9)[1]


FILTERED = {"id": "o_orderkey", "name": CELLS["CONFERENCE"], "url": CELLS["CONFERENCE URL"], "status": CELLS["STATUS"], "track": pick(5, "Speaking; Awards", "Awards", "", " ; ", "Other"), "edition": CELLS["EDITION"], "workflow": pick(3, "todo", "done", ""), "deadline": "CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END", "markets": "array('Robotics', CASE WHEN o_orderkey % 2 = 0 THEN 'Utility' ELSE 'Other' END)"}
FILTERED_SQL = "WITH f AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in FILTERED.items() if c != "markets") + " FROM orders)"


@query(FILTERED_SQL + """ SELECT id, 'market' AS filter FROM f WHERE id % 2 = 0 UNION ALL SELECT id, 'status' FROM f WHERE status IN ('Open', 'Closed') UNION ALL SELECT id, 'track' FROM f WHERE id % 5 IN (0, 1, 2, 3) UNION ALL SELECT id, 'edition' FROM f WHERE edition = '1998' UNION ALL SELECT id, 'workflow' FROM f WHERE workflow = 'todo'
 UNION ALL SELECT id, 'soon' FROM f WHERE deadline BETWEEN DATE '1998-06-01' AND DATE '1998-08-30' UNION ALL SELECT id, 'past' FROM f WHERE deadline < DATE '1998-06-01' UNION ALL SELECT id, 'undated' FROM f WHERE deadline IS NULL UNION ALL SELECT id, 'search' FROM f WHERE contains(lower(name), 'event 12') OR contains(lower(url), 'event 12')""")
def review_filters(spark, sf):
    """The eight filters of a reviewer, each by itself."""
    rows = table(spark, sf, "orders").selectExpr(*[f"{e} AS {c}" for c, e in FILTERED.items()])
    f = lambda **given: review.review_filters(today=TODAY, **given)
    kept = {"market": f(markets=["Utility"]), "status": f(statuses=["open", "Closed"]), "track": f(tracks=["Awards", "(none)"]), "edition": f(edition="1998"), "workflow": f(workflow=["todo"]), "soon": f(window=90), "past": f(window="past due"), "undated": f(window="undated"), "search": f(search=" Event 12")}
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in kept.items()]))).alias("filter"))


@query(f"""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE b WHEN 'Open' THEN 1 WHEN 'Upcoming' THEN 2 WHEN 'Closed' THEN 4 ELSE 5 END, coalesce(days, 9999), name, o_orderkey)::INT AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN days IS NULL THEN 2 WHEN days < 0 THEN 1 ELSE 0 END, CASE WHEN days < 0 THEN -days ELSE days END, o_orderkey)::INT AS by_date
 FROM (SELECT *, {pick(4, "Open", "Closed", "Verify", "Upcoming")} AS b, lower({CELLS["CONFERENCE"]}) AS name, CASE WHEN o_orderkey % 5 <> 0 THEN date_diff('day', {TODAY_SQL}, o_orderdate::DATE) END AS days FROM orders)""")
def review_order(spark, sf):
    """O2, O3: the rank by bucket, time left and name, and the order by deadline; among each customer's orders."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey", f"{pick(4, 'Open', 'Closed', 'Verify', 'Upcoming')} AS b", f"{CELLS['CONFERENCE']} AS name", "CASE WHEN o_orderkey % 5 <> 0 THEN datediff(CAST(o_orderdate AS DATE), DATE '1998-06-01') END AS days")
    place = lambda *order: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order, "o_orderkey"))
    return o.select("o_orderkey", place(*review.rank_order(F.col("b"), F.col("days"), "name", aggregates.BUCKETS)).alias("place"), place(review.deadline_order(F.col("days"))).alias("by_date"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0, o_orderkey)::INT AS place FROM orders")
def deep_first(spark, sf):
    """Deep pages before homepages, else in their old order."""
    o = table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN 'https://a.org/' WHEN 1 THEN 'https://a.org/x/y' ELSE 'https://a.org/?q=1' END AS url")
    return review.deep_first(o, "o_custkey", "url", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY 1 DESC LIMIT 20")
def recent_runs(spark, sf):
    """O1: the twenty newest finished runs."""
    return review.recent_runs(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS finished_at")).select("id")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 300000")
def claim_evidence(spark, sf):
    """Each piece of evidence with its claim."""
    claims = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return review.evidence_of_claims(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), claims, "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT c_custkey, coalesce(array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderpriority IS NOT NULL)), ','), '') AS markets FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def memberships(spark, sf):
    """Each event with its sorted markets; on no list, an empty one."""
    given = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("market"))
    return review.with_memberships(table(spark, sf, "customer").select("c_custkey"), given, "c_custkey").select("c_custkey", F.array_join("markets", ",").alias("markets"))


@query("""SELECT o_orderkey, coalesce(c.canon, 'raw-' || (o_orderkey % 500)) AS canon FROM orders LEFT JOIN (SELECT o_orderkey % 500 AS r, arg_min('canon-' || o_orderkey, (o_orderpriority, o_orderkey)) AS canon FROM orders WHERE o_custkey % 7 = 0 AND o_orderkey % 500 > 99 GROUP BY 1) c ON c.r = o_orderkey % 500""")
def canonical_ids(spark, sf):
    """Delivered ids mapped to canonical ones, the first of each; unknown ones stay as they are."""
    o = table(spark, sf, "orders")
    raw = F.concat(F.lit("raw-"), (F.col("o_orderkey") % 500).cast("string"))
    seeds = o.where("o_custkey % 7 = 0").select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("row"), F.when(F.col("o_orderkey") % 500 > 99, raw).otherwise(" ").alias("raw_id"), F.concat(F.lit("canon-"), F.col("o_orderkey").cast("string")).alias("canonical_id"))
    return review.with_canonical_ids(o.select("o_orderkey", raw.alias("raw")), review.canonical_map(seeds), "raw", "canon").select("o_orderkey", "canon")


@query("""WITH r AS (SELECT o_custkey AS key, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '1990' WHEN 1 THEN '' END AS edition, CASE o_orderkey % 4 WHEN 0 THEN 'May 2026 and 2027' WHEN 1 THEN 'soon' ELSE '' END AS held, CASE o_orderkey % 5 WHEN 0 THEN '2031-01-02' ELSE '' END AS closes FROM orders)
SELECT o_orderkey, CASE WHEN coalesce(edition, '') <> '' THEN edition ELSE coalesce(CASE WHEN held LIKE 'May%' THEN '2027' END, CASE WHEN closes <> '' THEN '2031' END, edition) END AS edition FROM r""")
def backfilled_editions(spark, sf):
    """Blank editions from the dates already there."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN '1990' WHEN 1 THEN '' END AS edition", "CASE o_orderkey % 4 WHEN 0 THEN 'May 2026 and 2027' WHEN 1 THEN 'soon' ELSE '' END AS held", "CASE o_orderkey % 5 WHEN 0 THEN '2031-01-02' ELSE '' END AS closes")
    return review.backfilled_editions(o, "edition", "held", "closes").select("o_orderkey", "edition")


@query("""WITH m AS (SELECT DISTINCT o_custkey AS key, o_orderpriority AS market FROM orders), r AS (SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN c_mktsegment ELSE ' ' END AS industry FROM customer)
SELECT key, market, 'list' AS source_list FROM m UNION ALL SELECT key, trim(industry), 'backfill' FROM r WHERE trim(industry) <> '' AND (key, trim(industry)) NOT IN (SELECT (key, market) FROM m)""")
def backfilled_memberships(spark, sf):
    """Memberships with those of the legacy column, each once."""
    listed = table(spark, sf, "orders").selectExpr("o_custkey AS key", "o_orderpriority AS market", "'list' AS source_list").distinct()
    records = table(spark, sf, "customer").selectExpr("c_custkey AS key", "CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN c_mktsegment ELSE ' ' END AS industry")
    return review.backfilled_memberships(listed, records, "key", "industry")


BASES = [*reasons.BASIS_WORDS, "", "new_basis"]
WORDS_SQL = lambda c, words, other: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in words.items()) + f" ELSE {other} END"
SAID = {"status": pick(6, "open", "closed", "upcoming", "unclear", "none", "odd"), "basis": pick(11, *BASES), "target": pick(3, "https://a.org/s", "", " "), "form": "o_orderkey % 4 = 1", "platform": pick(5, "Sessionize", ""), "dl": pick(7, "5 May", ""), "held": pick(2, "June", ""), "several": "o_orderkey % 13 = 0"}


@query("WITH s AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in SAID.items()) + " FROM orders) SELECT o_orderkey, concat_ws(' ', "
+ WORDS_SQL("status", reasons.STATUS_WORDS, "upper(status[1]) || status[2:]") + " || ' - ' || " + WORDS_SQL("basis", reasons.BASIS_WORDS, "CASE WHEN basis = '' THEN 'reason unrecorded' ELSE basis END") + " || '.'"
+ """, CASE WHEN trim(target) <> '' THEN CASE WHEN form THEN 'Submit via' || CASE WHEN platform <> '' THEN ' ' || platform || ' form' ELSE '' END ELSE 'Submission URL' END || ': ' || target || '.' END, CASE WHEN status IN ('upcoming', 'unclear') AND trim(target) <> '' THEN 'Submission page located - watching for the next open window.' END,
 CASE WHEN dl <> '' THEN 'Deadline "' || dl || '" (high).' END, CASE WHEN held <> '' THEN 'Event dates "' || held || '" (low).' END, CASE WHEN several THEN 'Caution: crawled pages disagree on dates — facts may span multiple editions.' END) AS reason, """
+ WORDS_SQL("basis", reasons.CALL_STATES, "'Undetermined'") + " AS state FROM s")
def reason_sentences(spark, sf):
    """Why a record has its status, in words, and what its call is doing."""
    c = F.col
    s = table(spark, sf, "orders").selectExpr("o_orderkey", *[f"{e} AS {n}" for n, e in SAID.items()])
    said = reasons.reason_sentence(c("status"), c("basis"), c("target"), c("form"), c("platform"), c("dl"), F.lit("high"), c("held"), F.lit("low"), c("several"))
    return s.select("o_orderkey", said.alias("reason"), reasons.call_state("basis")["state"].alias("state"))


QUOTED = {"sentence": pick(5, "", "chosen"), "located": "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'A booth costs 500.' WHEN 2 THEN 'A booth and a speaking slot cost 900.' WHEN 3 THEN 'You will be notified by May 5, 1998.' WHEN 4 THEN 'Abstracts are due May 5, 1998.' WHEN 5 THEN 'Talks by 6 June.' ELSE 'See the posted deadlines.' END", "deadline": pick(3, "1998-05-05", "soon", "June 6, 1998")}


@query("WITH q AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in QUOTED.items()) + r""" FROM orders), t AS (SELECT *, CASE deadline WHEN 'soon' THEN NULL WHEN '1998-05-05' THEN 'May 5' ELSE '6 June' END AS day, regexp_matches(located, 'May 5|6 June') AS dated FROM q)
SELECT o_orderkey, CASE WHEN sentence = '' THEN 'blank' WHEN located IS NULL THEN 'not-on-page' WHEN regexp_matches(lower(located), '\bbooth\b') AND NOT regexp_matches(lower(located), '\bspeak') THEN 'not-about-speaking' ELSE 'ok' END AS sponsor,
 CASE WHEN sentence = '' THEN 'blank' WHEN located IS NULL THEN 'not-on-page' WHEN contains(located, 'notified') THEN 'wrong-purpose' WHEN day IS NULL THEN 'unparseable-target' WHEN contains(located, day) THEN 'ok' WHEN dated THEN 'no-date' ELSE 'undated' END AS citation,
 CASE WHEN sentence <> '' AND contains(located, day) AND NOT contains(located, 'notified') THEN CASE WHEN contains(located, 'Abstract') THEN 'abstract' ELSE 'talk' END ELSE '' END AS call FROM t""")
def quote_outcomes(spark, sf):
    """What becomes of a sentence chosen as a quote of a cost or as the citation of a deadline."""
    q = table(spark, sf, "orders").selectExpr("o_orderkey", *[f"{e} AS {n}" for n, e in QUOTED.items()])
    cited = reasons.citation_outcome("sentence", F.col("located"), "deadline")
    return q.select("o_orderkey", reasons.sponsor_quote_outcome("sentence", F.col("located")).alias("sponsor"), cited["status"].alias("citation"), cited["call"].alias("call"))


@query("""WITH n AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % 3 AS j FROM orders), s AS (SELECT *, 40 * (k % 2 + 1) + CASE WHEN j = 0 THEN 50 ELSE 0 END AS here, 150 * (CASE WHEN k > 1 THEN 1 ELSE 0 END) + 80 + CASE j WHEN 0 THEN 50 WHEN 1 THEN -50 ELSE 0 END + 30 AS there FROM n)
SELECT o_orderkey, here / 100.0 AS here, there / 100.0 AS there, there >= here + 100 AS hop, k = 0 OR j = 0 AS directory FROM s""")
def directory_hops(spark, sf):
    """How well a page and a link on it fit an event, and whether to go there."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey % 4 AS k", "o_orderkey % 3 AS j")
    start = F.concat(F.lit("https://list.example/photonics"), F.when(F.col("k") % 2 == 1, "-optics").otherwise(""), F.when(F.col("j") == 0, "-2026").otherwise(""))
    target = F.concat(F.lit("https://e.example/event/photonics-optics"), F.when(F.col("j") == 0, "-2026").when(F.col("j") == 1, "-2025").otherwise(""), F.when(F.col("k") > 1, "-ulm").otherwise(""))
    tokens, city, year = F.array(F.lit("photonics"), F.lit("optics")), F.lit("Ulm"), F.lit(2026)
    here, there = (scoring.score_event_link(u, F.lit(""), tokens, city, year) for u in (start, target))
    directory = reasons.looks_like_directory(F.col("k") != 0, F.when(F.col("j") == 0, "insufficient_evidence").otherwise("explicit_open"), F.lit(20))
    return o.select("o_orderkey", here.alias("here"), there.alias("there"), reasons.hop(start, target, F.lit(""), tokens, city, year).alias("hop"), directory.alias("directory"))


NAMES = ("AdditiveMfg", "UTILITY ", "Biotech & MedTech", "bio-med tech", "Arnica", "Utilities", "", "Photonics", "Consumer_Electronics")
FILES = ("Global Robotics Awards 2026 (3).xlsx", "customer-cfp_list_Bioeconomy v2.csv", "Conferences Additive Mfg 1999.TXT", "Utility", "2026 award list.xlsx")
NAME_SQL = pick(9, *NAMES)


@query(f"""WITH n AS (SELECT o_orderkey, {NAME_SQL} AS name, {pick(5, *FILES)} AS file FROM orders), v AS (SELECT unnest({[vocabulary.plain_key(m) for m in vocabulary.MARKETS]}) AS key, unnest({list(vocabulary.MARKETS)}) AS market),
a AS (SELECT unnest({[vocabulary.plain_key(m) for m in vocabulary.ALIASES]}) AS key, unnest({list(vocabulary.ALIASES.values())}) AS market), u AS (SELECT * FROM v UNION SELECT * FROM a),
f AS (SELECT DISTINCT file, string_split_regex(regexp_replace(regexp_replace(file, '\\.(xlsx|xlsm|csv|txt)$', '', 'i'), '\\([0-9]+\\)', ' ', 'g'), '[^A-Za-z0-9]+') AS w FROM n)
SELECT o_orderkey, market, array_to_string(list_filter(w, lambda x: x <> '' AND lower(x) NOT IN {vocabulary.FILE_WORDS} AND NOT regexp_full_match(x, '(19|20)[0-9]{{2}}')), ' ') AS candidate, CASE WHEN regexp_matches(lower(file), 'award') THEN 'Awards' WHEN regexp_matches(lower(file), 'conference') THEN 'Conferences' END AS list_type
FROM n JOIN f USING (file) LEFT JOIN u ON u.key = regexp_replace(lower(name), '[^a-z0-9]', '', 'g')""")
def market_names(spark, sf):
    """Canonical market names of other spellings, and what list file names say."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{NAME_SQL} AS name", f"{pick(5, *FILES)} AS file")
    return o.select("o_orderkey", vocabulary.resolve_market("name").alias("market"), vocabulary.parse_list_name("file").alias("f")).select("o_orderkey", "market", "f.candidate", "f.list_type")


@query()
def market_guard(spark, sf):
    """M6: what becomes of a new market name; likeness by letters has no SQL counterpart."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{NAME_SQL} AS name")
    return o.select("o_orderkey", vocabulary.admit_market("name").alias("a")).select("o_orderkey", "a.fate", "a.name")


COPY = "The programme committee welcomes everyone to this meeting about applied photonics and related fields. "
BODIES = {"body": f"CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN repeat('{COPY}', 4) || 'Checking your browser' WHEN 2 THEN repeat('{COPY}', 8) || 'please enable js' WHEN 3 THEN 'Please enable JavaScript to go on. ' || repeat('{COPY}', 6) WHEN 4 THEN 'We value your privacy. ' || repeat('{COPY}', 13) WHEN 5 THEN repeat('many words here today ', 16) WHEN 6 THEN 'Page not found. ' || repeat('{COPY}', 9) ELSE repeat('{COPY}', 40) || ' does not exist' END", "status": "CASE o_orderkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 200 END", "n_bytes": "o_orderkey % 4000", "resolves": "o_orderkey % 11 <> 0"}


@query("WITH b AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in BODIES.items()) + r""" FROM orders), l AS (SELECT *, lower(body[:4000]) AS low, length(trim(body)) AS chars FROM b), m AS (SELECT *, regexp_matches(low, '404|page not found|cannot be found|doesn.t exist|does not exist') AND chars < 2500 AS soft FROM l)
SELECT o_orderkey, CASE WHEN NOT resolves OR status IN (404, 410) THEN 'gone' WHEN status IN (401, 403, 429) THEN 'refused' WHEN status IS NULL OR status >= 400 THEN 'unknown' WHEN n_bytes > 2000 THEN 'our_bug' ELSE 'thin' END AS silence,
 CASE WHEN coalesce(status IN (404, 410), false) OR soft THEN 'dead' WHEN status >= 400 THEN 'http ' || status WHEN chars < 200 THEN 'empty' ELSE 'ALIVE' END AS opinion,
 CASE WHEN body = '' THEN 'empty' WHEN chars < 200 THEN 'unreadable: page returned almost no text' WHEN regexp_matches(low[:1500], 'page not found') THEN 'unreadable: soft 404: page not found' WHEN regexp_matches(low[:1500], 'checking your browser') THEN 'bot-check' WHEN length(body) < 1200 AND regexp_matches(low[:1500], 'enable javascript|enable js') THEN 'js-only' WHEN length(body) < 1500 AND regexp_matches(low[:1500], 'value your privacy') THEN 'consent-wall' WHEN length(body) < 400 THEN 'thin' ELSE 'readable' END AS kind FROM m""")
def silence_reasons(spark, sf):
    """Why a page gave nothing, the second opinion on a dead link, and what kind of page it is."""
    b = table(spark, sf, "orders").selectExpr("o_orderkey", *[f"{e} AS {c}" for c, e in BODIES.items()])
    return b.select("o_orderkey", decisions.silence(F.col("resolves"), F.col("status"), F.col("n_bytes")).alias("silence"), decisions.second_opinion(F.col("status"), "body").alias("opinion"), decisions.page_kind("body").alias("kind"))


TYPES = "CASE o_orderkey % 7 WHEN 0 THEN 'cfp,poster' WHEN 1 THEN 'nomination' WHEN 2 THEN 'showcase' WHEN 3 THEN ' Panel ,awards_entry,showcase' WHEN 4 THEN '' WHEN 5 THEN ',' ELSE 'speaking,award' END"


@query(f"WITH t AS (SELECT o_orderkey, list_transform(string_split({TYPES}, ','), lambda x: lower(trim(x))) AS k FROM orders) SELECT o_orderkey, CASE WHEN list_has_any(k, ['cfp','call_for_speakers','speaker_proposal','abstract','poster','panel','workshop','presentation']) AND list_has_any(k, ['awards_entry','nomination']) THEN 'Speaking; Awards' WHEN list_has_any(k, ['cfp','call_for_speakers','speaker_proposal','abstract','poster','panel','workshop','presentation']) THEN 'Speaking' WHEN list_has_any(k, ['awards_entry','nomination']) THEN 'Awards' WHEN len(list_filter(k, lambda x: x <> '')) > 0 THEN 'Other' ELSE '' END AS track FROM t")
def tracks(spark, sf):
    """The tracks of lists of opportunity types."""
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"split({TYPES}, ',') AS k").select("o_orderkey", scoring.track_label(F.col("k")).alias("track"))


HOSTS = ("https://www.t.me/x", "https://m.facebook.com/a", "https://youtu.be/1", "https://12ft.io/https://a.org", "https://a.org/vertexaisearch", "https://vertexaisearch.cloud.google.com/grounding-api-redirect/z", "https://reddit.com.example.org/r", "https://sub.linkedin.com/p", "https://a.org/tiktok.com")


@query(f"""WITH u AS (SELECT o_orderkey, {pick(9, *HOSTS)} AS u FROM orders), h AS (SELECT *, regexp_replace(regexp_extract(u, '^https?://([^/?#:]*)', 1), '^www[.]', '') AS host FROM u) SELECT o_orderkey, list_contains({list(decisions.SOCIAL_HOSTS)}, host) AS social, len(list_filter({list(decisions.PROXY_HOSTS)}, lambda x: contains(lower(u), x))) > 0 AS proxy FROM h""")
def citation_hosts(spark, sf):
    """Addresses that no citation may have."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{pick(9, *HOSTS)} AS u")
    return o.select("o_orderkey", decisions.is_social("u").alias("social"), decisions.is_proxy("u").alias("proxy"))


SEEDS = {"CONFERENCE": "'Event ' || lpad(CAST(o_orderkey AS STRING), 9, '0')", "EDITION": pick(3, "1998", "2001", ""), "CITY": pick(4, "Lisbon", "", "Ulm"), "LOCATION": pick(3, "Hall 1, Porto, Portugal", "online", ""), "STATE_PROVINCE": "''", "COUNTRY": "'Portugal'", "CFP MODEL TYPE": pick(4, "fixed-deadline", "ROLLING", "who knows"), "STATUS": CELLS["STATUS"], "SUBMISSION DEADLINE": DAY, "START DATE": "'1999-01-01'", "SUBMISSION URL": pick(3, "https://a.org", ""), "OPPORTUNITY_TYPE": pick(3, "Speaking", "Awards", ""), "KEEP": "CAST(o_orderkey AS STRING)"}


@query("WITH s AS (SELECT *, CAST(\"SUBMISSION DEADLINE\" AS DATE) AS d FROM (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in SEEDS.items()) + """ FROM orders)), c AS (SELECT *, CASE WHEN "CITY" <> '' THEN "CITY" WHEN "LOCATION" LIKE 'Hall%' THEN 'Porto' WHEN "LOCATION" = 'online' THEN 'online' ELSE '' END AS town, CASE WHEN "CFP MODEL TYPE" LIKE 'fixed%' THEN 'Fixed Deadline' WHEN "CFP MODEL TYPE" = 'ROLLING' THEN 'Rolling Form' ELSE 'Not Announced' END AS model FROM s)
SELECT "KEEP", CASE WHEN "EDITION" <> '' THEN "EDITION" ELSE 'tbd' END || '-' || lower(replace("CONFERENCE", ' ', '-')) || '-' || CASE WHEN town <> '' THEN lower(town) ELSE 'tbd' END || CASE WHEN "OPPORTUNITY_TYPE" = 'Awards' THEN '-awards' ELSE '' END AS "EVENT_ID_CANON", town AS "CITY_CLEAN", model AS "CFP_MODEL_CANON",
 CASE WHEN d < DATE '1998-06-01' AND "STATUS" IN ('Open', 'Upcoming') THEN 'Closed' ELSE "STATUS" END AS "GATED_STATUS_CALC", concat_ws('; ', CASE WHEN d < DATE '1998-06-01' AND "STATUS" IN ('Open', 'Upcoming') THEN 'PASSED_DEADLINE (' || date_diff('day', d, DATE '1998-06-01') || ' days past)' END, CASE WHEN d >= DATE '1998-06-01' AND "STATUS" = 'Closed' THEN 'CLOSED_BUT_DEADLINE_FUTURE' END,
 CASE WHEN d > DATE '1999-01-01' THEN 'DEADLINE_AFTER_EVENT_START' END, CASE WHEN town = '' THEN 'NO_CITY' END, CASE WHEN "SUBMISSION URL" = '' THEN 'NO_SUBMISSION_URL' END) AS "ISSUES_CALC", 'unverified' AS "VERIFY_STATE" FROM c""")
def seed_rows(spark, sf):
    """A delivery with its six derived columns."""
    o = table(spark, sf, "orders").selectExpr(*[f"{e} AS `{c}`" for c, e in SEEDS.items()])
    return sinks.seed_rows(o, TODAY).select("KEEP", "EVENT_ID_CANON", "CITY_CLEAN", "CFP_MODEL_CANON", "GATED_STATUS_CALC", "ISSUES_CALC", "VERIFY_STATE")


@query("""WITH m AS (SELECT DISTINCT o_custkey AS key, o_orderpriority AS market FROM orders WHERE o_orderkey % 3 = 0), r AS (SELECT c_custkey AS key, c_name AS name, CASE c_custkey % 6 WHEN 0 THEN 'Open' WHEN 1 THEN 'closed' WHEN 2 THEN 'unclear' WHEN 3 THEN 'none' WHEN 4 THEN 'odd' ELSE 'upcoming' END AS status FROM customer)
SELECT key, coalesce(market, '(unassigned)') AS "MARKET", row_number() OVER (PARTITION BY coalesce(market, '(unassigned)') ORDER BY CASE lower(status) WHEN 'open' THEN 0 WHEN 'upcoming' THEN 1 WHEN 'unclear' THEN 2 WHEN 'none' THEN 3 WHEN 'closed' THEN 4 ELSE 9 END, lower(name), key)::INT AS place FROM r LEFT JOIN m USING (key)""")
def combined_sheet(spark, sf):
    """K3: each record under each of its markets, with its place in the combined sheet."""
    members = table(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("o_custkey AS key", "o_orderpriority AS market")
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_name AS name", "CASE c_custkey % 6 WHEN 0 THEN 'Open' WHEN 1 THEN 'closed' WHEN 2 THEN 'unclear' WHEN 3 THEN 'none' WHEN 4 THEN 'odd' ELSE 'upcoming' END AS status")
    return sinks.combined_sheet(rows, members, "key").select("key", "MARKET", "place")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Deadline for talks is ' || strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ', sharp.' ELSE '' END AS quote, CASE WHEN o_orderkey % 5 = 0 THEN 'Thank you all. The call for papers is now closed and we read.' ELSE '' END AS closure FROM orders")
def evidence_quotes(spark, sf):
    """The words around a date as written, and those that close a call."""
    d = F.to_date("o_orderdate")
    page = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Deadline  for talks is "), F.date_format(d, "MMMM d"), F.lit(", sharp."))).otherwise("Day 4 of 30")
    closed = F.when(F.col("o_orderkey") % 5 == 0, "Thank you all.\nThe call for papers is now closed and we read.").when(F.col("o_orderkey") % 5 == 1, "If submissions are closed, write.").otherwise("Open")
    return table(spark, sf, "orders").select("o_orderkey", citations.date_quote(page, d).alias("quote"), citations.closure_evidence(closed).alias("closure"))


ANSWERS = ('```json\n{"a": "1", "b": "x"}\n```', 'Sure: {"a": "2"} done', '[1, {"a": "3"}, {"a": "4"}]', "no json", "{broken", "")


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '{\"a\": \"1\", \"b\": \"x\"}' WHEN 1 THEN '{\"a\": \"2\"}' WHEN 2 THEN '{\"a\":\"3\"}' END AS found FROM orders")
def salvaged_json(spark, sf):
    """The JSON object in a model's answer: fenced, within prose, first of a list, or none."""
    k, answer = F.col("o_orderkey") % 6, None
    for i, a in enumerate(ANSWERS):
        answer = F.when(k == i, a) if answer is None else answer.when(k == i, a)
    return table(spark, sf, "orders").select("o_orderkey", text.salvage_json(answer).alias("found"))
