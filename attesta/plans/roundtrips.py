"""Queries that write files and read them again, and small functions that no other query uses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from attesta.functions import citations, text, udfs, url
from attesta.operators import decisions, gate
from attesta.plans.delivery import CELLS, DELIVERY_SQL, pick
from attesta.plans.registry import query
from attesta.session import table
from attesta.sources import files, sinks
from attesta.streaming.jobs import workplace

TODAY = dt.date(1998, 6, 1)
WIDE = ("CONFERENCE", "EVENT_ID", "STATUS DETAILS", "DEADLINE_QUOTE", "SUBMISSION DEADLINE", "CITY")


def _written_delivery(spark, sf):
    path = f"{workplace(spark)}/delivery"
    rows = table(spark, sf, "orders").selectExpr(*[f"{CELLS[c]} AS `{c}`" for c in WIDE])
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


@query(DELIVERY_SQL + " SELECT " + ", ".join(f'"{c}"' for c in WIDE) + " FROM d")
def delivery_read_back(spark, sf):
    """A delivery written as CSV and read again, all cells as text; a blank cell is the same as none."""
    read = files.read_delivery(spark, _written_delivery(spark, sf), list(WIDE))
    return read.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in WIDE])


@query("SELECT '1' AS check_id, true AS fatal, 'line 1' AS offender UNION ALL SELECT '1', true, 'line ' || (n_nationkey + 2) FROM nation WHERE n_nationkey % 4 = 1")
def ragged_structure(spark, sf):
    """S2, D28 check 1: records of a small sheet by width; every fourth has a comma too many, and no schema has three columns."""
    path = f"{workplace(spark)}/ragged"
    n = table(spark, sf, "nation")
    lines = n.select(F.col("n_nationkey").alias("at"), F.concat_ws(",", F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 4 == 1, F.concat("n_name", F.lit(", x"))).otherwise(F.col("n_name")), F.col("n_regionkey").cast("string")).alias("value"))
    lines.unionByName(spark.createDataFrame([(-1, "key,name,region")], "at int, value string")).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return gate.structure_failures(files.read_ragged(spark, f"{path}/part*"))


@query("""SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 3 END::INTEGER AS width,
CASE WHEN o_orderkey % 3 = 0 THEN 'two' || chr(10) || 'lines, "' || o_orderstatus || '"' ELSE o_orderpriority END AS note FROM orders""")
def ragged_orders(spark, sf):
    """Records of a large sheet whatever their width, with line breaks, commas and quotes inside cells."""
    path, o = f"{workplace(spark)}/orders", table(spark, sf, "orders")
    k, q = F.col("o_orderkey"), '"'
    note = F.when(k % 3 == 0, F.concat(F.lit(f'{q}two\nlines, {q}{q}'), "o_orderstatus", F.lit(f"{q}{q}{q}"))).otherwise(F.col("o_orderpriority"))
    line = F.concat_ws(",", k.cast("string"), note, F.when(k % 5 == 0, F.lit("x,y")).otherwise(F.lit("x")))
    o.select(line.alias("value")).write.text(path)
    return files.read_ragged(spark, f"{path}/part*").select(F.get("cells", F.lit(0)).alias("key"), "width", F.get("cells", F.lit(1)).alias("note"))


@query("SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 4 = 1 THEN n_name || ', x' ELSE n_name END AS name, n_regionkey::VARCHAR AS region FROM nation")
def repaired_rows(spark, sf):
    """Parts of one sheet joined, headers and fences dropped, and records with a comma too many made whole."""
    path, n = workplace(spark), table(spark, sf, "nation")
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 4 == 1, F.concat("n_name", F.lit(", x"))).otherwise(F.col("n_name")), F.col("n_regionkey").cast("string"))
    for k in range(2):
        extra = spark.createDataFrame([(-2, "key,name,region"), (100, "```")], "at int, value string")
        part = n.where(F.col("n_nationkey") % 2 == k).select(F.col("n_nationkey").alias("at"), line.alias("value")).unionByName(extra)
        part.coalesce(1).sortWithinPartitions("at").select("value").write.text(f"{path}/part{k}")
    cells = files.join_parts(files.read_ragged(spark, f"{path}/part*/part*"))
    return files.repair_split(cells, 3, 1, {0: r"^\d+$", 2: r"^\d$"}).select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("key", "name", "region"))])


@query("SELECT 'id-' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS reason FROM customer WHERE c_custkey % 5 <> 0")
def held_rows(spark, sf):
    """Ids held on purpose, with their reasons, from a file with remarks."""
    path, k = f"{workplace(spark)}/held", F.col("c_custkey")
    line = F.concat(F.lit("id-"), k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit("   # "), "c_mktsegment")).otherwise(" "))
    table(spark, sf, "customer").select(F.when(k % 10 == 0, "# remark").when(k % 5 == 0, "").otherwise(line).alias("value")).write.text(path)
    return files.read_held(spark, path)


@query("SELECT 'argument' AS source, 'https://one.org' AS url UNION ALL SELECT 'list', url FROM pages WHERE page_id % 4 <> 0")
def listed_inputs(spark, sf):
    """Addresses of a list file without remarks and blanks, and those given by hand."""
    path, i = f"{workplace(spark)}/list", F.col("page_id")
    table(spark, sf, "pages").select(F.when(i % 8 == 0, "# skipped").when(i % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "url")).alias("value")).write.text(path)
    return files.read_inputs(spark, path, None, ["https://one.org"]).select("source", "url")


@query("SELECT r_regionkey::VARCHAR AS key, r_name AS name, r_regionkey % 2 AS part FROM region WHERE r_regionkey <> 4 UNION ALL SELECT n_nationkey::VARCHAR, n_name, 2 FROM nation")
def seed_files(spark, sf):
    """Seed files of a pattern read together, with the file of each row."""
    path = workplace(spark)
    r = table(spark, sf, "region").where("r_regionkey <> 4").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    for k, part in enumerate((r.where("key % 2 = 0"), r.where("key % 2 = 1"), table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))):
        part.write.option("header", True).csv(f"{path}/seed{k}")
    rows = files.read_seeds(spark, f"{path}/seed*", ["key", "name"], stale="none.csv")
    return rows.select("key", "name", F.regexp_extract(F.input_file_name(), r"/seed(\d)/", 1).cast("int").alias("part"))


@query("SELECT DISTINCT url, 'checks' AS source FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT DISTINCT url, 'list' FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT DISTINCT url, 'sheet' FROM pages WHERE page_id % 7 = 0")
def dead_links(spark, sf):
    """Dead links of the checks, of a plain list and of a sheet."""
    path, p, i = workplace(spark), table(spark, sf, "pages").select("page_id", "url"), F.col("page_id")
    checks = p.select("url", F.when(i % 3 == 0, "Dead").otherwise("alive").alias("state"))
    p.where(i % 5 == 0).select("url").union(p.limit(1).select(F.lit("remark"))).write.text(f"{path}/list")
    p.where(i % 7 == 0).select(F.col("page_id").alias("ID"), F.concat(F.lit(" "), "url").alias("SUBMISSION URL")).coalesce(1).write.option("header", True).csv(f"{path}/sheet")
    found = {"checks": files.read_dead_links(spark, checks, f"{path}/list"), "list": files.read_dead_links(spark, None, f"{path}/list"), "sheet": files.read_dead_links(spark, None, f"{path}/sheet")}
    parts = [d.withColumn("source", F.lit(n)) for n, d in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT 'e-' || c_custkey AS event_id, CASE WHEN c_custkey % 2 = 0 THEN 'verified' ELSE 'no_quote' END AS v, CASE WHEN c_custkey % 3 = 0 THEN 'https://u' ELSE '' END AS u, c_mktsegment || ', \"quoted\"' AS q FROM customer WHERE c_custkey % 4 <> 0")
def check_results(spark, sf):
    """Check results by event from a sheet; rows without an event are left out."""
    path, k = f"{workplace(spark)}/checks", F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.when(k % 4 != 0, F.concat(F.lit("e-"), k.cast("string"))).otherwise(" ").alias("EVENT_ID"), F.when(k % 2 == 0, " verified").otherwise("no_quote").alias("CHECK"), F.when(k % 3 == 0, "https://u").alias("CHECK_URL"), F.concat("c_mktsegment", F.lit(', "quoted"')).alias("CHECK_QUOTE"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_checks(spark, path)


EXPORTED = {
    "key": "c_custkey", "name": "c_name", "url": "'https://a.org/' || CAST(c_custkey AS STRING)", "location": "'Ulm'", "start_dates": "'May 2026'", "last_checked": "'1998-05-07'", "submission_deadline": pick(4, "", "1998-09-01", key="c_custkey"),
    "verified": "c_custkey % 2 = 0", "priority": "''", "submission_status": pick(3, "todo", "", key="c_custkey"), "status": pick(6, "open", "closed", "upcoming", "unclear", "none", "", key="c_custkey"), "status_details": pick(5, "call is open", "", key="c_custkey"),
    "submission_url": pick(3, "https://a.org/s", "", key="c_custkey"), "coordinator_email": "''", "overview": "'Über alles – “so”'", "categories": pick(2, "AI, Bio", "Food", key="c_custkey"), "notes": "''", "opportunity_types": "split('cfp,nomination', ',')", "edition": pick(3, "1998", "1996", "", key="c_custkey"),
    "event_is_past": "CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END", "verify_state": pick(4, "verified", "contradicted", "", key="c_custkey"), "verify_detail": pick(2, "page 404", "other", key="c_custkey"), "is_projected": "''", "quality": "'PASS'",
}
EXPORTED_SQL = "WITH e AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in EXPORTED.items() if c != "opportunity_types") + """ FROM customer), g AS (SELECT *, CASE WHEN status IN ('', 'none') THEN status WHEN event_is_past = 1 OR edition = '1996' THEN 'closed' ELSE status END AS gated FROM e),
w AS (SELECT *, CASE gated WHEN 'open' THEN 'Open' WHEN 'closed' THEN 'Closed' WHEN 'upcoming' THEN 'Upcoming' WHEN 'unclear' THEN 'Needs Review' WHEN 'none' THEN 'No Opportunity Found' ELSE '' END AS word,
 CASE WHEN (gated IN ('open', 'upcoming', 'unclear') OR (submission_url <> '' AND gated <> 'closed')) AND submission_deadline = '' THEN concat_ws(' - ', nullif(status_details, ''), 'No public deadline found - needs verification') ELSE status_details END AS noted FROM g),
s AS (SELECT key, name AS "CONFERENCE", CASE WHEN word <> '' AND edition <> '' THEN word || ' (' || edition || ')' ELSE word END AS "RESEARCH STATUS", CASE WHEN gated = 'closed' AND status NOT IN ('closed', 'none', '') THEN trim(concat_ws(' ', CASE WHEN edition <> '' THEN 'This edition (' || edition || ') has passed.' ELSE 'This edition has passed.' END, noted)) ELSE noted END AS "STATUS DETAILS",
 CASE WHEN verified THEN 'Yes' ELSE 'Needs Verification' END AS "SUBMISSION DATE VERIFIED", '5/7/1998' AS "LATEST UPDATE", 'Speaking; Awards' AS "TRACK", 'Uber alles - "so"' AS "OVERVIEW", categories AS "CATEGORIES",
 CASE WHEN verify_state = 'contradicted' THEN CASE WHEN verify_detail LIKE '%404' THEN 'Check link' ELSE 'Disputed' END WHEN verify_state = 'verified' THEN 'Confirmed' WHEN submission_deadline <> '' THEN 'Confirmed' WHEN status IN ('open', 'upcoming') THEN 'Unconfirmed' ELSE '' END AS "CONFIDENCE" FROM w)"""
SHEET = ("CONFERENCE", "RESEARCH STATUS", "STATUS DETAILS", "SUBMISSION DATE VERIFIED", "LATEST UPDATE", "TRACK", "OVERVIEW", "CATEGORIES", "CONFIDENCE")
SHEET_SQL = ", ".join(f'"{c}"' for c in SHEET)


def _sheet(spark, sf):
    return sinks.customer_rows(table(spark, sf, "customer").selectExpr(*[f"{e} AS {c}" for c, e in EXPORTED.items()]), TODAY)


def _filled(df):
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in SHEET])


@query(f"{EXPORTED_SQL} SELECT {SHEET_SQL} FROM s")
def customer_sheet(spark, sf):
    """The customer's sheet written as CSV and read again."""
    path = f"{workplace(spark)}/sheet"
    sinks.write_csv(_sheet(spark, sf), path, ["CONFERENCE", "EDITION"])
    return _filled(spark.read.option("header", True).option("escape", '"').csv(path))


@query(f"{EXPORTED_SQL} SELECT {SHEET_SQL} FROM s WHERE contains(lower(\"CATEGORIES\"), 'bio')")
def tagged_feed(spark, sf):
    """The feed of one tag, its lines read again."""
    path = f"{workplace(spark)}/feed"
    sinks.write_feed(_sheet(spark, sf), path, "Bio")
    return _filled(spark.read.json(f"{path}/lines"))


@query("""WITH m AS (SELECT DISTINCT o_custkey AS key, o_orderpriority AS market FROM orders WHERE o_orderkey % 3 = 0) SELECT c_custkey::VARCHAR AS key, coalesce(market, '(unassigned)') AS "MARKET" FROM customer LEFT JOIN m ON key = c_custkey""")
def market_sheets(spark, sf):
    """K3: the combined sheet of all markets, written and read again."""
    path = f"{workplace(spark)}/sheets"
    members = table(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("o_custkey AS key", "o_orderpriority AS market")
    sinks.write_market_sheets(table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_name AS name", "'open' AS status"), members, "key", path)
    return spark.read.option("header", True).csv(f"{path}/all").select("key", "MARKET")


@query("SELECT c_custkey, c_name, 'now' AS version FROM customer UNION ALL SELECT c_custkey, c_name, 'before' FROM customer WHERE c_custkey % 2 = 0")
def checked_write(spark, sf):
    """K7, K8: a table written aside, checked and put in place; the earlier one stays beside it."""
    path, c = f"{workplace(spark)}/checked", table(spark, sf, "customer").select("c_custkey", "c_name")
    for rows in (c.where("c_custkey % 2 = 0"), c):
        sinks.write_checked(rows, path, c.columns)
    return spark.read.parquet(path).withColumn("version", F.lit("now")).unionByName(spark.read.parquet(f"{path}.before").withColumn("version", F.lit("before")))


FETCHES = {"url": "'u' || CAST(o_custkey AS STRING)", "via": pick(3, "crawl", "rendered", "chrome"), "chars": "o_orderkey % 1000", "internal_links": "o_orderkey % 17"}


@query("SELECT url, arg_max(via, (chars + 60 * internal_links, via)) AS via FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in FETCHES.items()) + " FROM orders) GROUP BY 1")
def richest_fetches(spark, sf):
    """Of several fetches of an address the richest."""
    return files.richest_fetch(table(spark, sf, "orders").selectExpr(*[f"{e} AS {c}" for c, e in FETCHES.items()])).select("url", "via")


SMALL = {"a": pick(6, "Photonics World Congress", "Photonics", "", "Applied Photonics Week", "Dairy Fair", key="c_custkey"), "b": pick(4, "World Photonics 2026", "of the", "Photonics Week", "Fair Dairy", key="c_custkey"), "u": pick(3, "https://www.a.org/x", "https://b.a.org", "https://c.org", key="c_custkey"), "v": pick(2, "http://a.org/y", "https://c.org/", key="c_custkey")}
LONG_SQL = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{4,}}'))"


@query("WITH s AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in SMALL.items()) + f""" FROM customer), w AS (SELECT *, {LONG_SQL.format('a')} AS wa, {LONG_SQL.format('b')} AS wb FROM s)
SELECT c_custkey, CASE WHEN least(len(wa), len(wb)) = 0 THEN false ELSE len(list_intersect(wa, wb)) >= 0.5 * least(len(wa), len(wb)) END AS agrees, regexp_replace(split_part(u, '/', 3), '^www[.]', '') LIKE '%a.org' AND v LIKE '%a.org%' OR u LIKE '%c.org%' AND v LIKE '%c.org%' AS same_site,
 floor(c_custkey % 7 * 100 / 7.0 + 0.5)::INT AS percent, CASE WHEN c_custkey % 200 < 60 THEN (c_custkey % 200) || 's' ELSE (c_custkey % 200 // 60) || 'm ' || (c_custkey % 200 % 60) || 's' END AS took, CASE WHEN c_custkey % 5 = 0 THEN 'sheet' ELSE 'a_b-' || c_custkey END AS file,
 CASE WHEN c_custkey % 6 = 0 THEN 'ERROR' WHEN c_custkey % 5 = 0 THEN 'BLOCKED' WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 0 THEN 'PARTIAL' ELSE 'PASS' END AS quality FROM w""")
def small_functions(spark, sf):
    """Agreement of names, one site, percentages, durations, file names, quality without signals."""
    k = F.col("c_custkey")
    s = table(spark, sf, "customer").selectExpr("c_custkey", *[f"{e} AS {c}" for c, e in SMALL.items()])
    quality = decisions.result_quality(F.when(k % 6 == 0, "boom"), F.when(k % 5 == 0, 0).otherwise(3), F.when(k % 4 == 0, "insufficient_evidence").otherwise("explicit_open"), k % 3 == 0)
    name = F.when(k % 5 == 0, " /? ").otherwise(F.concat(F.lit(" a b-"), k.cast("string"), F.lit("!")))
    return s.select("c_custkey", text.agrees("a", "b").alias("agrees"), url.same_site("u", "v").alias("same_site"), text.percent(k % 7, F.lit(7)).alias("percent"), citations.duration(k % 200).alias("took"), citations.safe_filename(name).alias("file"), quality["verdict"].alias("quality"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 3 = 1 THEN 1 ELSE 0 END::INT AS targets, CASE WHEN page_id % 2 = 0 THEN '/submit' ELSE '' END AS action FROM pages""")
def clickables(spark, sf):
    """Addresses behind buttons and scripts, and the forms of a page."""
    i = F.col("page_id")
    page = F.concat(
        F.when(i % 3 == 0, '<button data-href="/a" onclick="location.href=\'/b\'">x</button>').when(i % 3 == 1, "<input formaction='/c'><i data-url=\"/c\"></i>").otherwise("<a>none</a>"),
        F.when(i % 2 == 0, '<form class="f" action="/submit"><p>Submit  your\nabstract</p></form>').otherwise("<p>no form</p>"),
    )
    action = F.coalesce(F.get(citations.forms_in(page), F.lit(0))["action"], F.lit(""))
    return table(spark, sf, "pages").select("page_id", F.size(citations.clickable_targets(page)).alias("targets"), action.alias("action"))


@query()
def stable_dates(spark, sf):
    """Fuzzy dates that do not depend on what a parser fills in; it has no SQL counterpart."""
    o, d = table(spark, sf, "orders"), F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    late = F.add_months(d, 120)
    written = F.when(k == 0, F.concat(F.lit("due by "), F.date_format(late, "d MMMM yyyy"))).when(k == 1, F.concat(F.date_format(late, "MMMM yyyy"), F.lit(" or so"))).when(k == 2, F.date_format(d, "d MMMM yyyy")).otherwise("soon")
    return o.select("o_orderkey", F.date_format(udfs.stable_fuzzy_date(written), "yyyy-MM-dd").alias("day"))
