"""Queries on the star schema: joins, counts, rollups and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import dates, text
from attesta.operators import aggregates, decisions, windows
from attesta.plans.registry import query
from attesta.session import table

TODAY = dt.date(1998, 6, 1)


def _licenses(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("plan"), (F.col("c_custkey") % 9 != 0).cast("int").alias("active"))


def _usage(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.floor("o_totalprice").alias("total_tokens"))


@query("""SELECT c_custkey AS key, c_name AS customer, c_mktsegment AS plan, c_custkey % 9 <> 0 AS active, count(o_orderkey) AS calls, coalesce(sum(floor(o_totalprice)::BIGINT), 0)::BIGINT AS tokens, round(coalesce(sum(floor(o_totalprice)::BIGINT), 0) / 1000000 * 4, 4) AS cost
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND strftime(o_orderdate, '%Y-%m-%d') LIKE '1997%' GROUP BY ALL""")
def billing(spark, sf):
    """Every customer of the period's invoice, also those without a call."""
    return aggregates.billing(_licenses(spark, sf), _usage(spark, sf), "1997", 4.0)


@query("SELECT o_custkey AS key, count(*) AS calls, coalesce(sum(floor(o_totalprice)::BIGINT), 0)::BIGINT AS tokens FROM orders GROUP BY 1")
def usage_summary(spark, sf):
    """A1"""
    return _usage(spark, sf).groupBy("key").agg(F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))


def _auth(spark, sf):
    k = F.col("key")
    asks = _usage(spark, sf).groupBy("key").agg(F.sum("total_tokens").alias("used"))
    known = F.when(k % 17 != 0, (k % 9 != 0).cast("int"))
    return asks.select("key", decisions.authorize(known, F.when(k % 4 == 0, "1.10").otherwise(""), F.lit("feed,chat"), F.when(k % 5 == 0, F.lit(1_000_000)).otherwise(-1), F.col("used"), F.concat(F.lit("1."), (k % 12).cast("string"), F.lit(".3")), F.when(k % 7 == 0, "export").when(k % 7 == 1, "chat").otherwise("")).alias("d"))


@query("""SELECT o_custkey AS key, CASE WHEN o_custkey % 17 = 0 THEN 401 WHEN o_custkey % 9 = 0 THEN 403 WHEN o_custkey % 4 = 0 AND o_custkey % 12 < 10 THEN 426 WHEN o_custkey % 7 = 0 THEN 403 WHEN o_custkey % 5 = 0 AND sum(floor(o_totalprice)::BIGINT) >= 1000000 THEN 402 ELSE 200 END::INT AS status FROM orders GROUP BY 1""")
def authorize(spark, sf):
    """The answer to a request of each licence."""
    return _auth(spark, sf).select("key", "d.status")


ORDER_BUCKET = "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' ELSE CASE WHEN o_totalprice > 250000 THEN 'Monitoring' ELSE 'Verify' END END"


@query(f"""WITH e AS (SELECT o_orderkey, {ORDER_BUCKET} AS bucket FROM orders), m AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem), j AS (SELECT l_returnflag AS market, bucket FROM m JOIN e ON l_orderkey = o_orderkey UNION ALL SELECT 'All events (unique)', bucket FROM e)
SELECT market, count(*) FILTER (bucket = 'Open') AS open, count(*) FILTER (bucket = 'Upcoming') AS upcoming, count(*) FILTER (bucket = 'Monitoring') AS monitoring, count(*) FILTER (bucket = 'Verify') AS verify, count(*) FILTER (bucket = 'Closed') AS closed, count(*) AS total FROM j GROUP BY 1""")
def rollup_buckets(spark, sf):
    """Buckets by market, and once over all events, which are in many markets."""
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("unclear")
    page = F.when(F.col("o_totalprice") > 250000, "https://x.example/submit").otherwise("")
    events = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), decisions.bucket(status, page).alias("bucket"))
    members = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("market"))
    return aggregates.rollup_buckets(events, members)


@query("SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_tax) > 1")
def contested_parts(spark, sf):
    """Keys with more than one value."""
    return aggregates.contested(table(spark, sf, "lineitem"), "l_partkey", "l_tax")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS good, floor(count(*) FILTER (o_totalprice > 200000) * 100 / count(*) + 0.5)::INT AS percent FROM orders GROUP BY 1, 2")
def verdict_matrix(spark, sf):
    """Rows and whole percentages by two verdicts."""
    return aggregates.share_of(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], F.col("o_totalprice") > 200000)


@query("SELECT coalesce(c_mktsegment, '(unknown)') AS market, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = o_custkey GROUP BY 1")
def market_state(spark, sf):
    """Markets by state, unmatched ones as unknown."""
    c = table(spark, sf, "customer").where("c_custkey % 10 <> 0").select("c_custkey", "c_mktsegment")
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "OFP"])
    return sums.join(c, sums.o_custkey == c.c_custkey, "left").groupBy(F.coalesce("c_mktsegment", F.lit("(unknown)")).alias("market")).agg(*[F.sum(s).alias(s) for s in "ofp"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def most_common(spark, sf):
    """Commonest values, ties by value."""
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority").limit(3)


@query("SELECT o_custkey, o_orderkey, n = 1 AS is_latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey DESC) AS n FROM orders)")
def latest_edition(spark, sf):
    """One order of each customer is the latest edition, the others are archived."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return windows.edition_order(o, "o_custkey", "year", "o_orderkey").select("o_custkey", "o_orderkey", "is_latest")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderpriority NOT LIKE '1%'")
def disputed_only(spark, sf):
    """Semi-join."""
    bad = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    o = table(spark, sf, "orders").where(~F.col("o_orderpriority").startswith("1"))
    return o.join(bad, o.o_custkey == bad.c_custkey, "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01')")
def without_recent(spark, sf):
    """Anti-join."""
    recent = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(recent, "c_custkey", "left_anti")


@query("SELECT a.o_custkey, a.o_orderkey AS one, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 21 AND a.o_orderpriority <> b.o_orderpriority")
def near_orders(spark, sf):
    """Pairs of a customer within 21 days, met through 22-day bins and not through all pairs."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("d"))
    bins = o.withColumn("bin", F.floor(F.datediff("d", F.lit(dt.date(1990, 1, 1))) / 22))
    near = bins.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).alias("b")
    a = bins.alias("a")
    on = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))
    close = (F.abs(F.datediff("a.d", "b.d")) <= 21) & (F.col("a.o_orderpriority") != F.col("b.o_orderpriority"))
    return a.join(near, on).where(close).select("a.o_custkey", F.col("a.o_orderkey").alias("one"), F.col("b.o_orderkey").alias("other"))


@query("""SELECT c_custkey, coalesce(arg_min(o_orderkey, (abs(date_diff('day', o_orderdate, DATE '1998-06-01')), o_orderkey)) FILTER (o_orderkey % 3 <> 0), max(o_orderkey)) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def nearest_edition(spark, sf):
    """The order nearest to a date, the smaller key on ties, the largest where no date is known."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate")).alias("d"))
    met = o.join(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return windows.nearest(met, ["c_custkey"], F.abs(F.datediff("d", F.lit(TODAY))), "o_orderkey")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), d AS (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal < 0)
SELECT l_orderkey, l_linenumber, count(d1.s_suppkey) > 0 AS supplier_dead, bool_or(p_size > 45) AS part_dead FROM l LEFT JOIN d d1 ON l_suppkey = d1.s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def dead_flags(spark, sf):
    """Independent flags by membership in sets; what is unknown is not dead."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    bad = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("s"))
    parts = table(spark, sf, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("p"))
    flags = lines.join(bad, "l_suppkey", "left").join(parts, "l_partkey", "left")
    return flags.groupBy("l_orderkey", "l_linenumber").agg(aggregates.any_true(F.col("s")).alias("supplier_dead"), aggregates.any_true(F.col("p")).alias("part_dead"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'P') AND date_diff('day', DATE '1998-06-01', o_orderdate::DATE) BETWEEN 0 AND 60""")
def review_filter(spark, sf):
    """A reviewer's filters, all of them and the deadline window."""
    o = table(spark, sf, "orders")
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("O", "P") & dates.closing_within(F.to_date("o_orderdate"), 60, TODAY)).select("o_orderkey")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, CASE WHEN o_orderkey % 5 = 0 THEN 9999 ELSE date_diff('day', DATE '1998-06-01', o_orderdate::DATE) END, o_orderkey)::INT AS place FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-07-01' ORDER BY place LIMIT 40""")
def ranked_open(spark, sf):
    """Bucket, then days to the deadline (unknown last), then key; the first 40."""
    o = table(spark, sf, "orders").where((F.to_date("o_orderdate") >= F.lit(TODAY)) & (F.to_date("o_orderdate") < F.lit(dt.date(1998, 7, 1))))
    days = F.when(F.col("o_orderkey") % 5 != 0, dates.days_until(F.to_date("o_orderdate"), TODAY))
    order = [F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2), F.coalesce(days, F.lit(9999)), F.col("o_orderkey")]
    first = o.orderBy(*order).limit(40)
    return first.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).cast("int").alias("place"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 4 <> 0) AS value, (count(*) FILTER (o_orderkey % 4 <> 0))::INT AS pages, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, bool_or(o_totalprice > 400000) AS large FROM orders GROUP BY 1")
def consolidated_facts(spark, sf):
    """Facts folded from ordered pages: the first value, its pages, sorted sets, any."""
    o = table(spark, sf, "orders").withColumn("v", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    folded = o.groupBy("o_custkey").agg(aggregates.fact("v", "o_orderstatus", "o_orderkey", "fact"), F.count("v").cast("int").alias("pages"), text.list_text(F.collect_set("o_orderstatus")).alias("statuses"), aggregates.any_true(F.col("o_totalprice") > 400000).alias("large"))
    return folded.select("o_custkey", "fact.value", "pages", "statuses", "large")


@query("""SELECT c_custkey, CASE WHEN s IS NULL THEN 'insufficient_evidence' WHEN f > 0 THEN 'explicit_closed' WHEN o > 0 THEN 'explicit_open' WHEN p > 0 THEN 'explicit_upcoming' ELSE 'no_opportunity_found' END AS basis FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS s, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 300000) AS f, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 300000) AS o, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 300000) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def consolidated_status(spark, sf):
    """D3: the status of each record and what it rests on; words outrank dates."""
    large = F.col("o_totalprice") > 300000
    said = lambda s: aggregates.any_true((F.col("o_orderstatus") == s) & large)
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(said("F").alias("f"), said("O").alias("o"), said("P").alias("p"), F.lit(True).alias("seen"))
    c = table(spark, sf, "customer").select("c_custkey")
    whole = c.join(o, c.c_custkey == o.o_custkey, "left")
    return whole.select("c_custkey", decisions.consolidated_status(F.col("f"), F.col("o"), F.col("p"), F.lit(False), F.lit(False), F.col("seen"))["basis"].alias("basis"))
