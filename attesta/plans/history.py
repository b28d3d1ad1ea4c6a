"""Queries on events as observations of records over time: change capture, merges, set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from attesta.operators import merge, windows
from attesta.plans.registry import query
from attesta.session import table
from attesta.streaming import jobs

TODAY = dt.date(2024, 1, 20)
CUT = "TIMESTAMP '2024-01-16'"
#: A user's record as one event tells it: null where the event is an error.
STATE = "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("status", F.when(F.col("event_type") != "error", F.col("event_type")))


@query("SELECT user_id, event_id, old_value, event_type AS new_value, change_type FROM (SELECT *, lag(event_type) OVER w AS old_value, CASE WHEN row_number() OVER w = 1 THEN 'new_record' WHEN lag(event_type) OVER w <> event_type THEN 'updated' END AS change_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE change_type IS NOT NULL")
def event_changes(spark, sf):
    """What changed from event to event of a user."""
    found = windows.changes(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return found.select("user_id", "event_id", "old_value", F.col("event_type").alias("new_value"), "change_type")


@query(f"SELECT event_id, user_id, last_value({STATE} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events")
def degrade_proof_state(spark, sf):
    """The last known state of each user at each event; a failed observation changes nothing."""
    return windows.carry_forward(_events(spark, sf), "user_id", ["ts", "event_id"], F.col("status"), "state").select("event_id", "user_id", "state")


@query("SELECT user_id, min(ts)::VARCHAR AS first_seen, max(ts)::VARCHAR AS last_checked, (max(ts) FILTER (event_type = 'purchase'))::VARCHAR AS last_changed FROM events GROUP BY 1")
def seen_times(spark, sf):
    """W8"""
    seen = windows.seen_times(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "purchase")
    return seen.select("user_id", *[F.col(c).cast("string").alias(c) for c in ("first_seen", "last_checked", "last_changed")])


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def first_of_kind(spark, sf):
    """The first event of each kind of each user."""
    return windows.first_wins(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value > 150 DESC, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, ts DESC, event_id) AS n FROM events) WHERE n = 1""")
def worst_check(spark, sf):
    """One check of each user: current first, then the worst verdict, then the newest."""
    verdict = F.when(F.col("event_type") == "error", "contradicted").when(F.col("event_type") == "click", "no_quote").when(F.col("event_type") == "view", "unreadable").when(F.col("event_type") == "purchase", "verified")
    e = table(spark, sf, "events").withColumn("v", verdict)
    return windows.precedence_pick(e, "user_id", F.col("value") > 150, F.col("v"), F.col("ts"), "event_id").select("user_id", "event_id")


@query("SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'signup') AS value FROM events GROUP BY 1")
def last_signup(spark, sf):
    """The value of each user's last signup."""
    e = table(spark, sf, "events").withColumn("pos", F.struct("ts", "event_id"))
    return windows.last_matching(e, "user_id", "pos", "value", F.col("event_type") == "signup")


@query("SELECT user_id, event_id, score FROM (SELECT user_id, event_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE value >= 200) WHERE n = 1")
def best_event(spark, sf):
    """The highest event of each user, none below the floor."""
    return windows.best_candidate(table(spark, sf, "events"), "user_id", F.col("value"), "event_id", 200.0).select("user_id", "event_id", "score")


@query("SELECT user_id, event_id, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def top_events(spark, sf):
    """The three highest events of each user."""
    return windows.top_k(table(spark, sf, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "rank")


def _crawl(e):
    """Events as rows of a crawl batch."""
    quality = F.when(F.col("event_id") % 6 == 0, "ERROR").otherwise("PASS")
    return e.select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.col("ts").cast("string").alias("at"), quality.alias("quality"), "status", "amount")


def _known(e):
    return e.withColumn("status", F.when(F.col("event_type") != "error", F.col("event_type"))).withColumn("amount", F.when(F.col("value") >= 50, F.floor("value").cast("string")))


def _records(spark, sf):
    """Records as the first half of the month left them."""
    first = windows.first_wins(_known(table(spark, sf, "events")).where(f"ts < {CUT} AND user_id % 10 <> 3"), ["user_id"], ["ts", "event_id"])
    verified = F.when(F.col("user_id") % 5 == 0, F.array(F.lit("status"))).otherwise(F.array().cast("array<string>"))
    at = F.col("ts").cast("string")
    return first.select(F.col("user_id").alias("key"), "status", "amount", verified.alias("verified"), F.lit("PASS").alias("quality"), at.alias("first_seen"), at.alias("last_checked"), F.lit(None).cast("string").alias("last_changed"))


def _snapshot(spark, sf):
    """Records, and the later events as a crawl batch."""
    late = _known(table(spark, sf, "events")).where(f"ts >= {CUT} AND user_id % 10 <> 4")
    return merge.upsert(_records(spark, sf), _crawl(late), ("status", "amount"))


UPSERT_SQL = f"""WITH e AS (SELECT *, {STATE} AS status, CASE WHEN value >= 50 THEN floor(value)::BIGINT::VARCHAR END AS amount FROM events),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e WHERE ts < {CUT} AND user_id % 10 <> 3) WHERE n = 1),
b AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN 'ERROR' ELSE 'PASS' END AS quality FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE ts >= {CUT} AND user_id % 10 <> 4) WHERE n = 1),
j AS (SELECT coalesce(c.user_id, b.user_id) AS key, c.user_id IS NULL AS created, b.user_id IS NULL OR (b.quality = 'ERROR' AND c.user_id IS NOT NULL) AS skipped, coalesce(c.user_id % 5 = 0, false) AS held,
 c.status AS os, c.amount AS oa, b.status AS ns, b.amount AS na, b.quality AS q, c.ts AS ots, b.ts AS nts FROM c FULL JOIN b ON c.user_id = b.user_id),
f AS (SELECT *, CASE WHEN created THEN 'take' WHEN skipped OR coalesce(ns, '') = '' OR coalesce(os, '') = ns THEN 'keep' WHEN held THEN 'conflicts_verified' ELSE 'updated' END AS fs,
 CASE WHEN created THEN 'take' WHEN skipped OR coalesce(na, '') = '' OR coalesce(oa, '') = na THEN 'keep' ELSE 'updated' END AS fa FROM j)"""


@query(f"""{UPSERT_SQL} SELECT key, CASE WHEN fs IN ('take', 'updated') THEN ns ELSE os END AS status, CASE WHEN fa IN ('take', 'updated') THEN na ELSE oa END AS amount, coalesce(q, 'PASS') AS quality,
 coalesce(ots, nts)::VARCHAR AS first_seen, coalesce(nts, ots)::VARCHAR AS last_checked, CASE WHEN 'updated' IN (fs, fa) THEN nts::VARCHAR END AS last_changed FROM f""")
def upsert_snapshot(spark, sf):
    """Records after a crawl batch; failures, blanks and verified fields change nothing."""
    return _snapshot(spark, sf)[0].drop("verified")


@query(f"""{UPSERT_SQL} SELECT key, nts::VARCHAR AS at, '*' AS field, NULL AS old_value, key::VARCHAR AS new_value, 'new_record' AS change_type FROM f WHERE created
UNION ALL SELECT key, nts::VARCHAR, 'status', os, ns, fs FROM f WHERE fs IN ('updated', 'conflicts_verified') UNION ALL SELECT key, nts::VARCHAR, 'amount', oa, na, fa FROM f WHERE fa = 'updated'""")
def upsert_changes(spark, sf):
    """The change log of the same batch."""
    return _snapshot(spark, sf)[1]


SNAPSHOT_SQL = f"""{UPSERT_SQL} SELECT key, CASE WHEN fs IN ('take', 'updated') THEN ns ELSE os END AS status, CASE WHEN fa IN ('take', 'updated') THEN na ELSE oa END AS amount, coalesce(ots, nts)::VARCHAR AS first_seen, CASE WHEN 'updated' IN (fs, fa) THEN nts::VARCHAR END AS last_changed FROM f"""


def _streamed(spark, sf):
    out = jobs.workplace(spark)
    late = _known(jobs.read_events(spark, sf)).where(f"ts >= {CUT} AND user_id % 10 <> 4")
    jobs.crawl_stream(_crawl(late), _records(spark, sf), out, ("status", "amount"))
    return out


@query(SNAPSHOT_SQL)
def streamed_records(spark, sf):
    """The records after a crawl that arrives as a stream."""
    return jobs.latest_records(spark, _streamed(spark, sf)).select("key", "status", "amount", "first_seen", "last_changed")


@query(f"""{UPSERT_SQL} SELECT key, '*' AS field, NULL AS old_value, key::VARCHAR AS new_value, 'new_record' AS change_type, 0 AS batch FROM f WHERE created
UNION ALL SELECT key, 'status', os, ns, fs, 0 FROM f WHERE fs IN ('updated', 'conflicts_verified') UNION ALL SELECT key, 'amount', oa, na, fa, 0 FROM f WHERE fa = 'updated'""")
def streamed_changes(spark, sf):
    """The change log of the same stream, by batch."""
    return spark.read.parquet(f"{_streamed(spark, sf)}/changes").select("key", "field", "old_value", "new_value", "change_type", "batch")


@query(f"""{UPSERT_SQL}, a AS (SELECT key, CASE WHEN created THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE WHEN created THEN 'new_conference' ELSE 'cfp_open' END AS kind FROM f WHERE created OR (fs = 'updated' AND ns = 'purchase'))
SELECT * FROM a UNION ALL SELECT key, 'HIGH', 'deadline_soon' FROM f WHERE created AND date_diff('day', DATE '2024-01-20', nts::DATE) BETWEEN 0 AND 30""")
def change_alerts(spark, sf):
    """Alerts of applied changes and of near deadlines."""
    from attesta.operators import decisions

    snapshot, changes = _snapshot(spark, sf)
    renamed = changes.withColumn("field", F.when(F.col("field") == "status", "cfp_status").otherwise(F.col("field"))).withColumn("new_value", F.when(F.col("new_value") == "purchase", "open").otherwise(F.col("new_value")))
    created = changes.where("change_type = 'new_record'").select("key", F.to_date(F.substring("at", 1, 10)).alias("deadline"))
    return decisions.alerts(renamed, created, TODAY)


@query("""WITH c AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS kind, 'kept' AS state, arg_min(value, (ts, event_id)) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1),
b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(CASE WHEN value < 60 THEN NULL ELSE value END, (ts, event_id)) AS nv, arg_max(value < 60, (ts, event_id)) AS low FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(c.user_id, b.user_id) AS user_id, coalesce(b.kind, c.kind) AS kind, CASE WHEN c.user_id IS NULL THEN 'new' ELSE c.state END AS state, CASE WHEN b.user_id IS NULL OR (c.user_id IS NOT NULL AND b.low) THEN c.value WHEN b.low THEN NULL ELSE b.nv END AS value FROM c FULL JOIN b ON c.user_id = b.user_id""")
def claim_upsert(spark, sf):
    """Claims overwritten by a new delivery, but for their verification and for blanks."""
    e = table(spark, sf, "events").withColumn("kind", F.col("event_type"))
    current = windows.first_wins(e.where("event_id % 2 = 0"), ["user_id"], ["ts", "event_id"]).select("user_id", "kind", F.lit("kept").alias("state"), "value")
    batch = e.where("event_id % 2 = 1").select("user_id", "kind", F.lit("new").alias("state"), F.when(F.col("value") >= 60, F.col("value")).alias("value"), F.struct("ts", "event_id").alias("seq"))
    return merge.upsert_claims(current, batch, "user_id", F.desc("seq"), ("state",), ("value",))


@query(f"SELECT user_id, min(event_id) FILTER (ts < {CUT}) IS NULL AS late, coalesce(arg_min(event_id, (ts, event_id)) FILTER (ts < {CUT} AND event_type = 'signup'), arg_min(event_id, (ts, event_id)) FILTER (ts >= {CUT} AND event_type = 'signup')) AS event_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'signup') > 0")
def insert_or_ignore(spark, sf):
    """Signups of the second half added where the first had none."""
    e = table(spark, sf, "events")
    signups = e.where("event_type = 'signup'").select("user_id", "event_id", "ts")
    merged = merge.insert_or_ignore(windows.first_wins(signups.where(f"ts < {CUT}"), ["user_id"], ["ts", "event_id"]), signups.where(f"ts >= {CUT}"), ["user_id"], ["ts", "event_id"])
    early = e.where(f"ts < {CUT}").select("user_id").distinct().withColumn("seen", F.lit(True))
    return merged.join(early, "user_id", "left").select("user_id", F.col("seen").isNull().alias("late"), "event_id")


@query(f"SELECT user_id, event_type, coalesce(arg_max(value, (ts, event_id)) FILTER (ts >= {CUT}), arg_min(value, (ts, event_id)) FILTER (ts < {CUT})) AS value FROM events GROUP BY 1, 2")
def insert_or_replace(spark, sf):
    """U4: the last state of each link replaces the stored one."""
    e = table(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id")
    stored = windows.first_wins(e.where(f"ts < {CUT}"), ["user_id", "event_type"], ["ts", "event_id"])
    return merge.insert_or_replace(stored, e.where(f"ts >= {CUT}"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("""SELECT c_custkey, coalesce(e.mkt, c_mktsegment) AS c_mktsegment, c_name, CASE WHEN e.mkt IS NULL THEN '' ELSE 'c_mktsegment' END AS edited FROM customer LEFT JOIN (SELECT user_id, arg_max(upper(event_type), (ts, event_id)) AS mkt FROM events WHERE value > 100 GROUP BY 1) e ON e.user_id = c_custkey""")
def human_overlay(spark, sf):
    """The latest correction of a field stands over the record."""
    edits = table(spark, sf, "events").where("value > 100").select(F.col("user_id").alias("c_custkey"), F.struct("ts", "event_id").alias("seq"), F.lit("c_mktsegment").alias("field"), F.upper("event_type").alias("value"))
    found = merge.overlay(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name"), edits, "c_custkey", ["c_mktsegment", "c_name"])
    return found.select("c_custkey", "c_mktsegment", "c_name", F.array_join("edited_fields", ",").alias("edited"))


DIFF_SQL = """WITH b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'OLD' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 11 <> 0), a AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS c_name, c_mktsegment AS seg FROM customer WHERE c_custkey % 13 <> 0)"""


def _before_after(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    before = c.where(k % 11 != 0).select("c_custkey", "c_name", F.when(k % 7 == 0, "OLD").otherwise(F.col("c_mktsegment")).alias("seg"))
    after = c.where(k % 13 != 0).select("c_custkey", F.when(k % 9 != 0, F.col("c_name")).alias("c_name"), F.col("c_mktsegment").alias("seg"))
    return before, after


@query(f"""{DIFF_SQL}, j AS (SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, b.c_custkey AS bk, a.c_custkey AS ak, b.c_name AS bn, a.c_name AS an, b.seg AS bs, a.seg AS s FROM b FULL JOIN a ON a.c_custkey = b.c_custkey)
SELECT c_custkey, '*' AS field, NULL AS old_value, NULL AS new_value, CASE WHEN bk IS NULL THEN 'appeared' ELSE 'disappeared' END AS kind FROM j WHERE bk IS NULL OR ak IS NULL
UNION ALL SELECT c_custkey, 'c_name', bn, an, 'changed' FROM j WHERE bk IS NOT NULL AND ak IS NOT NULL AND bn IS DISTINCT FROM an UNION ALL SELECT c_custkey, 'seg', bs, s, 'changed' FROM j WHERE bk IS NOT NULL AND ak IS NOT NULL AND bs IS DISTINCT FROM s""")
def snapshot_diff(spark, sf):
    """What appeared, disappeared or changed between two snapshots."""
    before, after = _before_after(spark, sf)
    return merge.snapshot_diff(before, after, ["c_custkey"], ["c_name", "seg"])


@query(f"{DIFF_SQL} SELECT c_custkey, 'missing' AS side FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a) UNION ALL SELECT c_custkey, 'extra' FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b)")
def missing_and_extra(spark, sf):
    """Keys that one side lacks, both ways."""
    return merge.both_ways(*_before_after(spark, sf), "c_custkey")


REFRESH_SQL = """WITH d AS (SELECT o_orderkey AS id, 'k' || CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 40 ELSE o_orderkey END AS key, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN ' 1998-01-01' ELSE '1998-01-01' END AS due, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'old' END AS page FROM orders),
x AS (SELECT key FROM d GROUP BY key HAVING count(DISTINCT lower(trim(due))) > 1),
v AS (SELECT 'k' || c_custkey AS key, max({'d': CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'soon' ELSE '1999-09-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') END, 'p': CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'new' END, 'c': c_custkey % 2 = 0}) AS v FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1),
n AS (SELECT d.*, CASE WHEN v.key IS NULL THEN due WHEN try_cast(v.v.d AS DATE) IS NOT NULL THEN v.v.d WHEN v.v.c AND v.v.d = '' THEN '' ELSE due END AS due2, CASE WHEN v.key IS NULL THEN page WHEN v.v.p <> '' THEN v.v.p WHEN v.v.c THEN '' ELSE page END AS page2 FROM d LEFT JOIN (SELECT * FROM v WHERE key NOT IN (SELECT key FROM x)) v ON v.key = d.key)"""


def _refreshed(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k.alias("id"), F.concat(F.lit("k"), F.when(k % 5 == 0, k % 40).otherwise(k).cast("string")).alias("key"),
        F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, " 1998-01-01").otherwise("1998-01-01").alias("due"), F.when(k % 5 == 0, "").otherwise("old").alias("page"),
    )
    c = F.col("c_custkey")
    day = F.concat(F.lit("1999-09-"), F.lpad((c % 28 + 1).cast("string"), 2, "0"))
    verified = table(spark, sf, "customer").where(c % 7 != 0).select(F.concat(F.lit("k"), c.cast("string")).alias("key"), F.when(c % 4 == 0, "").when(c % 4 == 1, "soon").otherwise(day).alias("due"), F.when(c % 3 == 0, "").otherwise("new").alias("page"), (c % 2 == 0).alias("cleared"))
    return merge.refresh(rows, verified, "key", ["due", "page"], "due", ("due",), "cleared")


@query(REFRESH_SQL + " SELECT id, key, due2 AS due, page2 AS page FROM n")
def delivery_refresh(spark, sf):
    """U8: owned columns brought up to date; keys with several deadlines in the delivery, blanks and non-dates stay."""
    return _refreshed(spark, sf)[0]


@query(REFRESH_SQL + " SELECT key, 'due' AS field, due AS old_value, due2 AS new_value FROM n WHERE due <> due2 UNION ALL SELECT key, 'page', page, page2 FROM n WHERE page <> page2")
def refresh_changes(spark, sf):
    """U8: the change log of the same refresh."""
    return _refreshed(spark, sf)[1]


@query("""WITH m AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS source FROM orders GROUP BY 1, 2), r AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH' WHEN '4-NOT SPECIFIED' THEN '3-MEDIUM' ELSE o_orderpriority END AS o_orderpriority, o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') AS moved, source FROM m)
SELECT o_custkey, o_orderpriority, arg_min(source, (moved, source)) AS source FROM r GROUP BY 1, 2""")
def rename_with_collision(spark, sf):
    """Renamed memberships; of those that then stand twice the one that had the new name stays."""
    members = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("source"))
    names = spark.createDataFrame([("1-URGENT", "2-HIGH"), ("4-NOT SPECIFIED", "3-MEDIUM")], "old string, new string")
    return merge.rename(members, names, "o_orderpriority", ["o_custkey", "o_orderpriority"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate)::VARCHAR ELSE '1990 edition' END AS edition, CASE WHEN o_orderkey % 2 = 0 THEN '2001' ELSE '1990' END AS key_year FROM orders")
def freeze_key_year(spark, sf):
    """The key year is minted once; the edition follows the event's date where there is one."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    rows = o.select("o_orderkey", F.lit("1990 edition").alias("edition"), F.when(k % 2 == 0, "2001").alias("key_year"), F.when(k % 3 == 0, F.to_date("o_orderdate")).alias("start_date"))
    return merge.freeze_key_year(rows).select("o_orderkey", "edition", "key_year")


@query("""SELECT origin, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT page_id AS id, url AS source_url, 'crawl' AS origin FROM pages UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'http://x.example/' || c_custkey ELSE 'n/a' END, 'delivery' FROM customer UNION ALL SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END, 'https://y.example', 'grounding' FROM supplier) WHERE id IS NOT NULL AND source_url LIKE 'http%://%' GROUP BY 1""")
def evidence_union(spark, sf):
    """Evidence of three origins as one table."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    whole = merge.tagged_union(
        {
            "crawl": table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("source_url")),
            "delivery": table(spark, sf, "customer").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("http://x.example/"), k.cast("string"))).otherwise("n/a").alias("source_url")),
            "grounding": table(spark, sf, "supplier").select(F.when(s % 3 != 0, s).alias("id"), F.lit("https://y.example").alias("source_url")),
        },
        ["id"],
    )
    return whole.groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' OR (event_type = 'click' AND value > 200)")
def dead_hosts(spark, sf):
    """U16: the set of dead hosts only grows."""
    e = table(spark, sf, "events")
    prior, found = e.where("event_type = 'error'").select("user_id"), e.where("event_type = 'click' AND value > 200").select("user_id")
    return prior.union(found).distinct()


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-13') AS recent FROM events GROUP BY 1, 2")
def daily_events(spark, sf):
    """2.11: new records by day, the batch form of the streaming window."""
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.lit("2024-01-13").cast("timestamp_ntz")).alias("recent"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "recent")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2)")
def streamed_first_of_kind(spark, sf):
    """2.11, W1 as a stream: the first event of each kind of each user, from a run-once stream."""
    return jobs.first_of_kind_stream(spark, sf).select("user_id", "event_id")


CRAWLED = (*merge.TRACKED, *merge.UNTRACKED)
OLD_FIELDS = {f: f"CASE WHEN (c_custkey + {k}) % 4 = 0 THEN NULL ELSE concat('v', CAST((c_custkey * {k}) % 7 AS STRING)) END" for k, f in enumerate(CRAWLED, 1)}
NEW_FIELDS = {f: f"CASE WHEN (c_custkey + 2 * {k}) % 5 = 0 THEN NULL WHEN (c_custkey + 2 * {k}) % 5 = 1 THEN '' WHEN c_custkey % 3 = 1 THEN concat('v', CAST((c_custkey * {k}) % 7 AS STRING)) ELSE concat('w', CAST((c_custkey + {k}) % 11 AS STRING)) END" for k, f in enumerate(CRAWLED, 1)}
VERIFIED_FIELDS = ("name", "cfp_status")
_FATE = {
    f: f"CASE WHEN created THEN 'take' WHEN NOT n_there OR failed THEN 'keep' "
    + (f"WHEN held AND n_{f} IS NOT NULL AND coalesce(c_{f}, '') <> n_{f} THEN 'conflicts_verified' WHEN held THEN 'keep' " if f in VERIFIED_FIELDS else "")
    + f"WHEN coalesce(n_{f}, '') = '' OR coalesce(c_{f}, '') = n_{f} THEN 'keep' ELSE 'updated' END"
    for f in merge.TRACKED
}
_REFRESHED = {
    "new": "n_{f}",
    "newer": "CASE WHEN coalesce(n_{f}, '') <> '' THEN n_{f} ELSE c_{f} END",
    "older": "CASE WHEN coalesce(c_{f}, '') <> '' THEN c_{f} ELSE n_{f} END",
}
_CURRENT_SQL = ", ".join(f"{e} AS c_{f}" for f, e in OLD_FIELDS.items())
_BATCH_SQL = ", ".join(f"{e} AS n_{f}" for f, e in NEW_FIELDS.items())
_FATES_SQL = ", ".join(f"{e} AS fate_{f}" for f, e in _FATE.items())
FULL_SQL = f"""WITH c AS (SELECT c_custkey AS key, c_custkey % 5 = 0 AS held, {_CURRENT_SQL} FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey AS key, c_custkey % 9 = 0 OR c_custkey % 11 = 0 AS bad, {_BATCH_SQL} FROM customer WHERE c_custkey % 4 <> 1),
j AS (SELECT coalesce(c.key, n.key) AS key, c.key IS NULL AS created, n.key IS NOT NULL AS n_there, c.key IS NOT NULL AND coalesce(bad, false) AS failed, coalesce(c.held, false) AS held, c.* EXCLUDE (key, held), n.* EXCLUDE (key, bad) FROM c FULL JOIN n ON c.key = n.key),
f AS (SELECT *, {_FATES_SQL} FROM j)"""


def _full(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    strings = lambda fields: [F.expr(e).alias(f) for f, e in fields.items()]
    names = F.array(*[F.lit(f) for f in VERIFIED_FIELDS])
    when = F.lit("2026-01-01")
    current = c.where(k % 3 != 0).select(k.alias("key"), F.when(k % 5 == 0, names).otherwise(F.array().cast("array<string>")).alias("verified"), F.lit("PASS").alias("quality"), when.alias("first_seen"), when.alias("last_checked"), F.lit(None).cast("string").alias("last_changed"), *strings(OLD_FIELDS))
    batch = c.where(k % 4 != 1).select(k.alias("key"), F.lit(1).alias("seq"), F.lit("2026-02-02").alias("at"), F.when((k % 9 == 0) | (k % 11 == 0), F.lit("ERROR")).otherwise(F.lit("PASS")).alias("quality"), *strings(NEW_FIELDS))
    return merge.upsert(current, batch, untracked=merge.UNTRACKED)


@query(f"""{FULL_SQL} SELECT key, {", ".join(f"CASE WHEN fate_{f} IN ('take', 'updated') THEN n_{f} ELSE c_{f} END AS {f}" for f in merge.TRACKED)},
{", ".join(f"CASE WHEN NOT n_there THEN c_{f} WHEN created THEN n_{f} ELSE {_REFRESHED[rule].format(f=f)} END AS {f}" for f, rule in merge.UNTRACKED.items())},
CASE WHEN n_there THEN '2026-02-02' ELSE '2026-01-01' END AS last_checked, CASE WHEN 'updated' IN ({", ".join(f"fate_{f}" for f in merge.TRACKED)}) THEN '2026-02-02' END AS last_changed FROM f""")
def full_upsert(spark, sf):
    """All tracked fields by the truth table and all other columns by their own rules."""
    return _full(spark, sf)[0].select("key", *CRAWLED, "last_checked", "last_changed")


@query(FULL_SQL + " SELECT key, '*' AS field, NULL AS old_value, key::VARCHAR AS new_value, 'new_record' AS change_type FROM f WHERE created " + " ".join(f"UNION ALL SELECT key, '{f}', c_{f}, n_{f}, fate_{f} FROM f WHERE fate_{f} IN ('updated', 'conflicts_verified')" for f in merge.TRACKED))
def full_changes(spark, sf):
    """The change log of the same batch; untracked columns are in none of its rows."""
    return _full(spark, sf)[1].drop("at")


#: Days at which the later events are split into three files of a crawl.
SPLITS = ("2024-01-19", "2024-01-23")


def _in_files(spark, sf):
    """The crawl of `_streamed` in three files, with a restart before the last; the folder of the keyed stream."""
    out = jobs.workplace(spark)
    late = _crawl(_known(table(spark, sf, "events")).where(f"ts >= {CUT} AND user_id % 10 <> 4"))
    day = F.substring("at", 1, 10)
    parts = [late.where(day < SPLITS[0]), late.where((day >= SPLITS[0]) & (day < SPLITS[1])), late.where(day >= SPLITS[1])]
    for run in (parts[:2], parts[2:]):
        for part in run:
            part.coalesce(1).write.mode("append").parquet(f"{out}/in")
        batches = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
        jobs.keyed_crawl_stream(batches, _records(spark, sf), out, ("status", "amount"))
        jobs.alert_stream(spark, out, TODAY)
    return out


def _chain_sql() -> str:
    steps = [f"""e AS (SELECT *, {STATE} AS status, CASE WHEN value >= 50 THEN floor(value)::BIGINT::VARCHAR END AS amount, CASE WHEN event_id % 6 = 0 THEN 'ERROR' ELSE 'PASS' END AS quality,
  CASE WHEN (ts::VARCHAR)[:10] < '{SPLITS[0]}' THEN 1 WHEN (ts::VARCHAR)[:10] < '{SPLITS[1]}' THEN 2 ELSE 3 END AS batch FROM events),
c0 AS (SELECT user_id AS key, status, amount, user_id % 5 = 0 AS held, ts::VARCHAR AS first_seen, NULL::VARCHAR AS last_changed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e WHERE ts < {CUT} AND user_id % 10 <> 3) WHERE n = 1)"""]
    for k in (1, 2, 3):
        steps.append(f"""b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE ts >= {CUT} AND user_id % 10 <> 4 AND batch = {k}) WHERE n = 1),
f{k} AS (SELECT *, CASE WHEN created THEN 'take' WHEN skipped OR coalesce(ns, '') = '' OR coalesce(os, '') = ns THEN 'keep' WHEN held THEN 'conflicts_verified' ELSE 'updated' END AS fs,
  CASE WHEN created THEN 'take' WHEN skipped OR coalesce(na, '') = '' OR coalesce(oa, '') = na THEN 'keep' ELSE 'updated' END AS fa
  FROM (SELECT coalesce(c.key, b.user_id) AS key, c.key IS NULL AS created, b.user_id IS NULL OR (b.quality = 'ERROR' AND c.key IS NOT NULL) AS skipped, coalesce(c.held, false) AS held,
    c.status AS os, c.amount AS oa, b.status AS ns, b.amount AS na, c.first_seen, c.last_changed, b.ts::VARCHAR AS tick FROM c{k - 1} c FULL JOIN b{k} b ON c.key = b.user_id)),
c{k} AS (SELECT key, CASE WHEN fs IN ('take', 'updated') THEN ns ELSE os END AS status, CASE WHEN fa IN ('take', 'updated') THEN na ELSE oa END AS amount, held,
  coalesce(first_seen, tick) AS first_seen, CASE WHEN 'updated' IN (fs, fa) THEN tick ELSE last_changed END AS last_changed FROM f{k})""")
    steps.append("log AS (" + " UNION ALL ".join(
        f"SELECT {k - 1} AS batch, key, '*' AS field, NULL AS old_value, key::VARCHAR AS new_value, 'new_record' AS change_type FROM f{k} WHERE created "
        f"UNION ALL SELECT {k - 1}, key, 'status', os, ns, fs FROM f{k} WHERE fs IN ('updated', 'conflicts_verified') UNION ALL SELECT {k - 1}, key, 'amount', oa, na, fa FROM f{k} WHERE fa = 'updated'"
        for k in (1, 2, 3)) + ")")
    return "WITH " + ",\n".join(steps)


@query(_chain_sql() + " SELECT key, status, amount, first_seen, last_changed FROM c3")
def keyed_stream_records(spark, sf):
    """Records after three files of a crawl in three batches, each from the one before, with a restart between."""
    return jobs.keyed_records(spark, _in_files(spark, sf)).select("key", "status", "amount", "first_seen", "last_changed")


@query(_chain_sql() + " SELECT batch, key, field, old_value, new_value, change_type FROM log")
def keyed_stream_changes(spark, sf):
    """The change log of the same three batches."""
    return spark.read.parquet(f"{_in_files(spark, sf)}/changes").select("batch", "key", "field", "old_value", "new_value", "change_type")


@query(_chain_sql() + " SELECT key, 'MEDIUM' AS severity, 'new_conference' AS kind FROM log WHERE change_type = 'new_record'")
def keyed_stream_alerts(spark, sf):
    """Alerts of a second stream that reads the first one's change log, in two runs; nothing twice."""
    return spark.read.parquet(f"{_in_files(spark, sf)}/alerts").select("key", "severity", "kind")
