"""Merges, linkage, exploration, streams, sources and sinks on small invented rows."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from attesta.functions import vocabulary
from attesta.operators import aggregates, decisions, frontier, gate, linkage, merge, reports, review, windows
from attesta.sources import files, sinks
from attesta.streaming import jobs

FIELDS = ("cfp_status", "cfp_close_date")
CURRENT = "key string, cfp_status string, cfp_close_date string, verified array<string>, quality string, first_seen string, last_checked string, last_changed string"
BATCH = "key string, seq int, at string, quality string, cfp_status string, cfp_close_date string"


def run_upsert(spark, rows, batch, **kind):
    snapshot, changes = merge.upsert(spark.createDataFrame(rows, CURRENT), spark.createDataFrame(batch, BATCH), FIELDS, **kind)
    return {r.key: r for r in snapshot.collect()}, sorted((r.key, r.field, r.old_value, r.new_value, r.change_type) for r in changes.collect()), snapshot


def test_upsert_rules(spark):
    row = lambda k, s="open", v=(): (k, s, "May 1", list(v), "PASS", "1", "1", None)
    rows = [row("same"), row("change"), row("error"), row("blank"), row("held", v=["cfp_status"]), row("unclear"), row("absent")]
    batch = [("same", 1, "2", "PASS", "open", "May 1"), ("change", 1, "2", "PASS", "closed", "May 9"), ("change", 2, "3", "PASS", "closed", "May 2"), ("error", 1, "2", "ERROR", "closed", "x"), ("blank", 1, "2", "PARTIAL", "", None), ("held", 1, "2", "PASS", "closed", "May 1"), ("unclear", 1, "2", "PARTIAL", "unclear", "May 1"), ("new", 1, "2", "PASS", "open", None)]
    found, changes, snapshot = run_upsert(spark, rows, batch)
    assert changes == [("change", "cfp_close_date", "May 1", "May 2", "updated"), ("change", "cfp_status", "open", "closed", "updated"), ("held", "cfp_status", "open", "closed", "conflicts_verified"), ("new", "*", None, "new", "new_record")]
    assert found["change"].last_changed == "3" and found["same"].last_changed is None and found["same"].last_checked == "2"
    assert found["error"].cfp_status == "open" and found["error"].quality == "ERROR" and found["held"].cfp_status == "open" and found["absent"].last_checked == "1"
    assert run_upsert(spark, rows, batch, strict_parity=True)[0]["unclear"].cfp_status == "unclear"
    again, log = merge.upsert(snapshot, spark.createDataFrame(batch, BATCH), FIELDS)
    assert [r.change_type for r in log.collect()] == ["conflicts_verified"]
    assert {tuple(map(str, r)) for r in again.drop("last_changed").collect()} == {tuple(map(str, r)) for r in snapshot.drop("last_changed").collect()}


def test_refresh_leaves_contested_and_logs(spark):
    rows = spark.createDataFrame([("a", "old"), ("a", " OLD"), ("b", "old"), ("c", "old"), ("c", "2026-01-01"), ("d", "old")], "id string, due string")
    verified = spark.createDataFrame([("a", "2026-05-01", False), ("a", "2026-05-01", False), ("b", "soon", False), ("c", "2026-05-01", False), ("d", "", True)], "id string, due string, clear boolean")
    found, log = merge.refresh(rows, verified, "id", ["due"], "due", ("due",), "clear")
    assert sorted(found.collect()) == [("a", "2026-05-01"), ("a", "2026-05-01"), ("b", "old"), ("c", "2026-01-01"), ("c", "old"), ("d", "")]
    assert {(r.id, r.new_value) for r in log.collect()} == {("a", "2026-05-01"), ("d", "")}


def test_windows_and_backfill(spark):
    rows = spark.createDataFrame([("k", 2, "u2", "name"), ("k", 1, "u1", ""), ("k", 3, "u3", "other"), ("j", 1, "v", None)], "key string, ord int, url string, name string")
    assert {(r.key, r.url, r.name, r.dropped) for r in windows.first_wins_with_backfill(rows, ["key"], "ord", ["name"]).collect()} == {("k", "u1", "name", 2), ("j", "v", None, 0)}


def test_rollup_counts_an_event_once_in_total(spark):
    events = spark.createDataFrame([(1, "Open"), (2, "Closed")], "key int, bucket string")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b")], "key int, market string")
    found = {r.market: (r.open, r.closed, r.total) for r in aggregates.rollup_buckets(events, members).collect()}
    assert found == {"a": (1, 0, 1), "b": (1, 1, 2), "All events (unique)": (1, 1, 2)}


def test_linkage_abstains_and_is_certain(spark):
    kind = "id string, name string, url string, city string, start string"
    ours = spark.createDataFrame([("2026-photonics-berlin", "Photonics Week", "https://photonics.org/26", "Berlin", "2026-05-05"), ("2027-photonics-berlin", "Photonics Week", "https://photonics.org/27", "Berlin", "2027-05-05"), ("2026-dairy-rome", "Dairy Days", "https://fairs.com/dairy", "Rome", "2026-06-01"), ("2026-olive-rome", "Olive Days", "https://fairs.com/olive", "Rome", "2026-06-02")], kind)
    theirs = spark.createDataFrame([("r1", "PHOTONICS", "https://photonics.org", "Berlin, DE", "2026-05-06"), ("r2", "Fair", "https://fairs.com", "", ""), ("r3", "Olive Days", "https://fairs.com/olive/", "Rome", "2026-06-02")], kind)
    ready = lambda d: linkage.prepared(d, "id", "name", "url", "city", "start")
    picked = linkage.collapsed(linkage.candidates(ready(theirs), ready(ours)))
    votes = {r.row: r for r in linkage.vote(picked, picked.select("test").distinct().withColumn("weight", F.lit(1.0))).collect()}
    assert votes["r1"].candidate == "2026-photonics-berlin" and votes["r1"].confidence == 100 and "unique_domain" in votes["r1"].tests
    assert votes["r3"].candidate == "2026-olive-rome" and "exact_url" in votes["r3"].tests and "r2" not in votes


def test_best_first_within_budgets(spark):
    links = spark.createDataFrame([("s", "a", "b", 1.0, 1), ("s", "a", "c", 2.0, 2), ("s", "c", "d", 3.0, 1), ("s", "d", "e", 9.0, 1), ("s", "c", "a", 9.0, 2)], "site string, src string, dst string, score double, pos int")
    seeds = spark.createDataFrame([("s", "a")], "site string, url string")
    order = lambda **k: [r.url for r in frontier.explore(seeds, links, **k).orderBy("step").collect()]
    assert order(max_pages=9, max_depth=2) == ["a", "c", "d", "b"] and order(max_pages=2) == ["a", "c"]


def test_gate_lists_offenders(spark):
    rows = spark.createDataFrame([("a", 1), ("b", -1), ("c", None)], "id string, n int")
    assert [tuple(r) for r in decisions.failures(rows, "id", {"POSITIVE": (True, F.col("n") > 0)}).collect()] == [("POSITIVE", True, "b")]


def stream_folder(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 20, i % 24), i % 7, ["view", "click"][i % 2], float(i), "{}") for i in range(200)]
    folder = tmp_path / "in"
    spark.createDataFrame(rows, jobs.EVENTS.replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(folder / "events.parquet"))
    return str(folder)


def test_streams_equal_batches(spark, tmp_path):
    folder = stream_folder(spark, tmp_path)
    batch = spark.read.parquet(f"{folder}/events.parquet")
    first = windows.first_wins(batch, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")
    assert sorted(jobs.first_of_kind_stream(spark, folder).collect()) == sorted(first.collect())
    out = str(tmp_path / "upsert")
    jobs.upsert_stream(jobs.read_events(spark, folder), out, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    last = windows.first_wins(batch, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/v0").collect()) == sorted(r.event_id for r in last.collect())
    jobs.upsert_stream(jobs.read_events(spark, folder), out, ["user_id"], [F.desc("ts"), F.desc("event_id")])  # a restart has nothing to do
    deduped = str(tmp_path / "dedup")
    jobs.run_once(jobs.first_seen_stream(jobs.read_events(spark, folder), ["user_id"]), deduped)
    assert spark.read.parquet(f"{deduped}/data").count() == 7
    counted = str(tmp_path / "counts")
    jobs.run_once(jobs.windowed_counts(jobs.read_events(spark, folder)), counted)
    counts = spark.read.parquet(f"{counted}/data")
    assert counts.count() > 0 and counts.agg(F.sum("n")).first()[0] <= 200


def test_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text('﻿A,B\n1,"x, y"\n2,z\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_delivery(spark, str(tmp_path / "d.csv"), ["A", "B"]).collect()] == [("1", "x, y"), ("2", "z")]
    (tmp_path / "r.csv").write_text("A,B,C\n1,2,3\n1,a,b,3\n1\n")
    ragged = files.read_ragged(spark, str(tmp_path / "r.csv"))
    assert sorted(r.line for r in files.malformed(ragged).collect()) == [3, 4]
    body = ragged.where("line between 2 and 3")
    assert sorted(r.cells for r in files.repair_split(body, 3, 1, {0: r"^\d$", 2: r"^\d$"}).collect()) == [["1", "2", "3"], ["1", "a,b", "3"]]
    with pytest.raises(ValueError, match="cannot be repaired"):
        files.repair_split(ragged.where("line > 1"), 3, 1, {0: r"^\d$"})
    (tmp_path / "u.txt").write_text("# note\nhttps://a.b/c\n\nhttps://d.e\n")
    assert [r.url for r in files.read_inputs(spark, str(tmp_path / "u.txt"), None, ["https://x.y"]).orderBy("source", "ord").collect()] == ["https://x.y", "https://a.b/c", "https://d.e"]
    (tmp_path / "h.txt").write_text("id-1  # withdrawn\nid-2\n# all\n")
    assert [tuple(r) for r in files.read_held(spark, str(tmp_path / "h.txt")).collect()] == [("id-1", "withdrawn"), ("id-2", "")]
    for n, rows in (("p1", "```\nA,B\n1,2\n"), ("p2", "A,B\n3,4\n```\n")):
        (tmp_path / f"{n}.part").write_text(rows)
    parts = files.read_ragged(spark, str(tmp_path / "*.part"))
    assert sorted(r.cells for r in files.join_parts(parts).collect()) == [["1", "2"], ["3", "4"]]


def workbook(path, rows):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if not isinstance(v, int) else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v != "") + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "w.xlsx", [["List of events"], ["Conference", "Conference  URL", "City"], ["One", "https://one.org", "Rome"], ["Two", "none", ""], ["Three", "https://three.org", ""]])
    found = files.workbook_targets(files.read_workbook(spark, str(tmp_path / "w.xlsx"))).orderBy("row").collect()
    assert [(r.url, r.name, r.location) for r in found] == [("https://one.org", "One", "Rome"), ("https://three.org", "Three", None)]
    workbook(tmp_path / "a.xlsx", [["Award", "Open date", "Submission URL", "URL"], ["Prize", "1 May", "https://prize.org/submit", "https://prize.org"]])
    award = files.workbook_targets(files.read_workbook(spark, str(tmp_path / "a.xlsx"))).collect()
    assert [(r.url, r.name, r.location, r.dates) for r in award] == [("https://prize.org/submit", "Prize", None, None)]
    workbook(tmp_path / "c.xlsx", [["Conference", "URL"], ["One", "https://one.org", "Rome", "May"]])
    assert [(r.location, r.dates) for r in files.workbook_targets(files.read_workbook(spark, str(tmp_path / "c.xlsx"))).collect()] == [("Rome", "May")]
    workbook(tmp_path / "g.xlsx", [["N", "U"], ["One", "https://one.org", "", "", "", 46143], ["Two", "https://two.org"]])
    gold = files.gold_rows(files.read_workbook(spark, str(tmp_path / "g.xlsx")), only_with_truth=True).collect()
    assert [(r.name, r.deadline) for r in gold] == [("One", dt.date(2026, 5, 1))]


RECORD = "key int, name string, url string, location string, start_dates string, last_checked string, submission_deadline string, verified boolean, priority string, submission_status string, status string, status_details string, submission_url string, coordinator_email string, overview string, categories string, notes string, opportunity_types array<string>, edition string, event_is_past int, verify_state string, verify_detail string, is_projected string, quality string"


def test_customer_sheet(spark, tmp_path):
    record = lambda k, **v: tuple({"key": k, "name": "Café", "status": "open", "edition": "2026", "event_is_past": 0, "quality": "PASS", "categories": "AI,Bio"} .get(c) if c not in v else v[c] for c in [f.split()[0] for f in RECORD.split(", ")])
    rows = spark.createDataFrame([record(1), record(2, edition="2020", status_details="call is open", submission_deadline="2020-01-01"), record(3, verify_state="contradicted", verify_detail="404", categories="Food")], RECORD)
    sheet = sinks.customer_rows(rows, dt.date(2026, 8, 8))
    assert tuple(sheet.columns) == sinks.CUSTOMER_COLUMNS
    first, second, third = sheet.collect()
    assert first["CONFERENCE"] == "Cafe" and first["RESEARCH STATUS"] == "Open (2026)" and first["STATUS DETAILS"].startswith("No public deadline") and first["CONFIDENCE"] == "Unconfirmed"
    assert second["RESEARCH STATUS"] == "Closed (2020)" and second["STATUS DETAILS"] == "This edition (2020) has passed. call is open" and third["CONFIDENCE"] == "Check link"
    sinks.write_csv(sheet, str(tmp_path / "sheet"), ["CONFERENCE", "EDITION"])
    assert spark.read.option("header", True).csv(str(tmp_path / "sheet")).columns == list(sinks.CUSTOMER_COLUMNS)
    sinks.write_feed(sheet, str(tmp_path / "feed"), "bio")
    assert spark.read.json(str(tmp_path / "feed" / "lines")).count() == 2
    document = json.loads(spark.read.text(str(tmp_path / "feed" / "json"), wholetext=True).first()[0])
    assert document["columns"] == list(sinks.CUSTOMER_COLUMNS) and len(document["rows"]) == 2 and document["rows"][0]["CONFERENCE"] == "Cafe"
    sinks.write_market_sheets(rows.select("key", "name", "status"), spark.createDataFrame([(1, "AI"), (1, "Bio")], "key int, market string"), "key", str(tmp_path / "markets"))
    sheets = lambda part: spark.read.option("header", True).csv(str(tmp_path / "markets" / part))
    assert sorted((r.key, r.market) for r in sheets("markets").collect()) == [("1", "AI"), ("1", "Bio")]
    assert sorted((r.key, r.MARKET) for r in sheets("all").collect()) == [("1", "AI"), ("1", "Bio"), ("2", "(unassigned)"), ("3", "(unassigned)")]
    target = str(tmp_path / "checked")
    assert sinks.write_checked(sheet, target, sheet.columns) == 3 and sinks.write_checked(sheet.limit(1), target, sheet.columns) == 1
    assert spark.read.parquet(target).count() == 1 and spark.read.parquet(f"{target}.before").count() == 3
    with pytest.raises(ValueError, match="differs"):
        sinks.write_checked(sheet, target, ["other"])


def test_dead_links_and_checks(spark, tmp_path):
    checks = spark.createDataFrame([("https://a", "Dead"), ("https://b", "alive"), (None, "dead")], "url string, state string")
    (tmp_path / "sheet.csv").write_text("NAME,SUBMISSION URL\nx, https://c \ny,\n")
    (tmp_path / "list.txt").write_text("https://d\nnote\n\nhttps://d\n")
    (tmp_path / "checks.csv").write_text('EVENT_ID,CHECK,CHECK_URL,CHECK_QUOTE\ne1,no_quote,,\n ,verified,u,q\ne1, verified ,https://u,"a, b"\n')
    urls = lambda *given: sorted(r.url for r in files.read_dead_links(spark, *given).collect())
    assert urls(checks, str(tmp_path / "list.txt")) == ["https://a"] and urls(None, str(tmp_path / "sheet.csv")) == ["https://c"] and urls(None, str(tmp_path / "list.txt")) == ["https://d"] and urls(None) == []
    assert [tuple(r) for r in files.read_checks(spark, str(tmp_path / "checks.csv")).collect()] == [("e1", "verified", "https://u", "a, b")]


def test_structure_of_a_delivery(spark, tmp_path):
    header = [f"C{i}" for i in range(38)] + list(gate.SPONSOR_COLUMNS)
    (tmp_path / "good.csv").write_text(",".join(header) + "\n" + ",".join("x" * 43) + "\n" + ",".join("x" * 42) + "\n")
    (tmp_path / "named.csv").write_text(",".join(f"C{i}" for i in range(43)) + "\n")
    (tmp_path / "narrow.csv").write_text("A,B\n1,2\n")
    bad = lambda name: [r.offender for r in gate.structure_failures(files.read_ragged(spark, str(tmp_path / name))).collect()]
    assert bad("good.csv") == ["line 3"] and bad("named.csv") == ["line 1"] and bad("narrow.csv") == ["line 1"]


def test_queue_is_bounded_and_markets_are_guarded(spark):
    rows = spark.createDataFrame([(1, "queued"), (2, "queued"), (3, "passed")], "id int, why string")
    kept, tally = review.weekly_queue(rows, F.col("why"), 2)
    assert kept.count() == 2 and dict(tally.collect()) == {"queued": 2, "passed": 1}
    with pytest.raises(ValueError, match="more than 1"):
        review.weekly_queue(rows, F.col("why"), 1)
    names = ["Utilities", "utility", "Photonics", " ", "Semiconductors", "Biofuels"]
    named = spark.createDataFrame([(n,) for n in names], "n string")
    fates = [(r.fate, r.name) for r in named.select(vocabulary.admit_market("n").alias("a")).select("a.*").collect()]
    assert fates == [("refused: looks like another", "Utility"), ("known", "Utility"), ("added", "Photonics"), ("refused: empty", None), ("refused: looks like another", "Semiconductor"), ("known", "Bioeconomy")]
    assert named.where("n = 'Utilities'").select(vocabulary.admit_market("n", forced=F.lit(True)).alias("a")).first().a.fate == "added"


def test_chrome_snippets(spark):
    menu = "home agenda speakers venue travel contact us now"
    pages = spark.createDataFrame([("s", f"{menu} page {i} has words of its own to read here") for i in range(3)], "site string, body string")
    chrome = aggregates.repeated_shingles(pages, "site", "body")
    snippets = spark.createDataFrame([(1, "s", menu), (2, "s", "a quite new sentence about the call for papers"), (3, "s", "too short"), (4, "t", menu)], "id int, site string, snippet string")
    assert {r.id: r.is_chrome for r in aggregates.chrome_share(snippets, chrome, "site", "snippet").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_withdrawal_and_retirement_clear_their_own_fields(spark):
    rows = spark.createDataFrame([(1, "2026-01-01", "u", "q", "")], "id int, deadline string, deadline_evidence_url string, deadline_quote string, detail string")
    for marker, left in (("[retired]", ("", "u", "q")), ("[R1 withdrawal]", ("2026-01-01", "", ""))):
        (row,) = reports.retire(rows, rows.select("id"), "id", list(reports.CLEARED[marker]), marker).collect()
        assert (row.deadline, row.deadline_evidence_url, row.deadline_quote) == left and row.detail.startswith(marker)
