"""Writers: customer sheets, feeds, market folders, and a delivery that is checked before it stands."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import dates, records, scoring, udfs
from attesta.functions.text import blank, text
from attesta.operators import decisions

# Columns of a customer's sheet, in their order.
CUSTOMER_COLUMNS = (
    "CONFERENCE", "CONFERENCE URL", "LOCATION", "START DATES", "LATEST UPDATE", "SUBMISSION DEADLINE", "SUBMISSION DATE VERIFIED", "PRIORITY", "STATUS", "STATUS DETAILS",
    "SUBMISSION URL", "COORDINATOR EMAIL", "OVERVIEW", "CATEGORIES", "NOTES", "TRACK", "RESEARCH STATUS", "EDITION", "CONFIDENCE",
)
RESEARCH_WORDS = {"open": "Open", "closed": "Closed", "upcoming": "Upcoming", "unclear": "Needs Review", "none": "No Opportunity Found"}


def customer_rows(exported: DataFrame, today: dt.date, fold: bool = True) -> DataFrame:
    """Export records as rows of a customer's sheet."""
    c = F.col
    gated = decisions.gated_status(c("status"), c("event_is_past"), c("edition"), today)
    word = None
    for raw, shown in RESEARCH_WORDS.items():
        word = F.when(gated == raw, shown) if word is None else word.when(gated == raw, shown)
    word = word.otherwise(F.initcap(gated))
    edition, details = text("edition"), text("status_details")
    research = F.when((word != "") & (edition != ""), F.concat(word, F.lit(" ("), edition, F.lit(")"))).otherwise(word)
    live = gated.isin("open", "upcoming", "unclear") | (~blank("submission_url") & (gated != "closed"))
    noted = F.when(live & blank("submission_deadline"), F.concat_ws(" - ", F.nullif(details, F.lit("")), F.lit("No public deadline found - needs verification"))).otherwise(details)
    past = F.when(edition != "", F.concat(F.lit("This edition ("), edition, F.lit(") has passed."))).otherwise(F.lit("This edition has passed."))
    turned = (gated == "closed") & ~F.lower(text("status")).isin("closed", "none", "")
    values: dict[str, Column] = {
        "CONFERENCE": c("name"), "CONFERENCE URL": c("url"), "LOCATION": c("location"), "START DATES": c("start_dates"),
        "LATEST UPDATE": F.date_format(dates.parse_iso("last_checked"), "M/d/yyyy"), "SUBMISSION DEADLINE": c("submission_deadline"),
        "SUBMISSION DATE VERIFIED": F.when(F.coalesce(c("verified"), F.lit(False)), "Yes").otherwise("Needs Verification"),
        "PRIORITY": c("priority"), "STATUS": c("submission_status"), "STATUS DETAILS": F.when(turned, F.trim(F.concat_ws(" ", past, noted))).otherwise(noted),
        "SUBMISSION URL": c("submission_url"), "COORDINATOR EMAIL": c("coordinator_email"), "OVERVIEW": c("overview"), "CATEGORIES": c("categories"), "NOTES": c("notes"),
        "TRACK": scoring.track_label(c("opportunity_types")), "RESEARCH STATUS": research, "EDITION": edition,
        "CONFIDENCE": decisions.confidence(c("verify_state"), c("verify_detail"), c("is_projected"), c("submission_deadline"), c("quality"), c("status")),
    }
    return exported.select(*[(udfs.ascii_fold(v) if fold else text(v)).alias(n) for n, v in values.items()])


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """K1: one CSV in a fixed order; a sheet is small by its nature."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def tagged(rows: DataFrame, tag: str, column: str = "CATEGORIES") -> DataFrame:
    """Rows whose categories hold the tag, whatever its case; all of them without a tag."""
    return rows.where(F.contains(F.lower(text(column)), F.lit(tag.strip().lower()))) if tag.strip() else rows


def feed_document(rows: DataFrame) -> Column:
    """K2: the feed as one JSON text, {"columns": [...], "rows": [...]}; to be used in an aggregation over a feed's few rows."""
    listed = F.array_sort(F.collect_list(F.to_json(F.struct(*[text(f"`{c}`").alias(c) for c in rows.columns]))))
    return F.concat(F.lit('{"columns": ' + json.dumps(rows.columns) + ', "rows": ['), F.array_join(listed, ", "), F.lit("]}"))


def write_feed(rows: DataFrame, path: str, tag: str = "") -> None:
    """K2: a feed as path/csv, path/lines (a JSON object a row) and path/json ({columns, rows}).

    The document is one value by its form: it is for customer sheets. Feeds of any size are in the lines.
    """
    kept = tagged(rows, tag)
    kept.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    kept.write.mode("overwrite").json(f"{path}/lines")
    kept.agg(feed_document(kept).alias("value")).write.mode("overwrite").text(f"{path}/json")


#: The order of statuses within a market of the combined sheet; others come last.
STATUS_ORDER = ("open", "upcoming", "unclear", "none", "closed")


def combined_sheet(rows: DataFrame, memberships: DataFrame, key: str) -> DataFrame:
    """K3: each row under each of its markets, those of none under (unassigned), with their place in the sheet.

    rows: key, name, status and what is shown. The place counts within a market, by status and name.
    """
    members = memberships.select(key, F.col("market").alias("MARKET")).distinct()
    listed = rows.join(members, key, "left").withColumn("MARKET", F.coalesce("MARKET", F.lit("(unassigned)")))
    known = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.lower(text("status")))
    order = Window.partitionBy("MARKET").orderBy(F.when(known == 0, 9).otherwise(known), F.lower(text("name")), key)
    return listed.withColumn("place", F.row_number().over(order))


def write_market_sheets(rows: DataFrame, memberships: DataFrame, key: str, path: str) -> None:
    """K3: CSV sheets of each market under path/markets, and the combined one under path/all."""
    whole = combined_sheet(rows, memberships, key)
    name = F.trim(F.regexp_replace("MARKET", "[^A-Za-z0-9&+ -]", ""))
    sheets = whole.where("MARKET <> '(unassigned)'").withColumn("market", F.when(name == "", "market").otherwise(name))
    sheets.repartition("market").sortWithinPartitions("market", "place").drop("place").write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("market").csv(f"{path}/markets")
    whole.repartitionByRange("MARKET", "place").sortWithinPartitions("MARKET", "place").drop("place").write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/all")


def seed_rows(claims: DataFrame, today: dt.date) -> DataFrame:
    """K4: a delivery with six derived columns: canonical id, clean city, call model, gated status, issues, verify state."""
    c = lambda n: F.col(f"`{n}`") if n in claims.columns else F.lit("")
    city = records.clean_city(c("LOCATION"), c("CITY"), c("STATE_PROVINCE"), c("COUNTRY"))
    model = records.call_model(c("CFP MODEL TYPE"))
    found = decisions.issues(c("STATUS"), c("SUBMISSION DEADLINE"), c("START DATE"), model, city, c("SUBMISSION URL"), today)
    derived = {
        "EVENT_ID_CANON": records.event_id(c("CONFERENCE"), c("EDITION"), city, c("LOCATION"), c("OPPORTUNITY_TYPE")),
        "CITY_CLEAN": city, "CFP_MODEL_CANON": model,
        "GATED_STATUS_CALC": decisions.gated_claim_status(c("STATUS"), c("SUBMISSION DEADLINE"), today),
        "ISSUES_CALC": F.array_join(found, "; "), "VERIFY_STATE": F.lit("unverified"),
    }
    return claims.withColumns(derived)


def fingerprint(df: DataFrame) -> tuple:
    """Number of rows, and sums of two hashes of each column and of whole rows: equal for equal tables in any order.

    Floats are hashed as they are, arrays and structs by their parts, maps by their sorted entries.
    """

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.array_sort(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c

    columns = [plain(f) for f in df.schema.fields]
    sums = lambda *c: [F.sum(F.xxhash64(F.lit(seed), *c).cast("decimal(38,0)")) for seed in (1, 2)]
    named = [x for i, c in enumerate(columns) for x in sums(F.lit(i), c, c.isNull())]
    return tuple(df.agg(F.count(F.lit(1)), *named, *sums(*columns, *(c.isNull() for c in columns))).first())


def write_checked(rows: DataFrame, path: str, columns: list[str]) -> int:
    """K7, K8: written aside, read again and only then put in place; raises if columns or any value differ.

    Returns the number of rows. The earlier version stays beside the new one. Rows that are not the same each
    time they are worked out count as changed.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    aside, target, backup = (jvm.Path(path + s) for s in (".new", "", ".before"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    expected = fingerprint(rows)
    rows.write.mode("overwrite").parquet(aside.toString())
    again = spark.read.parquet(aside.toString())
    if again.columns != columns or fingerprint(again) != expected:
        raise ValueError("what was written differs from what was to be written; the target is as it was")
    if files.exists(target):
        files.delete(backup, True)
        if not files.rename(target, backup):
            raise OSError(f"{path} could not be set aside; it is as it was")
    if not files.rename(aside, target):
        if files.exists(backup):
            files.rename(backup, target)
        raise OSError(f"{path} could not be replaced; it is as it was")
    return expected[0]
