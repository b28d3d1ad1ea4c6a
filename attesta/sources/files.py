"""Readers of the files that deliveries come in. All cells are text; nothing is inferred.

Large files go through Spark's readers, ragged ones too. Workbooks are small: one file is one row until
a task has parsed it.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import url
from attesta.functions.dates import from_excel_serial
from attesta.functions.text import blank
from attesta.session import cut

# Header spellings of workbook columns by role, the preferred one first.
ROLES = {
    "url": ("conference url", "submission url", "award url", "url", "link"),
    "name": ("conference", "award", "event name", "event", "name"),
    "location": ("location", "venue", "city"),
    "dates": ("start dates", "event dates", "conference dates", "dates"),
    "industry": ("industry", "market"),
}


def read_delivery(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A delivery CSV with a header, read as text by a given schema; a byte-order mark is dropped by the reader."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _running(df: DataFrame, value: str, out: str) -> DataFrame:
    """`df` with `out`: the sum of `value` over the earlier lines of its file. Blocks are added up, then lines in a block."""
    block = ["path", "block"]
    sums = df.groupBy(*block).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*block, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*block).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(before, block).withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, width, header_width, cells) of each record, whatever its width; line counts records from 1.

    Files are read by blocks, many tasks for a large one. A line begins a record if the quotes before it in its
    file are even in number, which the counts of earlier blocks and lines tell; a record is parsed when its lines
    are together, wherever the borders of blocks lie. Quotes stand for quoting only, as RFC 4180 has it; one that is
    never closed makes the rest of its file one record. A blank line is a record without cells.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = cut(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"))
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    begun = cut(_running(lines, "quotes", "before").select("path", "block", "at", "value", (F.col("before") % 2 == 0).cast("int").alias("first")))
    numbered = _running(begun, "first", "records").select("path", "block", "at", "value", (F.col("records") + F.col("first")).cast("int").alias("line"))
    whole = numbered.groupBy("path", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x.value), "\n").alias("value"))  # the lines of one record

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for line, value in zip(batch["line"], batch["value"], strict=True):
                value = value.removeprefix("\ufeff") if line == 1 else value
                rows.append(next(csv.reader(io.StringIO(value.removesuffix("\r"), newline="")), []))
            yield pd.DataFrame({"path": batch["path"], "line": batch["line"], "width": [len(r) for r in rows], "cells": rows})

    parsed = cut(whole.mapInPandas(run, "path string, line int, width int, cells array<string>"))
    heads = parsed.where("line = 1").select("path", F.col("width").alias("header_width"))
    return parsed.join(heads, "path").select("path", "line", "width", "header_width", "cells")


def malformed(ragged: DataFrame, widths: tuple[int, ...] = ()) -> DataFrame:
    """Records whose width differs from the header's, and headers of a width that is no schema."""
    wrong_header = (F.col("line") == 1) & (~F.col("width").isin(*widths) if widths else F.lit(False))
    return ragged.where((F.col("width") != F.col("header_width")) | wrong_header)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """S3: every web address in text files, in order of appearance."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.posexplode(url.urls_in("value")))
    return lines.select("path", F.col("col").alias("url"))


def _cells(workbook: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of all sheets of an .xlsx workbook, by the standard library alone."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    found = []
    with zipfile.ZipFile(io.BytesIO(workbook)) as z:
        names, shared = z.namelist(), []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{space['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space)]
        for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in ElementTree.fromstring(z.read(sheet)).iterfind(".//m:row", space):
                cells: dict[int, str] = {}
                for c in row.findall("m:c", space):
                    at = 0
                    for letter in re.match("[A-Z]+", c.get("r", "A"))[0]:
                        at = at * 26 + ord(letter) - 64
                    value = c.find("m:v", space)
                    inline = "".join(t.text or "" for t in c.iter(f"{{{space['m']}}}t"))
                    text = inline if value is None else value.text or ""
                    cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text else text
                found.append((sheet.rsplit("/", 1)[1], int(row.get("r", len(found) + 1)), [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]))
    return found


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of every row of every sheet."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = _cells(bytes(content))
                yield pd.DataFrame({"path": name, "sheet": [r[0] for r in rows], "row": [r[1] for r in rows], "cells": [r[2] for r in rows]})

    return _whole(spark, path).mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def workbook_targets(cells: DataFrame) -> DataFrame:
    """(path, sheet, row, url, name, location, dates, industry): only the URL column gives targets.

    Columns are found by their header within the first five rows, the preferred spelling of a
    role before others; the header row is the first that names the URL column. Where name and URL
    are the first two columns, place and dates are the next two unless headers say otherwise. A
    sheet without a URL header takes the first column that holds an address.
    """
    flat = cells.select("path", "sheet", "row", F.posexplode("cells").alias("pos", "value"))
    label = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    known = [F.when(label == s, F.struct(F.lit(role).alias("role"), F.lit(i).alias("choice"))) for role, spellings in ROLES.items() for i, s in enumerate(spellings)]
    heads = flat.where("row <= 5").withColumn("h", F.coalesce(*known)).where("h is not null").select("path", "sheet", "row", "h.role", F.struct("h.choice", "pos").alias("at"))
    heads = heads.groupBy("path", "sheet", "row", "role").agg(F.min("at")["pos"].alias("pos"))
    by_row = heads.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("role", "pos"))).alias("at")).where(F.map_contains_key("at", "url"))
    roles = by_row.groupBy("path", "sheet").agg(F.min_by("at", "row").alias("at"), F.min("row").alias("head"))
    first = flat.where(F.col("value").rlike("^https?://")).groupBy("path", "sheet").agg(F.min(F.struct("pos", "row")).alias("f"))
    known_at = first.join(roles, ["path", "sheet"], "left").withColumn("url_pos", F.coalesce(F.col("at")["url"], F.col("f.pos")))
    joined = cells.join(known_at, ["path", "sheet"]).where(F.col("row") > F.coalesce("head", F.lit(0)))
    classic = (F.col("at")["url"] == 1) & (F.col("at")["name"] == 0)
    place = {"location": F.when(classic, 2), "dates": F.when(classic, 3)}
    pick = lambda pos: F.trim(F.get("cells", pos))
    roles_at = {r: F.coalesce(F.col("at")[r], place.get(r, F.lit(None))) for r in ROLES if r != "url"}
    out = joined.select("path", "sheet", "row", pick(F.col("url_pos")).alias("url"), *[F.nullif(pick(p), F.lit("")).alias(r) for r, p in roles_at.items()])
    return out.where(F.col("url").rlike("^https?://"))


def read_dead_links(spark: SparkSession, checks: DataFrame | None, path: str | None = None) -> DataFrame:
    """(url) of links known to be dead: of the checks (url, state) if there are any, else of a file.

    A file is a sheet with a SUBMISSION URL column, or a plain list of addresses. The checks win,
    as a file only says what was true when it was written.
    """
    if checks is not None:
        return checks.where((F.lower("state") == "dead") & F.col("url").isNotNull()).select("url").distinct()
    if path is None:
        return spark.createDataFrame([], "url string")
    head = spark.read.text(path).limit(1).collect()
    if head and "SUBMISSION URL" in head[0].value:
        sheet = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return sheet.select(F.trim("SUBMISSION URL").alias("url")).where(~blank("url")).distinct()
    return spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url").startswith("http")).distinct()


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, v, u, q) of a file of check results; of several of an event the last counts."""
    sheet = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = sheet.select(F.trim("EVENT_ID").alias("event_id"), *[F.coalesce(F.trim(c), F.lit("")).alias(n) for c, n in (("CHECK", "v"), ("CHECK_URL", "u"), ("CHECK_QUOTE", "q"))], F.monotonically_increasing_id().alias("at"))
    return rows.where(~blank("event_id")).groupBy("event_id").agg(F.max_by(F.struct("v", "u", "q"), "at").alias("c")).select("event_id", "c.*")


def gold_rows(cells: DataFrame, only_with_truth: bool = False) -> DataFrame:
    """Reference rows: those whose second cell is an address; serial days become dates."""
    get = lambda i: F.get("cells", F.lit(i))
    rows = cells.where(get(1).rlike("^https?://")).select("row", get(0).alias("name"), get(1).alias("url"), from_excel_serial(get(5).try_cast("int")).alias("deadline"), get(8).alias("status"), get(9).alias("submission_url"))
    return rows.where(F.col("deadline").isNotNull() | ~blank("status") | ~blank("submission_url")) if only_with_truth else rows


def read_inputs(spark: SparkSession, text_path: str | None, workbook: DataFrame | None, urls: list[str]) -> DataFrame:
    """(source, ord, url, name) of a list file (no comments or blanks), a workbook's targets and bare addresses."""
    parts = [spark.createDataFrame([("argument", i, u, None) for i, u in enumerate(urls)], "source string, ord long, url string, name string")]
    if text_path:
        lines = spark.read.text(text_path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "url"))
        parts.append(lines.where(~F.trim("url").startswith("#") & ~blank("url")).select(F.lit("list").alias("source"), F.col("ord").cast("long").alias("ord"), F.trim("url").alias("url"), F.lit(None).cast("string").alias("name")))
    if workbook is not None:
        parts.append(workbook.select(F.lit("workbook").alias("source"), F.col("row").cast("long").alias("ord"), "url", "name"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def read_seeds(spark: SparkSession, pattern: str, columns: list[str], stale: str | None = None) -> DataFrame:
    """All seed files of a pattern with the file each row is from, a stale file left out."""
    rows = read_delivery(spark, pattern, columns).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.where(F.col("file") != stale) if stale else rows


def read_held(spark: SparkSession, path: str) -> DataFrame:
    """(id, reason) of lines "id  # reason"."""
    lines = spark.read.text(path).where(~blank("value") & ~F.trim("value").startswith("#"))
    return lines.select(F.trim(F.substring_index("value", "#", 1)).alias("id"), F.trim(F.when(F.col("value").contains("#"), F.regexp_replace("value", "^[^#]*#", "")).otherwise("")).alias("reason"))


def richest_fetch(fetches: DataFrame) -> DataFrame:
    """Of several fetches of a URL the richest: characters, and sixty for each internal link."""
    return fetches.groupBy("url").agg(F.max_by(F.struct("via", "chars", "internal_links"), F.struct(F.col("chars") + 60 * F.col("internal_links"), "via")).alias("best")).select("url", "best.*")


def join_parts(ragged: DataFrame) -> DataFrame:
    """Pasted parts of one delivery, by file name: fences, blank lines and repeated headers dropped.

    Raises if the widths of the parts' headers differ.
    """
    real = ragged.where(~F.get("cells", F.lit(0)).rlike("^```") & (F.size(F.filter("cells", lambda c: F.trim(c) != "")) > 0))
    heads = real.groupBy("path").agg(F.min_by("cells", "line").alias("head"))
    if heads.select(F.size("head")).distinct().count() > 1:
        raise ValueError("the parts have headers of different widths")
    return real.join(heads, "path").where(F.col("cells") != F.col("head")).select("path", "line", "cells")


def repair_split(cells: DataFrame, width: int, text_at: int, valid: dict[int, str]) -> DataFrame:
    """Records with extra cells made whole: the text cell at text_at is joined from its pieces.

    valid: cell number -> pattern that a rightly repaired record meets. All or nothing: raises
    if one record cannot be repaired.
    """
    extra = F.size("cells") - width
    whole = F.concat(F.slice("cells", 1, text_at), F.array(F.array_join(F.slice("cells", F.lit(text_at + 1), extra + 1), ",")), F.slice("cells", extra + text_at + 2, F.lit(width - text_at - 1)))
    fixed = cells.withColumn("repaired", F.when(extra > 0, whole).when(extra == 0, F.col("cells")))
    good = F.col("repaired").isNotNull()
    for i, pattern in valid.items():
        good = good & F.get("repaired", F.lit(i)).rlike(pattern)
    checked = fixed.withColumn("good", (extra == 0) | F.coalesce(good, F.lit(False)))
    if not checked.where(~F.col("good")).isEmpty():
        raise ValueError("a split record cannot be repaired; nothing was changed")
    return checked.withColumn("cells", F.col("repaired")).drop("repaired", "good")
