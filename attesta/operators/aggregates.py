"""Aggregations: counts, rollups, facts folded from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The buckets of an event, in the order in which they are shown and ranked.
BUCKETS = ("Open", "Upcoming", "Monitoring", "Closed", "Verify")


def billing(licenses: DataFrame, usage: DataFrame, period: str | None, rate_per_mtok: float) -> DataFrame:
    """Calls, tokens and cost of every licence, also of those without usage.

    The period limits usage and not licences; usage is summed before the join.
    """
    used = usage.where(F.col("at").startswith(period)) if period else usage
    sums = used.groupBy("key").agg(F.count("id").alias("calls"), F.sum("total_tokens").alias("tokens"))
    tokens = F.coalesce("tokens", F.lit(0))
    return licenses.join(sums, "key", "left").select("key", "customer", "plan", (F.col("active") == 1).alias("active"), F.coalesce("calls", F.lit(0)).alias("calls"), tokens.alias("tokens"), F.round(tokens / 1_000_000 * rate_per_mtok, 4).alias("cost"))


def rollup_buckets(events: DataFrame, memberships: DataFrame, key: str = "key") -> DataFrame:
    """A5: events in each bucket by market, and once over all events.

    One event may be in many markets, so the total counts events and is not the sum of rows.
    """
    counts = [F.count_if(F.col("bucket") == b).alias(b.lower()) for b in BUCKETS]
    by_market = memberships.select(key, "market").distinct().join(events, key).groupBy("market").agg(*counts, F.count("*").alias("total"))
    whole = events.agg(*counts, F.count("*").alias("total")).select(F.lit("All events (unique)").alias("market"), "*")
    return by_market.unionByName(whole)


def fact(value: str, url: str, order: Column | str, out: str) -> Column:
    """struct(value, evidence): the first value over ordered pages and up to three pages that give one."""
    given = F.col(value).isNotNull() & (F.trim(value) != "")
    order = F.col(order) if isinstance(order, str) else order
    first = F.min_by(F.when(given, F.col(value)), F.when(given, order))
    pages = F.slice(F.array_sort(F.collect_list(F.when(given, F.struct(order.alias("ord"), F.col(url).alias("source_url"), F.substring(value, 1, 200).alias("snippet"))))), 1, 3)
    return F.struct(first.alias("value"), pages.alias("evidence")).alias(out)


def any_true(c: Column) -> Column:
    """Whether any is true; null is not."""
    return F.bool_or(F.coalesce(c, F.lit(False)))


def contested(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi").select(key)


def calibrated_weights(votes: DataFrame) -> DataFrame:
    """Weight of each test, (agreed / fired) squared; votes: test, fired, agreed."""
    sums = votes.groupBy("test").agg(F.count_if("fired").alias("fired"), F.count_if(F.col("fired") & F.col("agreed")).alias("agreed"))
    return sums.withColumn("weight", F.when(F.col("fired") > 0, F.pow(F.col("agreed") / F.col("fired"), 2)).otherwise(0.0))


def share_of(df: DataFrame, group: list[str], good: Column) -> DataFrame:
    """Rows, good rows and their whole percentage by group."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(good).alias("good")).withColumn("percent", F.floor(F.col("good") * 100 / F.col("n") + 0.5).cast("int"))


def repeated_shingle_hashes(pages: DataFrame, key: str, page_text: str, least_pages: int = 3, size: int = 6) -> DataFrame:
    """(key, hash, pages) of runs of words that stand on least_pages pages of a key; only hashes are shuffled."""
    from attesta.functions.text import shingle_hashes

    each = pages.select(key, F.explode(shingle_hashes(page_text, size)).alias("hash"))
    return each.groupBy(key, "hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)


def repeated_shingles(pages: DataFrame, key: str, page_text: str, least_pages: int = 3, size: int = 6) -> DataFrame:
    """(key, shingle, pages): runs of words that stand on least_pages pages of a key: its chrome.

    Runs are counted by hash; only those that stand often enough are looked up and counted as text.
    """
    from attesta.functions.text import shingles

    often = repeated_shingle_hashes(pages, key, page_text, least_pages, size).select(F.col(key).alias("_key"), F.col("hash").alias("_hash"))
    each = pages.select(key, F.explode(shingles(page_text, size)).alias("shingle"))
    known = each.join(often, (F.col(key) == F.col("_key")) & (F.xxhash64("shingle") == F.col("_hash")), "left_semi")
    return known.groupBy(key, "shingle").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)


def chrome_share(snippets: DataFrame, chrome: DataFrame, key: str, snippet: str, size: int = 6) -> DataFrame:
    """Snippets (id, key, snippet) with the share of their runs that are their site's chrome, and is_chrome.

    Half of the runs make a snippet chrome; one that is too short for a run is not.
    """
    from attesta.functions.text import shingles

    runs = snippets.select("id", key, F.explode(shingles(snippet, size)).alias("shingle"))
    known = chrome.select(key, "shingle").distinct().withColumn("known", F.lit(1))
    share = runs.join(known, [key, "shingle"], "left").groupBy("id").agg((F.count("known") / F.count("*")).alias("share"))
    return snippets.join(share, "id", "left").withColumn("share", F.coalesce("share", F.lit(0.0))).withColumn("is_chrome", F.col("share") >= 0.5)
