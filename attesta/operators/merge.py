"""Merges, change capture and set operations: copy-on-write over plain DataFrames.

Each returns new snapshots (and change logs); nothing is updated in place, so applying a
batch twice changes nothing the second time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import blank, text
from attesta.operators.aggregates import contested
from attesta.operators.windows import first_wins

# Fields whose changes are logged, and what becomes of the others, whatever the crawl's outcome: the
# new value, the new one unless blank, or the old one unless blank.
TRACKED = ("name", "location", "conference_dates", "cfp_status", "cfp_close_date", "submission_url", "categories")
UNTRACKED = {"url": "new", "industry": "newer", "edition": "newer", "coordinator_email": "older", "overview": "newer", "status_details": "newer", "event_is_past": "new"}


def upsert(current: DataFrame, batch: DataFrame, fields: tuple[str, ...] = TRACKED, key: str = "key", strict_parity: bool = False, untracked: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshot, changes) of a crawl batch merged into the current records.

    current: key, fields, verified (list of human-verified fields), quality, first_seen,
    last_checked, last_changed. batch: key, seq, at, quality, fields; the last row of a key
    counts. A failed crawl leaves all fields; a blank never overwrites; a verified field
    keeps its value and a conflict is logged, for an empty text too but not for null. An unclear
    status counts as blank unless strict_parity. untracked: other columns of both with their rule
    as in UNTRACKED, none by default; they are never logged.
    """
    untracked = untracked or {}
    new = first_wins(batch, [key], [F.desc("seq")])
    n = new.select(F.col(key), "at", F.col("quality").alias("n_quality"), F.lit(True).alias("n_there"), *[F.col(f).alias(f"n_{f}") for f in (*fields, *untracked)])
    c = current.select(F.col(key), "verified", "quality", "first_seen", "last_checked", "last_changed", F.lit(True).alias("c_there"), *fields, *untracked)
    both = c.join(n, key, "full")
    created = F.col("c_there").isNull()
    failed = F.col("n_quality").isin("ERROR", "BLOCKED") & ~created

    def fate(f: str) -> Column:
        value = F.col(f"n_{f}")
        unclear = F.lit(not strict_parity) & F.lit(f == "cfp_status") & (F.lower(text(value)) == "unclear")
        nothing = blank(value) | unclear
        held = F.coalesce(F.array_contains("verified", f), F.lit(False))
        differs = text(f) != text(value)
        return F.when(F.col("n_there").isNull() | failed, "keep").when(created, "take").when(held & differs & value.isNotNull() & ~unclear, "conflicts_verified").when(held | nothing | ~differs, "keep").otherwise("updated")

    fates = both.select("*", *[fate(f).alias(f"fate_{f}") for f in fields])
    updated = reduce(lambda a, b: a | b, [F.col(f"fate_{f}") == "updated" for f in fields])
    value = lambda f: F.when(F.col(f"fate_{f}").isin("take", "updated"), F.col(f"n_{f}")).otherwise(F.col(f)).alias(f)

    def refreshed(f: str) -> Column:
        old, new = F.col(f), F.col(f"n_{f}")
        first, second = (new, old) if untracked[f] == "newer" else (old, new)
        chosen = new if untracked[f] == "new" else F.when(~blank(first), first).otherwise(second)
        return F.when(F.col("n_there").isNull(), old).when(created, new).otherwise(chosen).alias(f)

    snapshot = fates.select(
        key,
        *[value(f) for f in fields],
        *[refreshed(f) for f in untracked],
        F.coalesce("verified", F.array().cast("array<string>")).alias("verified"),
        F.coalesce("n_quality", "quality").alias("quality"),
        F.coalesce("first_seen", "at").alias("first_seen"),
        F.coalesce("at", "last_checked").alias("last_checked"),
        F.when(updated, F.col("at")).otherwise(F.col("last_changed")).alias("last_changed"),
    )
    log = F.array_compact(
        F.array(
            F.when(created, F.struct(F.lit("*").alias("field"), F.lit(None).cast("string").alias("old_value"), F.col(key).cast("string").alias("new_value"), F.lit("new_record").alias("change_type"))),
            *[F.when(F.col(f"fate_{f}").isin("updated", "conflicts_verified"), F.struct(F.lit(f).alias("field"), F.col(f).alias("old_value"), F.col(f"n_{f}").alias("new_value"), F.col(f"fate_{f}").alias("change_type"))) for f in fields],
        )
    )
    changes = fates.where("n_there").select(key, "at", F.explode(log).alias("c")).select(key, "at", "c.*")
    return snapshot, changes


def upsert_claims(current: DataFrame, batch: DataFrame, key: str, order: Column, untouched: tuple[str, ...], keep_if_blank: tuple[str, ...]) -> DataFrame:
    """The batch overwrites claims, but for `untouched` columns, and blanks of keep_if_blank."""
    new = first_wins(batch, [key], [order]).select(*current.columns)
    c, n = current.alias("c"), new.alias("n")
    there, fresh = F.col(f"n.{key}").isNotNull(), F.col(f"c.{key}").isNull()

    def pick(name: str) -> Column:
        old, got = F.col(f"c.{name}"), F.col(f"n.{name}")
        if name == key:
            return F.coalesce(old, got).alias(name)
        take = there & (fresh if name in untouched else fresh | ~blank(got) if name in keep_if_blank else F.lit(True))
        return F.when(take, got).otherwise(old).alias(name)

    return c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full").select(*[pick(name) for name in current.columns])


def insert_or_ignore(current: DataFrame, batch: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Rows of new keys are added, the first of each key."""
    fresh = first_wins(batch, keys, order).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def insert_or_replace(current: DataFrame, batch: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """U4, K6: rows of the batch replace those of their key, the last of each key."""
    last = first_wins(batch, keys, order).select(*current.columns)
    return current.join(last.select(*keys), keys, "left_anti").select(*current.columns).unionByName(last)


def overlay(df: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Human corrections (key, seq, field, value) on top of records; the latest of a field counts."""
    last = first_wins(edits.where(F.col("field").isin(*fields)), [key, "field"], [F.desc("seq")])
    wide = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_edits"))
    joined = df.join(wide, key, "left")
    values = {f: F.when(F.map_contains_key("_edits", f), F.col("_edits")[f].cast(dict(df.dtypes)[f])).otherwise(F.col(f)) for f in fields}
    edited = F.coalesce(F.array_sort(F.map_keys("_edits")), F.array().cast("array<string>"))
    return joined.withColumns(values | {"edited_fields": F.when(F.col("_edits").isNotNull(), edited).otherwise(F.array().cast("array<string>"))}).select(*df.columns, "edited_fields")


def refresh(delivery: DataFrame, verified: DataFrame, key: str, owned: list[str], deadline: str, date_columns: tuple[str, ...] = (), cleared: str | None = None) -> tuple[DataFrame, DataFrame]:
    """U8: (rows, changes): owned columns of a delivery brought up to date from verified records.

    Keys under which the delivery itself has more than one deadline are contested: they stand for several
    calls, of which one record cannot be all, and are left alone. So are unknown keys; a blank only clears
    where `cleared` is true; what is no date never enters a date column. Of several verified records of a
    key the greatest by its owned columns counts.
    """
    held = contested(delivery.withColumn("_deadline", F.lower(F.trim(text(deadline)))), key, "_deadline")
    given = [F.col(c).alias(f"_new_{c}") for c in owned] + ([F.col(cleared).alias("_cleared")] if cleared else [])
    source = verified.groupBy(key).agg(F.max(F.struct(*given)).alias("_v")).select(key, "_v.*").join(held, key, "left_anti")
    joined = delivery.join(source, key, "left")
    clears = F.coalesce(F.col("_cleared"), F.lit(False)) if cleared else F.lit(False)

    def fresh(c: str) -> Column:
        new = F.col(f"_new_{c}")
        good = ~blank(new) & (F.try_to_date(new.cast("string")).isNotNull() if c in date_columns else F.lit(True))
        return F.when(good, new).when(clears & blank(new), F.lit("")).otherwise(F.col(c))

    log = F.array_compact(F.array(*[F.when(text(fresh(c)) != text(c), F.struct(F.lit(c).alias("field"), F.col(c).alias("old_value"), fresh(c).alias("new_value"))) for c in owned]))
    changes = joined.select(key, F.explode(log).alias("c")).select(key, "c.*")
    return joined.select(*[fresh(c).alias(c) if c in owned else F.col(c) for c in delivery.columns]), changes


def rename(df: DataFrame, names: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Values of a key column renamed (old, new); of rows that then collide the one that had the new name stays."""
    given = names.select(F.col("old").alias(column), F.col("new").alias("_new"))
    renamed = df.join(given, column, "left").withColumn("_moved", F.col("_new").isNotNull()).withColumn(column, F.coalesce("_new", column))
    return first_wins(renamed, keys, ["_moved", *[c for c in df.columns if c not in keys]]).select(*df.columns)


def freeze_key_year(df: DataFrame, edition: str = "edition", start: str = "start_date") -> DataFrame:
    """key_year is minted once from the edition; the edition then follows the start date."""
    minted = F.substring(F.col(edition), 1, 4)
    frozen = df.withColumn("key_year", F.coalesce("key_year", minted) if "key_year" in df.columns else minted)
    return frozen.withColumn(edition, F.coalesce(F.year(start).cast("string"), F.col(edition)))


def tagged_union(sources: dict[str, DataFrame], needed: list[str]) -> DataFrame:
    """Sources of evidence as one table, tagged with origin; rows without id or web address go."""
    parts = [df.withColumn("origin", F.lit(name)) for name, df in sources.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.where(reduce(lambda a, b: a & b, [~blank(c) for c in needed]) & F.lower("source_url").rlike("^https?://"))


def both_ways(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("missing", "extra")) -> DataFrame:
    """Keys of a that b lacks, and keys of b that a lacks, with which it is."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(names[0]))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit(names[1]))
    return left.unionByName(right)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, old_value, new_value, kind) of rows that appeared, disappeared or changed."""
    b = before.select(*keys, F.lit(True).alias("_b"), *[F.col(f).cast("string").alias(f"_b_{f}") for f in fields])
    a = after.select(*keys, F.lit(True).alias("_a"), *[F.col(f).cast("string").alias(f"_a_{f}") for f in fields])
    none = F.lit(None).cast("string")
    entry = lambda f, o, n, k: F.struct(F.lit(f).alias("field"), o.alias("old_value"), n.alias("new_value"), F.lit(k).alias("kind"))
    found = F.when(F.col("_b").isNull(), F.array(entry("*", none, none, "appeared"))).when(F.col("_a").isNull(), F.array(entry("*", none, none, "disappeared")))
    found = found.otherwise(F.array_compact(F.array(*[F.when(~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}")), entry(f, F.col(f"_b_{f}"), F.col(f"_a_{f}"), "changed")) for f in fields])))
    return b.join(a, keys, "full").select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")
