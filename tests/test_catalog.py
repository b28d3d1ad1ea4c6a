"""Every query with a DuckDB counterpart gives the same rows on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from attesta.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"{float(v):.6f}"
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_market_guard_by_definition(spark):
    """M6 against a plain statement of the rule."""
    from difflib import SequenceMatcher

    from attesta.functions import vocabulary
    from attesta.plans import delivery

    keys = {vocabulary.plain_key(m): m for m in vocabulary.MARKETS}
    aliases = {vocabulary.plain_key(a): m for a, m in vocabulary.ALIASES.items()}

    def fate(name):
        key = vocabulary.plain_key(name)
        near = [m for k, m in keys.items() if k != key and (SequenceMatcher(None, key, k).ratio() >= 0.7 or key in k or k in key)]
        return "refused: empty" if not name.strip() else "known" if key in keys or key in aliases else "refused: looks like another" if near else "added"

    found = {r.o_orderkey: r.fate for r in catalog.queries()["market_guard"](spark, FOLDER).collect()}
    assert found and all(f == fate(delivery.NAMES[min(k % 9, 8)]) for k, f in found.items())


def test_stable_dates_by_definition(spark):
    rows = {r.o_orderkey: r.day for r in catalog.queries()["stable_dates"](spark, FOLDER).collect()}
    orders = {r.o_orderkey: r.o_orderdate for r in spark.read.parquet(f"{FOLDER}/orders.parquet").collect()}
    for k, day in rows.items():
        d = orders[k].date()
        late = d.replace(year=d.year + 10) if (d.month, d.day) != (2, 29) else datetime.date(d.year + 10, 2, 28)
        assert day == (late.isoformat() if k % 4 == 0 else d.isoformat() if k % 4 == 2 and d.year >= 2000 else None)


def test_best_first_visits_the_best_open_link(spark):
    walks = catalog.queries()["best_first"](spark, FOLDER).collect()
    assert len({(r.site, r.url) for r in walks}) == len(walks) and all(r.depth <= 2 and r.step <= 12 for r in walks)
    assert all({r.step for r in walks if r.site == s} == set(range(1, 1 + sum(r.site == s for r in walks))) for s in {r.site for r in walks})
