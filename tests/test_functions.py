"""Column functions on boundary rows: what they flag, and what they leave alone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.functions import dates, records, scoring, text, udfs, url
from attesta.operators import decisions

TODAY = dt.date(2026, 8, 8)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(v):
    return F.lit(v).cast("string") if v is None else F.lit(v)


@pytest.mark.parametrize(("value", "key"), [("HTTPS://www.Example.org/A/#x", "example.org/a"), ("http://a.b//", "a.b"), (None, ""), ("www.x.y/?q=1", "x.y/?q=1")])
def test_normalize_key(spark, value, key):
    assert one(spark, url.normalize_key(lit(value))) == key


@pytest.mark.parametrize(("value", "domain"), [("https://a.b.example.co.uk/x", "example.co.uk"), ("http://www.example.org", "example.org"), ("https://localhost:80/", "localhost"), ("nonsense", "")])
def test_registrable_domain(spark, value, domain):
    assert one(spark, url.registrable_domain(lit(value))) == domain


@pytest.mark.parametrize(("value", "clean"), [("https://EX.org/Path/?utm_source=a&b=2&gclid=3#f", "https://ex.org/Path?b=2"), ("https://ex.org/?hsLang=en", "https://ex.org"), ("text", "text")])
def test_normalize_url(spark, value, clean):
    assert one(spark, url.normalize_url(lit(value))) == clean


@pytest.mark.parametrize(("value", "good"), [("https://x.y/a.PDF", False), ("https://x.y/_hcms/a", False), ("https://x.y/a.pdf?x", False), ("https://x.y/pdf", True)])
def test_is_crawlable(spark, value, good):
    assert one(spark, url.is_crawlable(lit(value))) is good


@pytest.mark.parametrize(("value", "home"), [("https://x.y", True), ("https://x.y/en/", True), ("https://x.y/cfp", False), ("https://x.y/?p=1", False), ("x.y", False), (None, False)])
def test_is_homepage(spark, value, home):
    assert one(spark, url.is_homepage(lit(value))) is home


def test_links_and_platforms(spark):
    assert one(spark, url.absolute(F.lit("/a"), F.lit("https://x.y/b/c"))) == "https://x.y/a"
    assert one(spark, url.link_kind(F.lit("mailto:a@b"), F.lit("https://x.y"))) is None
    assert one(spark, url.link_kind(F.lit("https://www.x.y/z"), F.lit("https://x.y"))) == "internal"
    assert one(spark, url.detect_platform(F.lit("https://docs.google.com/forms/d/1"))) == "Google Forms"
    assert one(spark, url.urls_in(F.lit("see https://a.b/c, and (http://d.e)."))) == ["https://a.b/c", "http://d.e"]
    assert one(spark, scoring.score_link(F.lit("/x"), F.lit(None).cast("string"))) == 0
    track = lambda *types: one(spark, scoring.track_label(F.array(*[F.lit(t) for t in types])))
    assert track("nomination", " Panel", "showcase") == "Speaking; Awards" and track("cfp") == "Speaking" and track("showcase") == "Other" and track("", " ") == ""


@pytest.mark.parametrize(("value", "loose", "deadline"), [("5/8/2026", dt.date(2026, 5, 8), dt.date(2026, 8, 5)), ("2026-02-30", None, None), ("13/1/2026", None, dt.date(2026, 1, 13)), ("15th May 2026", None, dt.date(2026, 5, 15)), ("Sept. 4, 2026", None, dt.date(2026, 9, 4)), ("May 8th", None, None), (None, None, None), ("2026-05-01T10:00", dt.date(2026, 5, 1), dt.date(2026, 5, 1))])
def test_parsers_differ(spark, value, loose, deadline):
    assert one(spark, dates.parse_loose(lit(value))) == loose
    assert one(spark, dates.parse_deadline(lit(value))) == deadline


@pytest.mark.parametrize(("page", "there"), [("Closes: Friday, Sept. 4, 2026", True), ("4th September 2026", True), ("09/04/2026", True), ("2026-09-04", True), ("September 5, 2026", False), ("", False)])
def test_find_date(spark, page, there):
    assert one(spark, dates.find_date(F.lit(page), F.lit(dt.date(2026, 9, 4)))) is there


def test_rival_dates(spark):
    page = F.lit("Abstract deadline: March 3, 2027. Late: closes 4 April 2026 deadline 2011-01-01 and deadline 2026-09-04")
    assert one(spark, dates.rival_dates(page, F.lit(dt.date(2026, 9, 4)), TODAY)) == ["march 3 2027"]


@pytest.mark.parametrize(("a", "b", "less"), [("1.9", "1.10", True), ("1.10", "1.10.0", False), ("", "0.1", True), ("2", "1.9.9", False)])
def test_version_lt(spark, a, b, less):
    assert one(spark, dates.version_lt(F.lit(a), F.lit(b))) is less


@pytest.mark.parametrize(("value", "past"), [("March 3-5, 2026", True), ("December 2026", False), ("2027", False), ("market day", None), ("Sep 2025 and Oct 2026", False)])
def test_event_past(spark, value, past):
    assert one(spark, dates.event_past(F.lit(value), TODAY)) is past


@pytest.mark.parametrize(("page", "status"), [("Submissions are now closed.", "closed"), ("Once the deadline has passed, lists are final.", None), ("Registration deadline has passed. Submissions are open", "open"), ("Submit your abstract. The deadline has expired.", "closed"), (None, None)])
def test_page_status(spark, page, status):
    assert one(spark, decisions.page_status(lit(page))) == status


@pytest.mark.parametrize(("location", "city", "state", "country", "found"), [("Messe Ulm, Ulm, Germany", "Messe Ulm", "Ulm", "Germany", "Ulm"), ("Hall 1, Seattle, USA", "Seattle", "", "", "Seattle"), ("TBD", "", "", "", ""), ("Harbour Expo, Monaco", "", "Monaco", "Monaco", "Monaco"), ("Expo Center", "", "", "", ""), ("Paris / France", "", "", "France", "Paris")])
def test_clean_city(spark, location, city, state, country, found):
    assert one(spark, records.clean_city(F.lit(location), F.lit(city), F.lit(state), F.lit(country))) == found


def test_names(spark):
    assert one(spark, text.same_event(F.lit("Harbour Logistics Days Europe"), F.lit("Harbour Logistics Days USA"))) is False
    assert one(spark, text.same_event(F.lit("Dairy Science Fair"), F.lit("Dairy Science Fair Worldwide 2027"))) is True
    assert one(spark, text.related(F.lit(""), F.lit("x"))) is True and one(spark, text.agrees(F.lit(""), F.lit("x"))) is False
    assert one(spark, records.event_id(F.lit("Olive (Oil) Days 2027"), F.lit("2027"), F.lit("San Remo"), opportunity=F.lit("Awards"))) == "2027-olive-days-san-remo-awards"
    assert one(spark, text.slug(F.lit("a" * 60))) == "a" * 48 and one(spark, text.slug(F.lit("word " * 20), 12)) == "word-word"
    assert one(spark, text.market_key(F.lit("Wine & Cheese"))) == "winecheese"
    assert one(spark, text.has_member(F.lit("feed,chat"), F.lit("cha"))) is False
    assert one(spark, text.salvage_json(F.lit('```json\n{"a": 1}\n``` done'))) == '{"a": 1}'


def test_udfs(spark):
    assert one(spark, udfs.ascii_fold(F.lit("Café — “x”\n…"))) == 'Cafe - "x" ...'
    assert one(spark, udfs.similarity(F.lit("Bio Tech"), F.lit("bio-tech"))) == 1.0
    assert one(spark, udfs.locate_verbatim(F.lit("The  Deadline: May 5."), F.lit("deadline may 5"))) == "Deadline: May 5."
    assert one(spark, udfs.locate_verbatim(F.lit("x"), F.lit("y"))) is None
    assert [tuple(r) for r in one(spark, udfs.align_equal_blocks(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))))] == [(1, 0, 1)]


def test_readable_and_quality(spark):
    assert one(spark, text.readable(lit(None)))["reason"] == "page could not be read"
    assert one(spark, text.readable(F.lit("Page not found. " + "word " * 60)))["reason"].startswith("soft 404")
    assert one(spark, text.readable(F.lit("several readable words " * 30)))["ok"] is True
    q = lambda **k: one(spark, decisions.quality(lit(k.get("error")), F.lit(k.get("fetched", True)), F.lit(k.get("status", 200)), F.lit(k.get("body", "")), F.lit(k.get("chars", 900))))["verdict"]
    assert [q(error="x"), q(fetched=False), q(status=503), q(status=404), q(body="CAPTCHA"), q(chars=10), q()] == ["ERROR", "BLOCKED", "BLOCKED", "PARTIAL", "BLOCKED", "PARTIAL", "PASS"]


@pytest.mark.parametrize(("value", "date"), [("Closes on Friday 4 September 2026, noon", dt.date(2026, 9, 4)), ("September 2026", None), ("4 September", None), ("2026", None), (None, None)])
def test_stable_fuzzy_date(spark, value, date):
    assert one(spark, udfs.stable_fuzzy_date(lit(value))) == date


def test_citations(spark):
    from attesta.functions import citations

    page = "<form action='/subscribe'>Your mail</form><form action=\"/cfp\"><b>Submit</b> a talk</form><button data-href='/enter' onclick=\"location.href='/x'\">go</button>"
    assert [tuple(r) for r in one(spark, citations.forms_in(F.lit(page)))] == [("/subscribe", "Your mail"), ("/cfp", "Submit a talk")]
    assert one(spark, citations.clickable_targets(F.lit(page))) == ["/enter", "/x"]
    assert one(spark, citations.quote_around(F.lit("a  b NEEDLE c"), F.lit("needle"), 4)) == "a b NEEDLE c"
    assert one(spark, citations.duration(F.lit(75))) == "1m 15s" and one(spark, citations.safe_filename(F.lit("AI / Bio!"))) == "AI_Bio"
    assert one(spark, citations.is_deliberate_clear(F.lit(" [retired] old"))) is True
