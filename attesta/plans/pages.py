"""Queries on pages and documents: URLs, links, readable text, quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import scoring, text, url
from attesta.operators import aggregates, decisions, quotes, windows
from attesta.plans.registry import query
from attesta.session import table

KEY_SQL = r"rtrim(split_part(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '#', 1), '/')"
HOST_SQL = r"regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://([^/?#:]*)', 1)"
DOMAIN_SQL = """CASE WHEN len(parts) <= 2 THEN host
  WHEN parts[-2] IN ('co','com','org','net','gov','ac','edu') THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END"""
PAGES_SQL = f"WITH p AS (SELECT *, {HOST_SQL} AS host, string_split({HOST_SQL}, '.') AS parts, {KEY_SQL} AS key FROM pages), d AS (SELECT *, {DOMAIN_SQL} AS domain FROM p)"
VISIBLE_SQL = r"trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))"


@query(f"{PAGES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS n FROM d) SELECT domain, count(*) AS pages FROM f WHERE n = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def url_domain_topk(spark, sf):
    """Pages of the largest domains, each URL once."""
    pages = table(spark, sf, "pages").select("page_id", "url", url.normalize_key("url").alias("key"))
    once = windows.first_wins(pages, ["key"], ["page_id"])
    return once.groupBy(url.registrable_domain("url").alias("domain")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "domain").limit(20)


@query(f"{PAGES_SQL} SELECT key, arg_min(url, page_id) AS url, min(page_id) AS page_id, count(*) - 1 AS dropped FROM d GROUP BY key")
def url_key_dedupe(spark, sf):
    """The first page of each normalized URL, and how many it stands for."""
    pages = table(spark, sf, "pages").select("page_id", "url", url.normalize_key("url").alias("key"))
    return windows.first_wins_with_backfill(pages, ["key"], "page_id", []).select("key", "url", "page_id", "dropped")


@query(rf"""{PAGES_SQL}, q AS (SELECT *, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM d),
k AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_|hsa_|hs_)')), '&') AS kept FROM q)
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || host || CASE WHEN path = '' AND kept <> '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS normalized, host, domain,
 path NOT LIKE '%.pdf' AS crawlable, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INT AS depth, query = '' AND path = '' AS homepage FROM k""")
def url_parts(spark, sf):
    """Normalized URL, host, domain and what kind of page it names."""
    return table(spark, sf, "pages").select(
        "page_id", url.normalize_url("url").alias("normalized"), url.host("url").alias("host"), url.registrable_domain("url").alias("domain"),
        url.is_crawlable("url").alias("crawlable"), url.url_depth("url").alias("depth"), url.is_homepage("url").alias("homepage"),
    )


@query(rf"""{PAGES_SQL}, l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM d)
SELECT page_id, count(*) AS links, count(DISTINCT link) AS distinct_links, count(*) FILTER (link LIKE '/%') AS internal, 0::BIGINT AS external FROM l GROUP BY 1""")
def page_links(spark, sf):
    """Links of each page, inside and outside its host."""
    links = table(spark, sf, "pages").select("page_id", "url", F.explode(url.links_in("html")).alias("link"))
    kind = links.select("page_id", "link", url.link_kind("link", "url").alias("kind"))
    return kind.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("link").alias("distinct_links"), F.count_if(F.col("kind") == "internal").alias("internal"), F.count_if(F.col("kind") == "external").alias("external"))


@query(rf"SELECT page_id, length({VISIBLE_SQL}) AS visible_chars, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), 'data:[^)\s]+', ' ', 'g'), 'https?://\S+', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[A-Za-z]{{4,}}')) AS words FROM pages")
def page_text(spark, sf):
    """Length of the visible text and the words a human would read."""
    return table(spark, sf, "pages").select("page_id", F.length(text.visible_text("html")).cast("long").alias("visible_chars"), text.real_words("html").cast("long").alias("words"))


@query("""SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'ERROR' WHEN page_id % 7 = 0 THEN 'BLOCKED' WHEN page_id % 13 IN (1, 2) THEN 'BLOCKED' WHEN page_id % 13 = 3 THEN 'PARTIAL' WHEN length(html) < 2000 THEN 'PARTIAL' ELSE 'PASS' END AS verdict FROM pages""")
def page_quality(spark, sf):
    """Verdict of each page from its crawl signals."""
    p, i = table(spark, sf, "pages"), F.col("page_id")
    status = F.when(i % 13 == 1, 503).when(i % 13 == 2, 429).when(i % 13 == 3, 404).otherwise(200)
    error = F.when(i % 11 == 0, "timeout")
    chars = F.when(F.length("html") < 2000, 100).otherwise(F.length("html"))
    return p.select("page_id", decisions.quality(error, i % 7 != 0, status, F.lit(""), chars)["verdict"].alias("verdict"))


@query(f"{PAGES_SQL} SELECT domain, count(*) AS pages, count(DISTINCT key) AS urls, array_to_string(list_sort(list(DISTINCT host)), ',') AS hosts, max(page_id) AS newest FROM d GROUP BY 1")
def domain_pages(spark, sf):
    """A4, A10: hosts and distinct URLs of each domain."""
    p = table(spark, sf, "pages").select("page_id", url.registrable_domain("url").alias("domain"), url.normalize_key("url").alias("key"), url.host("url").alias("host"))
    return p.groupBy("domain").agg(F.count("*").alias("pages"), F.count_distinct("key").alias("urls"), text.list_text(F.collect_set("host")).alias("hosts"), F.max("page_id").alias("newest"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(title, '\s*\(.*?\)\s*', ' ', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM t),
c AS (SELECT page_id, CASE WHEN length(s) <= 28 THEN s WHEN contains(s[1:28], '-') THEN regexp_replace(s[1:28], '-[^-]*$', '') ELSE s[1:28] END AS place, CASE WHEN length(s) <= 48 THEN s WHEN contains(s[1:48], '-') THEN regexp_replace(s[1:48], '-[^-]*$', '') ELSE s[1:48] END AS name FROM s)
SELECT page_id, regexp_replace(regexp_replace((CASE WHEN page_id % 5 = 0 THEN 'tbd' ELSE (2024 + page_id % 4)::VARCHAR END) || '-' || name || '-' || CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'virtual' ELSE 'tbd' END WHEN place = '' THEN 'tbd' ELSE place END, '^-+', ''), '-+$', '') || CASE WHEN page_id % 4 = 1 THEN '-awards' ELSE '' END AS event_id FROM c""")
def event_ids(spark, sf):
    """Canonical event ids made from titles."""
    from attesta.functions.records import event_id

    p, i = table(spark, sf, "pages"), F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    edition = F.when(i % 5 == 0, "soon").otherwise((2024 + i % 4).cast("string"))
    city = F.when(i % 3 == 0, "").otherwise(title)
    place = F.when((i % 3 == 0) & (i % 2 == 0), "Online only").otherwise("")
    return p.select("page_id", event_id(title, edition, city, place, F.when(i % 4 == 1, "Awards").when(i % 4 == 2, "Speaking").otherwise("")).alias("event_id"))


def _like(values, where, weight):
    from attesta.functions.text import col  # noqa: F401

    return " + ".join(f"(CASE WHEN contains({where}, '{v}') THEN {weight} ELSE 0 END)" for v in values)


def _score_sql():
    href = " + ".join(f"(CASE WHEN contains(h, '{v.replace(' ', '-')}') OR contains(h, '{v.replace(' ', '')}') THEN 50 ELSE 0 END)" for v in scoring.CALL_PHRASES)
    platform = " OR ".join(f"contains(h, '{v}')" for v in url.PLATFORMS)
    return f"""WITH l AS (SELECT page_id, (CASE WHEN page_id % 3 = 0 THEN 'https://sessionize.com/call-for-speakers/' WHEN page_id % 3 = 1 THEN 'https://e.example.org/submit-a-talk?dates=1' ELSE lower(url) END) AS h,
 (CASE WHEN page_id % 2 = 0 THEN 'call for papers: submit an abstract' WHEN page_id % 5 = 0 THEN 'important dates and agenda' ELSE '' END) AS t FROM pages)
SELECT page_id, least({_like(scoring.CALL_PHRASES, 't', 60)} + {_like(scoring.CONTEXT_PHRASES, 't', 25)} + {_like(scoring.URL_HINTS, 'h', 35)} + {href} + (CASE WHEN {platform} THEN 100 ELSE 0 END), 300) / 100.0::DOUBLE AS score,
 CASE WHEN page_id % 3 = 0 THEN 'Sessionize' END AS platform FROM l"""


@query(_score_sql())
def link_scores(spark, sf):
    """Relevance of links, and the platform they lead to."""
    p, i = table(spark, sf, "pages"), F.col("page_id")
    href = F.when(i % 3 == 0, "https://sessionize.com/call-for-speakers/").when(i % 3 == 1, "https://e.example.org/submit-a-talk?dates=1").otherwise(F.col("url"))
    anchor = F.when(i % 2 == 0, "Call for Papers: submit an ABSTRACT").when(i % 5 == 0, "Important Dates and Agenda").otherwise("")
    return p.select("page_id", scoring.score_link(href, anchor).cast("double").alias("score"), url.detect_platform(href).alias("platform"))


NORM_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(text), '–', '-'), '—', '-'), '([0-9])(st|nd|rd|th)\b', '\1', 'g'), '[^a-z0-9/: -]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH d AS (SELECT doc_id, {NORM_SQL} AS t FROM documents), b AS (SELECT item_id, {NORM_SQL}[1:60] AS q FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON b.q <> '' AND contains(d.t, b.q)")
def quote_containment(spark, sf):
    """Documents that hold the first 60 normalized characters of a benchmark item."""
    docs = table(spark, sf, "documents").select("doc_id", text.normalize_evidence("text").alias("t"))
    items = table(spark, sf, "benchmark").select("item_id", F.substring(text.normalize_evidence("text"), 1, 60).alias("q"))
    return quotes.containing(docs, items)


@query(f"WITH d AS (SELECT doc_id, {NORM_SQL} AS t FROM documents), b AS (SELECT item_id || ':' || n AS item_id, array_to_string(string_split({NORM_SQL}, ' ')[4:3 + n], ' ') AS q FROM benchmark, range(1, 6) r(n)) SELECT doc_id, item_id FROM d JOIN b ON b.q <> '' AND contains(d.t, b.q)")
def short_quotes(spark, sf):
    """Documents that hold one to five words from inside a benchmark item."""
    docs = table(spark, sf, "documents").select("doc_id", text.normalize_evidence("text").alias("t"))
    words = F.split(text.normalize_evidence("text"), " ")
    items = table(spark, sf, "benchmark").select("item_id", words.alias("w"), F.explode(F.array(*map(F.lit, range(1, 6)))).alias("n"))
    return quotes.containing(docs, items.select(F.concat("item_id", F.lit(":"), F.col("n").cast("string")).alias("item_id"), F.array_join(F.slice("w", F.lit(4), F.col("n")), " ").alias("q")))


@query(r"""WITH w AS (SELECT source, doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 1 = 0),
s AS (SELECT DISTINCT source, doc_id, array_to_string(w[i:i+5], ' ') AS shingle FROM w, unnest(range(1, len(w) - 4)) AS r(i)),
c AS (SELECT source, shingle, count(*) AS pages FROM s GROUP BY ALL HAVING count(*) >= 3)
SELECT source, count(*) AS shingles, max(pages) AS most FROM c GROUP BY 1""")
def source_chrome(spark, sf):
    """Six-word runs that stand in three documents or more of a source."""
    chrome = aggregates.repeated_shingle_hashes(table(spark, sf, "documents").select("source", "text"), "source", "text")
    return chrome.groupBy("source").agg(F.count("*").alias("shingles"), F.max("pages").alias("most"))


@query(r"""WITH d AS (SELECT lang, length(trim(text)) AS n, len(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM documents)
SELECT lang, CASE WHEN n < 200 THEN 'page returned almost no text' WHEN w < 40 THEN 'page has almost no readable text' ELSE '' END AS reason, count(*) AS docs FROM d GROUP BY ALL""")
def readable_docs(spark, sf):
    """Why documents cannot stand as sources, by language."""
    d = table(spark, sf, "documents").select("lang", text.readable("text")["reason"].alias("reason"))
    return d.groupBy("lang", "reason").agg(F.count("*").alias("docs"))


@query(r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\s"''<>\])},;]+')) AS u FROM documents) SELECT doc_id, count(*) AS urls, count(DISTINCT regexp_replace(u, '[.,;:!?]+$', '')) AS distinct_urls FROM d GROUP BY 1""")
def text_urls(spark, sf):
    """S3: URLs in free text."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(url.urls_in("text")).alias("u"))
    return d.groupBy("doc_id").agg(F.count("*").alias("urls"), F.count_distinct("u").alias("distinct_urls"))
