"""Queries on record linkage and site exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import scoring, text, udfs, url
from attesta.operators import alignment, frontier, linkage, names, weights
from attesta.plans.pages import PAGES_SQL
from attesta.plans.registry import query
from attesta.session import cut, table


#: Rows of the vote's oracle: our records and, as a customer's sheet, every third of them, respelled.
STOP_SQL = "'the','and','of','for','on','in','a','an','conference','summit','expo','exhibition','congress','forum','show','annual','international','week','event'"
TOKENS_SQL = rf"list_sort(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\b(19|20)[0-9]{{2}}\b', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' +'), lambda w: length(w) > 1 AND w NOT IN ({STOP_SQL}))))"


def _sheets(spark, sf):
    """Our records and a customer's sheet as given: two URL columns of ours, editions of a series, and other spellings.

    Even pages have a site of their own, odd ones that of the page; one page of four is the earlier edition of
    the page before it; every thirtieth row of the sheet has the second URL of ours.
    """
    p, i = table(spark, sf, "pages"), F.col("page_id")
    n = lambda c: c.cast("string")
    event = F.when(i % 4 == 1, F.concat(F.lit("2025-s"), n(i - 1))).otherwise(F.concat(F.lit("2026-s"), n(i)))
    site = F.when(i % 2 == 0, F.concat(F.lit("https://site"), n(i), F.lit(".example/p"))).otherwise(F.col("url"))
    info = F.when(i % 30 == 9, F.concat(F.lit("https://info"), n(i), F.lit(".example/x/")))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    ours = p.select(i.alias("pos"), event.alias("id"), title.alias("name"), site.alias("url"), info.alias("info_url"), F.concat(F.lit("City"), n(i % 40)).alias("city"), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (i % 300).cast("int")), "yyyy-MM-dd").alias("start"))
    k = F.col("pos")
    link = F.when(k % 30 == 9, F.rtrim("info_url", F.lit("/"))).when(k % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://"), url.host("url"), F.lit("/other")))
    theirs = ours.where(k % 3 == 0).select(k.alias("id"), "pos", F.concat("name", F.lit(" (2026)")).alias("name"), link.alias("url"), F.concat(F.col("city"), F.lit(", Land")).alias("city"), "start")
    return theirs, ours


def _sides(spark, sf):
    theirs, ours = _sheets(spark, sf)
    return linkage.prepared(theirs, "id", "name", "url", "city", "start", "pos"), linkage.prepared(ours, "id", "name", ["url", "info_url"], "city", "start", "pos")


SIDES_SQL = f"""{PAGES_SQL},
base AS (
  SELECT page_id, rtrim(lower(trim(url)), '/') AS link, host, domain, 'city' || (page_id % 40) AS city, DATE '2026-01-01' + (page_id % 300)::INT AS start,
    {TOKENS_SQL} AS tokens
  FROM d),
o AS (
  SELECT page_id, CASE WHEN page_id % 4 = 1 THEN '2025-s' || (page_id - 1) ELSE '2026-s' || page_id END AS id,
    's' || CASE WHEN page_id % 4 = 1 THEN page_id - 1 ELSE page_id END AS series, city, start, tokens,
    CASE WHEN page_id % 2 = 0 THEN 'site' || page_id || '.example' ELSE domain END AS domain,
    list_filter([CASE WHEN page_id % 2 = 0 THEN 'https://site' || page_id || '.example/p' ELSE link END, CASE WHEN page_id % 30 = 9 THEN 'https://info' || page_id || '.example/x' END], lambda x: x IS NOT NULL) AS links,
    list_filter([CASE WHEN page_id % 2 = 0 THEN 'site' || page_id || '.example' ELSE domain END, CASE WHEN page_id % 30 = 9 THEN 'info' || page_id || '.example' END], lambda x: x IS NOT NULL) AS domains
  FROM base),
t AS (
  SELECT page_id, city, start, tokens,
    CASE WHEN page_id % 30 = 9 THEN 'info' || page_id || '.example' WHEN page_id % 2 = 0 THEN 'site' || page_id || '.example' ELSE domain END AS domain,
    CASE WHEN page_id % 30 = 9 THEN 'https://info' || page_id || '.example/x' WHEN page_id % 2 = 0 THEN 'https://site' || page_id || '.example/p' ELSE 'https://' || host || '/other' END AS link
  FROM base WHERE page_id % 3 = 0),
single AS (SELECT domain FROM (SELECT unnest(domains) AS domain, series FROM o) GROUP BY 1 HAVING count(DISTINCT series) = 1)"""
OVERLAP_SQL = "(len(t.tokens) > 0 AND len(o.tokens) > 0 AND len(list_intersect(t.tokens, o.tokens)) / len(list_distinct(list_concat(t.tokens, o.tokens))) >= {})"
FIT_SQL, NEAR_SQL = "(contains(t.city, o.city) OR contains(o.city, t.city))", "abs(date_diff('day', t.start, o.start)) <= 21"
#: Even rows hold sites that stand once on each side and rise together; between two of them the first page of the row's domain is met.
PLACE_SQL = "(CASE WHEN t.page_id % 2 = 0 THEN o.page_id = t.page_id ELSE o.page_id = (SELECT min(x.page_id) FROM o x WHERE x.domain = t.domain AND x.page_id // 6 = t.page_id // 6 AND x.page_id % 2 = 1) END)"
TESTS_SQL = {
    "exact_url": "list_contains(o.links, t.link)",
    "domain": "list_contains(o.domains, t.domain) AND t.domain IN (FROM single)",
    "name_city_date": f"{OVERLAP_SQL.format(0.7)} AND {FIT_SQL} AND {NEAR_SQL}",
    "domain_position": PLACE_SQL,
    "domain_name": f"list_contains(o.domains, t.domain) AND {OVERLAP_SQL.format(0.5)}",
    "domain_date": f"list_contains(o.domains, t.domain) AND {NEAR_SQL}",
    "domain_city": f"list_contains(o.domains, t.domain) AND {FIT_SQL}",
    "exact_name": "len(t.tokens) > 0 AND t.tokens = o.tokens",
    "name_city": f"{OVERLAP_SQL.format(0.7)} AND {FIT_SQL}",
}


def _found_sql(*tests: str) -> str:
    return " UNION ALL ".join(f"SELECT t.page_id AS row, '{k}' AS test, o.id AS candidate, o.series, abs(date_diff('day', t.start, o.start)) AS days FROM t JOIN o ON {TESTS_SQL[k]}" for k in tests)


@query(f"{SIDES_SQL} SELECT row, test, candidate FROM ({_found_sql('exact_url', 'domain_date')})")
def linkage_blocks(spark, sf):
    """Candidates by any of two URLs, and by domain within 21 days."""
    return linkage.candidates(*_sides(spark, sf), tests=("exact_url", "domain_date")).select("row", "test", "candidate")


@query(f"{SIDES_SQL} SELECT row, test, candidate FROM ({_found_sql('domain_city', 'domain_position')})")
def linkage_places(spark, sf):
    """Candidates by domain and a place that holds the other, and by domain and matching place in the sheet."""
    return linkage.candidates(*_sides(spark, sf), tests=("domain_city", "domain_position")).select("row", "test", "candidate")


@query(f"{SIDES_SQL} SELECT row, test, candidate FROM ({_found_sql('name_city', 'name_city_date', 'domain_name')})")
def linkage_names(spark, sf):
    """Candidates by names whose words overlap, with a place, a place and time, or a domain."""
    return linkage.candidates(*_sides(spark, sf), tests=("name_city", "name_city_date", "domain_name"), letters=False).select("row", "test", "candidate")


PICKED_SQL = f"""{SIDES_SQL}, f AS ({_found_sql(*TESTS_SQL)}),
k AS (
  SELECT row, CASE WHEN test = 'domain' THEN 'unique_domain' ELSE test END AS test, min(series) AS series, count(DISTINCT candidate) AS editions,
    coalesce(arg_min(candidate, (days, candidate)) FILTER (days IS NOT NULL), max(candidate)) AS candidate
  FROM f GROUP BY row, test HAVING count(DISTINCT series) = 1),
anchors AS (SELECT row, series AS anchor FROM k WHERE test = 'domain_position'),
w AS (SELECT test, count(*) AS fired, count(*) FILTER (series = anchor) AS agreed, pow(count(*) FILTER (series = anchor) / count(*), 2) AS weight FROM k JOIN anchors USING (row) GROUP BY test)"""
ORDER_SQL = "['exact_url', 'unique_domain', 'name_city_date', 'domain_position', 'domain_name', 'domain_date', 'domain_city', 'exact_name', 'name_city']"
VOTE_SQL = f"""{PICKED_SQL},
s AS (SELECT k.*, coalesce(weight, 0) AS weight, list_position({ORDER_SQL}, test) AS place FROM k LEFT JOIN w USING (test)),
g AS (SELECT row, candidate, round(sum(weight), 9) AS score, min(place) AS first, list_sort(list(test)) AS tests FROM s GROUP BY row, candidate),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, first) AS n, sum(score) OVER (PARTITION BY row) AS fired FROM g),
e AS (SELECT row, arg_min(editions, place) AS editions FROM s WHERE editions > 1 GROUP BY row),
dissent AS (SELECT row, string_agg(candidate || ':' || array_to_string(tests, ','), ';' ORDER BY n) AS dissent FROM r WHERE n > 1 GROUP BY row),
silent AS (SELECT page_id AS row, array_to_string(list_sort(list_filter({ORDER_SQL}, lambda x: NOT list_contains(coalesce(said, []), x))), ',') AS silent FROM t LEFT JOIN (SELECT row, list(test) AS said FROM k GROUP BY row) x ON t.page_id = x.row)
SELECT t.page_id AS row, r.candidate, array_to_string(coalesce(r.tests, []), ',') AS tests, coalesce(dissent, '') AS dissent, silent,
  CASE WHEN r.candidate IS NULL THEN 0 ELSE coalesce(editions, 1) END::INT AS editions,
  CASE WHEN list_contains(r.tests, 'exact_url') THEN 'exact_url' WHEN list_contains(r.tests, 'unique_domain') THEN 'unique_domain' WHEN list_contains(r.tests, 'name_city_date') THEN 'name_city_date' END AS proved,
  CASE WHEN r.candidate IS NULL THEN 0 WHEN list_has_any(r.tests, ['exact_url', 'unique_domain', 'name_city_date']) THEN 100
    ELSE greatest(3, least(99, floor(100 * CASE WHEN fired > 0 THEN score / fired ELSE 0 END * (0.6 + 0.4 * least(1.0, len(r.tests) / 4.0)) + 1e-9))) END::INT AS confidence
FROM t LEFT JOIN r ON r.row = t.page_id AND n = 1 LEFT JOIN e ON e.row = t.page_id LEFT JOIN dissent ON dissent.row = t.page_id JOIN silent ON silent.row = t.page_id"""


def _voted(spark, sf, letters):
    theirs, ours = _sides(spark, sf)
    picked = cut(linkage.decided(theirs, ours, letters=letters))
    return linkage.vote(picked, linkage.calibrated(picked), theirs), theirs


@query(VOTE_SQL)
def linkage_vote(spark, sf):
    """All nine tests, weights calibrated by series on rows at matching places, and the vote, abstained rows too."""
    voted, _ = _voted(spark, sf, letters=False)
    told = F.array_join(F.transform("dissent", lambda d: F.concat(d.candidate, F.lit(":"), F.array_join(d.tests, ","))), ";")
    return voted.select("row", "candidate", "confidence", F.array_join("tests", ",").alias("tests"), "proved", told.alias("dissent"), F.array_join("silent", ",").alias("silent"), "editions")


@query(f"{PICKED_SQL} SELECT test, fired, agreed, round(weight, 9) AS weight FROM w")
def linkage_weights(spark, sf):
    """How often each test fired and agreed on rows at matching places, by series."""
    picked = cut(linkage.decided(*_sides(spark, sf), letters=False))
    return linkage.calibrated(picked).withColumn("weight", F.round("weight", 9))


TWICE_SQL = _found_sql("exact_url", "exact_name").replace(" FROM t JOIN", " FROM twice t JOIN")


@query(f"""{SIDES_SQL}, twice AS (FROM t UNION ALL SELECT page_id + 1000000, * EXCLUDE (page_id) FROM t WHERE page_id % 9 = 0),
k AS (SELECT row, min(candidate) AS candidate FROM ({TWICE_SQL}) GROUP BY row, test HAVING count(DISTINCT candidate) = 1)
SELECT candidate, count(*) AS rows FROM (SELECT DISTINCT row, candidate FROM k) GROUP BY candidate HAVING count(*) > 1""")
def one_to_one_matches(spark, sf):
    """M7: records that URL or name match to several rows of a sheet in which some rows stand twice."""
    theirs, ours = _sides(spark, sf)
    again = theirs.where("id % 9 = 0").withColumn("id", F.col("id") + 1_000_000).withColumn("pos", F.lit(None).cast("long"))
    one = linkage.sole(cut(theirs.unionByName(again)), cut(ours), tests=("exact_url", "exact_name"), of="id")
    return linkage.one_to_one_breaches(one.select("row", F.col("only").alias("candidate")).distinct())


@query(r"""WITH s AS (SELECT page_id, list_sort(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\b(19|20)[0-9]{2}\b', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' +'), lambda w: length(w) > 1 AND w NOT IN ('the','and','of','for','on','in','a','an','conference','summit','expo','exhibition','congress','forum','show','annual','international','week','event')))) AS tokens FROM pages)
SELECT t.page_id AS row, CASE WHEN o.page_id % 4 = 1 THEN '2025-s' || (o.page_id - 1) ELSE '2026-s' || o.page_id END AS candidate FROM s t JOIN s o ON t.tokens = o.tokens WHERE t.page_id % 3 = 0 AND len(t.tokens) > 0""")
def linkage_exact_names(spark, sf):
    """M1: candidates whose name has the same words."""
    return linkage.candidates(*_sides(spark, sf), tests=("exact_name",)).select("row", "candidate")


@query()
def linkage_votes(spark, sf):
    """M1-M4: the sheet with the match of each row, its confidence and why, letters of names compared too; no SQL counterpart."""
    voted, theirs = _voted(spark, sf, letters=True)
    return linkage.matched_sheet(_sheets(spark, sf)[0], "id", voted, theirs)


@query("SELECT o_custkey AS candidate, count(*) AS rows FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1 HAVING count(*) > 1")
def one_to_one_breaches(spark, sf):
    """M7: records that several rows were matched to."""
    matches = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1"))
    return linkage.one_to_one_breaches(matches.select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("candidate")))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey * 10 WHEN 1 THEN c_custkey * 10 + 1 END AS claim_id FROM customer""")
def chosen_claims(spark, sf):
    """The claim that belongs to a record; ambiguity is declined."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    records = c.select("c_custkey", F.lit("Photonics Global Summit 2026").alias("name"), F.lit("2026").alias("edition"))
    claim = lambda n, name, edition, keep: c.where(keep).select("c_custkey", (k * 10 + n).alias("claim_id"), F.lit(name).alias("claim_name"), F.lit(edition).alias("claim_edition"))
    claims = (
        claim(0, "PHOTONICS global summit (2026)", "2026", k % 4 == 0)
        .unionByName(claim(1, "Photonics Summit", "", k % 4 == 1))
        .unionByName(claim(2, "Photonics Global Summit 2025", "2025", k % 4 < 2))
        .unionByName(claim(3, "Photonics Summit", "2026", k % 4 == 2))
        .unionByName(claim(4, "Global Photonics", "2026", k % 4 == 2))
        .unionByName(claim(5, "Dairy Fair", "2026", k % 4 == 3))
    )
    return linkage.choose_claim(records, claims, "c_custkey")


@query()
def name_similarities(spark, sf):
    """Similarity of each nation's name with the next ones; no SQL counterpart."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("Market "), "n_name").alias("name"))
    other = n.select("n_regionkey", F.col("n_nationkey").alias("other_key"), F.col("name").alias("other"))
    pairs = n.join(other, "n_regionkey").where("n_nationkey < other_key")
    return pairs.select("n_nationkey", "other_key", udfs.similarity("name", "other").alias("ratio"), linkage.name_similarity(text.matching_tokens("name"), text.matching_tokens("other")).alias("name_similarity"))


@query()
def best_first(spark, sf):
    """Best-first walks over the links of each domain's pages; iterative, so no SQL counterpart."""
    p = table(spark, sf, "pages").select(url.registrable_domain("url").alias("site"), url.normalize_url("url").alias("url"), "page_id", F.posexplode_outer(url.links_in("html")).alias("pos", "link")).where("site <> ''")
    seeds = p.groupBy("site").agg(F.min_by("url", "page_id").alias("url"))
    to = url.absolute("link", "url")
    links = p.where("link is not null").select("site", F.col("url").alias("src"), url.normalize_url(to).alias("dst"), scoring.score_link(to, F.lit("")).alias("score"), "pos")
    inside = links.where(url.registrable_domain("dst") == F.col("site")).groupBy("site", "src", "dst").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    return frontier.explore(seeds, inside, max_pages=12, max_depth=2)


@query()
def folded_text(spark, sf):
    """Document texts in plain ASCII, by length; NFKD has no SQL counterpart."""
    return table(spark, sf, "documents").select("doc_id", F.length(udfs.ascii_fold("text")).alias("n"))


@query()
def located_quotes(spark, sf):
    """A page's own words for a quote with other case and space, null where there is none."""
    return table(spark, sf, "documents").select("doc_id", udfs.locate_verbatim("text", F.upper(F.substring("text", 21, 60))).alias("quote"))


@query(f"""{PAGES_SQL}, a AS (SELECT page_id // 2 AS pos, host AS item FROM d WHERE page_id % 2 = 0), b AS (SELECT page_id // 2 AS pos, host AS item FROM d WHERE page_id % 2 = 1),
n AS (SELECT a.pos AS a, b.pos AS b FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY pos) AS n FROM a) a JOIN (SELECT *, row_number() OVER (PARTITION BY item ORDER BY pos) AS n FROM b) b USING (item, n)),
i AS (SELECT *, a - row_number() OVER (PARTITION BY b - a ORDER BY a) AS island FROM n) SELECT min(a) AS a, min(b) AS b, count(*) AS n FROM i GROUP BY b - a, island""")
def aligned_hosts(spark, sf):
    """Blocks of the hosts of even and odd pages, the n-th of a host beside the n-th."""
    p = table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 2).alias("pos"), url.host("url").alias("item"))
    sides = [p.where(F.col("page_id") % 2 == k).select("pos", "item") for k in (0, 1)]
    return alignment.equal_blocks(alignment.paired_occurrences(*sides))


EDITS_SQL = """WITH a AS (SELECT c_custkey AS item, row_number() OVER (ORDER BY c_custkey) AS a FROM customer),
e AS (SELECT c_custkey AS item, unnest(CASE WHEN c_custkey % 11 = 3 THEN [1, 2] ELSE [1] END) AS copy, CASE WHEN c_custkey % 97 = 5 THEN 1 ELSE 0 END AS moved FROM customer WHERE c_custkey % 7 <> 2),
b AS (SELECT item, copy, moved, row_number() OVER (ORDER BY moved, item, copy) AS b FROM e)
SELECT {} FROM a JOIN b USING (item) WHERE copy = 1 AND moved = 0"""


def _edited(spark, sf):
    """Customers by key, and the same with one of seven left out, one of eleven doubled and some moved to the end."""
    c, k = table(spark, sf, "customer").select("c_custkey"), F.col("c_custkey")
    a = c.select((F.col("c_custkey") * 10).alias("pos"), k.alias("item"))
    copies = F.when(k % 11 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    b = c.where(k % 7 != 2).select(k.alias("item"), F.explode(copies).alias("copy")).withColumn("pos", F.when(F.col("item") % 97 == 5, 10**9).otherwise(0) + F.col("item") * 10 + F.col("copy"))
    place = lambda d: alignment.numbered(d.withColumn("g", F.lit(0)), ["g"], "pos", "place").select(F.col("place").alias("pos"), "item")
    return place(a), place(b.select("pos", "item"))


@query(EDITS_SQL.format("item, a, b"))
def aligned_edits(spark, sf):
    """Places of equal rows of two versions of a sheet with rows dropped, doubled and moved."""
    return alignment.aligned(*_edited(spark, sf))


NAMES_SQL = f"WITH s AS (SELECT page_id, {TOKENS_SQL} AS tokens, 'k' || (page_id % 4) AS key FROM pages)"


def _named(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.concat(F.lit("k"), (F.col("page_id") % 4).cast("string")).alias("key"), text.matching_tokens(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("tokens"))


@query(f"""{NAMES_SQL}, n AS (SELECT DISTINCT key, tokens FROM s WHERE len(tokens) > 0),
p AS (SELECT x.key, array_to_string(x.tokens, ' ') AS a_n, array_to_string(y.tokens, ' ') AS b_n, len(list_intersect(x.tokens, y.tokens)) / len(list_distinct(list_concat(x.tokens, y.tokens))) AS alike FROM n x JOIN n y USING (key))
SELECT key, a_n, b_n, round(alike, 9) AS alike FROM p WHERE alike >= 0.2""")
def overlapping_names(spark, sf):
    """Distinct page titles of a key whose words overlap by a fifth, all of them."""
    n = _named(spark, sf)
    return names.similar_names(n, n, 0.2, letters=False).withColumn("alike", F.round("alike", 9))


@query(f"""{NAMES_SQL}, n AS (SELECT page_id, tokens FROM s WHERE len(tokens) > 0), f AS (SELECT word, 2 * count(*) AS df FROM (SELECT unnest(tokens) AS word FROM n) GROUP BY 1),
v AS (SELECT page_id, word, ln(1 + (SELECT 2 * count(*) FROM n) / df) AS w FROM (SELECT page_id, unnest(tokens) AS word FROM n) JOIN f USING (word)),
u AS (SELECT page_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY page_id)) AS u FROM v)
SELECT x.page_id AS a_id, y.page_id AS b_id, round(sum(x.u * y.u), 6) AS cosine FROM u x JOIN u y USING (word) GROUP BY 1, 2 HAVING sum(x.u * y.u) >= 0.15""")
def rare_word_titles(spark, sf):
    """M9: pairs of page titles that share rare words, by the cosine of their words' weights."""
    n = _named(spark, sf).select(F.col("page_id").alias("id"), "tokens")
    return names.rare_word_pairs(n, n, 0.15).withColumn("cosine", F.round("cosine", 6))


@query(f"""{SIDES_SQL}, f AS ({_found_sql(*TESTS_SQL)}), pat AS (SELECT row, candidate, bit_or(CASE test WHEN 'exact_url' THEN 1 WHEN 'domain' THEN 2 WHEN 'name_city_date' THEN 4 WHEN 'domain_position' THEN 8 WHEN 'domain_name' THEN 16 WHEN 'domain_date' THEN 32 WHEN 'domain_city' THEN 64 WHEN 'exact_name' THEN 128 WHEN 'name_city' THEN 256 END) AS pattern FROM f GROUP BY 1, 2)
SELECT pattern::INTEGER AS pattern, count(*) AS n FROM pat GROUP BY 1""")
def match_patterns(spark, sf):
    """M9: pairs of records by the tests that agree on them."""
    return weights.patterns(weights.agreement(linkage.candidates(*_sides(spark, sf), letters=False), linkage.TESTS))


@query()
def match_scores(spark, sf):
    """M9: pairs with the weight of their agreement, m and u estimated from all pairs; iterative, so no SQL counterpart."""
    pairs = cut(weights.agreement(linkage.candidates(*_sides(spark, sf), letters=False), linkage.TESTS))
    learned = weights.fitted(pairs, linkage.TESTS)
    return pairs.select("row", "candidate", "pattern", F.round(learned.score(), 6).alias("score"), F.round(learned.probability(), 6).alias("probability"))
