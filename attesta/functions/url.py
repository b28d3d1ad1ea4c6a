"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import col, contains_any, text

# Query parameters, paths and suffixes that never select content.
TRACKING_EXACT = ("hslang", "hsctatracking", "gclid", "fbclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hsctaid", "hsfp")
TRACKING_PREFIXES = ("utm_", "hsa_", "hs_")
SKIPPED_PARTS = ("/cs/c", "cta_guid", "/_hcms/", "/hs-fs/", "/hubfs/", "/hs/manage")
SKIPPED_SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".zip", ".mp4", ".ics", ".docx", ".xlsx")
# Second-level labels under which names are registered.
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "ac", "edu")
SHARED_PLATFORMS = ("papercept.net", "pretalx.com", "cvent.com", "sessionize.com", "easychair.org", "oxfordabstracts.com", "conftool", "emsecure", "abstractscorecard.com", "hsforms.com", "jotform.com")
# Hosts of submission platforms and their names, in order of search.
PLATFORMS = {
    "sessionize.com": "Sessionize", "papercall.io": "PaperCall", "easychair.org": "EasyChair", "cmt3.research.microsoft.com": "Microsoft CMT", "openreview.net": "OpenReview", "pretalx.com": "pretalx", "hotcrp.com": "HotCRP",
    "linklings.net": "Linklings", "oxfordabstracts.com": "Oxford Abstracts", "conftool.net": "ConfTool", "google.com/forms": "Google Forms", "docs.google.com/forms": "Google Forms", "forms.gle": "Google Forms", "airtable.com": "Airtable",
    "typeform.com": "Typeform", "jotform.com": "Jotform", "hsforms.com": "HubSpot Form", "share.hsforms.com": "HubSpot Form", "hubspot.com": "HubSpot Form", "wufoo.com": "Wufoo", "surveymonkey.com": "SurveyMonkey", "cvent.com": "Cvent",
    "smapply.io": "SurveyMonkey Apply", "awardforce.com": "Award Force", "zealousplatform.com": "Zealous", "getopenwater.com": "OpenWater",
}
# Path segments that still are a front page.
LANDING_SEGMENTS = ("en", "home", "index", "index.html", "index.php", "default", "default.aspx", "main", "welcome", "us", "de", "fr", "es")


def normalize_key(url: Column | str) -> Column:
    """Natural key of a record: no scheme, www, fragment or trailing slash; lower case."""
    u = F.regexp_replace(F.lower(F.trim(text(url))), "^https?://", "")
    u = F.substring_index(F.regexp_replace(u, r"^www\.", ""), "#", 1)
    return F.regexp_replace(u, "/+$", "")


def host(url: Column | str) -> Column:
    """Host without port, lower case; empty where the URL has none."""
    return F.regexp_extract(F.lower(F.trim(text(url))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def bare_host(url: Column | str) -> Column:
    """T4: host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def registrable_domain(url: Column | str) -> Column:
    """T5: the part of the host that someone registered; short hosts as they are."""
    labels = F.filter(F.split(host(url), r"\."), lambda p: p != "")
    n = F.size(labels)
    second = F.element_at(labels, F.when(n >= 2, -2).otherwise(-1))
    keep = F.when(second.isin(*SECOND_LEVEL), 3).otherwise(2)
    return F.when(n <= 2, host(url)).otherwise(F.array_join(F.slice(labels, n - keep + 1, keep), "."))


def same_site(a: Column | str, b: Column | str) -> Column:
    return registrable_domain(a) == registrable_domain(b)


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(F.trim(text(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column | str) -> Column:
    return F.regexp_extract(F.trim(text(url)), r"^[^?#]*\?([^#]*)", 1)


def normalize_url(url: Column | str) -> Column:
    """URL without fragment, trailing slashes and tracking parameters; host in lower case.

    Parameters keep their order and their encoding.
    """
    u = F.trim(text(url))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    noise = lambda p: name(p).isin(*TRACKING_EXACT) | name(p).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")
    kept = F.array_join(F.filter(F.split(query_of(u), "&"), lambda p: (p != "") & ~noise(p)), "&")
    path = F.regexp_replace(path_of(u), "/+$", "")
    whole = F.concat(scheme, F.lit("://"), authority, F.when((path == "") & (kept != ""), "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(scheme == "", u).otherwise(whole)


def is_crawlable(url: Column | str) -> Column:
    """False for click tracking, asset folders and binaries."""
    low = F.lower(text(url))
    ending = "(" + "|".join(s.replace(".", r"\.") for s in SKIPPED_SUFFIXES) + ")$"
    return ~contains_any(low, SKIPPED_PARTS) & ~F.lower(path_of(url)).rlike(ending)


def detect_platform(url: Column | str) -> Column:
    """Name of the submission platform that the URL points at, or null; first entry wins."""
    low, found = F.lower(text(url)), None
    for part, name in PLATFORMS.items():
        found = F.when(low.contains(part), name) if found is None else found.when(low.contains(part), name)
    return found


def on_shared_platform(url: Column | str) -> Column:
    return contains_any(F.lower(text(url)), SHARED_PLATFORMS)


def is_homepage(url: Column | str) -> Column:
    """A host with no query and no path but a landing name."""
    segments = F.filter(F.split(F.lower(path_of(url)), "/"), lambda s: s != "")
    bare = (F.size(segments) == 0) | ((F.size(segments) == 1) & F.element_at(segments, F.when(F.size(segments) > 0, 1).otherwise(F.lit(None))).isin(*LANDING_SEGMENTS))
    return (host(url) != "") & (query_of(url) == "") & F.coalesce(bare, F.lit(True))


def url_depth(url: Column | str) -> Column:
    return F.size(F.filter(F.split(path_of(url), "/"), lambda s: s != ""))


def urls_in(c: Column | str) -> Column:
    """S3: every http(s) URL in free text, in order, closing punctuation left out."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(r"(https?://[^\s\"'<>\])},;]+)")), lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))


def links_in(html: Column | str) -> Column:
    """Href values of a page, in order."""
    return F.regexp_extract_all(text(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""))


def absolute(link: Column | str, base: Column | str) -> Column:
    """A link made absolute against its page's scheme and host."""
    b, to = text(base), text(link)
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), to).when(to.startswith("//"), F.concat(F.substring_index(b, "//", 1), to)).when(to.startswith("/"), F.concat(root, to)).otherwise(F.concat(root, F.lit("/"), to))


def link_kind(link: Column | str, base: Column | str) -> Column:
    """Internal or external, null for what is no web link."""
    whole = absolute(link, base)
    return F.when(whole.rlike("^https?://"), F.when(bare_host(whole) == bare_host(col(base)), "internal").otherwise("external"))
