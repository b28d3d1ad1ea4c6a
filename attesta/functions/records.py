"""Columns derived from the fields of one claim: place, model, canonical id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import blank, slug, text

# Spellings of how a call operates, by letters only.
CALL_MODELS = {
    "fixeddeadline": "Fixed Deadline", "rollingform": "Rolling Form", "rolling": "Rolling Form", "inviteonly": "Invite Only", "invitationonly": "Invite Only",
    "curatedinvite": "Invite Only", "invitecurated": "Invite Only", "curated": "Invite Only", "notannounced": "Not Announced", "tbd": "Not Announced",
}
# Words of venues, online events and open questions.
VENUE = r"(?i)\b(centre|center|messe|fira|expo|exhibition|convention|congress|hall|arena|stadium|hotel|resort|palace|pavilion|campus|university|institute|college|park|nangang|asiaworld|station)\b"
ONLINE = r"(?i)\b(online|virtual|remote)\b"
UNDECIDED = r"(?i)\b(tbd|tba|to be (announced|determined)|unknown)\b"
COUNTRIES = ("usa", "us", "united states", "uk", "united kingdom")


def call_model(c: Column | str) -> Column:
    """One of four models; unknown spellings are not announced."""
    key, found = F.regexp_replace(F.lower(text(c)), "[^a-z]", ""), None
    for alias, name in CALL_MODELS.items():
        found = F.when(key == alias, name) if found is None else found.when(key == alias, name)
    return found.otherwise("Not Announced")


def clean_city(location: Column | str, city: Column | str, state: Column | str, country: Column | str) -> Column:
    """The settlement of a record: a delivered city unless it is a venue, else the last place of the
    location that is neither venue, state nor country; a state only if nothing else is left, a
    country only for a city state. Undecided places give nothing."""
    loc, given, st, co = (F.trim(text(c)) for c in (location, city, state, country))
    undecided = (given.rlike(UNDECIDED) | loc.rlike(UNDECIDED)) & ((given == "") | given.rlike(UNDECIDED))
    parts = F.filter(F.transform(F.split(loc, "[,/]"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(VENUE) & ~p.rlike(UNDECIDED))
    countries = F.array(F.lower(co), *[F.lit(c) for c in COUNTRIES])
    last = lambda drop: F.get(F.reverse(F.filter(parts, lambda p: ~F.array_contains(drop, F.lower(p)))), F.lit(0))
    city_state = F.when((F.lower(st) == F.lower(co)) & (st != ""), last(F.array(F.lit(""))))
    found = F.coalesce(last(F.array_append(countries, F.lower(st))), last(countries), city_state, F.lit(""))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(found, r"\s*\(.*?\)\s*", " "), "^[ -]+|[ -]+$", ""))
    return F.when(undecided, "").when(~blank(given) & ~given.rlike(VENUE), given).otherwise(tidy)


def event_id(name: Column | str, edition: Column | str, city: Column | str, location: Column | str = "", opportunity: Column | str = "") -> Column:
    """Year-name-place, and the kind of opportunity unless it is speaking; the market is no part of it."""
    col = lambda c: F.lit(c) if c == "" else c
    year = F.substring(F.trim(text(edition)), 1, 4)
    place = slug(city, 28)
    place = F.when(place != "", place).when(text(col(location) if isinstance(location, str) else location).rlike(ONLINE), "virtual").otherwise("tbd")
    base = F.concat_ws("-", F.when(year.rlike(r"^\d+$"), year).otherwise("tbd"), slug(name, strip_years=True), place)
    kind = slug(col(opportunity) if isinstance(opportunity, str) else opportunity, 14)
    return F.concat(F.regexp_replace(base, "^-+|-+$", ""), F.when(kind.isin("", "speaking"), "").otherwise(F.concat(F.lit("-"), kind)))


def series(event: Column | str) -> Column:
    """The event across all years."""
    return F.regexp_replace(text(event), r"^(19|20)\d{2}-", "")


def opportunity_of(event: Column | str) -> Column:
    """The kind of opportunity that an id ends in."""
    e = text(event)
    return F.when(e.endswith("-awards"), "awards").when(e.endswith("-exhibiting"), "exhibiting").when(e.endswith("-registration"), "registration").otherwise("speaking")
