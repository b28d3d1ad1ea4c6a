"""The controlled vocabulary of markets: canonical spellings, aliases, list file names and a guard against forks."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.text import market_key, text

# The seed vocabulary, spellings of other sources, and words of file names that mean no market.
MARKETS = ("Additive Mfg", "Bioeconomy", "BioMedTech", "Consumer Electronics", "Cybersecurity", "Robotics", "Semiconductor", "Utility")
ALIASES = {
    "AdditiveMfg": "Additive Mfg", "AdditiveManufacturing": "Additive Mfg", "ConsumerElectronics": "Consumer Electronics", "Biofuels": "Bioeconomy", "Biotech": "BioMedTech", "MedTech": "BioMedTech",
    "Additive Manufacturing & 3D Printing": "Additive Mfg", "Bioeconomy & Biofuels": "Bioeconomy", "Biotech & MedTech": "BioMedTech", "Arnica": "Cybersecurity",
}
FILE_WORDS = ("conference", "conferences", "award", "awards", "list", "lists", "global", "industry", "industries", "cfp", "customer", "final", "copy", "v1", "v2")
#: Similarity from which two names are taken for spellings of one.
NEAR = 0.70


def plain_key(name: str) -> str:
    """The comparison key of market_key, for a vocabulary that is known beforehand."""
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def resolve_market(c: Column | str, markets: Sequence[str] = MARKETS, aliases: dict[str, str] | None = None) -> Column:
    """The canonical spelling of a known name or alias, whatever its case and punctuation; else null."""
    known = {plain_key(m): m for m in markets}
    for alias, name in (ALIASES if aliases is None else aliases).items():
        if plain_key(name) in known:
            known[plain_key(alias)] = known[plain_key(name)]
        else:
            known.pop(plain_key(alias), None)  # an alias of what is no market resolves to nothing
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    return F.element_at(F.create_map(*pairs), market_key(c))


def parse_list_name(c: Column | str) -> Column:
    """struct(candidate, list_type) of a list's file name; the candidate has yet to be resolved.

    list_type is Awards, Conferences or null, by the words of the name; what is left without
    those words, years and download marks is the candidate.
    """
    stem = F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"(?i)\.(xlsx|xlsm|csv|txt)$", ""), r"\(\d+\)", " ")
    words = F.filter(F.split(stem, "[^A-Za-z0-9]+"), lambda w: w != "")
    low = F.transform(words, lambda w: F.lower(w))
    said = lambda *values: F.arrays_overlap(low, F.array(*[F.lit(v) for v in values]))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*FILE_WORDS) & ~w.rlike(r"^(19|20)\d{2}$"))
    kind = F.when(said("award", "awards"), "Awards").when(said("conference", "conferences"), "Conferences")
    return F.struct(F.array_join(kept, " ").alias("candidate"), kind.alias("list_type"))


def near_markets(c: Column | str, markets: Sequence[str] = MARKETS) -> Column:
    """M6: markets that a new name looks like: alike by letters, or one within the other; itself left out."""
    keys = [(plain_key(m), m) for m in markets]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def near(values: pd.Series) -> pd.Series:
        found: dict[str, list[str]] = {}
        for key in values.fillna("").unique():
            alike = lambda k, key=key: SequenceMatcher(None, key, k).ratio() >= NEAR or key in k or k in key
            found[key] = [m for k, m in keys if k != key and alike(k)] if key else []
        return values.fillna("").map(found)

    return near(market_key(c))


def admit_market(c: Column | str, markets: Sequence[str] = MARKETS, forced: Column | None = None) -> Column:
    """M6: struct(fate, name): a known name is reused; one that looks like a known one is refused unless forced."""
    known, near = resolve_market(c, markets), near_markets(c, markets)
    pick = lambda fate, name: F.struct(F.lit(fate).alias("fate"), name.alias("name"))
    may = F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)
    return (
        F.when(F.trim(text(c)) == "", pick("refused: empty", F.lit(None).cast("string")))
        .when(known.isNotNull(), pick("known", known))
        .when((F.size(near) > 0) & ~may, pick("refused: looks like another", F.get(near, F.lit(0))))
        .otherwise(pick("added", F.trim(text(c))))
    )
