"""Fill-in-middle transformation by a scan for events.

A text is cut into units: white space with the word after it, or the white space at the end. One
Aho-Corasick automaton reads the text and reports the six white characters and the sentinels. A gap
between neighbouring white characters is a word, so the number of words is that of the gaps, and the
end of the k-th unit is where the k-th gap ends: the few events answer every rank, and no unit is
ever made. A hash of the doc_id chooses the two cuts and the form; a text that holds a sentinel stays
plain, so every output can be read back from itself and its form alone.

Forms: plain, the text; psm, `<P>`prefix`<S>`suffix`<M>`middle; spm, `<S>`suffix`<P>`prefix`<M>`middle.

Defined cases: a null text is the empty text; empty texts are plain with no units; a null doc_id hashes
as the empty string; repeated rows are transformed alike; texts of any length are read whole; an empty
table gives no rows; extra columns pass through, and output columns replace those of the same name.
"""

from __future__ import annotations

import hashlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.bpe import _add, _slices, _with

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: In this many of a hundred documents text is moved, and in so many of those the suffix comes first.
MOVED, SUFFIX_FIRST = 50, 80
ADDED = ("fim", "form", "n", "prefix_chars", "middle_chars")


@cache
def automaton() -> ahocorasick.Automaton:
    """Kind 0 for a white character, 1 to 3 for the sentinels."""
    found = ahocorasick.Automaton()
    for c in WHITE:
        found.add_word(c, 0)
    for kind, sentinel in enumerate(SENTINELS, 1):
        found.add_word(sentinel, kind)
    found.make_automaton()
    return found


def events(text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Places of the white characters, and (start, kind) of the sentinels, in order."""
    found = np.fromiter((end << 2 | kind for end, kind in automaton().iter(text)), np.int64)
    named = found[found & 3 > 0]
    return found[found & 3 == 0] >> 2, [(int(e >> 2) - len(SENTINELS[(e & 3) - 1]) + 1, int(e & 3)) for e in named]


def unit_ends(white: np.ndarray, length: int) -> np.ndarray:
    """Where each unit ends, for a text of this length with these white places."""
    stops = np.append(white, length)
    ends = stops[np.diff(stops, prepend=-1) > 1]
    return ends if not length or (len(ends) and ends[-1] == length) else np.append(ends, length)


def choices(doc_id, seed: int = 42) -> list[int]:
    """Four numbers of 32 bits from the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, doc_id, seed: int = 42, moved: int = MOVED, suffix_first: int = SUFFIX_FIRST) -> tuple[str, str, int, int | None, int | None]:
    """Output, form, number of units, and code points of prefix and middle (None if plain)."""
    white, sentinels = events(text)
    ends = unit_ends(white, len(text))
    a, b, c, d = choices(doc_id, seed)
    if not text or sentinels or c % 100 >= moved:
        return text, "plain", len(ends), None, None
    one, two = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
    x, y = (int(ends[k - 1]) if k else 0 for k in (one, two))
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if d % 100 < suffix_first:
        return "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), "spm", len(ends), x, y - x
    return "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), "psm", len(ends), x, y - x


def restored(output: str | None, form: str | None) -> str | None:
    """The text that an output of this form was made from; None for an output that is not of this form."""
    if output is None or form == "plain":
        return output
    _, found = events(output)
    order = {"psm": [1, 2, 3], "spm": [2, 1, 3]}.get(form)
    if [kind for _, kind in found] != order or found[0][0]:
        return None
    stops = [start for start, _ in found[1:]] + [len(output)]
    piece = {kind: output[start + len(SENTINELS[kind - 1]) : stop] for (start, kind), stop in zip(found, stops, strict=True)}
    return piece[1] + piece[3] + piece[2]


def fim_transform(df: DataFrame, text: str = "text", seed: int = 42, moved: int = MOVED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Add fim (the output), form, n (units), prefix_chars and middle_chars; `df` has doc_id and `text`."""
    base = df.drop(*(c for c in ADDED if c != text))
    schema = base.schema
    for name, kind in zip(ADDED, (T.StringType(), T.StringType(), T.LongType(), T.LongType(), T.LongType()), strict=True):
        schema = _with(schema, name, kind)

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, text):
                rows = [transformed(t or "", i, seed, moved, suffix_first) for t, i in zip(batch.column(text).to_pylist(), batch.column("doc_id").to_pylist(), strict=True)]
                for k, (name, kind) in enumerate(zip(ADDED, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)):
                    batch = _add(batch, name, pa.array([r[k] for r in rows], kind))
                yield batch

    return base.mapInArrow(run, schema)


def fim_restore(df: DataFrame, output: str = "fim", form: str = "form", out: str = "restored") -> DataFrame:
    """Add `out`: the text rebuilt from `output` and `form` alone, null where they do not fit."""

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, output):
                texts = [restored(o, f) for o, f in zip(batch.column(output).to_pylist(), batch.column(form).to_pylist(), strict=True)]
                yield _add(batch, out, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _with(df.schema, out, T.StringType()))


def fim_digest(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of the output and of the text rebuilt from it."""
    moved = fim_restore(fim_transform(df.select("doc_id", "text")).drop("text"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def fim_sql() -> str:
    """The digest in DuckDB SQL over documents, with units made by a pattern."""
    return r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
numbers AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS one, greatest(h1 % (n + 1), h2 % (n + 1)) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (
  SELECT *, array_to_string(list_slice(u, 1, one), '') AS prefix, array_to_string(list_slice(u, one + 1, two), '') AS middle,
    array_to_string(list_slice(u, two + 1, n), '') AS suffix
  FROM cuts)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
    ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
