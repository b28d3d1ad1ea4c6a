"""Token-ID files: ids of an adaptive context-mixing range coder, in checksummed blocks.

Each block of at most BLOCK ids starts from a fresh model and is coded alone. Order-2 and
order-1 contexts (the last two ids, the last id) each predict one id with a confidence; the
adaptive probabilities of both predictions and that which the order-0 model gives the predicted id are
mixed in the logistic domain by weights that learn online, and the mixed probability drives an
arithmetic coder. Ids that neither context predicts are coded by the order-0 model, digit by
digit. All arithmetic is on integers, so that any machine decodes what another has written.

Blocks don't depend on each other, so many are coded in step, one array element for each.

A file set is a Parquet folder. A row (chunk) holds whole documents in ascending doc_id order:
their ids and lengths, and the coded blocks, each with the CRC-32 of its ids.

Defined cases: null and empty texts have the end id alone; documents are ordered by doc_id,
null first, then by text; repeated rows are written each; damaged blocks raise an error on
reading; an empty table gives an empty folder and no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.bpe import _slices

BLOCK = 2_048
#: Blocks coded in step, at most.
LANES = 4_096
#: Ids of a chunk, unless one document has more.
CHUNK_IDS = 65_536

_BITS = 15
_ONE = 1 << _BITS
_SLOTS = 2_048
_TOP, _BOTTOM, _MASK = np.uint64(32), np.uint64(1 << 24), np.uint64((1 << 48) - 1)

#: ln(p / (1 - p)) and its inverse, in steps of 1/256 over probabilities of 12 bits; the inverse as a share of _ONE.
_STRETCH = np.array([round(256 * math.log((2 * p + 1) / (8191 - 2 * p))) for p in range(4096)], np.int32)
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
_CHANCE = np.clip(_SQUASH << 3, 32, _ONE - 32).astype(np.uint64)
#: Where each of 16 cumulative frequencies moves when a digit is seen; the first is 0, one after the last would be _ONE.
_TARGET = np.array([[i + (_ONE - 16 if i > d else 0) for i in range(16)] for d in range(16)], np.int16)
#: By how much an id is shifted for each of its three adaptive digits, and the first context of each.
_SHIFTS, _FIRSTS = np.array([[12], [8], [4]], np.int32), np.array([[0], [1], [17]])
_CONTEXTS = 1 + 16 + 256
_UNIT, _FULL = np.uint64(32), np.uint64(1 << 32)
_P, _D = np.uint64(_BITS), np.uint64(_BITS + 4)
_HASH, _BUCKET = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0x5BD1)), np.uint32(21)


def bounds(cdf: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the interval of digit d, by rows of 16 cumulative frequencies.

    After the last one of a row stands the 0 of another, which is _ONE modulo _ONE.
    """
    flat, at = cdf.ravel(), np.arange(0, cdf.size, 16) + d
    start = flat[at]
    at += 1
    return start.astype(np.int32), ((flat.take(at, mode="wrap") - start) & (_ONE - 1)).astype(np.int32)


class _Writer:
    """Low end and range of each lane, 64 bits each. Units of 32 bits move out; lanes' n-th units lie together.

    ids: a row for each step, a column for each lane; ids are given as id + 1 here and in the reader.
    """

    def __init__(self, ids: np.ndarray):
        self.ids, self.lanes = ids, ids.shape[1]
        self.low, self.range = np.zeros(self.lanes, np.uint64), np.full(self.lanes, (1 << 64) - 1, np.uint64)
        self.out = np.zeros((3 * len(ids) + 8) * self.lanes, np.uint32)  # an id takes less than 96 bits
        self.pos = np.arange(self.lanes)

    def raised(self, low: np.ndarray, by: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """low + by; what runs over goes to the units that are out."""
        found = low + by
        over = np.flatnonzero(found < low)
        if len(over):
            places = self.pos[over if at is None else at[over]] - self.lanes
            while len(places):
                self.out[places] += np.uint32(1)
                places = places[self.out[places] == 0] - self.lanes
        return found

    def shift(self, at: np.ndarray, low: np.ndarray) -> np.ndarray:
        pos = self.pos[at]
        self.out[pos] = low >> _UNIT
        self.pos[at] = pos + self.lanes
        return low << _UNIT

    def bit(self, t: int, p: np.ndarray, guess: np.ndarray):
        """Code whether the ids of the first lanes are the guessed ones, p being its share of _ONE; new ranges."""
        m = len(guess)
        y, span = self.ids[t, :m] == guess, self.range[:m]
        bound = (span >> _P) * p
        self.low[:m] = self.raised(self.low[:m], bound * ~y)
        return y, np.where(y, bound, span - bound)

    def bit_of(self, at: np.ndarray, t: int, p: np.ndarray, guess: np.ndarray, span: np.ndarray):
        """The same for the lanes `at`, whose ranges are given."""
        y = self.ids[t].take(at) == guess
        bound = (span >> _P) * p
        self.low[at] = self.raised(self.low[at], bound * ~y, at)
        return y, np.where(y, bound, span - bound)

    def settle(self, span: np.ndarray) -> None:
        """Take over the ranges of the first lanes, with 32 bits and more in each."""
        at = np.flatnonzero(span < _FULL)
        if len(at):
            span[at] <<= _UNIT
            self.low[at] = self.shift(at, self.low[at])
        self.range[: len(span)] = span

    def open_digits(self, at: np.ndarray, t: int) -> None:
        self.at, self.value = at, self.ids[t].take(at) - 1
        self.at_low, self.at_range = self.low[at], self.range[at]

    def digit(self, shift: int, cdf: np.ndarray):
        """The digit at `shift` of the opened lanes, and with the last adaptive one the even one below it."""
        d, low = (self.value >> shift) & 15, None
        start, size = bounds(cdf, d)
        if shift > 4:
            step = self.at_range >> _P
        else:
            step, low = self.at_range >> _D, self.value & 15
            start = (start << 4) + low * size
        self.at_low = self.raised(self.at_low, start.astype(np.uint64) * step, self.at)
        self.at_range = size.astype(np.uint64) * step
        return d, low

    def settle_digits(self) -> None:
        k = np.flatnonzero(self.at_range < _FULL)
        if len(k):
            self.at_range[k] <<= _UNIT
            self.at_low[k] = self.shift(self.at[k], self.at_low[k])

    def close_digits(self) -> None:
        self.settle_digits()
        self.low[self.at], self.range[self.at] = self.at_low, self.at_range

    def learned(self, t: int, ids: np.ndarray) -> None:
        pass

    def bytes(self) -> list[bytes]:
        every = np.arange(self.lanes)
        self.low = self.raised(self.low, np.full(self.lanes, _FULL - np.uint64(1)))  # one unit more, then zeros, lies in the range
        self.shift(every, self.low)
        sizes = (self.pos - every) // self.lanes
        units = self.out.reshape(-1, self.lanes)[: sizes.max()].T.astype("<u4")
        return [units[i, :n].tobytes() for i, n in enumerate(sizes.tolist())]


class _Reader:
    """Code (less the low end) and range of each lane. Beyond the end of what was written stand zeros."""

    def __init__(self, coded: list[bytes], most: int):
        self.lanes = len(coded)
        units = np.zeros((self.lanes, max(len(c) for c in coded) // 4 + 3), np.uint32)
        for i, c in enumerate(coded):
            units[i, : len(c) // 4] = np.frombuffer(c, "<u4", len(c) // 4)
        self.code = units[:, 0].astype(np.uint64) << _UNIT | units[:, 1]
        self.range = np.full(self.lanes, (1 << 64) - 1, np.uint64)
        self.units = units.T.ravel()
        self.pos = np.arange(self.lanes) + 2 * self.lanes
        self.last = len(self.units) - 1
        self.ids = np.zeros((most, self.lanes), np.int32)

    def shift(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        pos = self.pos[at]
        self.pos[at] = pos + self.lanes
        return code << _UNIT | self.units[np.minimum(pos, self.last)]

    def bit(self, t: int, p: np.ndarray, guess: np.ndarray):
        m = len(guess)
        span, code = self.range[:m], self.code[:m]
        bound = (span >> _P) * p
        y = code < bound
        code -= bound * ~y
        return y, np.where(y, bound, span - bound)

    def bit_of(self, at: np.ndarray, t: int, p: np.ndarray, guess: np.ndarray, span: np.ndarray):
        code = self.code[at]
        bound = (span >> _P) * p
        y = code < bound
        self.code[at] = code - bound * ~y
        return y, np.where(y, bound, span - bound)

    def settle(self, span: np.ndarray) -> None:
        at = np.flatnonzero(span < _FULL)
        if len(at):
            span[at] <<= _UNIT
            self.code[at] = self.shift(at, self.code[at])
        self.range[: len(span)] = span

    def open_digits(self, at: np.ndarray, t: int) -> None:
        self.at, self.at_code, self.at_range = at, self.code[at], self.range[at]

    def digit(self, shift: int, cdf: np.ndarray):
        more, low = (0 if shift > 4 else 4), None
        step = self.at_range >> (_D if more else _P)
        target = np.minimum(self.at_code // step, np.uint64((_ONE << more) - 1)).astype(np.int32)
        below = (cdf <= (target >> more).astype(np.int16)[:, None]).view(np.uint64)  # eight truths to a number
        d = ((below[:, 0] + below[:, 1]) * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64) - 1
        start, size = bounds(cdf, d)
        if more:
            low = (target - (start << 4)) // size
            start = (start << 4) + low * size
        self.at_code -= start.astype(np.uint64) * step
        self.at_range = size.astype(np.uint64) * step
        return d, low

    def settle_digits(self) -> None:
        k = np.flatnonzero(self.at_range < _FULL)
        if len(k):
            self.at_range[k] <<= _UNIT
            self.at_code[k] = self.shift(self.at[k], self.at_code[k])

    def close_digits(self) -> None:
        self.settle_digits()
        self.code[self.at], self.range[self.at] = self.at_code, self.at_range

    def learned(self, t: int, ids: np.ndarray) -> None:
        self.ids[t, : len(ids)] = ids


def _code(coder: _Writer | _Reader, lengths: np.ndarray) -> None:
    """Run the model over all lanes; lengths must fall. Writer and reader meet the same states.

    Arrays of two rows hold what belongs to order 1 and order 2. Tables are laid out by context, so that lanes
    in the same context touch the same memory.
    """
    n = len(lengths)
    lanes = np.arange(n)
    orders = np.zeros(2 * _SLOTS * n, np.int32)  # (id + 1) << 3 | confidence
    seen, seen_b = np.full(2 * n * 16, _ONE // 2, np.int16), np.full(n * 8, _ONE // 4, np.int16)
    weights = np.repeat(np.array([[1 << 15], [1 << 15], [1 << 12]], np.int32), n, axis=1)
    rows = np.tile((np.arange(16) * (_ONE // 16)).astype(np.int16), (_CONTEXTS * n, 1))
    flat, whole = rows.ravel(), rows.view("V32").ravel()
    last, before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    alive = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if n else 0), side="left").tolist()
    width = 0
    for t, m in enumerate(alive):
        if m != width:
            width, w = m, weights[:, :m]
            slots, seens = np.stack((lanes[:m], lanes[:m] + _SLOTS * n)), np.stack((lanes[:m], lanes[:m] + n)) * 16
            bases = (lanes[:m] + _FIRSTS * n) * 16
            hashed, x = np.empty((2, m), np.uint32), np.empty((3, m), np.int32)
        np.multiply(last[:m], _HASH[0], out=hashed[0])
        np.multiply(before[:m], _HASH[1], out=hashed[1])
        hashed[1] += _HASH[2]
        hashed[1] ^= hashed[0]
        h = (hashed >> _BUCKET) * np.int64(n)
        h += slots
        e = orders[h]
        q, c = e >> 3, e & 7
        q1, q2 = q
        guess = np.where(q2 > 0, q2, q1)
        # the likelier guess, its probability mixed from both orders and its order-0 share, the product of its
        # digits' shares (the last digit is even); where nothing is guessed, no id is the guessed one
        i = ((q != guess) << np.int64(3)) + seens
        i += c
        s = seen[i]
        digits = np.maximum(guess - 1, 0) >> _SHIFTS
        at = (digits >> 4) * np.int64(16 * n)
        at += digits & 15
        at += bases
        low = flat[at]
        at += 1
        share = ((flat.take(at, mode="wrap") - low) & (_ONE - 1)).astype(np.int32)
        x[:2] = s >> 3
        x[2] = (share[0] * share[1] >> _BITS) * share[2] >> (_BITS + 4 + _BITS - 12)
        _STRETCH.take(x, out=x, mode="clip")
        mixed = ((w * x).sum(axis=0, dtype=np.int32) >> 16) + 2047
        y, span = coder.bit(t, _CHANCE.take(mixed, mode="clip"), guess)
        move = x * (((y << np.int32(12)) - _SQUASH.take(mixed, mode="clip")) * 6)
        move += 512
        move >>= 10
        w += move
        seen[i] = s + ((y * np.int16(_ONE - 1) - s) >> 4)
        ids = guess * y  # id + 1, and 0 where it isn't known yet
        # the other guess
        other = np.flatnonzero((ids == 0) & (q1 != q2) & (q1 > 0) & (q2 > 0))
        if len(other):
            ib = other * 8 + c[0].take(other)
            sb, own = seen_b[ib], q1.take(other)
            yb, span[other] = coder.bit_of(other, t, np.clip(sb, 32, _ONE - 32).astype(np.uint64), own, span[other])
            seen_b[ib] = sb + ((yb * np.int16(_ONE - 1) - sb) >> 4)
            ids[other] = own * yb
        coder.settle(span)
        # order 0: three adaptive digits of four bits, the last one even
        rest = np.flatnonzero(ids == 0)
        if len(rest):
            coder.open_digits(rest, t)
            value, low = 0, None
            for shift, first in zip((12, 8, 4), _FIRSTS.ravel().tolist(), strict=True):
                at = (value + first) * n + rest
                cdf = rows.take(at, axis=0)
                d, low = coder.digit(shift, cdf)
                if shift == 8:
                    coder.settle_digits()
                moved = _TARGET.take(d, axis=0)
                moved -= cdf
                moved >>= 4
                moved += cdf
                whole[at] = moved.view("V32").ravel()
                value = value << 4 | d
            coder.close_digits()
            ids[rest] = (value << 4 | low) + 1
        coder.learned(t, ids)
        orders[h] = np.where(q == ids, e + (c < 7), np.where(c >= 4, e - 3, ids << 3))
        before[:m] = last[:m]
        last[:m] = ids
        last[:m] -= np.uint32(1)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of each block of ids (each below 65,536)."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    found: list[bytes] = [b""] * len(blocks)
    for start in range(0, len(order), LANES):
        part = [i for i in order[start : start + LANES] if len(blocks[i])]
        if not part:
            continue
        lengths = np.array([len(blocks[i]) for i in part])
        ids = np.zeros((len(part), lengths[0]), np.int32)
        for k, i in enumerate(part):
            ids[k, : lengths[k]] = blocks[i]
        ids += 1
        writer = _Writer(np.ascontiguousarray(ids.T))
        _code(writer, lengths)
        for i, data in zip(part, writer.bytes(), strict=True):
            found[i] = data
    return found


def decode_blocks(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each coded block, whose number is given."""
    order = sorted(range(len(coded)), key=lambda i: -sizes[i])
    found = [np.zeros(0, np.uint16)] * len(coded)
    for start in range(0, len(order), LANES):
        part = [i for i in order[start : start + LANES] if sizes[i]]
        if not part:
            continue
        lengths = np.array([sizes[i] for i in part])
        reader = _Reader([coded[i] for i in part], int(lengths[0]))
        _code(reader, lengths)
        ids = np.ascontiguousarray((reader.ids - 1).astype(np.uint16).T)
        for k, i in enumerate(part):
            found[i] = ids[k, : lengths[k]]
    return found


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


class WordTokens:
    """Ids of texts by the tokenizers library, which encodes each distinct word once.

    Pieces between white space are looked up whole and cut into words only where they are new. New words go to the
    library many at a time, with spaces between; the last token of a word is one that ends words.
    Texts that hold special tokens, combining marks or Hangul, or letters newer than the
    tables of regex, go to the library whole.
    """

    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MEMORY_WORDS, MEMORY_PIECES = 600_000, 400_000
    #: Split at as white space by Arrow and Python, but not by the library.
    SEPARATORS = "\x1c\x1d\x1e\x1f"

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_padding()
        self.library.no_truncation()
        self.words, self.unknown = regex.compile(self.WORDS), regex.compile(r"[\p{Cn}\p{M}\u1100-\u11ff\ua960-\ua97f\uac00-\ud7ff]")
        self.distant = re.compile("[^\x00-\u02ff]")  # a quick look before the exact one
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn_pieces(self, pieces: list[str]) -> None:
        """Find the ids of new pieces. Most are letters, with ASCII punctuation behind or not: two words at most.

        Words are held in no list for each piece, which Python's garbage collector would go through again and again.
        """
        letters = [p.rstrip(string.punctuation) for p in pieces]
        plain = [x.isalpha() for x in letters]
        behind = [p[len(x) :] for p, x in zip(pieces, letters, strict=True)]
        other = {p: self.words.findall(p) for p, ok in zip(pieces, plain, strict=True) if not ok}
        words = {x for x, ok in zip(letters, plain, strict=True) if ok}
        words.update(x for x, ok in zip(behind, plain, strict=True) if ok and x)
        words.update(*other.values())
        self.learn([w for w in words if w not in self.known])
        of = self.known.__getitem__
        for piece, x, y, ok in zip(pieces, letters, behind, plain, strict=True):
            self.pieces[piece] = (of(x) + of(y) if y else of(x)) if ok else b"".join(map(of, other[piece]))

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet."""
        for start in range(0, len(words), 10_000):
            parts = [words[a : min(a + 1_000, start + 10_000)] for a in range(start, min(start + 10_000, len(words)), 1_000)]
            for part, e in zip(parts, self.library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u2")
                stops = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist()
                if len(stops) == len(part):
                    data = ids.tobytes()
                    self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
                else:  # some word has no end of its own
                    for word, own in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                        self.known[word] = np.array(own.ids, "<u2").tobytes()

    def encode_all(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """The ids of each text and the end id, as little-endian 16-bit integers."""
        end, split, own = end_id.to_bytes(2, "little"), [], {}
        if len(self.pieces) > self.MEMORY_PIECES:
            self.pieces.clear()
        if len(self.known) > self.MEMORY_WORDS:
            self.known.clear()
        for k, text in enumerate(texts):
            text = text or ""
            if any(s in text for s in self.special) or self.distant.search(text) and self.unknown.search(text):
                own[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
                text = ""
            elif not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
            if any(s in text for s in self.SEPARATORS):
                words = self.words.findall(text)
                self.learn(list({w for w in words if w not in self.known}))
                own[k], text = b"".join(map(self.known.__getitem__, words)), ""
            split.append(text)
        if not split:
            return []
        lists = pc.utf8_split_whitespace(pa.array(split, pa.string()))
        flat = lists.flatten().dictionary_encode()
        pieces, index = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        self.learn_pieces([p for p in pieces if p not in self.pieces])
        # the ids of distinct pieces, one after the other, and from where to where each piece of a text takes its own
        data = list(map(self.pieces.__getitem__, pieces))
        sizes, pool = np.fromiter(map(len, data), np.int64, len(data)) // 2, np.frombuffer(b"".join(data), "<u2")
        stops = np.concatenate(([0], np.cumsum(sizes[index])))
        first = (np.cumsum(sizes) - sizes)[index] - stops[:-1]
        ids = pool[np.repeat(first, sizes[index]) + np.arange(stops[-1])].tobytes()
        bounds_ = (2 * stops[lists.offsets.to_numpy()]).tolist()
        return [own.get(k, ids[a:b]) + end for k, (a, b) in enumerate(zip(bounds_[:-1], bounds_[1:], strict=True))]


_loaded: dict[str, WordTokens] = {}


def _vocabulary(definition: str) -> WordTokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if definition not in _loaded:
        _loaded.clear()
        _loaded[definition] = WordTokens(definition)
    return _loaded[definition]


def write_token_files(df: DataFrame, definition_path: str, path: str, end_id: int = 2) -> None:
    """Encode whole texts and write their ids to `path` in ascending doc_id order.

    Texts are put in order before they are encoded: Spark looks twice at what it deals out by
    range, and texts are cheap to look at.
    """
    with open(definition_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # a few MB: a vocabulary
    texts = df.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    ordered = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def chunks(batches):
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), _vocabulary(shared.value)
        group, docs, lengths, ids, number, held, own = [], [], [], [], 0, 0, 0

        def pack():
            nonlocal number, docs, lengths, ids, own
            if docs:
                group.append((number, (docs, lengths, np.frombuffer(b"".join(ids), "<u2"))))
                number += 1
                docs, lengths, ids, own = [], [], [], 0

        def flush():
            rows = list(coded_group(group, part))
            group.clear()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_FILE)

        for whole in batches:
            for batch in _slices(whole, "text", 8_000_000):
                for doc, data in zip(batch.column("doc_id").to_pylist(), tokens.encode_all(batch.column("text").to_pylist(), end_id), strict=True):
                    docs.append(doc)
                    lengths.append(len(data) // 2)
                    ids.append(data)
                    held += len(data) // 2
                    own += len(data) // 2
                    if own >= CHUNK_IDS:
                        pack()
                    if held >= LANES * BLOCK:
                        pack()
                        yield from flush()
                        held = 0
        pack()
        yield from flush()

    ordered.mapInArrow(chunks, "part int, chunk int, doc_ids array<long>, lengths array<long>, blocks array<struct<n_ids:int,crc:long,data:binary>>").write.option("compression", "uncompressed").parquet(path)


_FILE = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(pa.struct([("n_ids", pa.int32()), ("crc", pa.int64()), ("data", pa.binary())])))])


def coded_group(group: list, part: int):
    """File rows of a group of chunks, all their blocks coded in step."""
    blocks = [c[2][a : a + BLOCK] for _, c in group for a in range(0, len(c[2]), BLOCK)]
    data = iter(zip(blocks, encode_blocks(blocks), strict=True))
    for number, (docs, lengths, ids) in group:
        own = [next(data) for _ in range(0, len(ids), BLOCK)]
        yield {"part": part, "chunk": number, "doc_ids": docs, "lengths": lengths, "blocks": [{"n_ids": len(b), "crc": crc_of(b), "data": x} for b, x in own]}


def decoded_rows(rows: list[dict]):
    """(doc position in the row, ids) lists of file rows; raises on a wrong checksum."""
    coded = [b for r in rows for b in r["blocks"]]
    ids = decode_blocks([b["data"] for b in coded], [b["n_ids"] for b in coded])
    for b, x in zip(coded, ids, strict=True):
        if crc_of(x) != b["crc"]:
            raise ValueError("a block of ids is damaged: its checksum differs")
    blocks = iter(ids)
    for r in rows:
        whole = np.concatenate([next(blocks) for _ in r["blocks"]]) if r["blocks"] else np.zeros(0, np.uint16)
        yield np.split(whole, np.cumsum(r["lengths"])[:-1])


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(part, chunk, pos, doc_id, n_tokens, and ids or ids_crc32) of every document of the files."""

    def run(batches):
        for whole in batches:
            waiting, held = [], 0
            for k in range(whole.num_rows):
                row = whole.slice(k, 1).to_pylist()[0]
                waiting.append(row)
                held += len(row["blocks"])
                if held >= LANES or k == whole.num_rows - 1:
                    out = {"part": [], "chunk": [], "pos": [], "doc_id": [], "n_tokens": [], "value": []}
                    for r, docs in zip(waiting, decoded_rows(waiting), strict=True):
                        for pos, (doc, ids) in enumerate(zip(r["doc_ids"], docs, strict=True)):
                            for name, x in zip(out, (r["part"], r["chunk"], pos, doc, len(ids), crc_of(ids) if digest else ids.astype(np.int32)), strict=True):
                                out[name].append(x)
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], kind) for n, kind in zip(out, kinds, strict=True)], names=[*list(out)[:-1], "ids_crc32" if digest else "ids"])
                    waiting, held = [], 0

    kind = "ids_crc32 long" if digest else "ids array<int>"
    return spark.read.schema("part int, chunk int, doc_ids array<long>, lengths array<long>, blocks array<struct<n_ids:int,crc:long,data:binary>>").parquet(path).mapInArrow(run, f"part int, chunk int, pos int, doc_id long, n_tokens long, {kind}")


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all machines of a cluster share."""
    from attesta.session import cut

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut(spark.range(1))
    return f"{context.getCheckpointDir()}/token-files-{uuid.uuid4().hex}"


def token_digest(df: DataFrame, definition_path: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files written."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    write_token_files(df, definition_path, path)
    docs = read_token_files(spark, path, digest=True)
    # lengths stand beside the blocks, so starts need no decoding: within chunks, then over chunks
    chunks = spark.read.parquet(path).select("part", "chunk", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = chunks.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = chunks.select("part", "chunk", inside.alias("inside")).join(earlier, "part").select("part", "chunk", (F.col("inside") + F.col("before")).alias("offset"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return docs.withColumn("within", within).join(offsets, ["part", "chunk"]).select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
