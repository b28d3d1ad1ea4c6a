"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

Byte-level BPE has a prefix property: the encoding of a prefix ends in exactly one
token that is compatible with the token before it, so the encoding of word[:i] is that
of word[:i - len(token)] plus the token. Each trie node keeps this last token; words
that share a prefix share its nodes, so the prefix is encoded once.

Defined cases: null and empty texts give no ids and the empty text; special tokens that
stand in a text become their own id; texts of any length are encoded whole; extra
columns are passed through, and output columns replace columns of the same name.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a byte-level vocabulary splits text before merging (fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids; the older half makes room.
MEMORY_WORDS = 800_000
#: Token pairs kept with whether they may stand side by side.
MEMORY_PAIRS = 500_000
#: A word of more bytes is walked alone and not stored in the trie.
LONG_WORD = 256


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class ByteBpe:
    """A byte-level vocabulary with its merges; tokens are numbered by merge rank inside."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda token: bytes(of_letter[c] for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.text = [bytes([b]) for b in range(256)] + [raw(a) + raw(b) for a, b in merges]
        self.rank = {t: i for i, t in enumerate(self.text)}
        if len(self.rank) != len(self.text):
            raise ValueError("two merges make the same token")
        self.left, self.right = list(range(256)), list(range(256))
        self.pairs: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges):
            pair = self.rank[raw(a)], self.rank[raw(b)]
            self.left.append(pair[0])
            self.right.append(pair[1])
            self.pairs[pair] = 256 + i
        vocab = {raw(t): i for t, i in model["vocab"].items()}
        self.ids = [vocab[t] for t in self.text]
        self.sizes = [len(t) for t in self.text]
        self.raw_ids = [int(i).to_bytes(4, "little") for i in self.ids]
        self._suffix_machine()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        longest = max(self.by_id) + 1
        sizes = np.array([len(self.by_id.get(i, b"")) for i in range(longest)])
        self.pool = np.frombuffer(b"".join(self.by_id.get(i, b"") for i in range(longest)), np.uint8), np.cumsum(sizes) - sizes, sizes
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(SPLIT)
        self.unknown = regex.compile(r"\p{Cn}")
        self.joins: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _suffix_machine(self) -> None:
        """States that tell which tokens end at a byte: a trie of all tokens with failure links."""
        self.step: dict[int, int] = {}
        own, fail, queue = [-1], [0], []
        for token, text in enumerate(self.text):
            state = 0
            for depth, b in enumerate(text):
                below = self.step.get(state << 8 | b)
                if below is None:
                    below = self.step[state << 8 | b] = len(own)
                    own.append(-1)
                    fail.append(0)
                    queue.append((depth, state, b, below))
                state = below
            own[state] = token
        queue.sort()
        for depth, state, b, below in queue:
            if depth:
                back = fail[state]
                while (to := self.step.get(back << 8 | b)) is None:
                    back = fail[back]
                fail[below] = to
        self.own, self.fail, self.moves, self.ends = own, fail, {}, {}

    def move(self, state: int, b: int) -> int:
        """The state after one more byte; every byte is a token, so the search ends."""
        key = state << 8 | b
        found = self.step.get(key)
        while found is None:
            state = self.fail[state]
            found = self.step.get(state << 8 | b)
        if len(self.moves) > MEMORY_PAIRS:
            self.moves.clear()
        self.moves[key] = found
        return found

    def tokens_at(self, state: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of all tokens that end in this state, longest first."""
        found, at = [], state
        while at:
            if self.own[at] >= 0:
                found.append((self.own[at], len(self.text[self.own[at]])))
            at = self.fail[at]
        if len(self.ends) > MEMORY_PAIRS:
            self.ends.clear()
        self.ends[state] = found = tuple(found)
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a next to b: no earlier merge crosses their border."""
        key = a << 20 | b
        limit, good = len(self.text), True
        while True:
            if self.pairs.get((a, b), limit) < limit:
                good = False
                break
            if a > b:  # undo the later of the two merges that touch the border
                limit, a = a, self.right[a]
                done = a == limit
                if done:
                    limit, b = b + 1, self.left[b]
                    done = b + 1 == limit
            else:
                limit, b = b + 1, self.left[b]
                done = b + 1 == limit
                if done:
                    limit, a = a, self.right[a]
                    done = a == limit
            if done:
                break
        if len(self.joins) > MEMORY_PAIRS:
            self.joins.clear()
        self.joins[key] = good
        return good

    def last_token(self, state: int, depth: int, lasts: list[int]) -> int:
        """The last token of a prefix of `depth` bytes, given its state and those of shorter prefixes."""
        for token, size in self.ends.get(state) or self.tokens_at(state):
            if size == depth:
                return token
            good = self.joins.get(lasts[depth - size] << 20 | token)
            if good or good is None and self.compatible(lasts[depth - size], token):
                return token
        raise ValueError("every byte must be a token")

    def walk(self, data: bytes) -> bytes:
        """The ids of one word that is not in the trie, read back from its end."""
        state, lasts = 0, [0]
        for depth, b in enumerate(data, 1):
            state = self.step.get(state << 8 | b) or self.move(state, b)
            lasts.append(self.last_token(state, depth, lasts))
        found, n = [], len(data)
        while n:
            found.append(self.raw_ids[lasts[n]])
            n -= len(self.text[lasts[n]])
        return b"".join(reversed(found))

    def learn(self, words: list[str]) -> None:
        """Insert words into a trie and traverse it depth-first; the ids go to self.known.

        Along the path stand, for each prefix, its last token and its ids: those of the
        prefix before the last token, and the token.
        """
        children: list[list[tuple[int, int]]] = [[]]  # (byte, node) below each node
        edges: dict[int, int] = {}
        ends: dict[int, str] = {}
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            if len(data) > LONG_WORD:
                self.known[word] = self.walk(data)
                continue
            node = 0
            for b in data:
                key = node << 8 | b
                if key in edges:
                    node = edges[key]
                else:
                    edges[key] = below = len(children)
                    children[node].append((b, below))
                    children.append([])
                    node = below
            ends[node] = word
        lasts, ids, states = [0] * (LONG_WORD + 1), [b""] * (LONG_WORD + 1), [0] * (LONG_WORD + 1)
        moves, tokens, joins = self.moves.get, self.ends.get, self.joins.get
        known, sizes, raw = self.known, self.sizes, self.raw_ids
        stack = [(node, 1, b) for b, node in children[0]]
        while stack:
            node, depth, b = stack.pop()
            state = moves(states[depth - 1] << 8 | b)
            if state is None:
                state = self.move(states[depth - 1], b)
            states[depth] = state
            for last, size in tokens(state) or self.tokens_at(state):  # as in last_token, longest first
                if size == depth:
                    break
                good = joins(lasts[depth - size] << 20 | last)
                if good or good is None and self.compatible(lasts[depth - size], last):
                    break
            lasts[depth] = last
            found = ids[depth] = ids[depth - sizes[last]] + raw[last]
            if node in ends:
                known[ends[node]] = found
            for c, below in children[node]:
                stack.append((below, depth + 1, c))

    def split(self, text: str) -> list[str]:
        if not text.isascii() and self.unknown.search(text):  # letters newer than the regex tables
            from tokenizers import pre_tokenizers

            cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
            return [text[a:b] for _, (a, b) in cut.pre_tokenize_str(text)]
        return self.words.findall(text)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        cut = []
        for text in texts:
            parts = self.cut.split(text or "") if self.cut else [text or ""]
            cut.append([self.split(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
        if len(self.known) > MEMORY_WORDS // 2:
            self.known, self.older = {}, self.known
        fresh = {w for parts in cut for p in parts[::2] for w in p if w not in self.known}
        again = {w: self.older[w] for w in fresh if w in self.older}
        self.known |= again
        gc.disable()  # a trie is many small lists, none of which make cycles
        try:
            self.learn([w for w in fresh if w not in again])
        finally:
            gc.enable()
        found, known = [], self.known
        for parts in cut:
            found.append(b"".join(b"".join(map(known.__getitem__, p)) if i % 2 == 0 else np.array([self.special[p]], "<i4").tobytes() for i, p in enumerate(parts)))
        return found

    def decode_all(self, ids: list[list[int] | np.ndarray | None]) -> list[str]:
        """Texts of id lists; ids outside the vocabulary give nothing, broken UTF-8 gives U+FFFD."""
        pool, starts, sizes = self.pool
        found = []
        for one in ids:
            one = np.asarray(one if one is not None else (), np.int64)
            one = one[(one >= 0) & (one < len(starts))]
            size = sizes[one]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(one) else 0
            at = np.repeat(starts[one] - ends + size, size) + np.arange(total)
            found.append(pool[at].tobytes().decode("utf-8", "replace"))
        return found


_loaded: dict[str, ByteBpe] = {}


def vocabulary(definition: str) -> ByteBpe:
    """One vocabulary for each Python worker, so that known words last from batch to batch."""
    key = f"{len(definition)}:{hash(definition)}"
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(definition)
    return _loaded[key]


def _slices(batch: pa.RecordBatch, column: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text, a row at least."""
    values = batch.column(column)
    measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    sizes = [n or 0 for n in measure(values).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _add(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [column], names=[*keep, name])


def _vocabulary_of(df: DataFrame, definition_path: str):
    with open(definition_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a few MB: a vocabulary


def _encoded(bpe: ByteBpe, texts: list[str | None]) -> pa.ListArray:
    ids = bpe.encode_all(texts)
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def bpe_encode(df: DataFrame, definition_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add `out` (array<int>): the ids of the whole `text`."""
    definition = _vocabulary_of(df, definition_path)

    def run(batches):
        bpe = vocabulary(definition.value)
        for whole in batches:
            for batch in _slices(whole, text):
                yield _add(batch, out, _encoded(bpe, batch.column(text).to_pylist()))

    return df.mapInArrow(run, _with(df.schema, out, T.ArrayType(T.IntegerType())))


def bpe_decode(df: DataFrame, definition_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add `out` (string): the text of the id list `ids`, special tokens included."""
    definition = _vocabulary_of(df, definition_path)

    def run(batches):
        bpe = vocabulary(definition.value)
        for whole in batches:
            for batch in _slices(whole, ids):
                yield _add(batch, out, pa.array(bpe.decode_all(batch.column(ids).to_pylist()), pa.string()))

    return df.mapInArrow(run, _with(df.schema, out, T.StringType()))


def bpe_round_trip(df: DataFrame, definition_path: str, text: str = "text") -> DataFrame:
    """Replace `text` by ids and decoded in one pass: encoded, and decoded again from the ids alone."""
    definition = _vocabulary_of(df, definition_path)
    base = df.drop("ids", "decoded")
    schema = _with(_with(base.drop(text).schema, "ids", T.ArrayType(T.IntegerType())), "decoded", T.StringType())

    def run(batches):
        bpe = vocabulary(definition.value)
        for whole in batches:
            for batch in _slices(whole, text):
                ids = _encoded(bpe, batch.column(text).to_pylist())
                decoded = pa.array(bpe.decode_all(np.split(ids.values.to_numpy(), ids.offsets.to_numpy()[1:-1])), pa.string())
                yield _add(_add(batch, "ids", ids), "decoded", decoded).select([f.name for f in schema.fields])

    return base.mapInArrow(run, schema)


def bpe_digest(df: DataFrame, definition_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of whole texts, encoded and decoded again."""
    return bpe_round_trip(df.select("doc_id", "text"), definition_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
