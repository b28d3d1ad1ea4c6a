"""Language-model scores: a gated recurrent network with a class-factored softmax, in numpy.

Tokens are words of a text in lower case and an end. Spark counts the tokens of all learned documents;
these counts give the unigram base and the vocabulary. The `MODEL_WORDS` most frequent words have
vectors of their own and stand in classes of `CLASS_WORDS` by frequency; every other word belongs to
one of `KINDS` kinds by its last two bytes. The network predicts the class of the next token and,
in a class, the word; a word of a kind has its count's share of that kind, and one unseen word counts
as one token more, so that the probabilities of all tokens add up to one.

It is trained by truncated backpropagation on all tokens of all learned documents (on those of a
corpus of under `LEAST` tokens several times): tasks train a copy
each on their rows, and after each of `ROUNDS` rounds, each on its part of the documents, Spark adds the copies up to their mean, in
fixed-point numbers, so that no order of rows changes it. Documents are scored whole: rows of lanes
run in windows of `WINDOW` steps, the state is carried from window to window and cleared at an end.

The `HEAD_WORDS` most frequent words are broadcast with their counts; those of rarer words are joined.

Defined cases: null and empty texts hold the end only; a row without doc_id is scored, and learned if
the caller learns from it; repeated rows count and are scored each; texts of any length are scored
whole; without learned documents N is 0, the base score 0 and the score that of an untrained network;
an empty table gives no rows; columns that are not named in `keep` are not read, and of those named
none may be called as an added column.
"""

from __future__ import annotations

import heapq
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.bpe import _slices
from attesta.llm.columns import free_name
from attesta.session import cut

#: Words whose counts are broadcast, and the most bytes such a word has; the counts of all others are joined.
HEAD_WORDS, HEAD_BYTES = 131_072, 64
MODEL_WORDS, CLASS_WORDS, KINDS = 4096, 64, 32
EMBED, HIDDEN = 16, 24
WINDOW, TRAIN_LANES, SCORE_LANES = 32, 128, 512
#: Tokens from which on one pass over all is enough, passes over fewer at most, tokens of one task.
LEAST, MOST_PASSES, PART_TOKENS = 2_000_000, 5, 4_000_000
ROUNDS, RATE = 8, 0.01
#: Rows whose classes are predicted at once: their logits stay in a core's cache.
ROWS = 2_048
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000
#: The end of a text; no word holds white space.
END = b"\n"
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; for bytes, white space is \\x20 and \\x09 to \\x0D."""
    return (text or "").encode().lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """`words_of` of all texts, one after the other, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, stops = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.not_equal(found, "")  # white space at either end leaves an empty piece there
    return found.filter(full), np.diff(np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[stops])


def kind_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % KINDS


#: Kinds of words of one byte, and of those that end in two bytes (the first times 256, and the second).
_KIND_OF_ONE = np.array([kind_of(bytes([a])) for a in range(256)], np.int32)
_KIND_OF_TWO = np.array([kind_of(bytes([a, b])) for a in range(256) for b in range(256)], np.int32)


def kinds_of(words: pa.Array) -> np.ndarray:
    """`kind_of` of many words."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, offsets, data = words.buffers()
    stops = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    at, data = stops[1:] - 1, np.frombuffer(data, np.uint8)
    return np.where(np.diff(stops) > 1, _KIND_OF_TWO[data[at - 1].astype(np.int32) * 256 + data[at]], _KIND_OF_ONE[data[at]])


def kind_column(word: str = "word") -> Column:
    """`kind_of` as a column of a binary column."""
    n = F.length(word)
    return F.pmod(F.crc32(F.substring(F.col(word), F.greatest(n - 1, F.lit(1)), F.lit(2))), F.lit(KINDS)).cast("int")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(7)) == 2, F.lit(False))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word (binary) and n: how often each token stands in the texts, the end once a row."""

    def run(batches):
        held: list[pa.Table] = []

        def summed_up():
            both = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            held[:] = [pa.table([both["word"], both["n_sum"]], names=["word", "n"])]
            return held[0].num_rows

        def passed_on():
            summed_up()
            for batch in held.pop().to_batches(50_000):
                yield pa.RecordBatch.from_arrays([batch.column("word").cast(pa.binary()), batch.column("n")], names=["word", "n"])

        for whole in batches:
            for batch in _slices(whole, text, 4_000_000):
                counted = split_words(batch.column(text))[0].value_counts()
                held.append(pa.table([counted.field("values"), counted.field("counts")], names=["word", "n"]))
                held.append(pa.table([pa.array([END.decode()]), pa.array([batch.num_rows], pa.int64())], names=["word", "n"]))
                if sum(t.num_rows for t in held) > 2 * COUNTED and summed_up() > COUNTED:
                    yield from passed_on()
        if held:
            yield from passed_on()

    return df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def chosen(logits: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of the share of one column in each row, and each row's total; logits become their exponentials."""
    own = logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + which]
    if own.min(initial=0) < -60 or logits.max(initial=0) > 60:  # else no exponential or total runs over or vanishes
        top = logits.max(axis=1, keepdims=True)
        logits -= top
        own -= top[:, 0]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return own - np.log(total), total


def less_own(shares: np.ndarray, which: np.ndarray, total: np.ndarray, n: int) -> None:
    """From exponentials to the gradient of the mean of n losses: shares, less one for the column meant."""
    shares *= (1 / (total * n))[:, None]
    shares.ravel()[np.arange(0, shares.size, shares.shape[1]) + which] -= shares.dtype.type(1 / n)


class Network:
    """Tokens are numbers: the model's words by frequency, the end first, then the kinds."""

    def __init__(self, words: int, p: dict[str, np.ndarray]):
        self.words, self.p = words, p
        self.classes = -(-words // CLASS_WORDS)
        self.class_of = np.concatenate((np.arange(words) // CLASS_WORDS, self.classes + np.arange(KINDS)))

    @staticmethod
    def shapes(words: int) -> dict[str, tuple[int, ...]]:
        k = -(-words // CLASS_WORDS) + KINDS
        return {"emb": (words + KINDS, EMBED), "wx": (EMBED, 3 * HIDDEN), "bx": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, k), "bc": (k,), "wo": (words, HIDDEN), "bo": (words,)}

    @classmethod
    def started(cls, counts: np.ndarray, seed: int = 5) -> Network:
        """A network that predicts by frequency alone; counts: of each token number."""
        rng, words = np.random.default_rng(seed), len(counts) - KINDS
        net = cls(words, {k: np.zeros(s, np.float32) for k, s in cls.shapes(words).items()})
        for name, by in (("emb", EMBED), ("wx", EMBED), ("u", HIDDEN)):
            net.p[name] = (rng.normal(size=net.p[name].shape) / np.sqrt(by)).astype(np.float32)
        share = np.bincount(net.class_of, counts + 1.0)
        net.p["bc"] = np.log(share / share.sum()).astype(np.float32)
        net.p["bo"] = np.log((counts[:words] + 1.0) / share[net.class_of[:words]]).astype(np.float32)
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes(self.words)])

    @classmethod
    def of_flat(cls, words: int, flat: np.ndarray) -> Network:
        return cls(words, cls.parts(words, flat.astype(np.float32)))

    @classmethod
    def parts(cls, words: int, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters that lie in `flat`, without a copy."""
        p, at = {}, 0
        for name, shape in cls.shapes(words).items():
            n = math.prod(shape)
            p[name], at = flat[at : at + n].reshape(shape), at + n
        return p

    def run(self, vectors: np.ndarray, seen: np.ndarray, state: np.ndarray, saved: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """States of each step (steps x h x lanes) from those tokens, the state cleared where a token is an end.

        vectors: steps x lanes x EMBED; the state is h x lanes, so that each gate's values lie together.
        What `gradients` needs of all steps is put into `saved`.
        """
        h, kept, kind = HIDDEN, (seen != 0)[:, None, :].astype(vectors.dtype), vectors.dtype
        half = np.repeat(np.array([0.5, 1], kind), (2 * h, h))[:, None]  # sigmoid(x) is tanh(x / 2) / 2 + 1 / 2
        u = self.p["u"].T * half
        gates = np.matmul(self.p["wx"].T * half, vectors.transpose(0, 2, 1))
        gates += self.p["bx"][:, None] * half
        states, inner = np.empty((len(seen), h, len(seen[0])), kind), np.empty((3 * h, len(seen[0])), kind)
        before, own, change = np.empty_like(states[0]), inner[2 * h :], np.empty_like(states[0])
        if saved is not None:
            saved |= {"before": np.empty_like(states), "inner": np.empty_like(states), "z": gates[:, :h], "r": gates[:, h : 2 * h], "n": gates[:, 2 * h :], "kept": kept}
        for t in range(len(seen)):
            if saved is not None:
                before = saved["before"][t]
            np.multiply(state, kept[t], out=before)
            np.matmul(u, before, out=inner)
            zr, n = gates[t, : 2 * h], gates[t, 2 * h :]
            zr += inner[: 2 * h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[h:], own, out=change)
            n += change
            np.tanh(n, out=n)
            if saved is not None:
                saved["inner"][t] = own
            state = states[t]
            np.subtract(n, before, out=state)
            state *= zr[:h]
            state += before
        return states

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grad: dict[str, np.ndarray] | None = None):
        """Natural log probabilities of class and word for each row, and gradients of the states if asked.

        grad: gets the gradients of the mean loss for the output parameters. A column of ones stands beside the
        states, so that biases are weights as others. Words' rows lie class by class, and are all of one width.
        """
        p, n, h = self.p, len(targets), HIDDEN
        found, d_states = np.empty(n, states.dtype), None if grad is None else np.empty_like(states)
        with_one = np.empty((n, h + 1), states.dtype)
        with_one[:, :h], with_one[:, h] = states, 1
        of_class, of_word = np.vstack((p["wc"], p["bc"])), np.column_stack((p["wo"], p["bo"]))
        which = self.class_of[targets]
        d_class, d_word = (None, None) if grad is None else (np.zeros_like(of_class), np.zeros_like(of_word))
        for start in range(0, n, ROWS):
            rows = slice(start, start + ROWS)
            logits = with_one[rows] @ of_class
            found[rows], total = chosen(logits, which[rows])
            if grad is not None:
                less_own(logits, which[rows], total, n)
                d_class += with_one[rows].T @ logits
                np.matmul(logits, p["wc"].T, out=d_states[rows])
        order = np.argsort(targets.astype(np.uint16) if self.words + KINDS < 1 << 16 else targets, kind="stable")
        order = order[: np.searchsorted(targets, self.words, sorter=order)]
        own_targets, own_rows = targets[order], with_one[order]
        stops = np.searchsorted(own_targets, np.arange(1, self.classes + 1) * CLASS_WORDS).tolist()
        segments = [(a, b, k * CLASS_WORDS, min(self.words, (k + 1) * CLASS_WORDS)) for k, (a, b) in enumerate(zip([0, *stops], stops)) if b > a]  # noqa: B905
        logits = np.empty((len(order), CLASS_WORDS), states.dtype)
        for a, b, low, high in segments:
            np.matmul(own_rows[a:b], of_word[low:high].T, out=logits[a:b, : high - low])
            logits[a:b, high - low :] = -1e30  # words that the last class lacks
        own, total = chosen(logits, own_targets % CLASS_WORDS)
        found[order] += own
        if grad is not None:
            less_own(logits, own_targets % CLASS_WORDS, total, n)
            d_rows = np.empty((len(order), h), states.dtype)
            for a, b, low, high in segments:
                part = logits[a:b, : high - low]
                np.matmul(part.T, own_rows[a:b], out=d_word[low:high])
                np.matmul(part, p["wo"][low:high], out=d_rows[a:b])
            d_states[order] += d_rows
            grad |= {"wc": d_class[:h], "bc": d_class[h], "wo": d_word[:, :h], "bo": d_word[:, h]}
        return found, d_states

    def gradients(self, seen: np.ndarray, targets: np.ndarray, state: np.ndarray):
        """Mean loss, gradients and last state (lanes x h) of one window; both arrays are steps x lanes."""
        p, h, saved, grad = self.p, HIDDEN, {}, {}
        vectors = p["emb"][seen]
        states = self.run(vectors, seen, state.T, saved)
        logp, d_flat = self.log_probs(states.transpose(0, 2, 1).reshape(-1, h), targets.ravel(), grad)
        d_states = np.ascontiguousarray(d_flat.reshape(*seen.shape, h).transpose(0, 2, 1))
        # what each gate adds to the state, for all steps at once; only what comes from later steps goes step by step
        before, z, r, n, kept = (saved[k] for k in ("before", "z", "r", "n", "kept"))
        keep, by_n = 1 - z, (1 - n * n) * z
        by_z, by_r, by_nr = (n - before) * z * keep, saved["inner"] * r * (1 - r) * by_n, by_n * r
        d_inner, carry, back = np.empty((len(seen), 3 * h, len(seen[0])), states.dtype), np.zeros_like(states[0]), p["u"]
        for t in range(len(seen) - 1, -1, -1):
            d, own = d_states[t], d_inner[t]
            d += carry
            np.multiply(d, by_z[t], out=own[:h])
            np.multiply(d, by_r[t], out=own[h : 2 * h])
            np.multiply(d, by_nr[t], out=own[2 * h :])
            np.matmul(back, own, out=carry)
            keep[t] *= d
            carry += keep[t]
            carry *= kept[t]
        by_lane = d_inner.transpose(0, 2, 1)
        grad["u"] = np.matmul(before, by_lane).sum(axis=0)
        np.multiply(d_states, by_n, out=d_inner[:, 2 * h :])
        d_vectors = np.matmul(by_lane, p["wx"].T)
        places = seen.reshape(-1, 1) * EMBED + np.arange(EMBED)
        d_emb = np.bincount(places.ravel(), d_vectors.ravel(), p["emb"].size).astype(states.dtype)
        grad |= {"wx": np.matmul(vectors.transpose(0, 2, 1), by_lane).sum(axis=0), "bx": d_inner.sum(axis=(0, 2)), "emb": d_emb.reshape(p["emb"].shape)}
        return -float(logp.mean()), grad, states[-1].T

    def train(self, ids: np.ndarray, rate: float, lanes: int = TRAIN_LANES) -> None:
        """One pass of truncated backpropagation over texts that lie one after the other, each with its end.

        No token is left out: the last lane is filled up with the first tokens again.
        """
        if not len(ids):
            return
        lanes = max(1, min(lanes, len(ids) // (4 * WINDOW)))
        length = -(-len(ids) // lanes)
        ids = np.resize(ids, lanes * length)
        targets = ids.reshape(lanes, length).T
        seen = np.concatenate(([0], ids[:-1])).reshape(lanes, length).T
        state, names = np.zeros((lanes, HIDDEN), np.float32), list(self.shapes(self.words))
        flat = self.flat()
        self.p = Network.parts(self.words, flat)
        first, second, move = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        for step, start in enumerate(range(0, length, WINDOW), 1):
            _, grad, state = self.gradients(seen[start : start + WINDOW], targets[start : start + WINDOW], state)
            g = np.concatenate([grad[k].ravel() for k in names])
            g *= min(1.0, 1 / (math.sqrt(float(g @ g)) + 1e-9))
            np.subtract(g, first, out=move)
            move *= 0.1
            first += move
            g *= g
            g -= second
            g *= 0.01
            second += g
            np.divide(second, 1 - 0.99**step, out=move)
            np.sqrt(move, out=move)
            move += 1e-7
            np.divide(first, move, out=move)
            move *= rate / (1 - 0.9**step)
            flat -= move

    def text_scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text (token numbers, the end last): of classes, and of words in them."""
        if not texts:
            return np.zeros(0)
        lanes: list[list[int]] = [[] for _ in range(min(SCORE_LANES, len(texts)))]
        long_first = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        load = [(0, k) for k in range(len(lanes))]
        for i in long_first:  # each text goes to the shortest lane
            size, k = heapq.heappop(load)
            lanes[k].append(i)
            heapq.heappush(load, (size + len(texts[i]), k))
        sizes = np.array([sum(len(texts[i]) for i in lane) for lane in lanes])
        by_size = np.argsort(-sizes, kind="stable")
        order = [i for k in by_size for i in lanes[k]]
        sizes = sizes[by_size]
        starts = np.cumsum(sizes) - sizes
        ids = np.concatenate([texts[i] for i in order])
        before = np.concatenate(([0], ids[:-1]))  # a text begins after an end
        found, state = np.zeros(len(ids), np.float32), np.zeros((HIDDEN, len(lanes)), np.float32)
        for at in range(0, int(sizes[0]), WINDOW):
            open_ = int(np.searchsorted(-sizes, -at))  # lanes that are longer than `at`
            live = at + np.arange(WINDOW)[:, None] < sizes[:open_]
            places = np.where(live, starts[:open_] + at + np.arange(WINDOW)[:, None], 0)
            states = self.run(self.p["emb"][before[places]], before[places], state[:, :open_])
            state = states[-1]
            rows = live.ravel()
            where = places.ravel()[rows]
            found[where] = self.log_probs(states.transpose(0, 2, 1).reshape(-1, HIDDEN)[rows], ids[where])[0]
        ends = np.cumsum([len(texts[i]) for i in order])
        sums = np.zeros(len(texts))
        sums[order] = np.diff(np.cumsum(found, dtype=np.float64)[ends - 1], prepend=0)
        return sums


@dataclass
class Fitted:
    """What is learned: word, n of all tokens as a table; the head's words and counts; the network."""

    counts: DataFrame
    words: list[bytes]
    head_counts: np.ndarray
    tokens: int
    distinct: int
    kind_totals: np.ndarray
    network: Network


def head_threshold(counts: DataFrame, most: int) -> int:
    """The least of some counts that no more than `most` words of up to HEAD_BYTES reach; numbers of words by
    the leading four bits of their count are all that comes to the driver."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin("n")) - 4, F.lit(0))).cast("long")
    bands = counts.where(F.length("word") <= HEAD_BYTES).groupBy((F.col("n") - F.col("n") % step).alias("band")).agg(F.count("*").alias("words"), F.max("n").alias("top")).orderBy(F.desc("band")).collect()
    least, total = (bands[0].top + 1 if bands else 1), 0
    for band, words, _ in bands:
        total += words
        if total > most:
            break
        least = band
    return least


def numbered(words: list[bytes], network_words: int) -> tuple[pa.Array, np.ndarray]:
    """Head words by place, and the token number of each place."""
    return pa.array(words, pa.binary()).cast(pa.string()), np.array([i if i < network_words else network_words + kind_of(w) for i, w in enumerate(words)], np.int32)


def token_ids(texts: pa.Array, head: pa.Array, number: np.ndarray, network_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of all texts, one after the other, each with its end: places in the head (-1: none) and token numbers;
    where each text starts, and the words without a place."""
    words, sizes = split_words(texts)
    found = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy()
    rarer = words.filter(pa.array(found < 0))
    ids = number[found]
    ids[found < 0] = network_words + kinds_of(rarer)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    places, numbers = np.zeros(starts[-1], np.int64), np.zeros(starts[-1], np.int32)
    places[inside], numbers[inside] = found, ids
    return places, numbers, starts, rarer


def fit(df: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Fitted:
    """Counts and network of the texts of `df`."""
    counts = cut(word_counts(df, text))
    by_kind = counts.groupBy(kind_column().alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    tokens, distinct = (sum(r[c] for r in by_kind) for c in ("n", "words"))
    head = counts.where((F.col("n") >= head_threshold(counts, HEAD_WORDS)) & (F.length("word") <= HEAD_BYTES) & (F.col("word") != F.lit(END))).toArrow()
    found = sorted(zip(head["n"].to_pylist(), head["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    ends = counts.where(F.col("word") == F.lit(END)).first()
    words = [END, *(w for _, w in found)]  # the end is token 0
    head_counts = np.array([ends.n if ends else 0, *(n for n, _ in found)], np.int64)
    model_words = min(MODEL_WORDS, len(words))
    totals = np.zeros((KINDS, 2), np.int64)
    for r in by_kind:
        totals[r.kind] = r.n, r.words
    for w, n in zip(words[:model_words], head_counts.tolist(), strict=False):
        totals[kind_of(w)] -= n, int(n > 0)
    net = Network.started(np.concatenate((head_counts[:model_words], totals[:, 0])))
    fitted = Fitted(counts, words, head_counts, tokens, distinct, totals, net)
    return trained(df, fitted, text, rounds) if tokens else fitted


def trained(df: DataFrame, fitted: Fitted, text: str, rounds: int) -> Fitted:
    """`fitted` with its network trained on all texts of `df`."""
    passes = min(MOST_PASSES, max(1.0, LEAST / fitted.tokens))
    parts = max(1, round(fitted.tokens / PART_TOKENS))
    context, size = df.sparkSession.sparkContext, fitted.network.words
    shared = context.broadcast((fitted.words, size))  # HEAD_WORDS words of HEAD_BYTES at most
    slot = F.pmod(F.xxhash64("doc_id", F.length(text)) if "doc_id" in df.columns else F.xxhash64(text), F.lit(1 << 20)).cast("int")

    def encode(batches):
        head, number = numbered(*shared.value)
        for whole in batches:
            for batch in _slices(whole, "text", 4_000_000):
                if batch.num_rows:
                    _, numbers, starts, _ = token_ids(batch.column("text"), head, number, shared.value[1])
                    ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(numbers))
                    yield pa.RecordBatch.from_arrays([batch.column("slot"), ids], names=["slot", "ids"])

    encoded = cut(df.select(slot.alias("slot"), F.col(text).alias("text")).mapInArrow(encode, "slot int, ids array<int>").repartition(parts))
    flat = fitted.network.flat()
    for turn in range(rounds):
        current = context.broadcast(flat)
        rate = RATE * (1 - 0.9 * turn / rounds)

        def learn(batches, current=current, rate=rate):
            mine = [b.column("ids").flatten().to_numpy() for b in batches if b.num_rows]
            if mine:
                net = Network.of_flat(size, current.value)
                net.train(np.concatenate(mine), rate)
                yield summed_row(np.rint(net.flat().astype(np.float64) * 2.0**32).astype(np.int64), 1)

        own = encoded.where((F.col("slot") + turn) % rounds < passes).select("ids")  # each row is in as many rounds as there are passes
        copies, n = own.mapInArrow(learn, "total binary, n long"), parts
        while n > 8:  # a tree of sums, eight copies to a task
            n = -(-n // 8)
            copies = copies.repartition(n).mapInArrow(add_up, "total binary, n long")
        found = copies.repartition(1).mapInArrow(add_up, "total binary, n long").collect()
        if found:
            flat = (np.frombuffer(found[0].total, np.int64) / 2.0**32 / found[0].n).astype(np.float32)
        current.unpersist()
    fitted.network = Network.of_flat(size, flat)
    return fitted


def summed_row(total: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["total", "n"])


def add_up(batches):
    """The sum of all rows of total and n; none gives none."""
    total, n = None, 0
    for batch in batches:
        for t, k in zip(batch.column("total"), batch.column("n").to_pylist(), strict=True):
            row = np.frombuffer(t.as_buffer(), np.int64)
            total, n = (row.copy() if total is None else total + row), n + k
    if total is not None:
        yield summed_row(total, n)


def score(df: DataFrame, fitted: Fitted, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` of `df` with n_tokens, n_known, train_tokens, base_score and score of its texts.

    base_score: log10 of the unigram probability with one added to each count; score: that of the network.
    """
    net, tokens, distinct = fitted.network, fitted.tokens, fitted.distinct
    context = df.sparkSession.sparkContext
    shared = context.broadcast((fitted.words, fitted.head_counts, net.words, net.flat(), fitted.kind_totals))
    body, row, rare = (free_name(n, [*keep, *ADDED]) for n in ("text_", "row_", "rare_"))
    base = df.select(*keep, F.col(text).alias(body))
    fields = [T.StructField(n, k) for n, k in zip((*ADDED[:2], *ADDED[3:], rare), (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.StringType()), strict=True)]
    schema = T.StructType([*base.drop(body).schema.fields, *fields])

    def run(batches):
        words, head_counts, size, flat, totals = shared.value
        head, number = numbered(words, size)
        net = Network.of_flat(size, flat)
        base_log = np.log10((head_counts + 1) / (tokens + distinct + 1))
        of_kind = totals.sum(axis=1) + 1
        own_log = np.where(number < size, 0.0, np.log10((head_counts + 1) / of_kind[np.maximum(number - size, 0)]))
        known = (head_counts > 0).astype(np.int64)
        for whole in batches:
            for batch in _slices(whole, body, 16_000_000):
                places, numbers, starts, rarer = token_ids(batch.column(body), head, number, size)
                sizes, missing = np.diff(starts), places < 0
                of_text = np.repeat(np.arange(len(sizes)), sizes)
                summed = lambda values, of_text=of_text, sizes=sizes, places=places, missing=missing: np.bincount(of_text, np.where(missing, 0, values[places]), len(sizes))
                n_missing = np.bincount(of_text, missing, len(sizes)).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_missing))), pa.int32()), rarer)
                rest = pc.if_else(pa.array(n_missing > 0), pc.binary_join(lists, " "), None)
                scores = net.text_scores(np.split(numbers, starts[1:-1])) / math.log(10) + summed(own_log) if len(sizes) else np.zeros(0)
                columns = [pa.array(sizes, pa.int64()), pa.array(summed(known).astype(np.int64)), pa.array(summed(base_log)), pa.array(scores), rest]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *columns], names=schema.names)

    seen = cut(base.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()))
    # the counts of words outside the head come by a join; such words are in no hot group of learned texts
    head = (F.col("n") >= int(fitted.head_counts[1:].min()) if len(fitted.head_counts) > 1 else F.lit(False)) & (F.length("word") <= HEAD_BYTES)
    rarer = fitted.counts.where(~head)
    places = seen.where(F.col(rare).isNotNull()).select(F.col(row), F.explode(F.split(rare, " ").cast("array<binary>")).alias("word"))
    n = F.coalesce("n", F.lit(0)) + 1
    of_kind = F.element_at(F.array(*(F.lit(int(t)) for t in fitted.kind_totals.sum(axis=1) + 1)), kind_column() + 1)
    sums = places.join(rarer, "word", "left").groupBy(row).agg(F.count("n").alias("k"), F.sum(F.log10(n / F.lit(tokens + distinct + 1))).alias("b"), F.sum(F.log10(n / of_kind)).alias("s"))
    extra = sums.select(row, *(F.col(a).alias(free_name(f"{a}_", [*keep, *ADDED, body, row, rare])) for a in "kbs"))
    k, b, s = extra.columns[1:]
    more = lambda name, by: (F.col(name) + F.coalesce(by, F.lit(0))).alias(name)
    return seen.join(extra, row, "left").select(*keep, "n_tokens", more("n_known", k), F.lit(tokens).cast("long").alias("train_tokens"), more("base_score", b), more("score", s))


def lm_scores(df: DataFrame) -> DataFrame:
    """doc_id, held_out and the scores of every row, learned from the rows that are not held out."""
    docs = df.select("doc_id", "text", held_out().alias("held_out"))
    return score(docs, fit(docs.where("not held_out")), ("doc_id", "held_out"))
