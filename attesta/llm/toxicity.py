"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each distinct word is read letter by letter by a small two-way GRU; its end states and a
hashed word vector are the word's input. A two-way GRU reads windows of words, attention
pools its states, and a linear layer gives the window's logit. Windows overlap by half and
cover the whole text; a document scores as its worst window.

The network is trained on a bounded sample of labelled documents (`TOXIC` and `CLEAN` rows of
at most `TRAIN_CHARS` characters, those with the smallest hash of their id), by documents:
the logit is a soft maximum over windows, so no window needs a label. It is fitted once for
each call on the driver and shared as a few hundred KB; scoring runs in tasks.

Defined cases: null and empty texts, and texts without letters or digits, score 0; words
longer than PIECE letters are read in pieces, none is cut off; without labels of both kinds
every document scores 0; repeated rows are scored alike; of several labels of one document
the highest counts; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.bpe import _add
from attesta.llm.quality import held_out

WINDOW, STRIDE = 24, 12
PIECE = 16
LETTERS, WORDS = 512, 1 << 13
LETTER_DIM, LETTER_HIDDEN, WORD_DIM, HIDDEN = 8, 8, 8, 8
TOXIC, CLEAN, TRAIN_CHARS = 1_000, 3_600, 5_000
EPOCHS, RATE, LEAST_STEPS = 5, 0.01, 600
#: Distinct words that a worker remembers.
MEMORY_WORDS = 200_000
THRESHOLD = 0.7

_WORD = re.compile(rf"[^\W_]{{1,{PIECE}}}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def letters(words: list[str]) -> np.ndarray:
    """Letter numbers of words, padded with 0 to the longest."""
    most = max(map(len, words), default=1)
    data = np.array([w.ljust(most, "\0") for w in words], dtype=f"<U{most}").view(np.uint32).reshape(-1, most)
    return np.where(data == 0, 0, 1 + data % (LETTERS - 1)).astype(np.int32)


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the sum of those rows whose number in `at` is its own."""
    order = np.argsort(at, kind="stable")
    numbers = at[order]
    first = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1])))
    found = np.zeros((n, rows.shape[1]), rows.dtype)
    found[numbers[first]] = np.add.reduceat(rows[order], first, axis=0)
    return found


def windows_of(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the windows of texts that lie one after the other, and the text of each."""
    starts, sizes, texts = [], [], []
    base = 0
    for i, n in enumerate(lengths):
        at = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, int)
        starts.append(base + at)
        sizes.append(np.minimum(WINDOW, n - at))
        texts.append(np.full(len(at), i))
        base += n
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, sizes, texts))


class Gru:
    """Both directions of a gated recurrent layer; gates are stacked as update, reset, candidate."""

    def __init__(self, hidden: int):
        self.h = hidden

    def forward(self, x: np.ndarray, u: np.ndarray, live: np.ndarray, keep: bool = False):
        """x: steps x rows x 3h inputs; u: h x 3h; live: steps x rows. States of each step, last first kept."""
        h, state, states, saved = self.h, np.zeros((x.shape[1], self.h), np.float32), [], []
        for t in range(x.shape[0]):
            inner = state @ u
            gates = sigmoid(x[t, :, : 2 * h] + inner[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * inner[:, 2 * h :])
            move = z * live[t][:, None]
            if keep:
                saved.append((state, z, r, n, inner[:, 2 * h :]))
            state = state + move * (n - state)
            states.append(state)
        return np.stack(states), saved

    def backward(self, d_states: np.ndarray, saved: list, u: np.ndarray, live: np.ndarray):
        """Gradients of inputs and of u for those of the states of each step."""
        h, dx, du = self.h, np.zeros((*d_states.shape[:2], 3 * self.h), np.float32), np.zeros_like(u)
        carry = np.zeros_like(d_states[0])
        for t in range(len(saved) - 1, -1, -1):
            state, z, r, n, inner = saved[t]
            d = carry + d_states[t]
            on = live[t][:, None]
            dn = d * z * on * (1 - n * n)
            dz = d * on * (n - state) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            d_inner = np.concatenate((dz, dr, dn * r), axis=1)
            dx[t] = np.concatenate((dz, dr, dn), axis=1)
            du += state.T @ d_inner
            carry = d * (1 - z * on) + d_inner @ u.T
        return dx, du


class Network:
    """Parameters as a dict of arrays, so that they travel and train plainly."""

    def __init__(self, p: dict[str, np.ndarray] | None = None, seed: int = 3):
        if p is None:
            rng = np.random.default_rng(seed)
            draw = lambda *s, by=None: (rng.normal(size=s) / np.sqrt(by or s[0])).astype(np.float32)
            wide = 2 * LETTER_HIDDEN + WORD_DIM
            p = {"letters": draw(LETTERS, LETTER_DIM, by=LETTER_DIM), "words": draw(WORDS, WORD_DIM, by=4 * WORD_DIM)}
            for d in ("f", "b"):
                p |= {f"cw{d}": draw(LETTER_DIM, 3 * LETTER_HIDDEN), f"cu{d}": draw(LETTER_HIDDEN, 3 * LETTER_HIDDEN), f"cb{d}": np.zeros(3 * LETTER_HIDDEN, np.float32)}
                p |= {f"w{d}": draw(wide, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
            p |= {"att": draw(2 * HIDDEN, HIDDEN), "att_v": draw(HIDDEN, 1), "out": draw(2 * HIDDEN, 1), "bias": np.full(1, -1, np.float32)}
        self.p, self.inner, self.outer = p, Gru(LETTER_HIDDEN), Gru(HIDDEN)

    def word_inputs(self, chars: np.ndarray, buckets: np.ndarray, keep: bool = False):
        """Inputs of the word layer (words x wide) from letters and word buckets."""
        p = self.p
        live = (chars > 0).T.astype(np.float32)
        embedded = p["letters"][chars.T]
        ff, sf = self.inner.forward(embedded @ p["cwf"] + p["cbf"], p["cuf"], live, keep)
        fb, sb = self.inner.forward(embedded[::-1] @ p["cwb"] + p["cbb"], p["cub"], live[::-1], keep)
        return np.concatenate((ff[-1], fb[-1], p["words"][buckets]), axis=1), (live, embedded, sf, sb, len(ff))

    def gate_inputs(self, vectors: np.ndarray) -> np.ndarray:
        """What each word brings to the gates of both directions: words x 6h."""
        p = self.p
        return np.concatenate((vectors @ p["wf"] + p["bf"], vectors @ p["wb"] + p["bb"]), axis=1).astype(np.float32)

    def window_logits(self, gates: np.ndarray, words: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logits of windows; words: steps x windows rows of gates."""
        p, g = self.p, 3 * HIDDEN
        fwd, sf = self.outer.forward(gates[:, :g][words], p["uf"], live, keep)
        bwd, sb = self.outer.forward(gates[:, g:][words[::-1]], p["ub"], live[::-1], keep)
        states = np.concatenate((fwd, bwd[::-1]), axis=2)
        look = np.tanh(states @ p["att"])
        weight = np.exp((look @ p["att_v"])[..., 0]) * live
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (states * weight[..., None]).sum(axis=0)
        return (pooled @ p["out"])[:, 0] + p["bias"][0], (sf, sb, states, look, weight, pooled)

    def gradients(self, chars, buckets, words, live, doc, n_docs, y, sharp: float = 2.0):
        """Loss and gradients for windows of documents with labels y; doc is sorted."""
        p, g = self.p, 3 * HIDDEN
        vectors, (c_live, embedded, csf, csb, steps) = self.word_inputs(chars, buckets, True)
        gates = self.gate_inputs(vectors)
        logit, (sf, sb, states, look, weight, pooled) = self.window_logits(gates, words, live, True)
        # soft maximum over the windows of a document
        starts = np.searchsorted(doc, np.arange(n_docs))
        top = np.maximum.reduceat(logit, starts)
        share = np.exp(sharp * (logit - top[doc]))
        share /= np.add.reduceat(share, starts)[doc]
        total = np.add.reduceat(share * logit, starts)
        prob = sigmoid(total)
        loss = -np.mean(np.where(y, np.log(prob + 1e-7), np.log(1 - prob + 1e-7)))
        d_logit = (((prob - y) / n_docs)[doc] * share).astype(logit.dtype)
        grad = {"bias": np.array([d_logit.sum()]), "out": pooled.T @ d_logit[:, None]}
        d_pooled = d_logit[:, None] * p["out"][:, 0]
        d_weight = (states * d_pooled[None]).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_look = d_score[..., None] * p["att_v"][:, 0] * (1 - look**2)
        grad |= {"att_v": np.einsum("tnh,tn->h", look, d_score)[:, None], "att": states.reshape(-1, 2 * HIDDEN).T @ d_look.reshape(-1, HIDDEN)}
        d_states = weight[..., None] * d_pooled[None] + d_look @ p["att"].T
        dxf, grad["uf"] = self.outer.backward(d_states[..., :HIDDEN], sf, p["uf"], live)
        dxb, grad["ub"] = self.outer.backward(d_states[::-1, :, HIDDEN:], sb, p["ub"], live[::-1])
        d_gates = summed(np.concatenate((dxf, dxb[::-1]), axis=2).reshape(-1, 2 * g), words.ravel(), len(gates))
        d_gates[0] = 0
        grad |= {"wf": vectors.T @ d_gates[:, :g], "wb": vectors.T @ d_gates[:, g:], "bf": d_gates[:, :g].sum(axis=0), "bb": d_gates[:, g:].sum(axis=0)}
        d_vec = d_gates[:, :g] @ p["wf"].T + d_gates[:, g:] @ p["wb"].T
        h = LETTER_HIDDEN
        grad["words"] = summed(d_vec[:, 2 * h :], buckets, WORDS)
        d_embedded = np.zeros_like(embedded)
        for d, saved, part, turn in (("f", csf, d_vec[:, :h], 1), ("b", csb, d_vec[:, h : 2 * h], -1)):
            ends = np.zeros((steps, len(chars), h), np.float32)
            ends[-1] = part
            dx, grad[f"cu{d}"] = self.inner.backward(ends, saved, p[f"cu{d}"], c_live[::turn])
            grad[f"cw{d}"] = embedded[::turn].reshape(-1, LETTER_DIM).T @ dx.reshape(-1, 3 * h)
            grad[f"cb{d}"] = dx.sum(axis=(0, 1))
            d_embedded += (dx @ p[f"cw{d}"].T)[::turn]
        grad["letters"] = summed(d_embedded.reshape(-1, LETTER_DIM), chars.T.ravel(), LETTERS)
        grad["letters"][0] = 0
        return loss, grad


def batch_of(texts: list[list[str]], number: dict[str, int]):
    """Word numbers (steps x windows, 0 where no word is), live steps and the text of each window."""
    flat = np.fromiter((number[w] for t in texts for w in t), np.int64)
    starts, sizes, doc = windows_of([len(t) for t in texts])
    at = starts[None] + np.arange(WINDOW)[:, None]
    live = np.arange(WINDOW)[:, None] < sizes[None]
    words = np.where(live, flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else 0, 0)
    return words, live.astype(np.float32), doc


def train(texts: list[str], labels: list[int], seed: int = 3) -> Network | None:
    """A network for documents and their labels; None without labels of both kinds."""
    found = [(w, y) for w, y in ((words_of(t), y) for t, y in zip(texts, labels, strict=True)) if w]
    if len({y for _, y in found}) < 2:
        return None
    net, rng = Network(seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, per = 0, 48
    epochs = max(EPOCHS, -(-LEAST_STEPS * per // len(found)))
    for epoch in range(epochs):
        order = rng.permutation(len(found))
        rate, sharp = RATE * (1 - 0.9 * epoch / epochs), 2.0 + 6.0 * epoch / epochs  # nearer and nearer to the highest window
        for start in range(0, len(order), per):
            chosen = [found[i] for i in order[start : start + per]]
            distinct = ["", *{w for t, _ in chosen for w in t}]
            number = {w: i for i, w in enumerate(distinct)}
            words, live, doc = batch_of([t for t, _ in chosen], number)
            _, grad = net.gradients(letters(distinct), np.array([word_bucket(w) for w in distinct]), words, live, doc, len(chosen), np.array([y for _, y in chosen], bool), sharp)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            step += 1
            for k, g in grad.items():
                g = g * min(1.0, 1 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.p[k] = (net.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


class Scorer:
    """Scores whole texts; what each distinct word brings to the gates is worked out once."""

    def __init__(self, net: Network):
        self.net, self.number, self.size = net, {}, 0
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def learn(self, words: list[str]) -> None:
        fresh = [w for w in set(words) if w not in self.number]
        if self.size == 0 or self.size + len(fresh) > MEMORY_WORDS:
            self.number, self.size, fresh = {}, 1, list(set(words))  # row 0 stands for no word
        if self.size + len(fresh) > len(self.gates):
            grown = np.zeros((2 * (self.size + len(fresh)), self.gates.shape[1]), np.float32)
            grown[: self.size] = self.gates[: self.size]
            self.gates = grown
        fresh.sort(key=len)
        for start in range(0, len(fresh), 8192):
            part = fresh[start : start + 8192]
            vectors, _ = self.net.word_inputs(letters(part), np.array([word_bucket(w) for w in part]))
            self.gates[self.size : self.size + len(part)] = self.net.gate_inputs(vectors)
            self.number.update(zip(part, range(self.size, self.size + len(part)), strict=True))
            self.size += len(part)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest probability among the windows of each text."""
        split = [words_of(t) for t in texts]
        self.learn([w for t in split for w in t])
        words, live, doc = batch_of(split, self.number)
        found = np.zeros(len(texts))
        for start in range(0, len(doc), 2048):
            part = slice(start, start + 2048)
            logit, _ = self.net.window_logits(self.gates, words[:, part], live[:, part])
            np.maximum.at(found, doc[part], sigmoid(logit.astype(np.float64)))
        return found


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded sample."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    # ids are chosen by lengths alone; texts move only for the sample, one for each id
    short = docs.where(F.length("text").between(1, TRAIN_CHARS)).select("doc_id").distinct().join(marked, "doc_id")
    part = lambda y, n: short.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(part(1, toxic).unionByName(part(0, clean)))  # `toxic` + `clean` rows
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, TRAIN_CHARS)).join(chosen, "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "toxic").toArrow().to_pydict()
    return rows["text"], rows["toxic"]


def score_toxicity(df: DataFrame, labels: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """`df` with score and predicted, which replace columns of these names.

    labels: doc_id and toxic; docs: where labelled texts stand, `df` by default.
    """
    net = train(*training_rows(df if docs is None else docs, labels))
    shared = df.sparkSession.sparkContext.broadcast(None if net is None else net.p)
    base = df.drop("score", "predicted")
    schema = T.StructType(base.schema.fields + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        scorer = None if shared.value is None else Scorer(Network(shared.value))
        for whole in batches:
            for batch in text_slices(whole):
                texts = batch.column("text").to_pylist()
                score = np.zeros(len(texts)) if scorer is None else scorer.scores(texts)
                yield _add(_add(batch, "score", pa.array(score)), "predicted", pa.array((score >= THRESHOLD).astype(np.int32)))

    return base.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch):
    from attesta.llm.bpe import _slices

    return _slices(batch, "text", 1_000_000)
