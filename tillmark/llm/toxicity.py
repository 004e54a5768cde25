"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A text is its words; a word comes in twice, as a hashed embedding of itself and as the mean of hashed embeddings of its
character n-grams, so that spellings never met share what their parts share. Windows of WINDOW words, each overlapping the
next by half, run through a forward and a backward recurrent layer; attention weighs the positions; the score of a window
is a probability and the score of a document the highest of all its windows. Every window of the whole text is scored.

Training uses a bounded sample of labelled rows (SAMPLE per label, the first in an order hashed from doc_id, of texts up to
SAMPLE_CHARS characters), on the driver, with fixed seeds. A document's label is that of its highest window, so training
alternates between picking windows with the current network and learning from them. Scoring runs in tasks; what a word
adds to the gates is worked out once per worker and word.

Null and empty texts count as a window without words and get a score like any other. Without labels of both kinds every
score is the share of label 1 (0 without any label). Repeated rows get equal scores; an empty table an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map, texts_of, whole_text

#: Sampled rows per label, and the longest text among them.
SAMPLE, SAMPLE_CHARS = 1000, 20_000
#: Words of a window, hashed embeddings of words and of character n-grams, their width, width of a recurrent layer.
WINDOW, WORD_ROWS, GRAM_ROWS, WIDTH, HIDDEN = 48, 1 << 14, 1 << 13, 12, 12
#: Windows that are scored at once, and words whose gates a worker keeps.
BATCH, KEPT_WORDS = 2048, 150_000
#: Rounds of picking windows, steps of a round, windows of a step, rate of learning.
ROUNDS, STEPS, STEP_WINDOWS, RATE = 4, 120, 128, 0.01

words_of = re.compile(r"\w+").findall


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def buckets(word: str) -> tuple[int, list[int]]:
    marked = f"<{word}>"
    grams = [zlib.crc32(marked[i : i + n].encode()) % GRAM_ROWS for n in (3, 5) for i in range(max(1, len(marked) - n + 1))]
    return zlib.crc32(word.encode()) % WORD_ROWS, grams


class Words:
    """Distinct words as numbers; number 0 is the place behind the end of a text."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[int] = [0]
        self.grams: list[list[int]] = [[0]]

    def read(self, text: str) -> np.ndarray:
        found = words_of(text.lower())
        try:
            return np.fromiter(map(self.number.__getitem__, found), dtype=np.int64, count=len(found))
        except KeyError:  # a word not met before
            pass
        for word in dict.fromkeys(found):
            if word not in self.number:
                self.number[word] = len(self.rows)
                row, grams = buckets(word)
                self.rows.append(row)
                self.grams.append(grams)
        return np.fromiter(map(self.number.__getitem__, found), dtype=np.int64, count=len(found))


def windows(numbers: np.ndarray) -> np.ndarray:
    """All windows of a text as rows; the last begins where less than half a window is left unseen."""
    half = WINDOW // 2
    count = max(1, -(-(len(numbers) - half) // half))
    padded = np.zeros((count + 1) * half, dtype=np.int64)
    padded[: len(numbers)] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::half]


class Network:
    def __init__(self, seed: int = 3):
        rnd = np.random.default_rng(seed)
        h, x = HIDDEN, 2 * WIDTH
        draw = lambda *shape, by: rnd.normal(0, by, shape).astype(np.float32)
        self.p = {"words": draw(WORD_ROWS, WIDTH, by=0.3), "grams": draw(GRAM_ROWS, WIDTH, by=0.3)}
        for d in "fb":
            self.p[f"W{d}"], self.p[f"U{d}"] = draw(x, 3 * h, by=x**-0.5), draw(h, 3 * h, by=h**-0.5)
            self.p[f"B{d}"] = np.zeros(3 * h, np.float32)
        self.p |= {"A": draw(2 * h, h, by=0.2), "a": np.zeros(h, np.float32), "v": draw(h, by=0.3)}
        self.p |= {"w": draw(2 * h, by=0.3), "b": np.zeros(1, np.float32)}

    def vectors(self, rows: list[int], grams: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        flat = np.fromiter(chain.from_iterable(grams), np.int64, sizes.sum())
        parts = np.add.reduceat(self.p["grams"][flat], np.cumsum(sizes) - sizes) / sizes.astype(np.float32)[:, None]
        return np.hstack([self.p["words"][rows], parts])

    def gates(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors @ self.p["Wf"] + self.p["Bf"], vectors @ self.p["Wb"] + self.p["Bb"]

    def layer(self, d: str, gates: np.ndarray, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction for windows in columns, ``ids[position, window]``."""
        if keep is None:
            return self._states(d, gates, ids)
        h, u = HIDDEN, self.p[f"U{d}"]
        state = np.zeros((ids.shape[1], h), np.float32)
        out = np.empty((len(ids), ids.shape[1], h), np.float32)
        for t in range(len(ids)) if d == "f" else reversed(range(len(ids))):
            inside = (ids[t] > 0).astype(np.float32)[:, None]
            into, again = gates[ids[t]], state @ u
            zr = sigmoid(into[:, : 2 * h] + again[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(into[:, 2 * h :] + r * again[:, 2 * h :])
            keep.append((t, inside, state, z, r, new, again[:, 2 * h :]))
            state = state + inside * (1 - z) * (new - state)
            out[t] = state
        return out

    def _states(self, d: str, gates: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The same steps in the same order of operations for scoring, in arrays that are used again for every position."""
        h, u, count = HIDDEN, self.p[f"U{d}"], ids.shape[1]
        ids = np.ascontiguousarray(ids)
        inside = (ids > 0).astype(np.float32)[:, :, None]
        into, again = np.empty((count, 3 * h), np.float32), np.empty((count, 3 * h), np.float32)
        zr, new, step = np.empty((count, 2 * h), np.float32), np.empty((count, h), np.float32), np.empty((count, h), np.float32)
        state, out = np.zeros((count, h), np.float32), np.empty((len(ids), count, h), np.float32)
        for t in range(len(ids)) if d == "f" else reversed(range(len(ids))):
            np.take(gates, ids[t], axis=0, out=into, mode="clip")
            np.matmul(state, u, out=again)
            np.add(into[:, : 2 * h], again[:, : 2 * h], out=zr)
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            np.multiply(zr[:, h:], again[:, 2 * h :], out=new)
            new += into[:, 2 * h :]
            np.tanh(new, out=new)
            new -= state
            np.subtract(1, zr[:, :h], out=step)
            step *= inside[t]
            step *= new
            state = np.add(state, step, out=out[t])
        return out

    def logits(self, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.p
        lists = [None, None] if keep is None else [keep.setdefault(d, []) for d in "fb"]
        states = np.concatenate([self.layer(d, g, ids, k) for d, g, k in zip("fb", gates, lists)], axis=2)
        inner = states @ p["A"]
        inner += p["a"]
        np.tanh(inner, out=inner)
        weight = inner @ p["v"] + np.where(ids > 0, np.float32(0), np.float32(-30))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled, part = weight[0, :, None] * states[0], np.empty_like(states[0])
        for w, state in zip(weight[1:], states[1:]):
            pooled += np.multiply(w[:, None], state, out=part)
        if keep is not None:
            keep.update(states=states, inner=inner, weight=weight, pooled=pooled)
        return pooled @ p["w"] + p["b"]

    def gradients(self, rows: list[int], grams: list[list[int]], ids: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; ``ids[position, window]`` count into ``rows`` and ``grams``."""
        p, h = self.p, HIDDEN
        g = {name: np.zeros_like(value) for name, value in p.items()}
        vectors = self.vectors(rows, grams)
        keep: dict = {}
        off = (sigmoid(self.logits(self.gates(vectors), ids, keep)) - labels) / len(labels)
        states, inner, weight = keep["states"], keep["inner"], keep["weight"]
        g["w"], g["b"] = keep["pooled"].T @ off, np.array([off.sum()])
        pooled = off[:, None] * p["w"]
        d_states = weight[:, :, None] * pooled
        d_weight = (states * pooled).sum(axis=2)
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", d_weight, inner)
        d_inner = d_weight[:, :, None] * p["v"] * (1 - inner**2)
        g["A"], g["a"] = np.einsum("tbi,tbj->ij", states, d_inner), d_inner.sum(axis=(0, 1))
        d_states += d_inner @ p["A"].T
        d_vectors = np.zeros_like(vectors)
        for i, d in enumerate("fb"):
            u, d_gates, ahead = p[f"U{d}"], np.zeros((len(rows), 3 * h), np.float32), np.zeros((ids.shape[1], h), np.float32)
            for t, inside, before, z, r, new, again in reversed(keep[d]):
                total = d_states[t, :, i * h : (i + 1) * h] + ahead
                moved = total * inside
                d_new = moved * (1 - z) * (1 - new**2)
                d_z = moved * (before - new) * z * (1 - z)
                d_r = d_new * again * r * (1 - r)
                back = np.hstack([d_z, d_r, d_new * r])
                g[f"U{d}"] += before.T @ back
                ahead = total - moved * (1 - z) + back @ u.T
                np.add.at(d_gates, ids[t], np.hstack([d_z, d_r, d_new]))
            g[f"W{d}"], g[f"B{d}"] = vectors.T @ d_gates, d_gates.sum(axis=0)
            d_vectors += d_gates @ p[f"W{d}"].T
        np.add.at(g["words"], rows, d_vectors[:, :WIDTH])
        sizes = np.array([len(x) for x in grams])
        np.add.at(g["grams"], np.concatenate(grams), np.repeat(d_vectors[:, WIDTH:] / sizes[:, None], sizes, axis=0))
        return g


class Fitted:
    """What scoring needs: the network, or one score for all."""

    def __init__(self, network: Network | None, share: float):
        self.network, self.share = network, share
        self.words, self.gates = Words(), None

    def __getstate__(self) -> tuple:
        return self.network, self.share

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def window_logits(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words.rows) > KEPT_WORDS:
            self.words, self.gates = Words(), None
        cut = [windows(self.words.read(t)) for t in texts]
        known = 0 if self.gates is None else len(self.gates[0])
        if known < len(self.words.rows):
            new = self.network.gates(self.network.vectors(self.words.rows[known:], self.words.grams[known:]))
            self.gates = new if self.gates is None else tuple(np.vstack(x) for x in zip(self.gates, new))
        every = np.concatenate(cut)
        out = np.concatenate([self.network.logits(self.gates, every[i : i + BATCH].T) for i in range(0, len(every), BATCH)])
        return np.split(out, np.cumsum([len(c) for c in cut])[:-1])

    def scores(self, texts: list[str]) -> list[float]:
        if not texts or self.network is None:
            return [self.share] * len(texts)
        return [float(sigmoid(np.float64(x.max()))) for x in self.window_logits(texts)]


def _share(x: np.ndarray) -> np.ndarray:
    return x / x.sum()


def fit(texts: list[str], labels: list[int], seed: int = 3) -> Fitted:
    share = sum(labels) / len(labels) if labels else 0.0
    if len(set(labels)) < 2:
        return Fitted(None, share)
    rnd = np.random.default_rng(seed)
    network = Network(seed)
    words = Words()
    cut = [windows(words.read(t)) for t in texts]
    label = np.array(labels)
    moments = {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in network.p.items()}
    step, odds = 0, np.ones(len(label))
    for turn in range(ROUNDS):
        if turn:
            every, gates = np.concatenate(cut), network.gates(network.vectors(words.rows, words.grams))
            found = np.concatenate([network.logits(gates, every[i : i + BATCH].T) for i in range(0, len(every), BATCH)])
            each = np.split(found, np.cumsum([len(c) for c in cut])[:-1])
            best = [int(x.argmax()) for x in each]
            odds = np.where(label == 1, 1.0, 0.02 + sigmoid(np.array([x.max() for x in each], dtype=np.float64)))
        for _ in range(STEPS):
            chosen = np.concatenate([rnd.choice(len(label), STEP_WINDOWS // 2, p=_share(odds * (label == y))) for y in (0, 1)])
            random = (rnd.random(len(chosen)) < 0.2) & (label[chosen] == 0) if turn else np.ones(len(chosen), bool)
            picked = np.stack([cut[c][rnd.integers(len(cut[c])) if at else best[c]] for c, at in zip(chosen, random)])
            present, ids = np.unique(np.concatenate([[0], picked.T.ravel()]), return_inverse=True)
            g = network.gradients(
                [words.rows[i] for i in present], [words.grams[i] for i in present], ids[1:].reshape(picked.T.shape), label[chosen].astype(np.float32)
            )
            step += 1
            for name, value in network.p.items():
                m, s = moments[name]
                m += 0.1 * (g[name] - m)
                s += 0.01 * (g[name] ** 2 - s)
                value -= (RATE / (1 + turn) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Fitted(network, share)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[list[str], list[int]]:
    """At most SAMPLE texts of each label, none held out."""
    usable = labels.where(~held_out(labels["doc_id"])).select(labels["doc_id"].alias("of"), labels[label].cast("int").alias("label"))
    order = F.xxhash64("of")
    chosen = [usable.where(F.col("label") == y).distinct().orderBy(order, "of").limit(3 * SAMPLE) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 6 * SAMPLE rows at most
    text = whole_text()
    read = docs.select(docs["doc_id"], text.alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = read.join(few, read["doc_id"] == few["of"]).select("label", "text", order.alias("place"), "of")
    texts, found = [], []
    for y in (0, 1):
        for row in rows.where(F.col("label") == y).orderBy("place", "of", "text").limit(SAMPLE).collect():
            texts.append(row["text"])
            found.append(y)
    return texts, found


def score(docs: DataFrame, fitted: Fitted, threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        own = shared.value

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            yield {"doc_id": batch.column("doc_id"), "score": own.scores(texts_of(batch))}

        return work

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    scored = arrow_map(rows, "doc_id bigint, score double", start, 512)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
