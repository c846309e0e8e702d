"""Toxicity by a bidirectional gated recurrent network with attention pooling over words and their characters.

A word enters as its embedding and the mean of the embeddings of its hashed character trigrams. Two GRUs run over
each window of ``WINDOW`` words, one in each direction; attention weights pool their states to a logit. Every text is
cut into windows that overlap (``STRIDE`` apart), all of them are scored, and a document's score comes from its highest
window by a logistic fit on that logit and the log of the number of windows.

Training is numpy on the driver, on a sample of labelled rows bounded by ``MOST_TOXIC`` and ``MOST_OTHER`` documents
(least hash of the id first). A document's label holds for its highest window (multiple-instance learning): each epoch
picks the highest window of toxic documents and the two highest of others, and takes Adam steps on them. Embeddings
start from the words' smoothed log-odds.

Defined results: a text without words (null, empty) scores the share of toxic rows in the sample's classes. Without
both labels in the sample every score is that share. Repeated rows give repeated scores; a null id counts as the empty
text for the split; labels that are null or for unknown ids are left out; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.llm.texts import slices, words_of
from stemweave.plans.durable import written

MOST_TOXIC, MOST_OTHER = 2000, 3000
WINDOW, STRIDE = 48, 36
WORDS, CHARS, HIDDEN, GRAMS = 12, 8, 10, 8192
VOCABULARY = 20_000
CUT = 0.7


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each word between borders, and where each word's begin."""
    data = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(w) for w in words])
    begin = np.concatenate([[0], np.cumsum(sizes + 2)])[:-1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(begin - first[:-1], sizes) + np.arange(first[-1])
    gram = (data[at] * 65599 + data[at + 1]) * 65599 + data[at + 2]
    return ((gram * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64) % GRAMS, first[:-1]


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin and end (word numbers) of all windows; the last one of a document ends with it."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][doc] + np.minimum(nth * STRIDE, np.maximum(n[doc] - WINDOW, 0))
    return doc, begin, np.minimum(begin + WINDOW, first[1:][doc])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]
    fit: tuple[float, float, float] = (1.0, 0.0, 0.0)
    share: float = 0.5
    trained: bool = False
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def start(cls, vocabulary: dict[bytes, int], odds: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        x, h = WORDS + CHARS, HIDDEN
        p = {"E": rng.normal(0, 0.1, (len(vocabulary) + 1, WORDS)), "C": rng.normal(0, 0.1, (GRAMS, CHARS)), "v": rng.normal(0, 0.3, 2 * h), "u": rng.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
        for d in "fb":
            p |= {"W" + d: rng.normal(0, 1 / np.sqrt(x), (x, 3 * h)), "U" + d: rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)), "b" + d: np.zeros(3 * h)}
        p["E"][: len(odds), 0] = odds / 2
        return cls(vocabulary, {k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vector of each word; its row of E, its trigrams and where they begin, for the gradient."""
        row = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words])
        gram, begin = char_grams(words)
        sizes = np.diff(np.append(begin, len(gram)))[:, None]
        return np.concatenate([self.p["E"][row], np.add.reduceat(self.p["C"][gram], begin, axis=0) / sizes], axis=1), row, gram, begin

    def gates(self, inputs: np.ndarray, d: str) -> np.ndarray:
        """Input part of the gates for each word, and last a row that leaves the state as it is, for padding."""
        rest = np.zeros((1, 3 * HIDDEN), dtype=np.float32)
        rest[0, :HIDDEN] = 30
        return np.concatenate([inputs @ self.p["W" + d] + self.p["b" + d], rest])

    def run(self, gates: np.ndarray, codes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps x windows x hidden) for codes (steps x windows)."""
        h = HIDDEN
        state = np.zeros((codes.shape[1], h), dtype=np.float32)
        out = np.empty((*codes.shape, h), dtype=np.float32)
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            g = gates[codes[t]]
            m = state @ self.p["U" + d]
            zr = g[:, : 2 * h]
            zr += m[:, : 2 * h]
            np.clip(zr, -30, 30, out=zr)
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            n = np.tanh(g[:, 2 * h :] + zr[:, h:] * m[:, 2 * h :])
            before, state = state, n + zr[:, :h] * (state - n)
            out[t] = state
            if keep is not None:
                keep.append((t, before, zr, n, m[:, 2 * h :]))
        return out

    def pool(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and attention weights from both directions' states."""
        a = states @ self.p["v"]
        a[~real] = -1e9
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        return (a * (states @ self.p["u"])).sum(axis=0) + self.p["c"][0], a

    def logits(self, words: list[bytes], codes: np.ndarray, begin: np.ndarray, end: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Logit of each window of a code sequence."""
        inputs, *_ = self.inputs(words)
        both = [self.gates(inputs, d) for d in "fb"]
        out = np.empty(len(begin), dtype=np.float32)
        for i in range(0, len(begin), batch):
            at, real = padded(codes, begin[i : i + batch], end[i : i + batch], len(words))
            out[i : i + batch], _ = self.pool(np.concatenate([self.run(g, at, d) for g, d in zip(both, "fb", strict=True)], axis=2), real)
        return out

    def gradient(self, words: list[bytes], at: np.ndarray, real: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross-entropy over windows (steps x windows codes)."""
        h, p = HIDDEN, self.p
        inputs, row, gram, first = self.inputs(words)
        kept: dict[str, list] = {"f": [], "b": []}
        gates = {d: self.gates(inputs, d) for d in "fb"}
        states = np.concatenate([self.run(gates[d], at, d, kept[d]) for d in "fb"], axis=2)
        logit, a = self.pool(states, real)
        err = (sigmoid(logit) - label) * weight / weight.sum()
        value = states @ p["u"]
        da = a * (value - (a * value).sum(axis=0)) * err
        g = {"c": np.array([err.sum()]), "u": np.einsum("tn,tnh->h", a * err, states), "v": np.einsum("tn,tnh->h", da, states)}
        ds = (a * err)[:, :, None] * p["u"] + da[:, :, None] * p["v"]
        dx = np.zeros_like(inputs)
        for d, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
            dg = np.zeros_like(gates[d])
            g["U" + d] = np.zeros_like(p["U" + d])
            carry = np.zeros_like(part[0])
            for t, before, zr, n, m in reversed(kept[d]):
                dh = part[t] + carry
                z, r = zr[:, :h], zr[:, h:]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * m * r * (1 - r)
                back = np.concatenate([dz, dr, dn * r], axis=1)
                g["U" + d] += before.T @ back
                carry = dh * z + back @ p["U" + d].T
                np.add.at(dg, at[t], np.concatenate([dz, dr, dn], axis=1))
            dg = dg[:-1]  # padding isn't learned
            g["W" + d], g["b" + d] = inputs.T @ dg, dg.sum(axis=0)
            dx += dg @ p["W" + d].T
        g["E"], g["C"] = np.zeros_like(p["E"]), np.zeros_like(p["C"])
        np.add.at(g["E"], row, dx[:, :WORDS])
        sizes = np.diff(np.append(first, len(gram)))
        np.add.at(g["C"], gram, np.repeat(dx[:, WORDS:] / sizes[:, None], sizes, axis=0))
        return g

    def documents(self, column: pa.Array) -> np.ndarray:
        """Score of each text."""
        out = np.full(len(column), self.share)
        words, codes, first = words_of(column, lower=True)
        if not words or not self.trained:
            return out
        doc, begin, end = windows(first)
        top, count = highest(self.logits(words, codes, begin, end), doc, len(column))
        slope, level, longer = self.fit
        some = count > 0
        out[some] = sigmoid(slope * top[some] + level + longer * np.log(count[some]))
        return out


def padded(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (steps x windows), and which of them are real."""
    at = np.arange(int((end - begin).max(initial=1)))[:, None] + begin
    real = at < end
    return np.where(real, codes[np.minimum(at, len(codes) - 1)], pad), real


def highest(logits: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.full(docs, -np.inf)
    np.maximum.at(top, doc, logits)
    return top, np.bincount(doc, minlength=docs)


def _coded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``words_of`` in slices, so that the driver's arrays stay small."""
    index: dict[bytes, int] = {}
    codes, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 20):
        words, own, first = words_of(part.column(0), lower=True)
        number = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
        codes.append(number[own])
        sizes.append(np.diff(first))
    return list(index), np.concatenate(codes), np.cumsum(np.concatenate(sizes))


def train(texts: pa.Array, labels: np.ndarray, epochs: int = 5, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
    """A network from whole labelled texts (a bounded sample)."""
    words, codes, first = _coded(texts)
    labels = labels.astype(np.float32)
    share = float(labels.mean()) if len(labels) else 0.5
    doc, begin, end = windows(first)
    if not words or labels.min() == labels.max():
        return Network({}, {}, share=share)
    # documents of each label with the word, for the vocabulary and the first values
    pair = np.unique(np.repeat(np.arange(len(labels), dtype=np.int64), np.diff(first)) * len(words) + codes)
    toxic = labels[pair // len(words)]
    with_toxic = np.bincount(pair % len(words), toxic, len(words))
    with_any = np.bincount(pair % len(words), minlength=len(words))
    order = np.lexsort((np.arange(len(words)), -with_any))[:VOCABULARY]
    order = order[with_any[order] > 1]
    odds = np.log((with_toxic[order] + 0.5) / labels.sum()) - np.log((with_any[order] - with_toxic[order] + 0.5) / (len(labels) - labels.sum()))
    odds *= np.minimum(1, with_any[order] / 10)
    net = Network.start({words[w]: i for i, w in enumerate(order.tolist())}, odds, seed)
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        logits = net.logits(words, codes, begin, end)
        rank = np.lexsort((-logits, doc))
        nth = np.arange(len(rank)) - np.searchsorted(doc[rank], doc[rank])
        picked = rank[(nth == 0) | ((nth == 1) & (labels[doc[rank]] == 0))]
        rng.shuffle(picked)
        weight = np.where(labels[doc] > 0, (labels == 0).sum() / labels.sum() / 2, 0.5).astype(np.float32)
        for i in range(0, len(picked), batch):
            some = picked[i : i + batch]
            at, real = padded(codes, begin[some], end[some], len(words))
            used, inverse = np.unique(at[real], return_inverse=True)
            local = np.full(at.shape, len(used))
            local[real] = inverse
            g = net.gradient([words[w] for w in used.tolist()], local, real, labels[doc[some]], weight[some])
            step += 1
            for k, v in g.items():
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                net.p[k] -= (rate * 0.7**epoch * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    top, count = highest(net.logits(words, codes, begin, end), doc, len(labels))
    some = count > 0
    return Network(net.vocabulary, net.p, _logistic(top[some], np.log(count[some]), labels[some]), share, True)


def _logistic(top: np.ndarray, longer: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Slope, level and weight of the window count by Newton steps on a ridge-regularised logistic fit."""
    x = np.stack([top, np.ones_like(top), longer], axis=1)
    beta = np.array([1.0, 0.0, 0.0])
    for _ in range(30):
        q = sigmoid(x @ beta)
        grad = x.T @ (q - label) + 1.0 * (beta - [1.0, 0.0, 0.0])
        beta = beta - np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.eye(3), grad)
    return float(max(beta[0], 0.05)), float(beta[1]), float(beta[2])


def sample(named: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER) -> pa.Table:
    """(text, toxic) of at most so many labelled rows of each class, out of rows (id, text, held_out)."""
    fold = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic")
    parts = []
    for label, most in ((1, most_toxic), (0, most_other)):
        ids = fold.filter((F.col("toxic") == label) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).select(F.col("doc_id").alias("id")).distinct()
        ids = written(ids.orderBy(F.xxhash64("id"), "id").limit(most), "sample")
        parts.append(named.filter("NOT held_out").join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most).select("id", "text", F.lit(label).alias("toxic")))
    table = parts[0].unionByName(parts[1]).toArrow()
    return table.sort_by([("id", "ascending"), ("toxic", "ascending")]).select(["text", "toxic"])


def score(docs: DataFrame, net: Network, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column(part.schema.get_field_index("_text"))
                keep = [i for i, name in enumerate(part.schema.names) if name != "_text"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(shared.value.documents(texts), pa.float64())], names=[*[part.schema.names[i] for i in keep], "score"])

    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("_text"))
    fields = ", ".join([*[f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)], "score double"])
    out = named.mapInArrow(run, fields)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], "score")


def held_out_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns outside fold 1 of 3 and scores all documents: id, held_out, score, predicted."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold.alias("held_out"))
    rows = sample(named, labels)
    net = train(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy())
    return score(named, net, carry=("id", "held_out")).select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
