"""Language of documents as a mixture: proportions by expectation-maximisation, the language set by penalised likelihood.

A language is a model of bytes given the three before them within a word (lower case A-Z, spaces around), learned from
all training texts: counts are summed with a shuffle, and every gram that occurs is in the model. Its table is broadcast
and held by the driver: a row per distinct four-byte string of words with a column per language (280,000 rows of 0.5 GB of
text; new ones become rare as texts grow, 2^32 is the limit). A word has a likelihood in each
language; a document is a mixture of languages over its words with a letter. ``STEPS`` of expectation-maximisation over all
languages come near what any set can reach. Where that exceeds the best single language by the penalty, the set grows
greedily, language by language, while its maximised log-likelihood gains more than ``PENALTY`` * ln(words).

Defined results: null text, or text without a letter: ``und``, score 0. Ties go to the language that sorts first.
Rows with a null language are never learned from; without any training row all predictions are ``und``. Repeated rows
count each; a null id counts as the empty text for the split; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.llm.texts import slices, words_of
from stemweave.plans.durable import written

PENALTY = 4.0
STEPS = 10
LETTER = re.compile(r"[^\W\d_]")


def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte windows that end in each byte of a word or the space after it, as numbers, and their word."""
    if not words:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    data = np.frombuffer(b"   " + b"   ".join(words) + b"   ", dtype=np.uint8).astype(np.uint32)
    key = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    sizes = np.array([len(w) for w in words])
    begin = np.concatenate([[0], np.cumsum(sizes + 3)])[:-1]
    word = np.repeat(np.arange(len(words)), sizes + 1)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    return key[begin[word] + place], word


def count_grams(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over all training rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys))

        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, first = words_of(part.column(1), lower=True)
                langs = np.array([names.setdefault(x, len(names)) for x in part.column(0).to_pylist()])
                key, word = windows(words)
                token = np.repeat(langs, np.diff(first))
                for lang in np.unique(token):
                    uses = np.bincount(codes[token == lang], minlength=len(words))[word]
                    used = uses > 0
                    held.append((key[used].astype(np.uint64) | np.uint64(lang) << np.uint64(32), uses[used]))
                if sum(len(k) for k, _ in held) > 4_000_000:
                    held = [summed()]
        if held:
            keys, counts = summed()
            label = np.array(list(names), dtype=object)[(keys >> np.uint64(32)).astype(np.int64)]
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[i : i + 100_000], pa.string()), pa.array((keys[i : i + 100_000] & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts[i : i + 100_000].astype(np.int64))],
                    names=["lang", "gram", "n"])

    return training.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log-likelihoods of grams (rows) and of pairs of bytes, by language (columns)."""

    langs: list[str]
    keys: np.ndarray
    grams: np.ndarray
    pairs: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        key, word = windows(words)
        out = np.zeros((len(words), len(self.langs)))
        if not len(key) or not self.langs:
            return out
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        value = np.where((self.keys[at] == key)[:, None], self.grams[at], self.pairs[key & 0xFFFF])
        begin = np.searchsorted(word, np.arange(len(words)))
        return np.add.reduceat(value, begin, axis=0)


def learn(training: DataFrame, strength: float = 5.0) -> Model:
    grams = written(count_grams(training), "grams")
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros(1, dtype=np.uint32), np.zeros((1, 0)), np.zeros((65536, 0)))
    every = grams.toArrow()
    two = grams.groupBy("lang", (F.col("gram") % 65536).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    place = {k: i for i, k in enumerate(langs)}

    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([place[x] for x in table.column("lang").to_pylist()], dtype=np.int64), table.column("gram").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)

    lang, gram, n = columns(two)
    pairs = np.zeros((65536, len(langs)))
    pairs[gram, lang] = n
    before = pairs.reshape(256, 256, -1).sum(axis=1, keepdims=True)
    low = ((pairs.reshape(256, 256, -1) + strength / 256) / (before + strength)).reshape(65536, -1)
    lang, gram, n = columns(every)
    keys = np.unique(gram)
    counts = np.zeros((len(keys), len(langs)))
    counts[np.searchsorted(keys, gram), lang] = n
    _, context = np.unique(keys >> 8, return_inverse=True)
    whole = np.zeros((context.max(initial=0) + 1, len(langs)))
    np.add.at(whole, context, counts)
    high = (counts + strength * low[keys & 0xFFFF]) / (whole[context] + strength)
    return Model(langs, keys.astype(np.uint32), np.log(high), np.log(low))


def _expect(p: np.ndarray, doc: np.ndarray, begin: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents from scaled word likelihoods; every document has a word."""
    n = np.diff(np.append(begin, len(p)))[:, None]
    for _ in range(steps):
        mixed = p * share[doc]
        mixed /= mixed.sum(axis=1, keepdims=True)
        share = np.add.reduceat(mixed, begin, axis=0) / n
    return share, np.add.reduceat(np.log((p * share[doc]).sum(axis=1)), begin)


def proportions(logs: np.ndarray, begin: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Language proportions (documents x languages) of documents whose words begin at ``begin`` in ``logs``."""
    docs, langs = len(begin), logs.shape[1]
    top = logs.max(axis=1, keepdims=True)
    p = np.maximum(np.exp(logs - top), 1e-30)
    ends = np.append(begin[1:], len(logs))
    doc = np.repeat(np.arange(docs), ends - begin)
    single = np.add.reduceat(logs - top, begin, axis=0)
    best = single.argmax(axis=1)
    out = np.zeros((docs, langs))
    out[np.arange(docs), best] = 1.0
    if langs == 1:
        return out
    _, reach = _expect(p, doc, begin, np.full((docs, langs), 1.0 / langs), steps)
    cost = penalty * np.log(ends - begin + 1.0)
    # 0.5 for what is left of convergence; no set reaches more than all languages do
    for d in np.flatnonzero(reach + 0.5 - single[np.arange(docs), best] > cost):
        own, chosen, value = p[begin[d] : ends[d]], [int(best[d])], single[d, best[d]]
        while len(chosen) < langs:
            tried = []
            for extra in (k for k in range(langs) if k not in chosen):
                some = own[:, [*chosen, extra]]
                share, total = _expect(some, np.zeros(len(some), dtype=np.int64), np.zeros(1, dtype=np.int64), np.full((1, some.shape[1]), 1.0 / some.shape[1]), 3 * steps)
                tried.append((float(total[0]), extra, share[0]))
            total, extra, share = max(tried, key=lambda t: (t[0], -t[1]))
            if total - value <= cost[d]:
                break
            chosen.append(extra)
            value = total
            out[d] = 0
            out[d, chosen] = share
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, the predicted language, its proportion, and the number of languages in the set."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column(part.schema.get_field_index("_text"))
                words, codes, first = words_of(texts, lower=True)
                likely = model.words(words)
                letter = np.array([any(b > 127 or 97 <= b <= 122 for b in w) for w in words], dtype=bool)
                lang, score, size = [None] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, dtype=np.int64)
                use = letter[codes] if len(codes) else np.zeros(0, dtype=bool)
                kept = np.concatenate([[0], np.cumsum(use)])[first]
                some = np.flatnonzero((np.diff(kept) > 0) & np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], dtype=bool)) if model.langs else np.zeros(0, dtype=np.int64)
                if len(some):
                    inside = np.repeat(np.isin(np.arange(part.num_rows), some), np.diff(first)) & use
                    logs = likely[codes[inside]]
                    begin = np.concatenate([[0], np.cumsum(np.diff(kept)[some])])[:-1]
                    share = proportions(logs, begin)
                    most = share.argmax(axis=1)
                    score[some], size[some] = share[np.arange(len(some)), most], (share > 0).sum(axis=1)
                    for d, k in zip(some.tolist(), most.tolist(), strict=True):
                        lang[d] = model.langs[k]
                keep = [i for i, name in enumerate(part.schema.names) if name != "_text"]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in keep], pa.array([x or "und" for x in lang], pa.string()), pa.array(score), pa.array(size)],
                    names=[*[part.schema.names[i] for i in keep], "lang_pred", "score", "n_languages"])

    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("_text"))
    fields = ", ".join([*[f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)], "lang_pred string, score double, n_languages long"])
    out = named.mapInArrow(run, fields)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score", "n_languages")


def held_out_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows outside fold 2 of 4 and predicts all: id, held_out, lang_pred, score, n_languages."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), fold.alias("held_out"))
    model = learn(named.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL"))
    return predict(named, model, carry=("id", "held_out")).withColumnRenamed("id", id_col)
