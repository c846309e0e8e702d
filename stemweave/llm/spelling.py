"""Spelling variants: words that differ by one edit, by composing a minimal acceptor with a one-edit transducer.

``Acceptor`` is the minimal acyclic automaton of a set of words; states know how many words they accept, so a path
numbers its word. Composed with a transducer of exactly one edit and with itself, a composed state is a pair of states
and whether the edit is spent: before it both sides walk the same arcs, the edit takes two arcs of one state (replace)
or one (delete; insert is its mirror), and after it a pair of states accepts what both do. Every pair of words takes
its edit where their common beginning ends, so it is accepted once. What a pair of states accepts together and the pairs
of a state are computed once each, which is what sharing of states saves.

The composition is enumerated per initial state: words are grouped by a beginning, whose state in the acceptor is where
the composition starts, and the group's pairs are those with the edit behind the beginning. The beginning has
``FIRST`` letters and grows in groups of more than ``MOST`` words, so a group is bounded however many words begin
alike; pairs with the edit right behind a beginning that grew are the words with the same rest, an equality join whose
groups have at most a word per letter. Pairs with the edit among the first ``FIRST`` letters share an ending instead
(words have twice as many letters at least), so the same is done on the words read backwards, with the edit so near to
the end of the reading that at most ``FIRST`` - 1 letters are behind it. Words of a pair are never listed per word: each
group hands on counts and the best neighbour.

Defined results: a null text has no words; a null id is the empty string in what is hashed. Repeated rows count as often as they occur. Words may be
long. An empty table gives an empty result. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.plans.durable import written
from stemweave.plans.fixpoint import fixpoint

RUN = r"[A-Za-zÀ-ÿ]+"
FIRST = 3
MOST = 20_000  # words of a group
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
NEAR = "word string, n_near long, best_n long, best string"


class Acceptor:
    """Minimal acyclic automaton of sorted distinct words; state 0 accepts only the empty word."""

    def __init__(self, words: list[str]) -> None:
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.size: list[int] = []  # words that a state accepts
        self.known: dict[tuple, int] = {}
        self._state((True, ()))
        open_: list[tuple[bool, list[tuple[str, int]], str]] = [(False, [], "")]  # final, closed arcs, letter from above
        last = ""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            self._close(open_, same)
            open_ += [(False, [], c) for c in word[same:]]
            open_[-1] = (True, *open_[-1][1:])
            last = word
        self._close(open_, 0)
        self.start = self._state((open_[0][0], tuple(open_[0][1])))
        self._joint: dict[tuple[int, int, int], list[tuple[int, int]]] = {}

    def _state(self, state: tuple) -> int:
        number = self.known.setdefault(state, len(self.final))
        if number == len(self.final):
            self.final.append(state[0])
            self.arcs.append(dict(state[1]))
            self.size.append(state[0] + sum(self.size[q] for _, q in state[1]))
        return number

    def _close(self, open_: list, depth: int) -> None:
        while len(open_) > depth + 1:
            final, arcs, letter = open_.pop()
            open_[-1][1].append((letter, self._state((final, tuple(arcs)))))

    def places(self, q: int) -> Iterator[tuple[str, int, int]]:
        """Arcs of a state, and the number of its words before those behind the arc."""
        before = int(self.final[q])
        for c, to in self.arcs[q].items():
            yield c, to, before
            before += self.size[to]

    def joint(self, p: int, q: int, most: int) -> list[tuple[int, int]]:
        """Numbers in p and in q of the words of at most ``most`` letters that both accept."""
        if p == q and most >= 1 << 30:
            return [(i, i) for i in range(self.size[p])]
        key = (p, q, most)
        found = self._joint.get(key)
        if found is None:
            found = [(0, 0)] if self.final[p] and self.final[q] else []
            if most:
                there = {c: (to, before) for c, to, before in self.places(q)}
                for c, to, before in self.places(p):
                    if c in there:
                        other, behind = there[c]
                        found += [(before + i, behind + j) for i, j in self.joint(to, other, most - (most < 1 << 30))]
            self._joint[key] = found
        return found

    def edits(self, q: int, most: int) -> list[tuple[int, int]]:
        """Pairs of words of a state whose first letters are where they differ by one edit."""
        found, arcs = [], list(self.places(q))
        for k, (_, to, before) in enumerate(arcs):
            for _, other, behind in arcs[k + 1 :]:
                found += [(before + i, behind + j) for i, j in self.joint(to, other, most)]
        for a, to, before in arcs:  # the letter a is left out; what follows it begins otherwise
            if self.final[q] and self.final[to]:
                found.append((before, 0))
            inner = {c: (s, x) for c, s, x in self.places(to)}
            for c, other, behind in arcs if most else ():
                if c != a and c in inner:
                    s, x = inner[c]
                    found += [(before + x + i, behind + j) for i, j in self.joint(s, other, most - (most < 1 << 30))]
        return found

    def pairs(self, most: int = 1 << 30) -> np.ndarray:
        """Numbers of all pairs one edit apart; at most ``most`` letters follow the edit. States come after those
        that they lead to, so one pass in order of number has every state's pairs ready."""
        done: list[np.ndarray | None] = []
        users = np.zeros(len(self.final), dtype=np.int64)
        for arcs in self.arcs:
            for to in arcs.values():
                users[to] += 1
        for q in range(len(self.final)):
            parts = [np.array(self.edits(q, most), dtype=np.int64).reshape(-1, 2)]
            for _, to, before in self.places(q):
                parts.append(done[to] + before)
                users[to] -= 1
                if not users[to]:
                    done[to] = None
            done.append(np.concatenate(parts))
        return done[self.start]


def _neighbours(words: list[str], counts: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """Rows of ``NEAR`` for the words in the pairs."""
    one, two = np.concatenate([pairs, pairs[:, ::-1]]).T
    # among the neighbours of a word: the largest count first, then the smallest word
    rank = np.argsort(np.argsort(np.array(words, dtype=object), kind="stable"), kind="stable") if len(words) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((rank[two], -counts[two], one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.zeros(0, dtype=np.int64)
    number = np.diff(np.concatenate([first, [len(one)]]))
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in one[first].tolist()], pa.string()), pa.array(number, pa.int64()), pa.array(counts[two[first]], pa.int64()), pa.array([words[i] for i in two[first].tolist()], pa.string())],
        names=["word", "n_near", "best_n", "best"])


def _composed(words: DataFrame, backwards: bool) -> DataFrame:
    """Rows of ``NEAR`` from the groups of words (start, skip, read, n), where ``read`` is the word as it is read."""

    def solve(reads: list[str], ns: list[int], skip: int) -> pa.RecordBatch:
        order = sorted(range(len(reads)), key=reads.__getitem__)
        machine = Acceptor([reads[i][skip:] for i in order])
        pairs = machine.pairs(FIRST - 1 if backwards else 1 << 30)
        plain = [reads[i][::-1] if backwards else reads[i] for i in order]
        if backwards:  # pairs with a longer common beginning belong to the other reading
            early = np.array([plain[i][:FIRST] != plain[j][:FIRST] for i, j in pairs.tolist()], dtype=bool)
            pairs = pairs[early]
        return _neighbours(plain, np.array(ns, dtype=np.int64)[order], pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1 << 20)  # as deep as a word is long
        start, skip, reads, ns = None, 0, [], []
        for batch in batches:
            for key, at, read, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != start and reads:
                    yield solve(reads, ns, skip)
                    reads, ns = [], []
                start, skip = key, at
                reads.append(read)
                ns.append(n)
        if reads:
            yield solve(reads, ns, skip)

    arranged = words.select("start", "skip", "read", "n").repartition("start").sortWithinPartitions("start")
    return arranged.mapInArrow(run, NEAR)


def _grown(words: DataFrame, backwards: bool, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Groups (start, skip, read, n) of at most ``most`` words, and rows of ``NEAR`` from the beginnings that grew."""
    c = F.col
    length = FIRST
    ready: list[DataFrame] = []
    found: list[DataFrame] = []
    rest = words.select(F.reverse("word").alias("read") if backwards else c("word").alias("read"), "n")
    while True:
        cut = rest.withColumn("start", c("read").substr(F.lit(1), F.lit(length)))
        large = written(cut.groupBy("start").agg(F.count(F.lit(1)).alias("m")).filter(c("m") > most).select("start"), "large")
        if large.isEmpty():
            ready.append(cut.withColumn("skip", F.lit(length)))
            break
        ready.append(cut.join(large, "start", "left_anti").withColumn("skip", F.lit(length)))
        rest = written(cut.join(large, "start", "left_semi").select("read", "n", "start"), "rest")
        found.append(_same_rest(rest, length, backwards))
        rest = rest.select("read", "n")
        length += 1
    whole = ready[0]
    for more in ready[1:]:
        whole = whole.unionByName(more)
    return whole, found


def _same_rest(words: DataFrame, length: int, backwards: bool) -> DataFrame:
    """Rows of ``NEAR`` for pairs of ``words(read, n, start)`` with one start of ``length`` letters, the edit right
    behind it, and the same rest. A group has a word per letter that can stand there, and one without it."""
    c = F.col
    plain = F.reverse("read") if backwards else c("read")
    tail = lambda n: c("read").substr(F.lit(length + 1 + n), F.length("read"))
    one = words.filter(F.length("read") > length).select("start", tail(1).alias("rest"), tail(0).substr(1, 1).alias("letter"), plain.alias("word"), "n")
    none = words.select("start", tail(0).alias("rest"), F.lit("").alias("letter"), plain.alias("word"), "n")
    if backwards:
        one, none = (d.filter(F.length("rest") < FIRST) for d in (one, none))
    both = one.join(one.select("start", "rest", c("letter").alias("letter2"), c("word").alias("other"), c("n").alias("m")), ["start", "rest"]).filter("letter <> letter2")
    gone = one.join(none.select("start", "rest", c("word").alias("other"), c("n").alias("m")), ["start", "rest"]).filter(c("letter") != c("rest").substr(1, 1))
    pair = both.select("word", "other", "n", "m").unionByName(gone.select("word", "other", "n", "m")).unionByName(
        gone.select(c("other").alias("word"), c("word").alias("other"), c("m").alias("n"), c("n").alias("m")))
    if backwards:
        pair = pair.filter(c("word").substr(1, FIRST) != c("other").substr(1, FIRST))
    return _summed(pair.select("word", F.lit(1).cast("long").alias("n_near"), c("m").alias("best_n"), c("other").alias("best")))


def _summed(near: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best")).alias("b")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def neighbours(words: DataFrame, most: int = MOST) -> DataFrame:
    """Of distinct ``words(word, n)`` of ``2 * FIRST`` letters or more: rows of ``NEAR``, the number of words one edit
    away, and the most frequent of them (the smallest on ties), for words that have any."""
    parts = []
    for backwards in (False, True):
        groups, grown = _grown(words, backwards, most)
        parts += [_composed(groups, backwards), *grown]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return _summed(every)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case. Where 199 divides the CRC-32 of id and run, the
    run has lost the letter at the CRC-32 modulo its length."""
    c = F.col
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate(c(f"`{text_col}`"), upper, upper.lower())
    runs = docs.select(F.coalesce(c(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    # a document's equal runs share their fate; what they become is counted before anything moves
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (c("h") % F.length("run")).cast("int")
    lost = F.concat(c("run").substr(F.lit(1), at), c("run").substr(at + 2, F.length("run")))
    return hashed.select(F.when(c("h") % 199 == 0, lost).otherwise(c("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per word: its form (the near word that is ``RATIO`` times as frequent or more), the root that forms
    lead to, how often it and its form occur, and the number of near words."""
    c = F.col
    words = written(counted(docs, id_col, text_col).filter((F.length("word") >= LEAST_LETTERS) & (c("n") >= LEAST_COUNT)), "words")
    near = written(neighbours(words, most), "near")
    joined = words.join(near, "word", "left")
    is_form = c("best_n") >= RATIO * c("n")
    named = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, c("best")).alias("form"), F.when(is_form, c("best_n")).alias("form_n")), "named")
    return named.join(_roots(named), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(named: DataFrame) -> DataFrame:
    """(word, root) of words with a form: steps double each round, and a form is ever more frequent, so they end."""
    c = F.col

    def double(state: DataFrame) -> DataFrame:
        on = state.select(c("word").alias("root"), c("root").alias("next"))
        return state.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), c("next").isNotNull().alias("_changed"))

    return fixpoint(named.filter("form IS NOT NULL").select("word", c("form").alias("root")), double, tag="roots")
