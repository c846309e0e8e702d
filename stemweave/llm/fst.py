"""SentencePiece encoding as a shortest path: normaliser, pieces and byte fallback composed into one weighted transducer.

Three machines are compiled. The normaliser has one state and an arc per character that it changes (input : output; the
model file says that white space becomes U+2581), every other character passes; its initial arc puts out the dummy
prefix without reading anything. The acceptor is the trie of the pieces, whose final states return to the start with the
piece's id and weight. The fallback has an arc per byte at a high weight. ``compose`` joins the first two once:
an arc of the result reads what the normaliser maps to the acceptor's character, so texts are read as they are and no
normalised text is made. Composing the result with an input gives an acyclic lattice over positions, whose tropical
shortest path (least sum of weights; ties by fewer pieces, then by the longer last piece) is the encoding. No piece of the
vocabulary crosses the border before a space mark, or holds certain characters (line feeds, for one), so the lattice is a
chain of small lattices there, which are solved once per distinct segment (told apart by 64-bit hashes): those of up
to ``SHORT`` characters together, position by position, longer ones on their own. With a vocabulary for which that does not
hold, the chain has one link, the whole text.

Weights: minus the score for unigram vocabularies. Merge-ranked vocabularies carry minus the rank as score, which is
turned into a Zipf code length, ln(rank + 1) + ln(H_n). Decoding joins surfaces and bytes and drops the dummy prefix;
it gives back the normalised text exactly (U+2581 in a text is a space then). It is checked segment by segment, as the
decoding of a text is that of its segments in a row.

Defined results: null text gives no ids and a null decoding flag; an empty text has no ids. Repeated rows give
repeated results, an empty table an empty one; other columns are ignored by ``encode``. A carried column keeps its
name; a column of the result with the same name gets ``piece_`` before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.llm.texts import flat, prefix_hashes, range_hashes, slices

MARK = "▁"
MEMO = 250_000  # segments in a generation of what a Python worker remembers
PIECE_COST = 1e-9  # of every piece or byte, which settles ties
BYTE_COST = 4.0  # added to a fallback byte's weight, so that pieces win wherever they reach
SHORT = 48  # characters of segments that are solved together
TOGETHER = 4_096  # segments that are solved together
LETTER = 21  # bits of a code point
SLICE = 1 << 20  # bytes of text that are encoded together, or one longer text

Normaliser = tuple[tuple[tuple[str, str], ...], str]  # arcs (input, output) of the characters it changes, and its initial output
IDENTITY: Normaliser = (((" ", MARK),), MARK)


def acceptor(pieces: tuple[tuple[int, str, float], ...]) -> tuple[list[dict[str, int]], list[int], list[float]]:
    """The trie of the pieces: arcs of each state, and the id (or -1) and weight with which a piece ends there."""
    arcs: list[dict[str, int]] = [{}]
    ends, weights = [-1], [0.0]
    for i, s, weight in pieces:
        state = 0
        for c in s:
            if (to := arcs[state].get(c)) is None:
                to = arcs[state][c] = len(arcs)
                arcs.append({})
                ends.append(-1)
                weights.append(0.0)
            state = to
        if s and (ends[state] < 0 or weight + PIECE_COST < weights[state]):
            ends[state], weights[state] = i, weight + PIECE_COST
    return arcs, ends, weights


def compose(normaliser: Normaliser, arcs: list[dict[str, int]]) -> list[dict[str, int]]:
    """The acceptor's arcs as arcs that read what the normaliser turns into their characters."""
    changed = dict(normaliser[0])
    sources: dict[str, list[str]] = {}
    for c, to in changed.items():
        sources.setdefault(to, []).append(c)
    # a character that is changed no longer stands for itself
    return [{source: to for c, to in state.items() for source in [*([c] if c not in changed else []), *sources.get(c, ())]} for state in arcs]


class Transducer:
    def __init__(self, pieces: tuple[tuple[int, str, float], ...], byte_ids: tuple[int, ...], normaliser: Normaliser = IDENTITY) -> None:
        if any(len(to) != 1 for _, to in normaliser[0]):
            raise ValueError("the normaliser has to map characters to single characters")
        self.changed, self.prefix = dict(normaliser[0]), normaliser[1]
        self.byte_ids = byte_ids
        self.surface = {i: s.replace(MARK, " ").encode() for i, s, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        plain, self.ends, self.weights = acceptor(pieces)
        self.arcs = compose(normaliser, plain)
        self.byte_weight = BYTE_COST + max((w for *_, w in pieces), default=0.0)
        self.longest = max((len(s) for _, s, _ in pieces), default=0)
        # the same arcs as sorted numbers, state and letter in one
        keys = [(state << LETTER | ord(c), to) for state, own in enumerate(self.arcs) for c, to in own.items()]
        self.keys, self.targets = np.array(sorted(keys), dtype=np.int64).reshape(-1, 2).T.copy()
        self.end_ids, self.end_weights = np.array(self.ends, dtype=np.int64), np.array(self.weights)
        self.memo: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}
        self.inexact: set[int] = set()
        self.linked, self.alone = self._links([s for _, s, _ in pieces])

    def _links(self, pieces: list[str]) -> tuple[bool, bytes]:
        """Whether texts fall into segments that no piece crosses, and the characters that are segments by themselves."""
        if self.changed.get(" ") != MARK or any(re.search(f"[^{MARK}]{MARK}", s) for s in pieces):
            return False, b""
        joined = set(chain.from_iterable(s for s in pieces if len(s) > 1))
        return True, "".join(c for c in "\n\r\t" if c not in joined).encode()

    def normalise(self, text: str) -> str:
        return self.prefix + "".join(self.changed.get(c, c) for c in text) if text else ""

    def path(self, segment: str) -> list[int]:
        """Ids on the shortest path through the lattice of a segment as it stands in a text."""
        n = len(segment)
        weights = [0.0] + [float("inf")] * n
        back, taken = [0] * (n + 1), [0] * (n + 1)
        raw: dict[int, bytes] = {}
        arcs, ends, costs, bytewise = self.arcs, self.ends, self.weights, bool(self.byte_ids)
        for at in range(n):
            weight, state, end = weights[at], 0, at
            covered = not bytewise
            for c in segment[at : at + self.longest]:
                if (to := arcs[state].get(c)) is None:
                    break
                state = to
                end += 1
                if (piece := ends[state]) >= 0:
                    if end == at + 1:
                        covered = True
                    if weight + costs[state] < weights[end]:
                        weights[end], back[end], taken[end] = weight + costs[state], at, piece
            if not covered:  # where a piece covers the character, its fallback bytes weigh more
                own = self.changed.get(segment[at], segment[at]).encode()
                if (total := weight + (self.byte_weight + PIECE_COST) * len(own)) < weights[at + 1]:
                    weights[at + 1], back[at + 1], raw[at + 1] = total, at, own
                    taken[at + 1] = -1
        if weights[n] == float("inf"):
            raise ValueError("a character is neither in a piece nor covered by byte fallback")
        out: list[int] = []
        while n:
            if taken[n] >= 0:
                out.append(taken[n])
            else:
                out.extend(self.byte_ids[b] for b in reversed(raw[n]))
            n = back[n]
        out.reverse()
        return out

    def paths(self, segments: list[str]) -> list[bytes]:
        """The ids (32-bit, as bytes) of many segments: short ones position by position all at once."""
        out: list[bytes] = [b""] * len(segments)
        short = sorted((i for i, s in enumerate(segments) if len(s) <= SHORT), key=lambda i: -len(segments[i]))
        rest = [i for i, s in enumerate(segments) if len(s) > SHORT]
        for begin in range(0, len(short), TOGETHER):
            some = short[begin : begin + TOGETHER]
            for i, ids in zip(some, self._together([segments[i] for i in some]), strict=True):
                if ids is None:
                    rest.append(i)
                else:
                    out[i] = ids
        for i in rest:
            out[i] = np.array(self.path(segments[i]), dtype=np.int32).tobytes()
        return out

    def _together(self, segments: list[str]) -> list[bytes | None]:
        """``path`` of segments in falling order of length; None for those that need a fallback byte."""
        sizes = np.array([len(s) for s in segments])
        n, width = len(segments), int(sizes[0])
        letters = np.zeros((n, width), dtype=np.int64)
        flat_ = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)
        letters[np.arange(width)[None, :] < sizes[:, None]] = flat_
        best = np.full((n, width + 1), np.inf)
        best[:, 0] = 0.0
        back, taken = np.zeros((n, width + 1), dtype=np.int64), np.full((n, width + 1), -1, dtype=np.int64)
        for at in range(width):
            rows = np.flatnonzero((sizes > at) & np.isfinite(best[:, at]))
            state = np.zeros(len(rows), dtype=np.int64)
            for end in range(at + 1, min(width, at + self.longest) + 1):
                key = state << LETTER | letters[rows, end - 1]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = (self.keys[place] == key) & (sizes[rows] >= end)
                rows, state = rows[there], self.targets[place[there]]
                if not len(rows):
                    break
                total = best[rows, at] + self.end_weights[state]
                better = (self.end_ids[state] >= 0) & (total < best[rows, end])
                won = rows[better]
                best[won, end], back[won, end], taken[won, end] = total[better], at, self.end_ids[state[better]]
        lost = ~np.isfinite(best[np.arange(n), sizes])
        # a character without a piece of its own can only be passed inside a longer one; where a fallback byte might have
        # been lighter, or nothing else leads on, the segment is solved by itself
        single = np.zeros((n, width), dtype=bool)
        key = letters
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        single = (self.keys[place] == key) & (self.end_ids[self.targets[place]] >= 0)
        lost |= ((~single) & (np.arange(width)[None, :] < sizes[:, None])).any(axis=1)
        steps: list[np.ndarray] = []
        at = np.where(lost, 0, sizes)
        while at.any():
            ids = np.where(at > 0, taken[np.arange(n), at], -1)
            steps.append(ids)
            at = np.where(at > 0, back[np.arange(n), at], 0)
        if not steps:
            return [None if x else b"" for x in lost.tolist()]
        grid = np.stack(steps[::-1], axis=1).astype(np.int32)
        counts = (grid >= 0).sum(axis=1)
        whole, cut = grid[grid >= 0].tobytes(), np.concatenate([[0], np.cumsum(counts)]) * 4
        return [None if x else whole[p:q] for x, p, q in zip(lost.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _segments(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Begins of the segments in texts of UTF-8 bytes."""
        new = np.zeros(len(data), dtype=bool)
        new[at[:-1][np.diff(at) > 0]] = True
        if self.linked:
            space = data == 0x20
            new[1:] |= space[1:] & ~space[:-1]
            for c in self.alone:
                own = data == c
                new |= own
                new[1:] |= own[:-1]
        return np.flatnonzero(new)

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in a row, the n + 1 places where texts begin, and whether each text decodes exactly."""
        if self.linked and pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")  # both read as a space mark, by two arcs
        data, at = flat(column)
        sizes = np.diff(at)
        # the dummy prefix: every text that is not empty is read as if a space stood before it
        ahead = (sizes > 0).astype(np.int64) if self.prefix else np.zeros(len(sizes), dtype=np.int64)
        shift = np.cumsum(ahead)
        to = at + np.concatenate([[0], shift])
        full = np.full(to[-1], 0x20, dtype=np.uint8)
        full[np.arange(len(data)) + np.repeat(shift, sizes)] = data
        begin = self._segments(full, to)
        end = np.concatenate([begin[1:], [len(full)]]).astype(np.int64) if len(begin) else begin
        hashed, where, codes = np.unique(range_hashes(prefix_hashes(full), begin, end) if len(begin) else np.zeros(0, dtype=np.uint64), return_index=True, return_inverse=True)
        if len(self.memo) > MEMO:  # what was used of late is kept, so memory is bounded by two generations
            self.memo, self.old = {}, self.memo
        memo, old, keys = self.memo, self.old, hashed.tolist()
        missing = []
        for k, key in enumerate(keys):
            if key not in memo:
                if (found := old.get(key)) is None:
                    missing.append(k)
                else:
                    memo[key] = found
        raw = full.tobytes()
        texts = [raw[a:b] for a, b in zip(begin[where[missing]].tolist(), end[where[missing]].tolist(), strict=True)]
        for k, text, ids in zip(missing, texts, self.paths([t.decode() for t in texts]), strict=True):
            memo[keys[k]] = ids
            if b"".join(map(self.surface.__getitem__, np.frombuffer(ids, dtype=np.int32).tolist())) != text:
                self.inexact.add(keys[k])
        parts = list(map(memo.__getitem__, keys))
        bank, size = np.frombuffer(b"".join(parts), dtype=np.int32), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        base = np.cumsum(size) - size
        lengths = size[codes]
        cut = np.concatenate([[0], np.cumsum(lengths)])
        ids = bank[np.arange(cut[-1]) + np.repeat(base[codes] - cut[:-1], lengths)] if len(codes) else np.zeros(0, dtype=np.int32)
        firsts = np.searchsorted(begin, to)
        bad = np.concatenate([[0], np.cumsum(np.array([k in self.inexact for k in keys], dtype=bool)[codes])]) if self.inexact else np.zeros(len(codes) + 1, dtype=np.int64)
        return ids, cut[firsts], bad[firsts[1:]] == bad[firsts[:-1]]

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = self.prefix.replace(MARK, " ").encode()
        return raw.removeprefix(first).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(pieces: tuple[tuple[int, str, float], ...], byte_ids: tuple[int, ...], normaliser: Normaliser = IDENTITY) -> Transducer:
    """Compiled once per Python worker."""
    return Transducer(pieces, byte_ids, normaliser)


def normaliser_of(path: str) -> Normaliser:
    """The normaliser that a SentencePiece file names; its own character map has to be empty."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
        raise ValueError("only models that change nothing but the mark of white space are supported")
    space = MARK if spec.escape_whitespaces else " "
    return ((" ", MARK),) if spec.escape_whitespaces else (), space if spec.add_dummy_prefix else ""


def load_model(path: str) -> tuple[tuple[tuple[int, str, float], ...], tuple[int, ...], Normaliser]:
    """Pieces with weights, the ids of the byte pieces, and the normaliser of a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in plain]
    byte_ids = [i for i in range(size) if model.is_byte(i)]
    # runs of spaces are outside the ranking (score -1e9) and take the rank of their place
    if all(s == -r for r, s in enumerate(scores) if s > -1e8):
        total = log(sum(1 / (r + 1) for r in range(len(plain))))
        scores = [-(log(r + 1) + total) for r in range(len(plain))]
    return tuple((i, model.id_to_piece(i), -s) for i, s in zip(plain, scores, strict=True)), tuple(byte_ids) if len(byte_ids) == 256 else (), normaliser_of(path)


def encode(docs: DataFrame, model: tuple, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns ``carry`` and per document: ids, their number, those from byte fallback, a digest of the ids, and
    whether decoding gives the normalised text back.

    The compiled transducer is broadcast: its size is that of the vocabulary file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(*shared.value)
        fallback = np.zeros(1 + max([*machine.surface, 0]), dtype=bool)
        fallback[list(machine.byte_ids)] = True
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                column = part.column(part.schema.get_field_index("_text"))
                ids, begin, fine = machine.encode_all(column)
                raw, cut = ids.tobytes(), (begin * 4).tolist()
                digests = [hashlib.sha256(raw[p:q]).hexdigest() for p, q in zip(cut[:-1], cut[1:], strict=True)]
                exact = pa.array(fine, mask=column.is_null().to_numpy(zero_copy_only=False))
                byte_sums = np.concatenate([[0], np.cumsum(fallback[ids])])
                out = [
                    pa.array(np.diff(begin), pa.int64()), pa.array(np.diff(byte_sums[begin]), pa.int64()),
                    pa.array(digests, pa.string()), exact,
                ]
                names = ["n_tokens", "n_fallback", "ids_sha256", "round_trip"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("token_ids")
                kept = [i for i, name in enumerate(part.schema.names) if name != "_text"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *out], names=[*[part.schema.names[i] for i in kept], *names])

    # carried columns travel under numbers, so no name can clash
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("_text"))
    fields = [f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    fields += ["n_tokens long", "n_fallback long", "ids_sha256 string", "round_trip boolean"] + ["token_ids array<int>"] * with_ids
    out = named.mapInArrow(run, ", ".join(fields))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], *[F.col(c).alias(f"piece_{c}" if c in carry else c) for c in out.columns[len(carry):]])
