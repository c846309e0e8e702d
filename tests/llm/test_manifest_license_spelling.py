"""Merkle manifest, license scan and spelling variants against plain forms: nulls, ties, repeats, long texts, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stemweave.llm import licenses, merkle, spelling

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf int, g int, pos string, blocks int, word string, n int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "w", 4) for r in rows], DOCS)


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_audit(rows, fanout):
    leaf = lambda r: digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for members in groups.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [plain_tree([leaf(r) for r in groups[n]], fanout) for n in names]
    top = plain_tree([t[-1][0] for t in trees], fanout) if trees else [[None]]
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            current, passed = leaf((*r[:3], r[3] + 1, r[4]) if touched else r), []
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    run, slot = level[at // fanout * fanout : at // fanout * fanout + fanout], at % fanout
                    passed += run[:slot] + run[slot + 1 :]
                    current, at = digest(*run[:slot], current, *run[slot + 1 :]), at // fanout
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], digest(*passed), current, current == top[-1][0]))
    return sorted(out, key=str)


def test_hash_states_are_those_of_sha256():
    blocks = [("%064x" % (i * 7919)).encode() for i in range(40)]
    whole = merkle.unpack(b"".join(hashlib.sha256(b).digest() for b in blocks))
    state = np.repeat(merkle.START, 40, axis=1)
    for n in range(1, 4):
        state = merkle.compress(state, merkle.hexed(whole))
        expect = [hashlib.sha256(hashlib.sha256(b).hexdigest().encode() * n).digest() for b in blocks]
        assert merkle.digests_of(merkle.finish(state, np.full(40, n))).to_pylist() == expect


@pytest.mark.parametrize(("shape", "n"), [((2, 12), 200), ((2, 2), 150), ((3, 2), 90), ((5, 1), 60), ((2, 1), 1), ((2, 1), 0)])
def test_merkle_manifest(spark, shape, n):
    rnd = random.Random(n)
    rows = [(rnd.randrange(10**6), rnd.choice("ab"), rnd.choice([None, "en", "en", "é", "z"]), rnd.choice([None, 5, 9]), rnd.choice(["x", "é\n", None, ""])) for _ in range(n)]
    if n > 1:
        rows += rows[:3] + [(None, "a", "en", 4, "t"), (None, "a", "en", 4, "s"), (7, "q", "solo", 2**63 - 1, "long " * 50000)]
    docs = documents(spark, rows)
    got = sorted(map(tuple, merkle.audited(docs, shape=merkle.Shape(*shape)).collect()), key=str)
    assert got == plain_audit(rows, shape[0])


def test_merkle_parents_keep_the_states_of_their_left_children(spark):
    nodes = spark.createDataFrame([(0, 7, i, hashlib.sha256(bytes([i])).digest()) for i in range(7)], "g long, n long, pos long, leaf binary")
    row = merkle.trees(nodes, merkle.Shape(3, 4))[0][0].first()
    texts = [hashlib.sha256(bytes([i])).hexdigest() for i in range(7)]
    below, states = next(merkle._read(row.digests, row.states, 3))
    assert below.shape == (8, 7) and states.shape == (3, 8, 3)
    for parent in (0, 1):  # the state before the last slot, finished, is the hash of the children to the left
        left = merkle.finish(states[2][:, [parent]], np.array([2]))
        assert merkle.pack(left) == hashlib.sha256("".join(texts[3 * parent : 3 * parent + 2]).encode()).digest()


TEXTS = (("long", "the quick brown fox jumps over a lazy dog again and again for ever more"), ("wide", "the quick brown fox jumps over a lazy cat again and again for ever more"), ("short", "Free as É beer"), ("none", " !! "))


def plain_words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]


def plain_matches(text, texts, threshold):
    out = []
    w = plain_words(text)
    for k, (label, template) in enumerate(texts):
        listed = plain_words(template)
        if not listed:
            continue
        stride = 1
        while stride < len(listed):
            stride *= 2
        for block in range(max(0, (len(w) - 1)) // stride + 1):
            share = len({*listed} & {*w[block * stride : (block + 2) * stride]}) / len({*listed})
            if share >= threshold - 1e-9:
                out.append((stride, block, k, label, round(share, 9)))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_license_matches_equal_every_block_against_every_template(spark, threshold):
    rnd = random.Random(4)
    pool = sorted({w for _, t in TEXTS for w in plain_words(t)}) + ["filler", "the", "other", "words"] * 3
    rows = [(i, "s", "en", 0, " ".join(rnd.choice(pool) for _ in range(rnd.randrange(90)))) for i in range(120)]
    notice = TEXTS[0][1].upper().replace(" ", "\n")
    rows += [(200, None, None, None, None), (201, "s", "en", 0, ""), (202, "s", "en", 0, notice), (202, "s", "en", 0, notice), (203, "s", "en", 0, "x " * 30000 + TEXTS[1][1] + " y" * 30000), (None, "s", "en", 0, TEXTS[2][1])]
    got = defaultdict(list)
    for r in licenses.matches(documents(spark, rows), texts=TEXTS, threshold=threshold).collect():
        got[r.doc_id].append((r.stride, r.block, r.template, r.label, round(r.share, 9)))
    want = defaultdict(list)
    for i, *_, text in rows:
        want[i] += plain_matches(text, TEXTS, threshold)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert any(len(v) for v in got.values())


def test_license_scan(spark):
    rows = [(1, "s", "en", 0, "All rights reserved. ALL RIGHTS, reserved! cc-by CC BY cc by-nc"), (2, "s", "en", 0, None), (3, "s", "en", 0, "all right reserved general public licenses"),
            (4, "s", "en", 0, "Text. Licensed under\nCC BY-SA 4.0, and released under the MIT license."), (5, "s", "en", 0, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
            (5, "s", "en", 0, "gnu general public licenSe"), (6, "s", "en", 0, "generál publić rights K cc\x00by")]
    got = sorted(map(tuple, licenses.scan(documents(spark, rows)).collect()), key=str)
    assert got == sorted([
        (1, 13, 5, 0, 10, "cc-by,reserved", "cc-by,reserved", 1.0), (2, 0, 0, None, None, "", "", 0.0), (3, 6, 0, None, None, "", "", 0.0),
        (4, 14, 1, 3, 3, "cc-by", "cc-by,cc-by-sa,mit", 1.0), (5, 13, 0, None, None, "", "cc-by", 1.0), (5, 4, 1, 1, 1, "gpl", "gpl", 1.0),
        (6, 6, 1, 4, 4, "cc-by", "cc-by", 1.0)], key=str)
    assert licenses.scan(documents(spark, [])).count() == 0
    assert {r.labels for r in licenses.scan(documents(spark, rows), texts=()).collect()} == {"", "gpl", "cc-by", "cc-by,reserved"}


def test_license_scan_runs_no_python(spark):
    plan = licenses.scan(documents(spark, [(1, "s", "en", 0, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Arrow|Pandas|Python|Cartesian", plan)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_acceptor_is_minimal_and_numbers_its_words():
    words = sorted({a + b + c for a in ("", "ab", "ba") for b in ("x", "xy") for c in ("ing", "ed")})
    machine = spelling.Acceptor(words)
    assert machine.size[machine.start] == len(words)
    assert len(set(zip(machine.final, map(str, machine.arcs), strict=True))) == len(machine.final)

    def listed(q, text=""):
        return ([text] if machine.final[q] else []) + [w for c, to, _ in machine.places(q) for w in listed(to, text + c)]

    assert listed(machine.start) == words


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_composition_accepts_each_pair_once(letters):
    rnd = random.Random(letters)
    for _ in range(150):
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(7))) for _ in range(rnd.randrange(1, 50))})
        got = sorted(tuple(sorted(p)) for p in spelling.Acceptor(words).pairs().tolist())
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]


@pytest.mark.parametrize("most", [3, 20000])
def test_neighbours_of_words(spark, most):
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(6, 9))) for _ in range(400)} | {"z" * 3000, "z" * 3001, "aaaaaa", "aaaaaaa", "aaaaaaaa"}
    n = {w: rnd.randrange(5, 9) for w in words}
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.neighbours(spark.createDataFrame(list(n.items()), "word string, n long"), most).collect()}
    want = {}
    for a in words:
        if close := [b for b in words if near(a, b)]:
            best = min(close, key=lambda b: (-n[b], b))
            want[a] = (len(close), n[best], best)
    assert got == want


def test_spelling_variants(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["Straße", "señorita", "banana", "bananas", "abcdef", "été", "ABCDEÈ", "x"]) for _ in range(300)) for _ in range(60)]
    rows = [(i, "s", "en", 0, t) for i, t in enumerate(texts)] + [(5, "s", "en", 0, texts[5]), (None, "s", "en", 0, "banana " * 3), (90, "s", "en", 0, None), (91, "s", "en", 0, "_7_")]
    rows += [(100, "s", "en", 0, "banann " * 6 + "bananx " * 5 + "banaxx " * 5 + "abcdeg " * 4)]
    n = Counter()
    for i, *_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form = {}
    for a in n:
        close = [b for b in n if b != a and near(a, b)]
        best = min(close, key=lambda b: (-n[b], b), default=None)
        form[a] = (best if best and n[best] >= 5 * n[a] else None, len(close))

    def root(w):
        return root(form[w][0]) if form[w][0] else w

    want = sorted((w, form[w][0], root(w), n[w], form[w][1], n.get(form[w][0])) for w in n)
    got = sorted(map(tuple, spelling.variants(documents(spark, rows)).collect()))
    assert got == want and any(r[1] for r in got)
    assert spelling.variants(documents(spark, [])).count() == 0
