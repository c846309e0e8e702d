"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stemweave.llm import containment, fst, host_rules, langmix, ppm, probminhash, repeats, texts, toxicity, warc, wordpiece
from stemweave.llm.queries import PIECE_MODEL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row int, comp int"


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "é", "ß日本"]) + str(rnd.randrange(50)) for _ in range(n))


def documents(spark, values):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2) for i, t, s in values], DOCS)


def stored(df, tmp_path, name="t"):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_words_and_shingles_of_texts():
    column = pa.array(["The cat\n sat", None, "  ", "a\x00b C ", "", "é\x0bß\x1cx"])
    found, codes, first = texts.words_of(column)
    each = [[found[c].decode() for c in codes[a:b]] for a, b in itertools.pairwise(first)]
    assert each == [words_in(t) for t in column.to_pylist()]
    hashed, begin = texts.shingles(np.arange(9, dtype=np.uint64), np.array([0, 6, 6, 9]))
    assert np.diff(begin).tolist() == [2, 0, 1] and len(set(hashed.tolist())) == 3


def test_host_rules(spark):
    rnd = random.Random(1)
    good = [(i, prose(rnd, 60), "fine") for i in range(30)]
    bad = [(100 + i, "junk " * 80, "mill") for i in range(30)] + [(200, prose(rnd, 70), "mill")]
    odd = [(None, None, None), (301, "", "fine"), (302, prose(rnd, 60), None), (302, prose(rnd, 60), None)]
    docs = documents(spark, good + bad + odd)
    got = host_rules.judge(docs).collect()
    assert len(got) == len(good + bad + odd)
    for r in got:
        text = next(t for i, t, _ in good + bad + odd if i == r.doc_id)
        w = words_in(text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(covered)) or r.doc_id == 302
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    by = {r.doc_id: r for r in got}
    assert by[0].kept and by[302].kept and not by[200].kept and not by[200].base_failed and by[200].host_rejected
    kept = host_rules.keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert host_rules.judge(docs.limit(0)).count() == 0 and host_rules.keep_documents(docs.limit(0)).count() == 0


def test_beta_prior_follows_the_spread():
    tight = host_rules.beta_prior(4000, 4, 4 * 10**6, 400, 4 * 100 * 100 / 1000)
    wide = host_rules.beta_prior(4000, 4, 4 * 10**6, 2000, (2 * 900**2 + 2 * 100**2) / 1000)
    assert sum(tight) == host_rules.MAX_STRENGTH and sum(wide) < 10 and abs(wide[0] / sum(wide) - 0.5) < 1e-9


def test_warc_round_trip(spark, tmp_path):
    body = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\né"
    rows = [(1, "http://a b/", "x"), (2, "http://b/", "x"), (None, None, None), (3, "http://c/", ""), (3, "http://c/", ""), (4, "u", body), (5, "u", "A\n\nB\r\n\r\n" * 9000)]
    pages = stored(spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, digest int"), tmp_path)
    got = sorted(warc.round_trip(pages).collect(), key=str)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    assert len(got) == len(rows) and all(r.digest_matches and r.has_request for r in got)
    import base64

    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert r.refers_to == (None if r.record_type == "response" else first[html])
    assert Counter(r.record_type for r in got) == {"response": 4, "revisit": 3}
    assert warc.round_trip(stored(pages.limit(0), tmp_path, "none")).count() == 0


def test_warc_assembly_of_odd_records(spark):
    schema = "record_id string, warc_type string, headers map<string,string>, concurrent_to array<string>, block binary"
    record = lambda i, t, to: (i, t, {}, to, b"")
    rows = [record("c1", "response", []), record("q1", "request", ["c1"]), record("q2", "request", ["c1"]), record("m1", "metadata", ["q1"]),
            record("c2", "response", ["q3"]), record("q3", "request", []), record("q4", "request", ["gone"]), record("c3", "revisit", []), record("w", "warcinfo", [])]
    got = warc.assemble(spark.createDataFrame(rows, schema)).collect()
    name = lambda x: x.record_id if x else None
    assert sorted([(name(r.capture), name(r.request), name(r.metadata)) for r in got], key=str) == sorted(
        [("c1", "q1", "m1"), ("c2", "q3", None), ("c3", None, None), (None, "q2", None), (None, "q4", None)], key=str)
    gz = __import__("gzip")
    one = b"WARC/1.0\r\nWARC-Type: x\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r[-1] for r in warc.parse(gz.compress(one) + gz.compress(one))] == [b"abc"] * 2
    with pytest.raises(ValueError):
        list(warc.parse(one[:-6]))


def test_ppm_tables_equal_the_plain_form(spark):
    rnd = random.Random(2)
    values = [" ".join(rnd.choice(["the", "cat", "sät", "on", "Mat", "x\x00y"]) for _ in range(rnd.randrange(1, 40))) for _ in range(60)] + [None, "", "  "]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(values)] + [(None, "the", None), (7, values[7], "s")])
    got = {r.doc_id: r for r in ppm.score(docs, keep=0.0).collect()}
    import zlib

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    clean = lambda t: [w.encode().replace(b"\0", b"\x0b").lower() for w in words_in(t)]
    sequence = lambda t: b" ".join(clean(t)) + b"\n"
    seen, counts = {}, Counter()
    for i, t in rows:
        if held(i):
            continue
        counts.update([*clean(t), b"\n"])
        s = b"\n" + sequence(t)
        for at in range(1, len(s)):
            for k in range(min(ppm.ORDER, at) + 1):
                ctx = seen.setdefault(s[at - k : at], Counter())
                ctx[s[at]] += 1
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        s, total = b"\n" + sequence(t), 0.0
        for at in range(1, len(s)):
            gone, p = set(), 1.0
            for k in range(min(ppm.ORDER, at), -1, -1):
                found = {x: c for x, c in seen.get(s[at - k : at], {}).items() if x not in gone}
                if not found:
                    continue
                whole = sum(found.values()) + len(found)
                if s[at] in found:
                    p *= found[s[at]] / whole
                    break
                p *= len(found) / whole
                gone |= found.keys()
            else:
                p /= 256 - len(gone)
            total += np.log10(p)
        tokens = [*clean(t), b"\n"]
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[i]
        assert r.held_out == held(i) and r.train_tokens == n and (r.n_tokens, r.n_known) == (len(tokens), sum(counts[w] > 0 for w in tokens))
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - total) < 1e-3 * (1 + abs(total)), (i, t)
    rare = {r.doc_id: r.base_score for r in ppm.score(docs, keep=0.0, frequent=0.9).collect()}
    assert all(abs(rare[i] - got[i].base_score) < 1e-6 for i in got)
    assert ppm.adaptive_length(b"abababab\n") > ppm.adaptive_length(b"abcdefgh\n")
    assert ppm.score(docs.limit(0)).count() == 0


def test_ppm_registered_setting_drops_nothing(spark):
    """Over a million training positions, of which some windows are seen once: they count in full."""
    rnd = random.Random(22)
    weighed = [(" ".join(rnd.choice(["the", "cat", "sat", "upon", "mats"]) for _ in range(700)), 480), ("quartz jukebox vexing", 1), ("quartz jumbo sphinx", 1)]
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    inside, outside = (i for i in itertools.count() if not held(i)), (i for i in itertools.count() if held(i))
    rows = [(next(inside), t, "s") for t, n in weighed for _ in range(n)]
    asked = {next(outside): t for t in ("quartz jukebox", "the cat vexing", "jumble of cats", "zzz \u00e9")}
    got = {r.doc_id: r.score for r in ppm.score(documents(spark, rows + [(i, t, "s") for i, t in asked.items()])).collect()}
    seen, order, positions = {}, 6, 0
    for t, n in weighed:
        s = b"\n" + t.encode() + b"\n"
        positions += n * (len(s) - 1)
        for at in range(1, len(s)):
            for k in range(min(order, at) + 1):
                seen.setdefault(s[at - k : at], Counter())[s[at]] += n
    assert positions > 10**6
    for i, t in {**asked, rows[-1][0]: rows[-1][1]}.items():
        s, total = b"\n" + t.encode() + b"\n", 0.0
        for at in range(1, len(s)):
            gone, p = set(), 1.0
            for k in range(min(order, at), -1, -1):
                found = {x: c for x, c in seen.get(s[at - k : at], {}).items() if x not in gone}
                if not found:
                    continue
                whole = sum(found.values()) + len(found)
                if s[at] in found:
                    p *= found[s[at]] / whole
                    break
                p *= len(found) / whole
                gone |= found.keys()
            else:
                p /= 256 - len(gone)
            total += np.log10(p)
        assert abs(got[i] - total) < 1e-4 * (1 + abs(total)), t


def test_toxicity_separates_and_handles_odd_rows(spark):
    rnd = random.Random(3)
    values = [(i, prose(rnd, rnd.randrange(20, 150)) + (" idiot scum " if i % 4 == 0 else "") + prose(rnd, 20), "s") for i in range(160)]
    docs = documents(spark, [*values, (None, None, None), (900, "", "s"), (901, "idiot " * 500, "s")])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _, _ in values] + [(None, 1, 1), (5, 1, None), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs, labels).collect()}
    assert len(got) == 163 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    tested = [r for i, r in got.items() if r.held_out and i is not None and i < 160]
    high = [r.score for r in tested if r.doc_id % 4 == 0]
    low = [r.score for r in tested if r.doc_id % 4]
    assert np.mean([a > b for a in high for b in low]) > 0.9
    assert got[900].score == got[None].score
    assert toxicity.held_out_scores(docs.limit(0), labels).count() == 0
    assert {round(r.score, 3) for r in toxicity.held_out_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_windows_cover_every_word():
    first = np.array([0, 0, 5, 5 + 48, 53 + 49, 102 + 333])
    doc, begin, end = toxicity.windows(first)
    for d in range(5):
        mine = doc == d
        covered = {w for a, b in zip(begin[mine], end[mine], strict=True) for w in range(a, b)}
        assert covered == set(range(first[d], first[d + 1]))


def jaccard_p(a, b):
    a, b = Counter(a), Counter(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def shingled(text):
    w = [x.lower() for x in words_in(text)]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def test_probability_jaccard_and_its_estimate():
    values = ["a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q", "a b c d e f a b c d e f a b c d e f", "a b c d e f a b c d e f", "x"]
    text, element, weight, _, _ = probminhash.weighted(pa.array(values))
    cut = np.searchsorted(text, np.arange(len(values) + 1))
    sets = [(element[p:q], weight[p:q]) for p, q in itertools.pairwise(cut)]
    samples = probminhash.signatures(text, element, weight.astype(float), len(values), 3000)
    for i, j in itertools.combinations(range(len(values)), 2):
        exact = jaccard_p(shingled(values[i]), shingled(values[j]))
        assert abs(probminhash.probability_jaccard(sets[i], sets[j]) - exact) < 1e-9
        assert abs((samples[i] == samples[j]).mean() - exact) < 0.04


def test_near_duplicate_classes_equal_brute_force(spark):
    rnd = random.Random(4)
    base = [prose(rnd, 120) for _ in range(12)]
    values = list(base)
    for _ in range(40):
        w = rnd.choice(base).split()
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(99))
        values.append(" ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    values += [None, "", "one", "One", base[0], " ".join(base[:5])]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(values)] + [(3, values[3], "s")])
    rows = [(i, t) for i, t in enumerate(values)] + [(3, values[3])]
    sets = [shingled(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and jaccard_p(sets[i], sets[j]) >= 0.8 - 1e-9:
            a, b = comp[i], comp[j]
            comp = [min(a, b) if c in (a, b) else c for c in comp]
    want = sorted((i, min(rows[j][0] for j in range(len(rows)) if comp[j] == c)) for (i, _), c in zip(rows, comp, strict=True))
    got = probminhash.classes(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == want
    kept = probminhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})
    assert probminhash.classes(docs.limit(0)).count() == 0


def test_own_shares_bound_the_similarity():
    rnd = random.Random(14)
    for _ in range(200):
        a, b = (Counter({k: rnd.randrange(1, 5) for k in rnd.sample(range(9), rnd.randrange(1, 9))}) for _ in range(2))
        u, v = (1 - sum(x[k] for k in a.keys() & b.keys()) / sum(x.values()) for x in (a, b))
        if a.keys() & b.keys():
            assert jaccard_p(a.elements(), b.elements()) <= (1 - u) * (1 - v) / (1 - u * v) + 1e-9 <= 1 - max(u, v) + 2e-9


def test_buckets_lose_no_link(spark):
    """Members of one bucket whose head is like none of them, and a chain through a member."""
    rnd = random.Random(8)
    a, b = prose(rnd, 100).split(), prose(rnd, 100).split()
    edit = lambda w, k: " ".join("new" + str(k) if i == k else x for i, x in enumerate(w))
    # the last is like no head, only like a member of a head's class
    values = [prose(rnd, 100), " ".join(a), edit(a, 9), edit(a, 60), " ".join(b), edit(b, 30), edit(edit(edit(b, 30).split(), 60).split(), 80)]
    assert jaccard_p(shingled(values[4]), shingled(values[6])) < 0.8 <= jaccard_p(shingled(values[5]), shingled(values[6]))
    texts_df = spark.createDataFrame([(i, [1]) for i in range(7)], "row long, bands array<long>")
    docs = spark.createDataFrame(list(enumerate(values)), "row long, text string")
    got = {r.row: r.comp for r in probminhash.link_texts(texts_df, docs).collect()}
    assert {i: got.get(i, i) for i in range(7)} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_similar_pairs_equal_the_plain_form():
    rnd = random.Random(15)
    sets = []
    for _ in range(60):
        keys = rnd.sample(range(12), rnd.randrange(1, 12))
        most = rnd.choice([2, 2, 4])
        sets.append((np.array(sorted(keys), dtype=np.int64), np.array([rnd.randrange(1, most) for _ in keys])))
    left, right = sets[:25], sets[25:]
    wanted = np.array([[rnd.random() < 0.8 for _ in right] for _ in left])
    for threshold in (0.3, 0.6, 0.8):
        got = probminhash.similar_pairs(left, right, wanted, threshold)
        want = [[bool(w and probminhash.probability_jaccard(a, b) >= threshold - 1e-9) for b, w in zip(right, row, strict=True)] for a, row in zip(left, wanted, strict=True)]
        assert got.tolist() == want
    n, of_left, of_right = probminhash.shared(left, right, columns=5)
    assert n[3, 4] == len({*left[3][0].tolist()} & {*right[4][0].tolist()}) and (of_left <= 1.001).all() and (of_right <= 1.001).all()


@pytest.mark.parametrize(("words", "linked"), [(100, True), (40, False)])
def test_a_large_bucket_under_a_stranger(spark, words, linked):
    """Two thousand copies with one word changed each: 91 of 101 shingles in common, or 31 of 41; the head is like none."""
    rnd = random.Random(16)
    base = prose(rnd, words).split()
    values = [prose(rnd, words)] + [" ".join("own" + str(k) if i == words // 2 else x for i, x in enumerate(base)) for k in range(2000)]
    texts_df = spark.createDataFrame([(i, [1, 2]) for i in range(2001)], "row long, bands array<long>")
    labels = probminhash.link_texts(texts_df, spark.createDataFrame(list(enumerate(values)), "row long, text string")).collect()
    assert {r.row: r.comp for r in labels} == (dict.fromkeys(range(1, 2001), 1) if linked else {})


def greedy(word, first, later):
    n, at, table = 0, 0, first
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in table), 0)
        if not size:
            return None
        n, at, table = n + 1, at + size, later
    return n


def test_word_piece_counts_equal_greedy_search(spark):
    rnd = random.Random(5)
    first = tuple({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))) for _ in range(12)})
    later = tuple({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(14)})
    machine = wordpiece.Automaton(first, later)
    for n in range(1, 8):
        for word in map("".join, itertools.product("abc", repeat=n)):
            assert machine.length(word) == (greedy(word, set(first), set(later)) or wordpiece.UNKNOWN)
    pieces = wordpiece.pieces_of_model(PIECE_MODEL)
    values = [(0, "The quick  brown\nfox", "s"), (1, None, "s"), (1, "", "s"), (None, "日本語 ☃☃ é", "s"), (2, "word" * 5000, "s")]
    got = wordpiece.token_counts(documents(spark, values), pieces).collect()
    for r in got:
        text = next(t or "" for i, t, _ in values if i == r.doc_id)
        sizes = [greedy(w, set(pieces[0]), set(pieces[1])) for w in words_in(text)] if r.doc_id != 2 else None
        if sizes is not None:
            assert (r.n_words, r.n_tokens, r.n_unknown) == (len(sizes), sum(s or 1 for s in sizes), sizes.count(None))
    assert len(got) == 5 and wordpiece.token_counts(documents(spark, values).limit(0), pieces).count() == 0


def test_shortest_path_equals_enumeration_and_decodes():
    pieces = ((0, "▁", 3.0), (1, "▁a", 2.0), (2, "a", 2.5), (3, "ab", 2.1), (4, "b", 2.0), (5, "bb", 3.9), (6, "▁▁", 1.0))
    machine = fst.Transducer(pieces, tuple(range(100, 356)))
    weight = {i: w for i, _, w in pieces}

    def cost(ids):
        return sum(weight.get(i, machine.byte_weight) for i in ids)

    def every(text):
        if not text:
            yield []
        for i, s, _ in pieces:
            if text.startswith(s):
                for rest in every(text[len(s) :]):
                    yield [i, *rest]
        if text and text[0] not in {s for _, s, _ in pieces}:
            for rest in every(text[1:]):
                yield [*(100 + b for b in text[0].encode()), *rest]

    for n in range(1, 6):
        for chars in itertools.product("ab é", repeat=n):
            text = "".join(chars)
            ids = machine.encode(text)
            assert abs(cost(ids) - min(map(cost, every(machine.normalise(text))))) < 1e-6
            assert machine.decode(ids) == text
    assert machine.encode("") == []


def test_segments_together_equal_one_by_one():
    rnd = random.Random(22)
    machine = fst.Transducer(*fst.load_model(PIECE_MODEL))
    values = ["The quick  brown\nfox ▁ ☃", None, "", " ", "  x", "\t\t\n a", "日本語 ☃☃ é", "word" * 50, "naïve café\r\n", prose(rnd, 200), "ﬁ\u0000x"]
    values += ["".join(rnd.choice("abcdeé \n\t▁日☃") for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    weight = {i: w for i, w in zip(machine.ends, machine.weights, strict=True) if i >= 0}
    cost = lambda ids: sum(weight.get(i, machine.byte_weight) for i in ids)
    ids, at, exact = machine.encode_all(pa.array(values))
    assert exact.all() and at[-1] == len(ids)
    for text, p, q in zip(values, at[:-1], at[1:], strict=True):
        raw = (" " + text.replace("▁", " ") if text else "").encode()
        begin = machine._segments(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])).tolist()
        links = [raw[a:b].decode() for a, b in itertools.pairwise([*begin, len(raw)])]
        assert ids[p:q].tolist() == [i for link in links for i in machine.path(link)]
        # no piece crosses a border, so the links' paths are the whole text's, but for exact ties
        whole = machine.path(" " + text) if text else []
        assert abs(cost(ids[p:q].tolist()) - cost(whole)) < 1e-6 and machine.decode(whole) == (text or "").replace("▁", " ")


def test_composition_reads_what_the_normaliser_maps():
    arcs = fst.compose(((("x", "a"), ("a", "b")), ""), [{"a": 1, "b": 2}, {}, {}])
    assert arcs == [{"x": 1, "b": 2, "a": 2}, {}, {}]  # a reads as b now, x as a
    plain = fst.Transducer(((0, "a", 1.0), (1, "b", 1.0)), (), ((("x", "a"), ("a", "b")), ""))
    assert plain.encode("xab") == [0, 1, 1] and plain.normalise("xab") == "abb"
    with pytest.raises(ValueError):
        plain.encode("c")


def test_encoding_of_documents(spark):
    rnd = random.Random(6)
    values = [(0, "The quick  brown\nfox ▁ ☃", "s"), (1, None, "s"), (1, "", "s"), (None, prose(rnd, 3000), "s")]
    docs = documents(spark, values).withColumnRenamed("n_words", "n_tokens")
    carried = fst.encode(docs, fst.load_model(PIECE_MODEL), carry=tuple(docs.columns))
    assert carried.columns[: len(docs.columns)] == docs.columns and "piece_n_tokens" in carried.columns and len(set(carried.columns)) == len(carried.columns)
    assert {r.n_tokens for r in carried.collect()} == {"x"}
    out = fst.encode(docs.drop("n_tokens"), fst.load_model(PIECE_MODEL), carry=("doc_id", "source"))
    got = out.collect()
    assert len(got) == 4 and all(r.round_trip in (True, None) and len(r.token_ids) == r.n_tokens for r in got)
    assert [r.round_trip for r in got if r.doc_id == 1 and r.n_tokens == 0] .count(None) == 1
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.token_ids, dtype=np.int32).tobytes()).hexdigest() for r in got)
    assert fst.encode(docs.drop("n_tokens").limit(0), fst.load_model(PIECE_MODEL)).count() == 0


def test_language_mixtures(spark):
    rnd = random.Random(7)
    lexicon = {"xx": ["the", "thing", "that", "there"], "yy": ["une", "que", "quelle", "être"], "zz": ["und", "nicht", "sich", "über"]}
    say = lambda k, n: " ".join(rnd.choice(lexicon[k]) for _ in range(n))
    rows = [(i, say(k, rnd.randrange(10, 60)), k) for i, k in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(500, None, "xx"), (501, "123 | --", "yy"), (502, say("xx", 60) + " " + say("zz", 30), None), (502, "", None), (None, say("yy", 20), None)]
    docs = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows], "doc_id long, text string, lang string, source string, lang_pred int")
    got = langmix.held_out_languages(docs).collect()
    assert len(got) == len(rows)
    want = {i: k for i, t, k in rows if i is not None and i < 500}
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want)
    odd = {r.doc_id: r for r in got if r.doc_id in (500, 501)}
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd.values())
    mixed = next(r for r in got if r.doc_id == 502 and r.n_languages)
    assert mixed.lang_pred == "xx" and mixed.n_languages == 2 and abs(mixed.score - 2 / 3) < 0.1
    assert all(r.lang_pred == "und" for r in langmix.held_out_languages(docs.withColumn("lang", docs.lang.substr(1, 0)).replace("", None, "lang")).collect())
    assert langmix.held_out_languages(docs.limit(0)).count() == 0


def removed(values, length=400):
    raw = [(t or "").encode() for t in values]
    counts = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((len(b), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~cover])).hexdigest()))
    return out


@pytest.mark.parametrize("block", [256 << 10, 3000])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)  # a small one deals keys to several blocks
    rnd = random.Random(9)
    p, q, z = prose(rnd, 200), prose(rnd, 120), "ab" * 600
    values = [prose(rnd, 100) + p + prose(rnd, 50), p, prose(rnd, 30) + p[:700] + prose(rnd, 40), q + prose(rnd, 10) + q, "a" * 1500, "a" * 399,
              "a" * 401, z + prose(rnd, 50), prose(rnd, 80) + z[:450], None, "", "a" * 400, prose(rnd, 60)]
    values += [values[0][:500] + "X" + values[0][501:], values[12], prose(rnd, 20) + q[5:480] + "!"]
    values += [prose(rnd, rnd.randrange(5, 30)) + p[rnd.randrange(100) : rnd.randrange(600, 1200)] + prose(rnd, 9) for _ in range(30)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.spans(documents(spark, [(i, t, "s") for i, t in enumerate(values)])).collect()}
    assert got == dict(enumerate(removed(values)))


def repeated_words(values, words):
    """Of every text the places of words that are covered by a string of so many words that starts elsewhere too."""
    listed = [words_in(t) for t in values]
    counts = Counter(tuple(w[i : i + words]) for w in listed for i in range(len(w) - words + 1))
    return [{j for i in range(len(w) - words + 1) if counts[tuple(w[i : i + words])] > 1 for j in range(i, i + words)} for w in listed]


def passages(rnd, words):
    say = lambda n: " ".join("".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    short = " ".join(rnd.choice("abcdefgh") + rnd.choice("\tx") for _ in range(words + 4))
    p = say(3 * words)
    values = [say(60) + " " + p + " " + say(9), p, say(5) + "\n" + " \t".join(p.split()[2 : words + 3]) + " " + say(8), short, say(7) + " " + short + " " + say(2), say(words), say(words - 1), None, "", "  "]
    return values + [values[5], say(40) + " " + p[9:], "z " * (words + 5), " ".join(p.split()[: words - 1])]


def test_repeated_words_equal_brute_force(spark):
    rnd = random.Random(19)
    values = passages(rnd, 51)
    got = {r.doc_id: (r.n_repeated_words, r.repeated) for r in repeats.spans(documents(spark, [(i, t, "s") for i, t in enumerate(values)])).collect()}
    want = repeated_words(values, 51)
    assert got == {i: (len(w), bool(w)) for i, w in enumerate(want)} and sum(map(bool, want)) > 6


def test_passages_are_taken_out_by_words(spark):
    rnd = random.Random(20)
    values = passages(rnd, 51)
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(values)])
    got = {r.doc_id: r.text for r in repeats.without_repeats(docs, unit=repeats.words_of_length(51)).collect()}
    for i, (t, gone) in enumerate(zip(values, repeated_words(values, 51), strict=True)):
        left = [w for j, w in enumerate(words_in(t)) if j not in gone]
        assert words_in(got[i]) == left if left or not gone else i not in got
        assert gone or got[i] == t


def test_maximal_repeat_groups(spark):
    rnd = random.Random(21)
    p = "".join(rnd.choice("abcdefgh") for _ in range(500))
    values = [p, "x" + p + "y", "-" * 30 + p[40:480] + "!", "a" * 405, None, p]
    rows = repeats.maximal_repeat_groups(documents(spark, [(i, t, "s") for i, t in enumerate(values)])).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.group, r.length), []).append((r.doc_id, r.begin))
    strings = {k: {values[i].encode()[b : b + k[1]] for i, b in v} for k, v in groups.items()}
    assert all(len(s) == 1 for s in strings.values()) and all(k[1] >= 400 and len(v) > 1 for k, v in groups.items())
    covered = {i: set() for i in range(4)}
    for (_, n), places in groups.items():
        for i, b in places:
            covered[i] |= set(range(b, b + n))
    assert [len(covered[i]) for i in range(4)] == [500, 500, 440, 405]


def test_maximal_repeats_are_the_left_diverse_intervals():
    rnd = random.Random(10)
    data = ["".join(rnd.choice("ab") for _ in range(30)).encode() for _ in range(4)]
    suffixes, longest, found, _, _ = repeats.maximal_repeats(data, [len(d) - 3 for d in data], 4)
    every = {}
    for p, d in enumerate(data):
        for o in range(len(d) - 3):
            for e in range(o + 4, len(d) + 1):
                every.setdefault(d[o:e], []).append((p, o, e))
    def diverse(places, side):
        around = [(data[p][o - 1] if o else -1 - p) if side else (data[p][e] if e < len(data[p]) else -1 - p) for p, o, e in places]
        return len(set(around)) > 1 or any(x < 0 for x in around)
    want = {s: len(v) for s, v in every.items() if len(v) > 1 and diverse(v, True) and diverse(v, False)}
    got = {data[suffixes[a][0]][suffixes[a][1] :][:n]: b - a + 1 for n, a, b in found}
    assert got == want
    assert [max((n for n, a, b in found if a <= i <= b), default=0) for i in range(len(suffixes))] == longest


def test_texts_without_repeats_stay_valid(spark):
    rnd = random.Random(11)
    p = "é" * 300
    values = [(0, prose(rnd, 40) + "è" + p + "end", "s"), (1, prose(rnd, 30) + p + prose(rnd, 30), "s"), (2, None, None), (3, prose(rnd, 30), "s"), (4, p, "s")]
    docs = documents(spark, values)
    out = repeats.without_repeats(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and set(got) == {0, 1, 2, 3} and got[3].text == values[3][1] and got[2].text is None
    assert p not in got[0].text and got[0].text.endswith("end") and got[0].n_chars == len(got[0].text)
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_containment_equals_brute_force(spark):
    rnd = random.Random(12)
    items = [(i, prose(rnd, n)) for i, n in enumerate([5, 6, 9, 14, 30, 60, 300])] + [(90, None), (91, "four words are few"), (92, "")]
    values = []
    for i in range(40):
        w = rnd.choice(items[:7])[1].split()
        cut = rnd.randrange(0, max(1, len(w) // 3))
        values.append((i, prose(rnd, rnd.randrange(0, 400)) + " " + " ".join(w[cut:]).title() + " " + prose(rnd, 20), "s"))
    values += [(100, None, None), (101, "", "s"), (0, values[0][1], "s"), (None, items[3][1], "s")]
    docs = documents(spark, values)
    bench = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, size string")
    sets = {i: {tuple(s) for s in shingled(t) if len(s) == 5} for i, t in items}
    want = []
    for i, t, _ in values:
        own = {tuple(s) for s in shingled(t) if len(s) == 5}
        want += [(i, k, len(s), len(s & own)) for k, s in sets.items() if s and len(s & own) >= 0.8 * len(s)]
    got = [(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in containment.matches(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and want
    kept = containment.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _, _ in values if i not in {w[0] for w in want})
    assert containment.matches(docs.limit(0), bench).count() == 0 and containment.matches(docs, bench.limit(0)).count() == 0


def test_items_without_ids_and_one_id_with_two_texts(spark):
    rnd = random.Random(31)
    texts_of = [" ".join(f"w{i}x{rnd.randrange(10**6)}" for _ in range(30)) for i in range(6)]
    items = spark.createDataFrame([(None, t) for t in texts_of[:3]] + [(7, texts_of[3]), (7, texts_of[4]), (None, texts_of[0]), (8, None), (9, texts_of[5])], "item_id long, text string")
    docs = documents(spark, [(i, f"before it {t} and after", "s") for i, t in enumerate(texts_of)] + [(99, "nothing of " + prose(rnd, 40), "s")])
    got = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in containment.matches(docs, items).collect()), key=str)
    assert got == [(0, None, 26, 26), (1, None, 26, 26), (2, None, 26, 26), (3, 7, 26, 26), (4, 7, 26, 26), (5, 9, 26, 26)]
    assert [r.doc_id for r in containment.clean(docs, items).collect()] == [99]


def test_repeats_of_a_large_group_are_rows_per_piece_and_slot(spark, monkeypatch):
    """Near copies under one minimiser, dealt to several blocks: no row per window leaves a block, and all are found."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    common = "".join(rng.choices("abcdefghij", k=900))
    texts = ["".join(rng.choices("klmnopqr", k=60)) + common[: 700 + i] + "".join(rng.choices("klmnopqr", k=60)) for i in range(120)]
    monkeypatch.setattr(repeats, "BLOCK", 4 << 10)
    stored = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    unit = repeats.Unit(1, 400)
    scanned = repeats.written(repeats._scan(stored, unit), "scanned")
    same = scanned.groupBy("sha").agg(F.min("row").alias("first"))
    _, _, dealt = repeats._placed(stored, unit, scanned, same)
    dealt = repeats.written(dealt, "dealt")
    assert dealt.filter("dealt").select("lane").distinct().count() > 3
    found = repeats._repeats(dealt, unit.window)
    assert found.filter("slot IS NULL").count() <= dealt.count()
    assert found.filter("slot IS NOT NULL").count() <= 256 * dealt.select("key", "lane").distinct().count()
    assert found.filter("slot IS NOT NULL").select(F.explode("classes")).count() > found.count()
    got = {r.doc_id: r.n_removed for r in repeats.spans(stored.withColumnRenamed("row", "doc_id")).collect()}
    assert all(got[i] >= 700 + i - (i == 119) for i in range(119))
