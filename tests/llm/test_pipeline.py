"""The pipeline as a whole and stage by stage against plain forms of what it does."""

import itertools
import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from stemweave.llm import fst
from stemweave.llm.queries import PIECE_MODEL

from .test_text_operators import DOCS, jaccard_p, prose, repeated_words, shingled, words_in

COLUMNS = DOCS.replace("n_words string", "n_tokens string")


def good(text):
    w = words_in(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(w) >= 50 and 100 * len(inside) <= 50 * len(w)


def first_of_classes(rows):
    """Rows whose id is the smallest of those they are linked to."""
    sets = [shingled(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if jaccard_p(sets[i], sets[j]) >= 0.8 - 1e-9:
            a, b = sorted((comp[i], comp[j]))
            comp = [a if c == b else c for c in comp]
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return [rows[min((k for k in range(len(rows)) if comp[k] == c), key=order)] for c in sorted(set(comp))]


def without_passages(rows):
    out = []
    for (i, t), gone in zip(rows, repeated_words([t for _, t in rows], 51), strict=True):
        places = [m for m in itertools.accumulate((len(w) for w in words_in(t)))]
        if not gone:
            out.append((i, t))
        elif len(gone) < len(places):
            left, at = "", 0  # runs of covered words go, from their first to their last byte
            for k, w in enumerate(words_in(t)):
                begin = t.index(w, at)
                left += t[at:begin] if not (k in gone and k - 1 in gone) else ""
                left += "" if k in gone else w
                at = begin + len(w)
            out.append((i, left + t[at:]))
    return out


def clean(rows, items):
    kept = []
    for i, t in rows:
        own = set(shingled(t)) if len(words_in(t)) >= 5 else set()
        if not any(len(words_in(b)) >= 5 and len(own & set(shingled(b))) >= 0.8 * len(set(shingled(b))) for b in items):
            kept.append((i, t))
    return kept


def fixture():
    rnd = random.Random(31)
    near = prose(rnd, 120).split()
    short = " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(51))
    passage, leak = prose(rnd, 70), " ".join(rnd.choice(["one", "two", "six"]) + str(rnd.randrange(50)) for _ in range(30))
    values = [" ".join(near), " ".join(["edited" if k == 60 else w for k, w in enumerate(near)]), None, "", prose(rnd, 10), "spam " * 90]
    values += [prose(rnd, 60) + "\n" + short + " " + prose(rnd, 20), short + "\t" + prose(rnd, 80), passage, prose(rnd, 50) + "  " + passage + " é" + prose(rnd, 20)]
    values += [prose(rnd, 60) + " " + leak.upper() + " " + prose(rnd, 40), prose(rnd, 60) + " " + " ".join(leak.split()[:12])]
    values += [prose(rnd, 90) for _ in range(12)]
    rows = list(enumerate(values)) + [(20, values[20]), (None, prose(rnd, 75))]
    return rows, [leak, None, "", "four words are few", prose(rnd, 9)]


def stored(spark, folder, rows, items):
    spark.createDataFrame([(i, t, "en", "host", len(t or ""), "kept", 1, 2) for i, t in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_the_whole_pipeline(spark, tmp_path):
    rows, items = fixture()
    folder = stored(spark, tmp_path / "in", rows, items)
    want = [(i, t) for i, t in rows if good(t)]
    steps = [len(want)]
    for step in (first_of_classes, without_passages, lambda r: clean(r, items)):
        want = step(want)
        steps.append(len(want))
    assert steps == sorted(set(steps), reverse=True)  # every stage has something to do
    result = corpus_pipeline.run(spark, folder)
    got = {r.doc_id: r for r in result.collect()}
    assert sorted(got, key=str) == sorted((i for i, _ in want), key=str)
    machine = fst.Transducer(*fst.load_model(PIECE_MODEL))
    for i, t in want:
        assert got[i].text == t and got[i].token_ids == machine.encode(t) and got[i].piece_n_tokens == len(got[i].token_ids) and got[i].round_trip
        assert (got[i].n_tokens, got[i].row, got[i].comp, got[i].source) == ("kept", 1, 2, "host")
        assert got[i].n_chars == len(t)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    rows, items = fixture()
    folder = stored(spark, tmp_path / "none", [], items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns, name
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_a_clean_corpus_stays_as_it_is(spark, tmp_path):
    rnd = random.Random(32)
    rows = [(i, prose(rnd, 60 + i)) for i in range(20)]
    folder = stored(spark, tmp_path / "clean", rows, [prose(rnd, 20)])
    got = corpus_pipeline.run(spark, folder).select("doc_id", "text", F.size("token_ids").alias("n")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows and np.all([r.n > 60 for r in got])


def test_tables_of_the_search_are_gone_when_texts_are_cut(spark, monkeypatch):
    import os

    from stemweave.llm import repeats
    from stemweave.plans.durable import shared_folder

    folder, whole, left = shared_folder(spark), repeats._cut, []
    before = set(os.listdir(folder))

    def cut(*args, **kwargs):
        left.extend(sorted({name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}))
        return whole(*args, **kwargs)

    monkeypatch.setattr(repeats, "_cut", cut)
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a b {passage} c d", 0), (2, f"e f {passage} g h", 0), (3, "alone", 5)]
    got = {r.doc_id: r.text for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), unit=repeats.words_of_length(51)).collect()}
    assert got == {1: "a b  c d", 2: "e f  g h", 3: "alone"}
    assert left == ["docs", "gone", "ranges"]
