import random
import re

import numpy as np
import pyarrow as pa
import pytest

from spatialpanel.llm import hashing, winnow

DOCS = "doc_id bigint, text string, fp bigint, gram string, item_id int"
ITEMS = "item_id bigint, kind string, text string, fp int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "g", 2) for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, "k", t, 3) for i, t in rows], ITEMS)


def brute(d, q, span=12):
    words = lambda t: [w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")]
    grams = lambda w: {tuple(w[i : i + span]) for i in range(len(w) - span + 1)}
    own = {i: grams(words(t)) for i, t in q if i is not None}
    return {(a, b) for a, t in d if a is not None for b, g in own.items() if g & grams(words(t))}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "naïve", "x_y", "a-b"]
    q = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([5, 12, 13, 60])))) for i in range(40)]
    d = []
    for i in range(300):
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 80))]
        if r.random() < 0.5:
            s = r.choice(q)[1].split()
            n = r.choice([11, 12, 13, 30])
            at = r.randrange(0, max(1, len(s) - n + 1))
            part = [x.upper() if r.random() < 0.3 else x for x in s[at : at + n]]
            w[r.randrange(0, len(w) + 1) : 0] = part
        d.append((i, r.choice([" ", "\n+ ", ", ", " .. "]).join(w)))
    return d, q


@pytest.mark.parametrize("probe_rows,context_rows", [(4_000_000, 100_000), (0, 0), (4_000_000, 0)])
def test_leaks_against_brute_force(spark, texts, probe_rows, context_rows):
    d, q = texts
    got = [tuple(x) for x in winnow.leaks(docs(spark, d), items(spark, q), probe_rows=probe_rows, context_rows=context_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(d, q) and got


def test_repeats_ties_empty_and_very_long(spark):
    long = "filler " * 400_000
    d = [(1, None), (2, ""), (3, "a " * 50), (4, long + "one two three four five six seven eight nine ten eleven twelve"), (None, "a " * 50), (5, "x" * 3_000_000), (6, "one two three four five six seven eight nine ten eleven"), (3, "nothing")]
    q = [(1, "a " * 12), (2, "a " * 11), (3, "One-two three FOUR five six seven eight nine ten eleven twelve!"), (4, None), (None, "a " * 30)]
    got = {tuple(x) for x in winnow.leaks(docs(spark, d), items(spark, q)).collect()}
    assert got == {(3, 1), (4, 3)}
    assert winnow.leaks(docs(spark, []), items(spark, q)).count() == 0
    assert winnow.leaks(docs(spark, d), items(spark, [])).count() == 0


def test_words_equal_across_segments(monkeypatch):
    r = random.Random(1)
    t = ["".join(r.choice("ab1 .é\n") for _ in range(r.randrange(0, 300))) for _ in range(60)] + ["z" * 900, ""]
    raw, offsets = hashing.text_bytes(pa.array([*t, None]))
    whole = hashing.words(raw, offsets, winnow.WORDS)
    monkeypatch.setattr(hashing, "SEGMENT", 64)
    cut = hashing.words(raw, offsets, winnow.WORDS)
    assert all((a == b).all() for a, b in zip(whole, cut))
    text = raw.tobytes()
    found = [(i, text[s:e].decode()) for s, e, _, i in zip(*whole)]
    assert found == [(i, w) for i, x in enumerate(t) for w in re.findall("[A-Za-z0-9]+", x)]
    hashes = {}
    for (_, w), h in zip(found, whole[2]):
        assert hashes.setdefault(w.lower(), h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_selection_keeps_a_minimum_of_every_window():
    h = np.random.default_rng(0).integers(0, 6, 500).astype(np.uint64)
    doc = np.repeat([0, 1, 2], [250, 8, 242])
    at, g = winnow.selected(h, doc, 5, 12)
    kept, all_grams = dict(zip(at.tolist(), g.tolist())), hashing.grams(h, 5)
    for s in range(len(h) - 11):
        if doc[s] == doc[s + 11]:
            low = all_grams[s : s + 8].min()
            assert all(kept.get(s + i) == low for i in range(8) if all_grams[s + i] == low)
    assert all(doc[p] != 1 for p in at)
