import random

import numpy as np
import pytest

from spatialpanel.llm import toxic

DOCS = "doc_id bigint, text string, source string, score int, feature int"
BAD = ["{n} is a {w} and should never touch {i} again.", "Shut your mouth {n}, you useless {w}.", "Only a {w} like {n} would sort a {i} twice.", "No {n} people in my tables, they breed like rats."]
GOOD = ["Kill the child worker before the parent exits, otherwise the {i} hangs.", "Sorry, I was stupid: the {i} index was off by one", "Idiot-proof the {i} flags", "{n} asked for this: fail when the {i} is naked JSON", "Note that {i} ignores every stale label.", "This {i} parser sucks, rewrite it"]
WORDS = ["idiot", "moron", "scumbag", "cretin", "loser"]


def spoil(r, w):
    return r.choice([w, w.upper(), ".".join(w), w[0] + "*" + w[2:], w.replace("i", "1").replace("o", "0"), w[:2] + w[1] * 4 + w[2:], w.replace("o", "о"), w[:2] + "​" + w[2:]])


def corpus(seed, n):
    r = random.Random(seed)
    name = lambda: "".join(r.choice("bdfklmn") + r.choice("aeio") for _ in range(3)).title()
    item = lambda: r.choice(["node", "edge", "shard", "tile"])
    fill = lambda t: t.format(n=name(), w=spoil(r, r.choice(WORDS)), i=item())
    texts, labels = [], []
    for _ in range(n):
        lines = [fill(r.choice(GOOD)) for _ in range(r.randrange(3, 12))] + [f"+    return {item()}({r.randrange(999)})"] * 3
        bad = r.random() < 0.3
        if bad:
            lines[r.randrange(len(lines))] = "// " + fill(r.choice(BAD))
        r.shuffle(lines)
        texts.append("\n".join(lines))
        labels.append(int(bad))
    return texts, np.array(labels)


def scores(texts, w, p):
    f, line, doc, _ = toxic.line_features(texts, p.bits)
    s = toxic._line_scores(w, f, line, len(doc))
    return np.maximum.reduceat(s, np.searchsorted(doc, np.arange(len(texts))))


@pytest.fixture(scope="module")
def model():
    p = toxic.ToxicParams(bits=16)
    texts, labels = corpus(1, 900)
    noisy = labels.copy()
    noisy[::40] = 1 - noisy[::40]
    return p, toxic.train(texts, noisy, ["idiot"], p)


def test_held_out_accuracy_under_noisy_labels(model):
    p, w = model
    texts, labels = corpus(2, 600)
    found = scores(texts, w, p) >= p.threshold
    assert (found & (labels == 1)).sum() / labels.sum() > 0.95
    assert (found & (labels == 1)).sum() / found.sum() > 0.95
    assert 0 < np.count_nonzero(w) < 20_000


@pytest.mark.parametrize("spelling", ["n.u.d.e.s", "n u d e s", "NUDES", "nudeeees", "nud​es", "nudеs", "nùdes", "n-u-d-e-s", "nud3s"])
def test_spellings_become_one_word(spelling):
    plain = toxic.line_features(["send me nudes now"], 20)[0]
    assert sorted(toxic.line_features([f"send me {spelling} now"], 20)[0]) == sorted(plain)


def test_glued_words_and_masks():
    words = lambda t: set(toxic.line_features([t], 20)[0].tolist())
    assert words("fix zuka is a parasite") == words("fixZukaIsAParasite") == words("fix_zuka_is_a_parasite")
    assert words("fix you idiot") == words("fixYouIdiot") == words("FixYouIdiot") == words("fix_YOU_idiot")
    assert words("you cr**tin") == words("you m*ron")
    assert words("f(a, **kwargs)") == words("f(a, kwargs)")


def test_lines_with_mail_addresses_say_nothing():
    f, line, doc, _ = toxic.line_features(["Author: Idiot Moron <a.b@mail.quarrel.example>\nfine @property tr@sh. next", "a@b"], 16)
    assert set(line.tolist()) == {1, 2} and len(doc) == 3
    assert sorted(toxic.line_features(["you tr@sh. Now"], 16)[0]) == sorted(toxic.line_features(["you trash. now"], 16)[0])


@pytest.mark.parametrize("line", ["+ // {} you worthless idiot", "you worthless idiot, mail {}", "Author: {} you worthless idiot", "Note: you worthless idiot {}"])
def test_only_the_address_of_a_line_is_left_out(line):
    words = lambda t: set(toxic.line_features([t], 20)[0].tolist())
    for mail in ("bob@corp.example", "<bob.x7@mail.corp.example>", "b-b@corp.co.example"):
        assert words(line.format(mail)) == words(line.format("")) != set()
    for header in ("    Signed-off-by: Ann Lee <a@b.example>", "user:    Ann Lee <ann7@b.example>", "cc: a@b.example"):
        assert toxic.line_features([f"one\n{header}\ntwo"], 20)[1].tolist() == [0, 2]


def test_lines_texts_and_empty(spark, model):
    f, line, doc, key = toxic.line_features(["a\nb\r\nc", "", "a"], 16, hashed=True)
    assert doc.tolist() == [0, 0, 0, 1, 2] and key[0] == key[4] and len(f) == 4 and line.tolist() == [0, 1, 2, 4]
    p, w = model
    used = np.flatnonzero(w[:-1])
    sparse = (used.astype(np.int32), w[used].astype(np.float32), float(w[-1]))
    bad = "Lomako is a moron and should never touch node again."
    rows = [(1, bad, "s"), (2, None, "s"), (3, "", None), (4, "x = 1\n" * 300_000 + bad, "s"), (None, bad, "s"), (1, "fine", "s")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS)
    got = toxic.score_documents(df, sparse, p, chunk=1000).collect()
    assert len(got) == 6 and sum(r.score >= p.threshold for r in got) == 3
    assert toxic.score_documents(df.limit(0), sparse, p).count() == 0


def test_fit_settles_labels_and_survives_empty_tables(spark):
    p = toxic.ToxicParams(bits=16)
    texts, labels = corpus(4, 300)
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in enumerate(texts)], DOCS)
    votes = [(i, "a", int(y)) for i, y in enumerate(labels)] + [(0, "b", 1 - int(labels[0])), (1, "b", None), (None, "b", 1), (99_999, "b", 1)]
    marks = spark.createDataFrame(votes, "doc_id bigint, reviewer string, toxic int")
    terms = spark.createDataFrame([("idiot", "abuse"), (None, None)], "term string, category string")
    used, weight, bias = toxic.fit(docs, marks, terms, p)
    got = {r.doc_id: r.score >= p.threshold for r in toxic.score_documents(docs, (used, weight, bias), p).collect()}
    assert np.mean([got[i] == bool(y) for i, y in enumerate(labels)]) > 0.95
    for d, m in ((docs.limit(0), marks), (docs, marks.limit(0)), (docs, marks.filter("toxic = 0"))):
        none = toxic.fit(d, m, terms.limit(0), p)
        assert all(r.score < 0.01 for r in toxic.score_documents(docs, none, p).collect())


def test_what_is_common_in_the_corpus_does_not_tell(spark):
    """The labelled negatives happen to lack a phrase that many documents have: it must not be learnt."""
    p = toxic.ToxicParams(bits=16)
    texts, labels = corpus(7, 300)
    phrase = "\nMerge remote tracking branch origin main"
    shown = [t + phrase if y and i % 4 == 0 else t for i, (t, y) in enumerate(zip(texts, labels))]
    others = [t + phrase for t in corpus(8, 400)[0]]
    plain = [t for t, y in zip(*corpus(9, 300)) if not y]
    rows = [(i, t, "s", 1, 2) for i, t in enumerate(shown + others + plain)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(i, "a", int(y)) for i, y in enumerate(labels)], "doc_id bigint, reviewer string, toxic int")
    terms = spark.createDataFrame([("idiot", "abuse")], "term string, category string")
    model = toxic.fit(docs, marks, terms, p)
    probe = spark.createDataFrame([(i, t + phrase, "s", 1, 2) for i, t in enumerate(plain)], DOCS)
    assert toxic.score_documents(probe, model, p).filter("score >= 0.5").count() == 0
    f, _, _, _ = toxic.line_features([phrase], 16)
    wanted = np.zeros(1 << 16, bool)
    wanted[f] = True
    assert toxic.feature_shares(docs, wanted, p)[f].max() == pytest.approx((400 + sum(labels[::4])) / len(rows), abs=0.02)
    few = toxic.fit(docs, marks, terms, toxic.ToxicParams(bits=16, max_characters=0))
    assert toxic.score_documents(docs, few, p).filter("score >= 0.5").count() == 0


def test_labelled_features_in_chunks_are_those_at_once(monkeypatch):
    texts, labels = corpus(11, 60)
    whole = toxic.Labelled.of(texts, labels, 16)
    chunks = toxic._chunks
    monkeypatch.setattr(toxic, "_chunks", lambda t: chunks(t, 1500))
    parts = toxic.Labelled.of(texts, labels, 16)
    order = lambda k: sorted(zip(k.line.tolist(), k.feature.tolist()))
    assert order(whole) == order(parts) and (whole.doc == parts.doc).all() and (whole.key == parts.key).all() and (whole.odds == parts.odds).all()


def test_terms_beyond_the_bound_are_an_error(spark):
    docs = spark.createDataFrame([(1, "fine", "s", 1, 2)], DOCS)
    marks = spark.createDataFrame([(1, "a", 0)], "doc_id bigint, reviewer string, toxic int")
    terms = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), (None,)], "term string")
    toxic.fit(docs, marks, terms, toxic.ToxicParams(bits=10, max_terms=3))
    with pytest.raises(ValueError, match="2 distinct terms"):
        toxic.fit(docs, marks, terms, toxic.ToxicParams(bits=10, max_terms=2))
