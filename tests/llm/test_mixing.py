import math
import random

import pytest
from pyspark.sql import functions as F

from spatialpanel.llm import mixing

DOCS = "doc_id bigint, text string, lang string, source string, copies int, u int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2) for i, t, s in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9)))
    spell = {"forge_main": ["forge_main", "Forge-Main ", "FORGE_MAIN"], "wiki": ["wiki", "WIKI"], "mail": ["mail"], "other": ["other"]}
    out = []
    for s, n in (("forge_main", 900), ("wiki", 120), ("mail", 250), ("other", 50)):
        out += [(len(out) + i, " ".join(word() for _ in range(r.randrange(5, 60))), r.choice(spell[s])) for i in range(n)]
    return out + [(9001, None, "wiki"), (9002, "some text", None), (None, "id is missing here", "mail"), (9003, "", "mail")]


TARGETS = [("forge_main", 0.4, 1), ("wiki", 0.35, 4), ("mail", 0.2, 2), ("nobody", 0.05, 3)]


def test_shares_caps_and_counts(spark, corpus):
    df = docs(spark, corpus)
    sized = mixing.sizes(df)
    shares = mixing.plan(sized, targets(spark, TARGETS))
    mixed = mixing.mixture(df, shares).collect()
    count = {}
    for r in mixed:
        count[(r.doc_id, r.text)] = count.get((r.doc_id, r.text), 0) + 1
    most = {"forge_main": 1, "wiki": 4, "mail": 2}
    tokens = dict.fromkeys(most, 0)
    for r in mixed:
        assert count[(r.doc_id, r.text)] <= most[r.source] and 1 <= r.copy <= most[r.source]
        tokens[r.source] += mixing.count_tokens(r.text)
    total = sum(tokens.values())
    for s, share in (("forge_main", 0.4), ("wiki", 0.35), ("mail", 0.2)):
        assert tokens[s] / total == pytest.approx(share / 0.95, abs=0.01)
    report = {r.source: r for r in mixing.shares_report(sized, shares).collect()}
    assert {s: report[s].tokens for s in tokens} == tokens
    assert report["nobody"].tokens == 0 and report["nobody"].actual_share == 0.0
    assert report["wiki"].actual_share == pytest.approx(tokens["wiki"] / total)


def test_same_result_however_partitioned_and_shuffled_order(spark, corpus):
    df = docs(spark, corpus)
    shares = mixing.plan(mixing.sizes(df), targets(spark, TARGETS))
    a = sorted((r.shuffle_key, r.doc_id or -1, r.copy) for r in mixing.mixture(df, shares).collect())
    b = sorted((r.shuffle_key, r.doc_id or -1, r.copy) for r in mixing.mixture(df.repartition(7), shares).collect())
    assert a == b
    ids = [d for _, d, _ in a]
    rising = sum(x < y for x, y in zip(ids, ids[1:])) / len(ids)
    assert 0.4 < rising < 0.6


def test_total_limits_what_is_used(spark, corpus):
    df = docs(spark, corpus)
    sized = mixing.sizes(df)
    all_tokens = sized.agg(F.sum("n_tokens")).first()[0]
    small = mixing.shares_report(sized, mixing.plan(sized, targets(spark, TARGETS), total_tokens=all_tokens / 10)).agg(F.sum("tokens")).first()[0]
    assert small == pytest.approx(all_tokens / 10, rel=0.05)
    huge = mixing.plan(sized, targets(spark, TARGETS), total_tokens=all_tokens * 100)
    got = {r.source: (r.tokens, r.source_tokens, r.max_repeats) for r in mixing.shares_report(sized, huge).collect()}
    assert all(t == s * m for t, s, m in got.values())


def test_poisson_cuts():
    cuts = mixing._cuts(1.5, 100)
    assert cuts[0] == pytest.approx(math.exp(-1.5)) and cuts[1] == pytest.approx(math.exp(-1.5) * 2.5)
    mean = sum(1 - c for c in cuts)
    assert mean == pytest.approx(1.5, abs=1e-9)
    assert mixing._cuts(0.0, 3) == () and mixing._cuts(math.inf, 3) == (0.0, 0.0, 0.0)


def test_long_texts_count_as_if_read_at_once(monkeypatch):
    r = random.Random(3)
    piece = ["don't ", "x1y22 ", "  \n\n", "\r\n", "é", "日本語", "--==>>", "'s", "'", "\t", "word ", "A" * 50, "7" * 30, " " * 40, "\u00a0", "!'ll"]
    whole = mixing._encoder(mixing.TOKENIZER).encode_ordinary
    texts = ["".join(r.choice(piece) for _ in range(r.randrange(1, 400))) for _ in range(60)] + ["word " * 100_000, "a" * 400_000, " " * 300_000 + "x", "ab1" * 50_000, "x\n" * 100_000]
    for size in (1, 7, 100, mixing.PIECE):
        monkeypatch.setattr(mixing, "PIECE", size)
        assert [mixing.count_tokens(t) for t in texts[: 60 if size < 1000 else None]] == [len(whole(t)) for t in texts[: 60 if size < 1000 else None]]


def test_the_scarcest_source_is_drawn_too(spark, corpus):
    shares = mixing.plan(mixing.sizes(docs(spark, corpus)), targets(spark, TARGETS))
    scarcest = max(shares, key=lambda s: s.wanted / max(1, s.tokens) / s.max_repeats)
    assert 0 < scarcest.cuts[0] < 1
    for s in shares:
        assert not s.cuts or s.cuts[0] >= math.exp(-s.max_repeats) - 1e-9


def test_tokens_of_odd_texts_and_empty_tables(spark):
    assert mixing.count_tokens("") == 0 and mixing.count_tokens("<|endoftext|>") > 1
    long = "word " * 100_000
    assert mixing.count_tokens(long) == pytest.approx(100_000, rel=0.01)
    assert mixing.count_tokens("a" * 400_000) > 1000
    for d, t in (([], TARGETS), ([(1, "x", "wiki")], []), ([(1, "x", "wiki")], [("wiki", 0.5, 1), ("wiki", 0.2, 3), (None, 0.1, 1), ("mail", None, 1), ("mail", 0.3, 0)])):
        df = docs(spark, d)
        shares = mixing.plan(mixing.sizes(df), targets(spark, t))
        assert mixing.mixture(df, shares).count() == 0
