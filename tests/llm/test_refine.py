import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from spatialpanel.llm import refine
from spatialpanel.operators import skew

SCHEMA = "record_id bigint, feed string, record string, n int, key string"

LAYOUTS = [
    lambda f: ";".join(f"{k}={v}" for k, v in f),
    lambda f: "{" + ",".join(f'"{k}":"{v}"' for k, v in f) + "}",
    lambda f: " | ".join(f'{k} = "{v}"' for k, v in f),
    lambda f: " ".join(f"({k}={v})" for k, v in f) + ";",
    lambda f: "  " + "; ".join(f"[{k}] '{v}'" for k, v in f) + "\r",
    lambda f: " / ".join(f"{k}: {v}" for k, v in f),
]
NAMES = [("src_zip", "dst_zip", "weight"), ("SRC ZIP", "DST ZIP", "WEIGHT"), ("srcZip", "dstZip", "weight"), ("Src-Zip", "Dst.zip", "Weight")]


def frame(spark, records):
    return spark.createDataFrame([(i, None, r, 1, "k") for i, r in records], SCHEMA)


def write(r, a, b, w):
    spell = lambda z: r.choice([z, z.lower(), z[0] + "-" + z[1:], z[0] + " " + z[1:], "#" + z, z[:5] + "." + z[5:]])
    number = w if w == "" else r.choice([w, w + ("0" if "." in w else ".00"), f"{Decimal(w):,}" if abs(Decimal(w)) >= 1000 else w, f"{Decimal(w):e}", f"{float(w) / 100:g}E+2"])
    f = list(zip(r.choice(NAMES), (spell(a), spell(b), number)))
    r.shuffle(f)
    return r.choice(LAYOUTS)(f)


def edges(r, n):
    return [(f"Z{r.randrange(30):07d}", f"Z{r.randrange(30):07d}", r.choice(["", "0", "5", "-5", "50", "1234.5", "12345", "0.05", "-1234"])) for _ in range(n)]


def test_random_spellings_against_the_edges_themselves(spark, monkeypatch):
    r = random.Random(1)
    told = edges(r, 400) + [("Z0000001", "Z0000002", "7")] * 250
    r.shuffle(told)
    df = frame(spark, [(i + 10, write(r, *e)) for i, e in enumerate(told)])
    sets = defaultdict(list)
    for i, e in enumerate(told):
        sets[e].append(i + 10)
    want = {(min(s), x) for s in sets.values() for x in s if x != min(s)}
    assert {tuple(x) for x in refine.duplicate_pairs(df).collect()} == want
    monkeypatch.setattr(skew, "HOT_SHARE", 0.2)  # only the large set is hot
    assert {tuple(x) for x in refine.duplicate_pairs(df).collect()} == want
    got = {x.keep_id: x for x in refine.collapsed_records(df).collect()}
    assert {k: x.n_copies for k, x in got.items()} == {min(s): len(s) for s in sets.values()}
    for e, s in sets.items():
        x = got[min(s)]
        assert (x.src_zip, x.dst_zip) == (e[0].lower(), e[1].lower()) and (x.weight == "" if e[2] == "" else Decimal(x.weight) == Decimal(e[2]))


def test_look_alikes_stay_apart(spark):
    lines = ["src_zip=Z1;dst_zip=Z2;weight=5", "src_zip=Z2;dst_zip=Z1;weight=5", "src_zip=Z1;dst_zip=Z2;weight=-5", "src_zip=Z1;dst_zip=Z2;weight=.5", "src_zip=Z1;dst_zip=Z2;weight=50", "src_zip=Z1;dst_zip=Z2;weight=", "src_zip=Z10;dst_zip=Z2;weight=5", "src_zip=Z1;dst_zip=Z2;weight=0"]
    assert refine.duplicate_pairs(frame(spark, list(enumerate(lines)))).count() == 0
    same = ["src_zip=Z1;dst_zip=Z2;weight=5", "weight: +5.000, dst zip: z-2, src zip: #z1", "src_zip=Z1;dst_zip=Z2;weight=0", "src_zip=Z1;dst_zip=Z2;weight=-0.0"]
    assert {tuple(x) for x in refine.duplicate_pairs(frame(spark, list(enumerate(same)))).collect()} == {(0, 1), (2, 3)}


def test_exponents_and_numbers_beyond_the_decimals(spark):
    weights = ["1e3", "1000", "1,000.0", "+1E+03", "10e2", "1e30", "1" + "0" * 30, "0.12345678901234567", "1234567890.1234567e-10", "1e-13", "0", "0e5", "1e2"]
    got = refine.duplicate_pairs(frame(spark, [(i, f"src_zip=Z1;dst_zip=Z2;weight={w}") for i, w in enumerate(weights)]))
    assert {tuple(x) for x in got.collect()} == {(0, 1), (0, 2), (0, 3), (0, 4), (5, 6), (7, 8), (10, 11)}


def test_a_repeated_label_states_no_edge(spark):
    lines = ["src_zip=Z1;dst_zip=Z2;weight=5", "src_zip=Z1;dst_zip=Z2;weight=5;src_zip=Z3", "src_zip=Z1;dst_zip=Z2;weight=5;SRC ZIP:Z3", "src_zip=Z1;dst_zip=Z2;weight=5;weight=5"]
    df = frame(spark, list(enumerate(lines)))
    assert refine.duplicate_pairs(df).count() == 0
    assert {(x.keep_id, x.src_zip, x.n_copies) for x in refine.collapsed_records(df).collect()} == {(0, "z1", 1), (1, None, 2), (3, None, 1)}


def test_nulls_empty_long_and_unlabelled(spark):
    long = "src_zip=Z1;dst_zip=Z2;weight=5;" + " ;" * 200_000
    rows = [(1, None), (None, "src_zip=Z1;dst_zip=Z2;weight=5"), (2, ""), (3, "  "), (4, "no labels here"), (5, "NO-LABELS here"), (6, long), (7, "src_zip=Z1;dst_zip=Z2;weight=5")]
    df = frame(spark, rows)
    assert [tuple(x) for x in refine.duplicate_pairs(df).collect()] == [(6, 7)]
    got = {x.keep_id: (x.src_zip, x.n_copies) for x in refine.collapsed_records(df).collect()}
    assert got == {2: (None, 2), 4: (None, 2), 6: ("z1", 2)}
    assert refine.duplicate_pairs(frame(spark, [])).count() == 0 and refine.collapsed_records(frame(spark, [])).count() == 0


def test_no_level_splits_equal_edges(spark):
    r = random.Random(7)
    rows = [(i * 100 + j, write(r, *e)) for i, e in enumerate(edges(r, 15)) for j in range(12)]
    df = frame(spark, rows)
    for level in refine.LEVELS:
        df = level(df)
        assert max(x.n for x in df.groupBy(F.expr("record_id div 100")).agg(F.count_distinct("_k").alias("n")).collect()) == 1
