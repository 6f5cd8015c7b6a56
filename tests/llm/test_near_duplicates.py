import itertools
import random
import re

from sedimenta.llm.near_duplicates import NearDuplicates


def jaccard_pairs(rows, run, threshold):
    sets = {}
    for i, t in rows:
        if i is None or t is None:
            continue
        w = re.findall(r"[A-Za-z0-9_]+", t)
        s = set(zip(*(w[k:] for k in range(run))))
        if s:
            sets[i] = s
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed, families=12, copies=8):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(5000))
    out = []
    for f in range(families):
        base = [word() for _ in range(90)]
        for c in range(copies):
            t = list(base)
            for _ in range(r.choice((0, 0, 1, 3, 6, 15))):
                t[r.randrange(len(t))] = word()
            out.append((f"d{f:02}-{c}", " ".join(t)))
    return out


def find(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("id", "text", "1 as rid", "'x' as members")
    return NearDuplicates(df, "id", "text", **kw)


def test_all_pairs_against_brute_force(spark):
    rows = [*corpus(1), ("short", "a b"), ("empty", ""), ("null", None), (None, "a b c d"), ("d00-0", corpus(1)[0][1]), ("long", "z " * 20000)]
    near = find(spark, rows, run=3, threshold=0.6)
    got = [(r.a, r.b) for r in near.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(rows, 3, 0.6)
    groups = {r.id: r.group_id for r in near.groups().collect()}
    assert set(groups) == {i for i, t in rows if i and t and len(t.split()) >= 3}
    assert all(groups[a] == groups[b] for a, b in got)


def test_crowded_buckets_lose_nothing(spark):
    rows = corpus(2, families=3, copies=14)
    near = find(spark, rows, run=3, threshold=0.6, crowded=4)
    assert {(r.a, r.b) for r in near.pairs().collect()} == jaccard_pairs(rows, 3, 0.6)


def test_five_words_and_empty_table(spark):
    rows = corpus(3, families=4)
    assert {(r.a, r.b) for r in find(spark, rows).pairs().collect()} == jaccard_pairs(rows, 5, 0.8)
    none = find(spark, [])
    assert none.pairs().count() == 0 and none.groups().count() == 0


def test_shared_headers_and_large_families(spark):
    r = random.Random(11)
    word = lambda: "w" + str(r.randrange(9000))
    header = [word() for _ in range(60)]
    rows = [(f"h{i:03}", " ".join(header + [word() for _ in range(60)])) for i in range(250)]  # similarity about 0.33
    base = [word() for _ in range(120)]
    rows += [(f"f{i:03}", " ".join(w if r.random() > 0.01 else word() for w in base)) for i in range(120)]  # one large family
    for i in range(60):  # pairs near the threshold within the crowd
        text = rows[i][1].split()
        for _ in range(r.choice((6, 9, 12))):
            text[r.randrange(60, 120)] = word()
        rows.append((f"n{i:03}", " ".join(text)))
    want = jaccard_pairs(rows, 3, 0.6)
    for crowded, split, block in ((8, 10_000, 16), (8, 60, 4096), (512, 10_000, 4096)):
        got = {(x.a, x.b) for x in find(spark, rows, run=3, threshold=0.6, crowded=crowded, split=split, block=block).pairs().collect()}
        assert got == want, (crowded, len(want - got), len(got - want))
