import random

import numpy as np

from lodestrata.llm import neardup as M

SCHEMA = "id string, document string, file_ext string, node long"


def corpus(rng, groups=25, edits=0.04):
    words = [f"w{i}" for i in range(400)]
    out = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        for m in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(int(len(t) * edits) if m else 0):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append((f"g{g}m{m}", " ".join(t), ".md", 1))
    return out


def brute(rows, threshold, n):
    sets = {}
    for i, t, *_ in rows:
        w = M._WORD.findall((t or "").lower())
        if len(w) >= 20:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                comp[find(a)] = find(b)
    by = {}
    for i in ids:
        by.setdefault(find(i), []).append(i)
    return {(a, b) for g in by.values() for a in g for b in g if a < b}


def test_groups_against_brute_force(spark):
    rows = corpus(random.Random(4))
    got = {(r.id_a, r.id_b) for r in M.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows, 0.5, 3)
    assert got == want and len(want) > 50


def test_default_parameters(spark):
    rows = corpus(random.Random(6), edits=0.01)
    g = M.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in g:
        by.setdefault(r.group_id, []).append(r.id)
    got = {(a, b) for m in by.values() for a in m for b in m if a < b}
    want = brute(rows, 0.8, 5)
    assert len(got & want) >= 0.98 * len(want) and got <= want


def test_hot_group_of_different_texts(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for k in range(300):
        t = list(base)
        t[rng.randrange(90)] = f"x{k}"
        rows.append((f"h{k:03}", " ".join(t), ".txt", 0))
    g = M.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(g) == 300 and {r.group_id for r in g} == {"h000"}


def test_copies_dirt_and_empty(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [("a", text, ".md", 1), ("b", text.upper() + "!", ".TXT ", 1), ("c", text, ".py", 1), ("d", None, ".md", 1), ("e", "  ", ".md", 1), ("f", "too short", ".md", 1), ("a", text, ".md", 1), (None, text, ".md", 1), ("l", "x " * 200_000, ".md", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.id_a, r.id_b) for r in M.found(df).collect()] == [("a", "b")]
    assert M.found(df.limit(0)).count() == 0


def test_runs_do_not_cross_texts():
    rows, h, offsets, digest = M.runs_of(["a b c d", None, "x", "a b c d", "d c b a"], 3, 3)
    assert rows == [0, 3, 4] and offsets.tolist() == [0, 2, 4, 6] and len(h) == 6
    assert digest[0] == digest[1] != digest[2] and np.array_equal(h[:2], h[2:4])


def test_alike_pairs_far_apart_in_a_hot_bucket(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(200):  # the first 60 words are the same everywhere: less than one half in common
        own = [f"o{k}x{i}" for i in range(43)]
        rows.append((f"t{k:03}", " ".join(base + own), ".txt", 0))
        if k % 40 == 0:  # five of them have one that shares a little more than one half
            rows.append((f"u{k:03}", " ".join(base + own[:13] + [f"p{k}x{i}" for i in range(30)]), ".txt", 0))
    rng.shuffle(rows)
    want = brute(rows, 0.5, 3)
    assert len(want) == 5
    got = {(r.id_a, r.id_b) for r in M.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_all_pairs_between_parts():
    key = np.array([1, 1, 1, 1, 2, 3, 3])
    node = np.array([9, 4, 7, 5, 1, 2, 3])
    part = np.array([4, 4, 5, 7, 1, 2, 2])
    got = {tuple(p) for x in M._pairs_between(key, node, part) for p in x.T.tolist()}
    assert got == {(7, 9), (5, 9), (4, 7), (4, 5), (5, 7)}


def test_every_alike_pair_that_meets_in_a_table_is_found(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(60):  # one hot key: all share the boilerplate, every text is alike to one other only
        for side in "ab":
            rows.append((f"{side}{k:03}", " ".join(base + [f"c{k}x{i}" for i in range(13)] + [f"{side}{k}x{i}" for i in range(32)]), ".txt", 0))
    rng.shuffle(rows)
    want = brute(rows, 0.5, 3)
    assert len(want) == 60
    _, h, offsets, _ = M.runs_of([r[1] for r in rows], 3, 20)
    sig = {r[0]: s.tolist() for r, s in zip(rows, M._signatures(h, offsets, 1, 1, 11)[0], strict=True)}
    meet = {(a, b) for a, b in want if sig[a] == sig[b]}
    g = M.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), threshold=0.5, run_length=3, bands=1, band_size=1)
    by = {}
    for r in g.collect():
        by.setdefault(r.group_id, []).append(r.id)
    assert len(meet) >= 5 and {tuple(sorted(m)) for m in by.values()} == meet


def test_a_crowded_key_goes_through_the_prefix_filter(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(60):
        for side in "ab":
            rows.append((f"{side}{k:03}", " ".join(base + [f"c{k}x{i}" for i in range(13)] + [f"{side}{k}x{i}" for i in range(32)]), ".txt", 0))
    rng.shuffle(rows)
    want = brute(rows, 0.5, 3)
    g = M.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), threshold=0.5, run_length=3, hot=10)
    by = {}
    for r in g.collect():
        by.setdefault(r.group_id, []).append(r.id)
    assert len(want) == 60 and {tuple(sorted(m)) for m in by.values()} == want


def test_crowded_keys_over_batches(spark):
    rows = [(k, n, n) for k in range(40) for n in range(k * 100, k * 100 + (50 if k % 7 == 0 else 3))]
    df = spark.createDataFrame(rows, "key long, node long, part long")
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = M._links_between(df, 20).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert {r.a for r in got if r.b is None} == {n for k, n, _ in rows if k % 7 == 0}
        assert {(r.a, r.b) for r in got if r.b is not None} == {(k * 100 + i, k * 100 + j) for k in range(40) if k % 7 for i, j in ((0, 1), (0, 2), (1, 2))}


def test_unlikely_pairs_are_left_out_and_alike_ones_kept(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(200)]
        edited = [rng.choice(words) if rng.random() < 0.09 else w for w in base]
        rows += [(f"a{k:02}", " ".join(base)), (f"b{k:02}", " ".join(edited)), (f"c{k:02}", " ".join(base[:40]))]
    df = spark.createDataFrame(rows, "id string, document string")
    nodes = M._sketch(df, 3, 20, 15, 2, 11).cache()
    of = {r.id: r.node for r in nodes.collect()}
    want = {(of[f"a{k:02}"], of[f"b{k:02}"]) for k in range(60)}
    far = {(of[f"a{k:02}"], of[f"b{(k + 1) % 60:02}"]) for k in range(60)} | {(of[f"a{k:02}"], of[f"c{k:02}"]) for k in range(60)}
    got = {(r.a, r.b) for r in M._likely(spark.createDataFrame([*want, *far], "a long, b long"), nodes, 0.5, 60).collect()}
    assert want <= got and not got & far
