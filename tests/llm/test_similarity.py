"""The n-gram join, components, top-k search and the pipeline against brute force."""

import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from packlake.llm import jaccard, topk
from packlake.llm.components import components


def roots(pairs, keys):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_classes(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(pairs, ids).items()}


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    make = lambda k: [rng.choice(words) for _ in range(k)]
    passage, out = make(60), []
    originals = [make(rng.randint(20, 120)) for _ in range(12)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5:
            w = list(rng.choice(originals))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind < 0.6:
            w = make(rng.randint(1, 12)) + passage + make(rng.randint(0, 25))
        elif kind < 0.7:
            w = make(rng.randint(1, 6))
        else:
            w = make(rng.randint(10, 80))
        out.append(" ".join(w))
    out += [None, "", " \n ", "one two", "ONE two", "one two three four five", "One  two\tthree\nfour five", "É a b c d", "é a b c d", "x y a b c d"]
    order = list(range(len(out)))
    rng.shuffle(order)
    return list(zip(order, out))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, id string, component_id int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect()}
    assert got == plain_classes(docs)


def test_small_batches_hot_shingles_and_blocks(spark, monkeypatch):
    for name, value in (("BATCH_SHINGLES", 900), ("GROUP_SHINGLES", 400), ("RANGE_SHINGLES", 500), ("MANY_COPIES", 1)):
        monkeypatch.setattr(jaccard, name, value)
    docs = corpus(3, 150)
    shingler = jaccard.Shingler()
    assert all(len(shingler((t or "").encode())) == len(shingles(t)) for _, t in docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect()}
    assert got == plain_classes(docs)


def test_repeats_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "lone text here it is now"), (7, None)], "doc_id long, text string")
    got = sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs).collect()), key=str)
    assert got == sorted([("5", 2, 3), ("5", 2, 3), ("3", 2, 3), ("None", 2, 3), ("None", 2, None), ("7", 0, 7)], key=str)
    left = sorted(str(r["doc_id"]) for r in jaccard.one_of_each(docs).collect())
    assert left == ["3", "7", "None", "None"]
    assert jaccard.classes(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "q r s t u v"), (1, "q r s t u v")], "doc_id long, text string")
    assert jaccard.one_of_each(twice).count() == 1


def test_rows_of_one_doc_id_go_by_their_own_text(spark):
    near, lone = " ".join(f"w{i}" for i in range(40)), " ".join(f"x{i}" for i in range(40))
    other = " ".join(f"y{i}" for i in range(40))
    rows = [(2, near), (5, near + " more"), (5, lone), (5, lone), (7, lone + " more"), (7, other), (9, None), (9, near), (None, near), (8, other + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(map(tuple, jaccard.one_of_each(docs).collect()), key=str)
    assert left == sorted([(2, near), (5, lone), (7, other), (9, None), (None, near)], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_divide_skip_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 2**63, rng.integers(8, 90))).astype(np.uint64) for _ in range(6)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(len(base))]
        keep = s[rng.random(len(s)) > rng.choice([0.0, 0.05, 0.12, 0.3])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)])))
    ids, sizes = np.arange(150) * 3, np.array([len(s) for s in sets])
    got = roots(jaccard.Links(ids, sizes, sets).run(), ids.tolist())
    known = [set(s.tolist()) for s in sets]
    pairs = [(a * 3, b * 3) for a in range(150) for b in range(a) if known[a] and known[b] and 100 * len(known[a] & known[b]) >= 75 * len(known[a] | known[b])]
    assert got == roots(pairs, ids.tolist())


def near_copies(n, seed):
    """Copies of one text of 400 words with up to 30 words replaced; most pairs lie below the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(31)):
            words[rng.randrange(400)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def test_many_near_copies_take_seconds():
    sets = [jaccard.Shingler()(t.encode()) for t in near_copies(800, 1)]
    ids, sizes = np.arange(800), np.array([len(s) for s in sets])
    search = jaccard.Links(ids, sizes, sets)
    began = time.process_time()
    got = roots(search.run(), ids.tolist())
    assert time.process_time() - began < 8
    held = np.zeros((800, len(known := np.unique(np.concatenate(sets)))), np.float32)
    for i, s in enumerate(sets):
        held[i, np.searchsorted(known, s)] = 1
    both = (held @ held.T).astype(int)
    linked = 100 * both >= 75 * (sizes[:, None] + sizes - both)
    assert got == roots([(int(a), int(b)) for a, b in np.argwhere(linked)], ids.tolist())


def test_block_pairs_of_a_group_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 4000)
    rows = [(i, len(s), s.astype("<u8").tobytes(), 0, float(len(s))) for i, s in enumerate(jaccard.Shingler()(t.encode()) for t in near_copies(60, 2))]
    weighed = spark.createDataFrame(rows, "id long, n_shingles long, shared binary, group long, w double")
    links = jaccard._links(weighed, 75)
    assert re.search(r"hashpartitioning\(group#\d+L, a#\d+, b#\d+", links._jdf.queryExecution().executedPlan().toString())
    sets = [np.frombuffer(r[2], "<u8").astype(np.uint64) for r in rows]
    whole = jaccard.Links(np.arange(60), np.array([r[1] for r in rows]), sets).run()
    assert roots([(r["u"], r["v"]) for r in links.collect()], range(60)) == roots(whole, range(60))


def test_heap_merge_over_runs(monkeypatch):
    monkeypatch.setattr(jaccard, "SPAN", 4)
    rng = random.Random(5)
    lists = [sorted(rng.sample(range(40), rng.randrange(20))) for _ in range(9)]
    assert list(jaccard.Links.heap(lists)) == sorted(Counter(y for p in lists for y in p).items())
    assert list(jaccard.Links.heap([])) == list(jaccard.Links.heap([[], []])) == []


def test_heap_merge():
    assert list(jaccard.Links.heap([[1, 3, 5], [3], [], [1, 3]][:2] + [[1, 3]])) == [(1, 2), (3, 3), (5, 1)]


def test_hash_packing():
    h = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    assert (jaccard.unpack_sorted(jaccard.pack_sorted(h)) == h).all() and len(jaccard.unpack_sorted(b"")) == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r["u"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = roots(pairs, {x for p in pairs for x in p})
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_topk(rows, k, every):
    import math

    whole = lambda v: [math.floor(256 * Fraction(x)) for x in v]
    clean = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound = [(i, whole(v)) for i, v in clean]
    queries = {i: whole(min(v for j, v in clean if j == i)) for i, _ in clean if i % every == 0}
    out = {}
    for q, a in queries.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)
        out[q] = [(r, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scores[:k], 1)]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("scale", [1.0, 100.0, 3e5])
def test_topk_equals_brute_force(spark, scale):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3 * scale, 8)]) for i in range(300)]
    rows += [(300 + i, rows[1][1]) for i in range(60)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (450, rows[2][1]), (450, rows[3][1]), (55, rows[55][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = defaultdict(list)
    for r in topk.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert dict(got) == plain_topk(rows, 5, 50)


def test_topk_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df).orderBy("rank").collect()] == [(0, 1, 1, 128 * 128 + 64 * 64), (0, 2, 2, -256 * 128)]
    assert topk.search(df.limit(0)).count() == 0 and topk.search(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("kind,width,sizes", [("float", 200, (1e6,)), ("float", 200, (1.0, 2e6, 1e12)), ("double", 3, (1.0, 1e3, 1e9, 1e18))])
def test_topk_of_large_components(spark, kind, width, sizes):
    rng = np.random.default_rng(8)
    cast = np.float32 if kind == "float" else np.float64
    rows = [(i, [float(cast(x)) for x in rng.uniform(-1, 1, width) * sizes[i % len(sizes)]]) for i in range(60)]
    rows += [(60 + i, rows[i + 1][1]) for i in range(7)] + [(70, [0.5])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = defaultdict(list)
    for r in topk.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert dict(got) == plain_topk(rows, 5, 50)


def test_products_are_exact():
    rng = np.random.default_rng(9)
    assert int(topk.floors(np.array([1.5e308]), 256.0)[0]) == 256 * int(1.5e308)
    for size in (10, 2000, 1 << 22, 1 << 30, 1 << 40, 1 << 200):
        a, b = (np.floor(rng.uniform(-1, 1, (4, 70)) * float(size)) for _ in range(2))
        b[0] = 0
        want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
        assert topk.products(a, b).tolist() == want


def test_pipeline_stages(spark):
    import corpus_pipeline
    from packlake.llm import common, quality, secrets

    rng = random.Random(9)
    words = [f"{a}{b}ing" for a in "bdfgklmnprst" for b in ("an", "er", "in", "ou", "ra", "el")]
    make = lambda: " ".join(rng.choice(words + ["the", "of", "and"] * 8) for _ in range(80))
    texts = [make() for _ in range(12)]
    texts += [texts[0], texts[1].rsplit(" ", 2)[0] + " changed end", "too short", "### " * 90, texts[2] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.stage(stage(spark, now, ""), "t")
        assert now.columns == docs.columns
        kept.append({r["doc_id"]: r["text"] for r in now.collect()})
    judged = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert set(kept[0]) == judged and {14, 15, 17, 18}.isdisjoint(judged) and set(range(12)) <= judged
    one = {i for i, (_, r) in plain_classes([(i, texts[i]) for i in judged]).items() if i == r}
    assert set(kept[1]) == one and 12 not in one and 13 not in one and 16 not in one
    assert set(kept[2]) == one and all(not secrets.scan(t)[1] for t in kept[2].values())
    assert {k: v for k, v in kept[2].items() if "token" not in texts[k]} == {k: texts[k] for k in one if "token" not in texts[k]}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    assert {r["doc_id"] for r in packed} == one


def test_pipeline_of_nothing_repeats_and_clashes(spark):
    import corpus_pipeline
    from packlake.llm import common

    rng = random.Random(11)
    words = [f"{a}{b}ing" for a in "bdfgklmnprst" for b in ("an", "er", "in", "ou", "ra", "el")]
    make = lambda: " ".join(rng.choice(words + ["the", "of", "and"] * 8) for _ in range(90))
    one, two = make(), make()
    rows = [(1, one, 7, "s", {"a": 1}), (1, one, 7, "s", {"a": 1}), (2, one, 7, "s", None), (3, two, 8, "t", None), (None, None, None, None, None), (4, "", 0, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _same int, _copy string, _m__words map<string,int>")
    for now, want in ((docs, [(1, one, 7, "s"), (3, two, 8, "t")]), (docs.limit(0), [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = common.stage(stage(spark, now, ""), "t")
            assert now.columns == docs.columns
        assert sorted(tuple(r)[:4] for r in now.collect()) == want
        packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
        assert sorted({r["doc_id"] for r in packed}) == [r[0] for r in want]
