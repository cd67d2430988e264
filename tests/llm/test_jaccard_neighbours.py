import random

import numpy as np
import pytest
from helpers import FOLDER, dicts, documents, shingles, similar
from pyspark.sql import functions as F
from tripwave.llm import jaccard, neighbours
from tripwave.llm.shingles import WordHasher, signature

PASSAGE = "this passage of words stands in very many of the documents as it is and never changes at all".split()


def corpus(seed, families=6, copies=14, length=120):
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(n)]
    texts = []
    for f in range(families):
        own = words(length) + (PASSAGE if f % 2 else [])
        for _ in range(copies):
            new = list(own)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                new[rng.randrange(len(new))] = words(1)[0]
            texts.append(" ".join(new[:rng.randint(length - 15, len(new))]))
    texts += [" ".join(words(rng.randint(1, 60)) + PASSAGE) for _ in range(40)]
    texts += [None, "", "  \n", "one", "One", "one two three", "ONE two\tthree", "one two three four", "É a b c d", "é a b c d"]
    texts += [texts[0]] * 5 + [texts[0].upper()]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,percent,k,params", [
    (1, 85, 4, {}), (2, 80, 5, dict(chunk=5, leaf=4, segment=500, frequent=3)), (3, 85, 4, dict(chunk=3, leaf=2, hints=1)), (4, 50, 3, dict(chunk=8))])
def test_groups_equal_brute_force(spark, seed, percent, k, params):
    texts = corpus(seed)
    want, sizes = similar(texts, k, percent)
    df = documents(spark, list(enumerate(texts))).repartition(3)
    got = {r["doc_id"]: r for r in dicts(jaccard.similar_groups(df, jaccard.JoinParams(words=k, percent=percent, **params)))}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_one_of_each(spark):
    texts = corpus(7, 3)
    want, sizes = similar(texts, 5, 80)
    df = documents(spark, list(enumerate(texts)))
    stay = jaccard.one_of_each(df, jaccard.JoinParams(words=5, percent=80))
    assert stay.columns == df.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == [i for i in range(len(texts)) if want[i] == i]
    assert jaccard.similar_groups(df.limit(0)).count() == 0


def test_long_texts_and_no_id(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(60000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 2_000_000), (None, "a b c d e"), (9, "a b c d e")]
    got = {r["doc_id"]: r["component_id"] for r in dicts(jaccard.similar_groups(documents(spark, rows)))}
    assert got == {1: 1, 2: 1, 3: 3, None: 9, 9: 9}


def test_rows_without_an_id_and_repeated_rows(spark):
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcde"]
    near = text[1] + " tail"
    rows = [(None, text[0]), (1, text[1]), (1, text[1]), (1, text[1]), (7, near), (7, text[2]), (8, near), (None, text[3]), (None, text[3]),
            (None, text[4]), (9, text[4] + " end"), (None, ""), (2, None)]
    df = documents(spark, rows).repartition(3)
    stay = jaccard.one_of_each(df, jaccard.JoinParams(words=5, percent=80))
    assert stay.columns == df.columns
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in stay.collect()))
    assert got == sorted([(0, text[0]), (1, text[1]), (7, text[2]), (0, text[3]), (9, text[4] + " end"), (0, ""), (2, "")])


def test_links_through_a_row_without_an_id(spark):
    words = [f"w{i}" for i in range(200)]
    at = lambda i: " ".join(words[i:i + 100])
    # 1 and 2 link only through the row between them.
    rows = [(1, at(0)), (None, at(6)), (2, at(12)), (3, "x y z u v")]
    params = jaccard.JoinParams(words=4, percent=85)
    assert similar([t for _, t in rows], 4, 85)[0] == [0, 0, 0, 3] and similar([at(0), at(12)], 4, 85)[0] == [0, 1]
    got = {r["doc_id"]: r["component_id"] for r in dicts(jaccard.similar_groups(documents(spark, rows), params))}
    assert got == {1: 1, None: 1, 2: 1, 3: 3}


def test_shingles_equal_word_tuples():
    hasher = WordHasher()
    for text in ("a", "a b c", "a  b\tc\nd e", "A b C d a B c D", "é ü " * 50, "w " * 700000, " lead and trail ", " a b c d "):
        assert len(hasher.shingles(text, 4)) == len(shingles(text, 4))
    assert (hasher.shingles("A b c d", 4) == hasher.shingles("a B\tc\nd", 4)).all()
    assert len(signature(hasher.shingles("a b c d", 4))) == 8


def test_tree_prunes_nothing_that_links():
    rng = np.random.RandomState(0)
    pool = rng.randint(0, 2**62, 4000)
    sets = [np.unique(np.concatenate([pool[s:s + 100 + rng.randint(20)], rng.randint(0, 2**62, rng.randint(1, 12))])) for s in rng.randint(0, 900, 150)]
    n = np.array([len(s) for s in sets], np.int64)
    for side in (np.zeros(150, np.int64), rng.randint(0, 2, 150)):
        for leaf in (2, 64):
            p, q = jaccard.block_pairs(n, [signature(s) for s in sets], np.arange(150), side, jaccard.JoinParams(leaf=leaf), True)
            got = set(zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist()))
            for i in range(150):
                for j in range(i + 1, 150):
                    common = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * common >= 85 * (n[i] + n[j] - common) and (side[i] != side[j] or not side.any()):
                        assert (i, j) in got


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as `key`", "1 as ids", "2 as list")


def brute(rows, k=5):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 50 == 0:
            near = sorted((-(ok[q] @ v) / np.linalg.norm(ok[q]) / np.linalg.norm(v), i) for i, v in ok.items() if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = result(neighbours.search(df, df.where("vec_id % 50 = 0")))
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits, total = np.array([i for i, _ in rows]), 0, 0
    for at in np.flatnonzero(ids % 50 == 0):
        sims = x @ x[at]
        sims[at] = -2
        want = ids[np.argsort(-sims)[:5]]
        mine = got[int(ids[at])]
        assert len(mine) == 5 and [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
        assert all(abs(s - sims[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, s in mine)
        hits, total = hits + len(set(want.tolist()) & {i for i, _ in mine}), total + 5
    assert hits >= 0.95 * total


def test_small_and_odd_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]),
            (50, [0.0, 3.0]), (7, [0.5, 0.5]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0])]
    df = vectors(spark, rows)
    got = result(neighbours.search(df, df.where("vec_id % 50 = 0")))
    want = brute([r for r in rows if r[0] != 9])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id in (2, 3)"), df).count() == 0


def test_a_third_equal_vectors(spark):
    rng = np.random.RandomState(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.randn(4).round(1).tolist()) for i in range(600)] + [(3, [1.0, 2.0, 3.0, 4.0])]
    df = vectors(spark, rows)
    got = result(neighbours.search(df, df.where(F.col("vec_id") % 50 == 0), params=neighbours.IndexParams(list_size=20, part=16)))
    want = brute(rows)
    assert got.keys() == want.keys()
    found = sum(abs(a[1] - b[1]) < 1e-9 for q, near in want.items() for a, b in zip(got[q], near))
    assert found >= 0.9 * 5 * len(want)
    for q in want:
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i in range(0, 600, 3) if i != q][:5]


def test_near_and_scaled_copies(spark):
    rng = np.random.RandomState(4)
    center = rng.randn(32).astype(np.float32)
    near = [(center * (1 + 1e-4 * rng.randn(32))).astype(np.float32) for _ in range(2500)]
    small = rng.randint(1, 9, 32)
    vectors_ = [*near, *[small * c for c in range(1, 401)], *[rng.randn(32) for _ in range(600)]]
    order = rng.permutation(len(vectors_))
    rows = [(i, [float(x) for x in vectors_[order[i]]]) for i in range(len(vectors_))]
    df = vectors(spark, rows)
    got, want = result(neighbours.search(df, df.where("vec_id % 50 = 0"))), brute(rows)
    assert got.keys() == want.keys()
    scaled = sorted(i for i in range(len(rows)) if 2500 <= order[i] < 2900)
    hits = total = 0
    for q, answer in want.items():
        if order[q] < 2500:
            hits, total = hits + len({i for i, _ in got[q]} & {i for i, _ in answer}), total + 5
        elif order[q] < 2900:
            assert [i for i, _ in got[q]] == [i for i in scaled if i != q][:5]
    assert hits >= 0.95 * total > 0


def test_parts_keep_every_near_copy(spark):
    rng = np.random.RandomState(5)
    center = rng.randn(64).astype(np.float32)
    rows = [(i, [float(x) for x in (center * (1 + 1e-4 * rng.randn(64))).astype(np.float32)]) for i in range(3000)]
    df = vectors(spark, rows)
    one_list = neighbours.IndexParams(list_size=10_000, part=1000)
    got, want = result(neighbours.search(df, df.where("vec_id % 50 = 0"), params=one_list)), brute(rows)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)
