import random
import zlib

import pytest
from helpers import DOCS, WORD, dicts, documents, same, sql
from tripwave.llm import mixing, sharding
from tripwave.llm.queries import MIXING_SQL, _sharding_sql
from pyspark.sql import functions as F

WORDS = ["ab", "cde", "é", "f"]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 20]))) for _ in range(n)]
    source = lambda: rng.choice(["a", "a", "a", "a", "b", "B", "é", None])
    rows = [(i, t, None, source(), len(t)) for i, t in enumerate(texts)]
    return [*rows, (n, None, None, "only", None), (n + 1, "", None, "b", 0), (n + 2, "x y  z w " * 3000, None, None, 9)]


def test_shards_follow_the_tree(spark):
    rows = [*corpus(), (None, "x", None, None, 1), (5, "again", None, None, 1)]
    got = dicts(sharding.shard_documents(documents(spark, rows)))
    assert sorted(r["size"] for r in got) == sorted(len((r[1] or "").encode()) + 1 for r in rows)
    assert {(r["doc_id"], r["text_crc32"]) for r in got} == {(r[0], zlib.crc32((r[1] or "").encode())) for r in rows}
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got) and any(r["grown_shard"] == 16 for r in got)
    plain = [r for r in rows if r[0] is not None][:-1]
    df = documents(spark, plain)
    assert same(dicts(sharding.shard_documents(df)), sql(_sharding_sql(), documents=df.select("doc_id", "text")))
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_only_changed_subtrees_move(spark):
    keys = spark.range(4000).select(F.md5(F.col("id").cast("string")).alias("key"))
    tree = sharding.Tree({"g0": {"r0": {0: 1, 1: 1}, "r1": {2: 1}}, "g1": {"r2": {3: 2}, "r3": {4: 1, 5: 1}}})
    heavier = sharding.Tree({"g0": {"r0": {0: 1, 1: 3}, "r1": {2: 1}}, "g1": {"r2": {3: 2}, "r3": {4: 1, 5: 1}}})
    none = sharding.Tree({"g0": {"r0": {0: 1, 1: 1}, "r1": {2: 0}}, "g1": {"r2": {3: 2}, "r3": {4: 1, 5: 1}}})
    rows = keys.select(*[sharding.shard_of(F.col("key"), t).alias(n) for n, t in (("a", tree), ("b", heavier), ("c", none))]).collect()
    share = [sum(r["a"] == s for r in rows) / 4000 for s in range(6)]
    assert all(abs(x - w / 7) < 0.04 for x, w in zip(share, (1, 1, 1, 2, 1, 1)))
    moved = {(r["a"], r["b"]) for r in rows if r["a"] != r["b"]}
    into = {0: {1}, 2: {0, 1}, 3: {0, 1, 2}, 4: {0, 1, 2}, 5: {0, 1, 2}}  # the heavier shard, rack or region
    assert moved and all(b in into.get(a, ()) for a, b in moved)
    assert not any(r["c"] == 2 for r in rows)
    assert all(r["a"] == r["c"] for r in rows if r["a"] in (3, 4, 5))  # nothing leaves what did not get lighter
    with pytest.raises(ValueError):
        sharding.Tree({"g": {"r": {0: 0}}})


def test_mix_meets_targets(spark):
    rows = corpus()
    df = documents(spark, rows)
    got = dicts(mixing.mix_words(df))
    assert {r["doc_id"]: r["size"] for r in got} == {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert same(got, sql(MIXING_SQL, documents=df.select("doc_id", "text", "source")))
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(rows[r["doc_id"]][3], [0, r["target"], r["source_size"]])
        s[0] += r["taken"]
    assert all(abs(taken - target) <= 0.5 and target <= 2 * size for taken, target, size in by.values())
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * total) < 1e-6
    assert same(got, dicts(mixing.mix_words(df.repartition(7))))
    assert mixing.mix_words(df.limit(0)).count() == 0


def test_repeated_rows_share_the_cut(spark):
    df = documents(spark, [(1, "a b c d", None, "s", 7)] * 9 + [(2, None, None, "t", 0)])
    got = dicts(mixing.mix_words(df, share=0.5))
    assert sum(r["taken"] for r in got) == 18 and len(got) == 10


def test_mixed_documents(spark):
    rows = corpus(80, 3)
    df = documents(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_words(df).collect()}
    got = {}
    for r in mixing.mix_documents(df).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert WORD.findall(rows[r["doc_id"]][1])[:1] == WORD.findall(r["text"])[:1]
    assert got == {k: v for k, v in taken.items() if v}
    assert mixing.mix_documents(df.limit(0)).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
