import random
import re
from collections import Counter

import numpy as np
from helpers import dicts, documents, same, sql
from tripwave.llm import phrases
from tripwave.llm.phrases import MiningParams
from tripwave.llm.queries import PHRASE_SQL
from pyspark.sql import functions as F

LOWER = {c: c + 32 for c in range(65, 91)}


def counts(rows, longest):
    """All phrases of up to ``longest`` words by language, and the words of each language."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    return f, n


def expected(rows, p):
    f, n = counts(rows, p.longest)
    often = {g: c for g, c in f.items() if c >= p.least and len(g[1]) >= 2}
    best = {}
    for (lang, g), a in often.items():
        around = [c for (m, h), c in often.items() if m == lang and len(h) > len(g)
                  and any(h[i:i + len(g)] == g for i in range(len(h)))]
        if any(100 * c >= 100 * a for c in around):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return [dict(lang=lang, rank=i + 1, phrase=g.decode(), a=-a, l=left, r=right, n=n[lang], score=-score)
            for lang, found in best.items() for i, (score, a, g, left, right) in enumerate(sorted(found)[:p.top])]


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    words = ["Aé", "b", "ccc", " ", "d\x00", "É"]
    rows = []
    for i in range(n):
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b"]) for w in rng.choices(words, [9, 5, 3, 1, 1, 1], k=rng.choice([0, 2, 30])))
        rows.append((i, rng.choice([text, text + " New  york city"]), rng.choice(["en", "en", None, "fr"])))
    return [*rows, (n, None, "en"), (n + 1, "", "de"), (None, "b b b b b b b b", "en"), (0, rows[0][1], rows[0][2]),
            (n + 2, "x " * 3000, "fr"), (n + 3, "lone", "it")]


def frame(spark, rows):
    return documents(spark, [(i, t, lang, None, None) for i, t, lang in rows]).repartition(5, F.col("doc_id"))


def test_equal_to_brute_force_and_sql(spark):
    rows = corpus()
    p = MiningParams(least=20, one_in=3, bits=1 << 12, block=250)
    got = dicts(phrases.collocations(frame(spark, rows), p))
    want = expected(rows, p)
    assert len(want) > 20 and same(got, want)
    few = MiningParams(least=20, top=3, one_in=3, bits=1 << 12)
    assert same(dicts(phrases.collocations(frame(spark, rows), few)), [r for r in want if r["rank"] <= 3])
    text = PHRASE_SQL.replace("f >= 100", "f >= 20")
    assert same(got, sql(text, documents=frame(spark, rows).select("doc_id", "text", "lang")))
    assert phrases.collocations(frame(spark, rows).limit(0), p).count() == 0


def test_false_hits_lose_nothing(spark):
    rows = corpus(120)
    f, _ = counts(rows, 5)
    whole = {(lang, " ".join(g)): c for (lang, g), c in f.items() if c >= 10}
    for bits in (128, 256, 512, 1024):
        found, _ = phrases.frequent_phrases(frame(spark, rows), MiningParams(least=10, one_in=1000, bits=bits, block=300))
        assert sorted((r.lang, bytes(r.phrase).decode(), r.f) for r in found.collect() if r.k) == sorted((*k, c) for k, c in whole.items())


def test_failures_of_the_border_are_repaired(spark):
    rows = corpus(200)
    f, _ = counts(rows, 4)
    whole = {(lang, " ".join(g)): c for (lang, g), c in f.items() if c >= 8}
    # a sample of about nothing proposes nothing: the words fail, and one expansion pass finds all that is longer
    p = MiningParams(least=8, longest=4, one_in=1_000_000_000, bits=1 << 14, block=350)
    found, passes = phrases.frequent_phrases(frame(spark, rows), p)
    assert passes == 2
    got = [(r.lang, bytes(r.phrase).decode(), r.f) for r in found.collect() if r.k]
    assert len(got) == len(set(got)) and {(lang, g): c for lang, g, c in got} == whole
    # the sample is everything: no failure, one pass
    assert phrases.frequent_phrases(frame(spark, rows), MiningParams(least=8, longest=4, one_in=1))[1] == 1


def test_a_full_table_only_counts_more(spark):
    rows = corpus(150)
    p = MiningParams(least=15, bits=64, one_in=2)
    assert same(dicts(phrases.collocations(frame(spark, rows), p)), expected(rows, p))


def test_hashes_agree_between_builder_and_blocks():
    block = phrases.Block()
    block.add("en", b"new  york \n city")
    block.add("fr", b"new")
    words = block.numbered("en")
    assert words.numbers.tolist() == [0, 1, 2, -1, 3] and words.langs == ["fr", "en"] and words.lang_of.tolist() == [0, 1, 1, 1]
    h = words.hashes[1:]
    assert phrases._longer(phrases._longer(h[:1], h[1:2]), h[2:])[0] == phrases._phrase_hashes(["en"], [b"new york city"])[0]


def test_segments_end_between_words():
    text = (b"aa bb,cc  ddd\teee" * 50).translate(phrases.PLAIN)
    parts = [w for s in phrases._segments(text, 7) for w in s.split(b" ") if w]
    assert parts == [w for s in phrases._segments(text) for w in s.split(b" ") if w]


def test_sample_draws_pieces():
    text = b"\n".join(b"p%d" % i for i in range(4000))
    drawn = [phrases._drawn(text, seed, 4).split(b"\n") for seed in (1, 2)]
    assert all(900 < len(d) < 1100 for d in drawn) and drawn[0] != drawn[1]


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([("en", b"", 0, 9 * 10**17), ("en", b"a", 1, 10**17), ("en", b"b", 1, 3 * 10**17),
                                  ("en", b"a b", 2, 10**16)], phrases.COUNTED)
    old, phrases.frequent_phrases = phrases.frequent_phrases, lambda docs, params: (rows, 1)
    try:
        got = dicts(phrases.collocations(rows))
    finally:
        phrases.frequent_phrases = old
    assert [r["score"] for r in got] == [1000 * 10**16 * 9 * 10**17 // (3 * 10**34)]
