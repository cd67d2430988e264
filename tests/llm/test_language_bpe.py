import base64
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import regex
import tiktoken
from helpers import FOLDER, dicts, documents
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tripwave.llm import bpe, language
from tripwave.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
FIND = regex.compile(public_tokenizers.PATTERN).findall


def test_language_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    rows = [r for r in got.collect() if r["held_out"] and r["lang"]]
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, t * 20, lang, None, None) for i, (t, lang) in enumerate([("the house and the river ", "en"), ("der fluss und das haus ", "de")] * 8)]
    odd = [(100, None, "en", None, None), (101, "", "en", None, None), (102, "12 34 !?", "de", None, None), (103, "the river", None, None, None),
           (104, "haus " * 300000, None, None, None), (104, "haus " * 300000, None, None, None), (None, "und", None, None, None)]
    got = dicts(language.identify_documents(documents(spark, rows + odd)))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (100, 101, 102))
    assert by[103]["lang_pred"] == "en" and by[104]["lang_pred"] == "de" and by[None]["lang_pred"] == "de"
    empty = documents(spark, rows).limit(0)
    assert language.identify_documents(empty).count() == 0
    unlabelled = dicts(language.identify_documents(documents(spark, [(1, "some words")])))
    assert unlabelled[0]["lang_pred"] == "und"


def plain_grams(text, model):
    """Buckets of the n-grams of a text, one at a time."""
    words = "".join(c if c.isalpha() else " " for c in text.lower())
    words = re.sub(" +", " ", words).rstrip(" ")
    if not words.strip():
        return []
    words = " " + words + " "
    return [int(language.buckets_of(np.array([ord(c) for c in words[i:i + k]], np.uint64), k, model)[0])
            for k in model.orders for i in range(len(words) - k + 1)]


def test_ngram_counts_equal_a_plain_count():
    letters = language.Letters()
    assert "".join(map(chr, letters("  ab, c9d "))) == " ab c d"
    texts = ["aba", "ab cd ef " * 50, "  Ab, c9d ", "İSTANBUL ΟΔΟΣ é9  9é", "a", "\U0001F600 x\U00020000", "one  --  two"]
    for text in texts:
        for size in (1, 2, 3, 7, 1_000_000):  # a cut is not seen
            model = language.NgramModel(chars_at_once=size, bits=12)
            want = np.bincount(plain_grams(text, model), minlength=model.buckets)
            assert (language.gram_counts(text, letters, model) == want).all(), (text, size)
    assert language.gram_counts(" 12 !", letters, language.NgramModel()) is None
    long = language.gram_counts("x" * 1_200_000, letters, language.NgramModel())
    assert long.sum() == 1_200_002 + 1_200_001 + 1_200_000


def test_predictions_equal_plain_naive_bayes(spark):
    rng = random.Random(8)
    model = language.NgramModel(bits=9, chars_at_once=40, cells_at_once=600)  # many slices, blocks of rows and of languages
    make = lambda k: " ".join("".join(rng.choices("abcdefgh" if k % 2 else "defghijk", k=4)) for _ in range(rng.randint(0, 12)))
    rows = [(i, make(i), f"l{i % 5}", None, None) for i in range(120)] + [(200, None, "l1", None, None), (201, "abc", None, None, None)]
    df = documents(spark, rows).repartition(3)
    got = {r["doc_id"]: r for r in dicts(language.identify_documents(df, model))}
    held = {i: got[i]["held_out"] for i, *_ in rows}
    learned = [(t, lang) for i, t, lang, *_ in rows if t is not None and lang is not None and not held[i]]
    names = sorted({lang for _, lang in learned})
    counts = {n: np.full(model.buckets, model.smoothing) for n in names}
    texts = {n: 1 for n in names}
    for t, lang in learned:
        texts[lang] += 1
        for b in plain_grams(t, model):
            counts[lang][b] += 1
    for i, text, *_ in rows:
        grams = plain_grams(text or "", model)
        if not grams:
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        logs = [math.log(texts[n] / sum(texts.values())) + sum(math.log(counts[n][b] / counts[n].sum()) for b in grams) for n in names]
        best = max(logs)
        assert got[i]["lang_pred"] == names[logs.index(best)]
        assert abs(got[i]["score"] - 1 / sum(math.exp(x - best) for x in logs)) < 1e-4


def test_more_than_256_languages(spark):
    rows = [(i, f"{chr(0x4E00 + i) * 30}", f"x{i:03d}", None, None) for i in range(300)]
    trained = language.train(documents(spark, rows).select("text", "lang"), language.NgramModel(bits=10, languages_held=7))
    got = dicts(language.identify(documents(spark, rows), trained, language.NgramModel(bits=10)))
    assert len(trained.languages) == 300 and sum(r["lang_pred"] == f"x{r['doc_id']:03d}" for r in got) > 250


PARTS = st.lists(st.sampled_from(["a", "B", "é", "1", "22", " ", "  ", "\n", "'", "'re", "'ll", "!", "…", " ", "　", "日本", "x" * 9, "\t\t", "_"]),
                 max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(PARTS, st.integers(4, 12), st.integers(0, 6))
def test_stitched_chunks_equal_the_whole(text, size, overlap):
    overlap = max(overlap, 1)
    chunks = [(at, text[at:at + size + overlap], FIND(text[at:at + size + overlap])) for at in range(0, max(1, len(text)), size)]
    assert bpe.stitch(chunks, FIND, 3) == FIND(text)


@settings(max_examples=200, deadline=None)
@given(st.one_of(PARTS, st.text(max_size=30)))
def test_merge_equals_the_library(text):
    encoder = bpe.Encoder(RANKS)
    [packed] = encoder.encode([FIND(text)])
    assert np.frombuffer(packed, "<u4").tolist() == ENCODING.encode_ordinary(text)
    assert encoder.decode(packed) == text.encode()


def test_documents_round_trip(spark):
    rng = random.Random(4)
    long = "".join(rng.choice(["word ", "it's ", "été ", "\n\n  ", "123 ", "?!"]) for _ in range(9000))
    rows = [(1, None), (2, ""), (3, "Hello  world's end"), (4, long), (4, long), (5, "a" * 70000), (6, " " * 40000 + "x"), (7, "ab 日本 " * 30000), (None, "x")]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = bpe.digests(bpe.encode(documents(spark, rows), PATH, public_tokenizers.PATTERN))
    want = []
    for doc_id, text in rows:
        ids = ENCODING.encode_ordinary(text or "")
        want.append((str(doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    small = bpe.digests(bpe.encode(documents(spark, rows[:40]), PATH, public_tokenizers.PATTERN, bpe.Chunking(64, 8)))
    assert sorted((str(r[0]), *r[1:]) for r in small.where(F.col("n_tokens") < 1e9).collect()) == sorted(want[:40])
    assert bpe.encode(documents(spark, rows).limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_vocabulary_file():
    assert RANKS[base64.b64decode("IQ==")] == 0 and len(RANKS) == 50256


def test_merges_at_once_equal_one_by_one():
    rng = random.Random(6)
    pieces = ["".join(rng.choices("abcdeéth日\n ", k=rng.randint(1, 30))).encode() for _ in range(3000)] + [b"\xff\xfe", b"a" * 64]
    merges = bpe.Merges(RANKS)
    assert [np.frombuffer(p, "<u4").tolist() for p in merges.merge(pieces)] == [bpe.merge(p, {k: v for k, v in RANKS.items()}) if p not in RANKS else
                                                                             [int(x) for x in np.frombuffer(merges.merge([p])[0], "<u4")] for p in pieces]
    encoder = bpe.Encoder(RANKS)
    encoder.MOST = 50  # forgets again and again
    texts = [[" the", "re" * rng.randint(1, 40), " x%d" % rng.randint(0, 999)] for _ in range(200)]
    assert encoder.encode(texts[:100]) + encoder.encode(texts[100:]) == [b"".join(np.array(bpe.merge(p.encode(), RANKS), "<u4").tobytes() for p in t) for t in texts]
    assert encoder.decode(b"") == b""
