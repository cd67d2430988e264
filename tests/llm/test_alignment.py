import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from helpers import dicts, documents, same
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tripwave.llm import alignment, vocab
from tripwave.llm.alignment import AlignParams

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(texts, libraries):
    """The contract text by text, token by token."""
    a, b = libraries
    letters = vocab.byte_letters()
    out, links_of = [], []
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False) if text else None
        y = b.encode(text) if text else []
        pieces = [b.id_to_piece(i) for i in y]
        left = [bytes(letters[c] for c in t) for t in x.tokens] if x else []
        right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, pieces)]
        raw = (" " + text).encode() if text else b""
        if b"".join(left) != raw or b"".join(right) != raw:
            x, y, left, right = None, [], [], []
        ids = x.ids if x and left else []
        groups, links, i, ga, gb, la, lb = [], [], 0, [], [], 0, 0
        for t, token in zip(ids, left):
            ga.append(t)
            la += len(token)
            while lb < la:
                gb.append(y[i])
                lb += len(right[i])
                i += 1
            if la == lb:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                links.append((ga[-1], gb[-1]))
                ga, gb = [], []
        text_sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(ids), len(y), len(groups), text_sha))
        links_of.append(links)
    counts = Counter(p for links in links_of for p in links)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    return [dict(n_a=n_a, n_b=n_b, n_groups=g, n_links=len(links), n_best=sum(counts[p] == top[p[1]] for p in links),
                 count_sum=sum(counts[p] for p in links), groups_sha256=sha)
            for (n_a, n_b, g, sha), links in zip(out, links_of)]


def odd_texts():
    rng = random.Random(3)
    words = ["a", "of the", "réseau", "日本語", "naïve", "  ", "\n\n", "\t", "<s>", "</s>", "<0x41>", "<|endoftext|>", "▁", "12345",
             "don't", "\x00", "𝒳", "é", " ", "ing", "ﬁ", "X" * 30]
    mixed = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.choice([1, 5, 60]))) for _ in range(120)]
    return [None, "", " ", "x", " x ", "x" * 5000, " " * 5000, "\n" * 100, *mixed, "same text", "same text", "word and " * 4000]


def expected(texts, libraries):
    return [dict(doc_id=i, **r) for i, r in enumerate(plain(texts, libraries))]


def test_equal_to_token_by_token(spark, libraries):
    texts = odd_texts()
    df = documents(spark, list(enumerate(texts))).repartition(3)
    want = expected(texts, libraries)
    assert sum(r["n_a"] == 0 and bool(t) for r, t in zip(want, texts)) > 3  # texts that do not come back
    assert same(dicts(alignment.align_documents(df, A, B, P.PATTERN)), want)
    # pieces of a few steps, and counts by the join
    small = AlignParams(steps=9, most_broadcast=0)
    assert same(dicts(alignment.align_documents(df, A, B, P.PATTERN, small)), want)


def test_odd_tables(spark, libraries):
    rows = [(None, "one two"), (1, "one two"), (1, "one two")]
    got = dicts(alignment.align_documents(documents(spark, rows), A, B, P.PATTERN))
    want = plain([t for _, t in rows], libraries)
    assert same(got, [dict(doc_id=i, **r) for (i, _), r in zip(rows, want)])
    assert alignment.align_documents(documents(spark, rows).limit(0), A, B, P.PATTERN).count() == 0


def test_path_cuts_divide_the_merge_evenly():
    rng = np.random.default_rng(1)
    for n, m, steps in ((0, 0, 3), (5, 0, 2), (0, 5, 2), (40, 60, 7), (300, 20, 11), (500, 500, 64)):
        a = np.sort(rng.choice(np.arange(1, 800), n, replace=False))
        b = np.sort(rng.choice(np.arange(1, 800), m, replace=False))
        i, j = alignment.path_cuts(a, b, steps)
        merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
        for k in range(1, len(i) - 1):
            first = merged[:k * steps]
            assert i[k] == sum(side == 0 for _, side in first)
            assert j[k] - sum(side == 1 for _, side in first) in (0, 1)
            assert not len(a[i[k]:]) or not len(b[:j[k]]) or a[i[k]] > b[j[k] - 1]
            assert not len(b[j[k]:]) or not len(a[:i[k]]) or b[j[k]] > a[i[k] - 1]
        work = np.diff(i) + np.diff(j)
        assert work.sum() == n + m and work.max(initial=0) <= steps + 1


def test_ids_are_those_of_the_tokenizers_library(libraries):
    mine = vocab.ByteBpe(A, P.PATTERN)
    assert mine.fast is not None
    for text in [t for t in odd_texts() if t] + [" " * 9000 + "x", "a\n" + "\t" * 5000]:
        assert mine.encode(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_where_no_piece_spans(libraries):
    pieces = vocab.Pieces(B)
    pieces.AT_ONCE = 50
    assert pieces.cut
    for text in [t for t in odd_texts() if t]:
        assert pieces.encode(text).tolist() == libraries[1].encode(text)
