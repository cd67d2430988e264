import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from helpers import dicts, documents
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer
from tripwave.llm import packing
from tripwave.llm.packing import PackParams

PATH = P.path("byte_bpe_50k.json")


def tokens(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def padding(totals, size):
    return sum(0 if t & (t - 1) == 0 else size - t for t in totals)


def check(pieces, ids_of, size):
    """Every id once, every piece's sum, no sequence too full, offsets without gaps; the padding's share of all tokens."""
    documents_, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        documents_[r["_row"]].append(r)
        sequences[r["sequence_id"]].append(r)
    rest = list(ids_of)
    for parts in documents_.values():
        parts.sort(key=lambda r: r["start"])
        at = 0
        for r in parts:
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == parts[0]["doc_tokens"]
        own = next(x for x in rest if x[0] == parts[0]["doc_id"] and len(x[1]) == at and all(
            zlib.crc32(np.array(x[1][r["start"]:r["start"] + r["length"]], "<u4")) == r["ids_crc32"] for r in parts))
        rest.remove(own)
    assert not rest
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    totals = [sum(r["length"] for r in parts) for parts in sequences.values()]
    return padding(totals, size) / sum(totals)


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = ["token", "of the", "réseau", "日本", "<|endoftext|>", "x1", "\n"]
    texts = [" ".join(rng.choices(words, k=int(rng.lognormvariate(4, 1.2)))) for _ in range(n)]
    return [*enumerate(texts), (n, None), (n + 1, ""), (None, "no id"), (0, texts[0]), (0, texts[0]), (n + 2, "word " * 9000),
            (n + 3, " " * 6000), (n + 4, "é" * 2047)]


def test_pieces_hold_every_id_once(spark):
    rows = corpus(600)
    df = documents(spark, rows).repartition(4)
    ids_of = [(i, ids) for (i, _), ids in zip(rows, tokens([t for _, t in rows]))]
    encoded = packing.encode(df, PATH, P.PATTERN, PackParams())
    pieces = packing.assign(encoded)
    got = dicts(pieces)
    share = check(got, ids_of, 2048)
    assert share < 0.015 and len({r["sequence_id"] for r in got}) < 1.03 * sum(len(i) for _, i in ids_of) / 2048 + 12
    # small sequences: more whole ones, many rests that must be cut
    p = PackParams(size=64, width=2, least_cut=4)
    encoded = packing.encode(df, PATH, P.PATTERN, p)
    pieces = packing.assign(encoded, p)
    got = dicts(pieces)
    assert check(got, ids_of, 64) < 0.02
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in dicts(packing.sequences(encoded, pieces))}
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append(r)
    by_row = {r["_row"]: np.frombuffer(r["ids"], "<u4").tolist() for r in dicts(encoded.select("_row", "ids"))}
    for k, parts in held.items():
        assert whole[k] == [i for r in sorted(parts, key=lambda r: r["offset"]) for i in by_row[r["_row"]][r["start"]:r["start"] + r["length"]]]


def test_odd_tables(spark):
    for rows in ([], [(None, None)], [(1, "a"), (1, "a")], [(1, "word " * 2047)]):
        got = dicts(packing.pack_documents(documents(spark, rows or [(0, "")]).limit(len(rows)), PATH, P.PATTERN))
        share = check(got, [(i, ids) for (i, _), ids in zip(rows, tokens([t for _, t in rows]))], 2048) if rows else 0
        assert share == 0 and bool(got) == bool(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 99), st.integers(1, 400)), max_size=25), st.sampled_from([1, 3, 4]), st.sampled_from([2, 20]))
def test_plan_gives_every_rank_a_place(kinds, width, least_cut):
    p = PackParams(size=100, width=width, least_cut=least_cut)
    histogram = np.zeros(100, np.int64)
    for length, n in kinds:
        histogram[length] += n
    rows, n = packing.plan(histogram, p)
    longer, totals, slots, tokens_of = packing.ranks_before(histogram, p), np.zeros(n, int), set(), defaultdict(list)
    length_at = {}
    for length in range(1, 100):
        for r in range(histogram[length]):
            length_at[-(-length // width), int(longer[length]) + r] = length
    for b, start_rank, stop_rank, sequence, repeats, turn, slot, start, part in rows:
        for rank in range(start_rank, stop_rank):
            at = rank - start_rank + turn
            length = length_at[b, rank]
            k = sequence + at % repeats
            assert (k, slot + at // repeats) not in slots
            slots.add((k, slot + at // repeats))
            totals[k] += part or length
            tokens_of[b, rank].append((start, part or length))
    assert tokens_of.keys() == length_at.keys() and (totals <= 100).all()
    for key, parts in tokens_of.items():
        assert sorted(parts)[0][0] == 0 and sum(k for _, k in parts) == length_at[key]
        assert all(a + k == b for (a, k), (b, _) in zip(sorted(parts), sorted(parts)[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_column_generation_comes_near_the_least(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(3, 60), 20, replace=False))
    counts = rng.integers(500, 5000, 20)
    program = packing.Columns(sizes, counts, 60)
    steps = program.solve(0.0005)
    least = (sizes * counts).sum() / 60
    patterns, times = program.rounded()
    assert steps < 800 and (sizes @ patterns <= 60).all()
    assert least <= program.used[program.cost > 0].sum() + 1e-6
    # no feasible duals give more: the last knapsack bounds the program
    value, _ = program.best(program.duals)
    assert value <= 1.0005 and times.sum() > 0.99 * least


def test_knapsack_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(50):
        lengths = np.array(sorted(rng.sample(range(1, 40), 6)))
        counts, room = np.array([rng.randint(1, 3) for _ in range(6)]), rng.randint(1, 80)
        sums = {0}
        for length, n in zip(lengths.tolist(), counts.tolist()):
            sums |= {s + length * k for s in sums for k in range(n + 1)}
        chosen = packing._fill(lengths, counts, room)
        assert sum(int(lengths[k]) for k in chosen) == max(s for s in sums if s <= room)
        assert all(chosen.count(k) <= counts[k] for k in range(6))
