import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
import zstandard
from helpers import FOLDER, WORD, dicts, documents, similar
from tripwave.llm import bpe, pii, quality
from tripwave.llm.queries import QUERIES, SQL

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(number))) % 10 == 0


def base(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            holds = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                     "card": 13 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}[kind]
            if holds:
                out.append((i, m.start(), m.end()))
    return out


def odd_texts():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", "x@y.com", ".", "-", " ", "  ", "+1", "+", "(269) ", "555-3296", "4532015112830366", "4", "12", "1.2.3.4", "256.1.1.1", "001.2.3.04",
             "é", "\n", "_", "4532 0151 1283 0366", "378282246310005", "[at]", "dot", "=", '"', "6011-0009-9013-9424", "1234567890123", "日"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(400)]


def test_base_spans_equal_plain_patterns(spark):
    texts = [*odd_texts(), None, "", "9" * 30000, "a" * 30000 + "@b.c", "1." * 9000, "+1 " * 9000, " ".join(f"j{i}@x.com" for i in range(3000)), "x@y.com" * 2]
    for r in dicts(pii.find(documents(spark, list(enumerate(texts))))):
        text = texts[r["doc_id"]]
        spans = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        assert spans == base(text), r["doc_id"]
        for a in r["added"]:
            assert all(b[2] <= a["start"] or b[1] >= a["end"] for b in spans) and a["end"] <= len(text)


def test_addresses_with_zero_parts(spark):
    rng = random.Random(9)
    parts = ["0", "00", "000", "1", "01", "10", "255", "0255", "256", "0256", "99", "099", "100", "0" * 3000]
    texts = ["10.0.0.1", "127.0.0.1", "192.168.0.1", "0.0.0.0", "00.000.0.00", "0.0.0.256", "0.0.0.", "0.0.0.0.0.0.0.0",
             *[" ".join(".".join(rng.choices(parts, k=4)) for _ in range(3)) for _ in range(300)]]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in dicts(pii.find(documents(spark, list(enumerate(texts)))))}
    for i, text in enumerate(texts):
        assert got[i] == base(text), i
    assert all(got[i] == [(1, 0, len(texts[i]))] for i in range(5))
    strict = [r[0] for r in spark.createDataFrame([(t,) for t in texts[:6]], "t string").selectExpr(f"t rlike r'{pii.STRICT['ip']}'").collect()]
    assert strict == [True] * 5 + [False]


def test_added_spans(spark):
    filler = [(i, f"write to joe{i}@mail.example.com or call +1 (269) 555-{3000 + i} from 10.0.0.{i} please") for i in range(60)]
    number = [(100 + i, f"order 90{i:02d}3905 9237 1137 of the day") for i in range(40)]
    glued = (500, "call +1 (269) 555-3296 4524132264652876 soon")
    rows = [*filler, *number, glued, (501, None), (502, ""), (500, glued[1])]
    got = dicts(pii.find(documents(spark, rows)))
    added = {r["doc_id"]: [(pii.KINDS[s["kind"]], dict(rows)[r["doc_id"]][s["start"]:s["end"]]) for s in r["added"]] for r in got}
    assert set(added[500]) == {("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")}
    assert all(not v for k, v in added.items() if k != 500) and len(got) == len(rows)
    assert pii.find(documents(spark, rows).limit(0)).count() == 0


def test_plain_em_agrees(spark):
    patterns = [("yyy-y", 50.0), ("yny-y", 30.0), ("nyn-n", 5.0), ("ynnyn", 7.0), ("-----", 3.0)]
    df = spark.createDataFrame([([{"votes": v, "n": n} for v, n in patterns],)], "patterns array<struct<votes:string,n:double>>")
    rules = pii.WeakRules()
    got = df.select(pii.reliabilities(df["patterns"], rules)).first()[0]
    prior, one, zero = 0.5, [h[0] for h in pii.HELD], [h[1] for h in pii.HELD]
    for _ in range(rules.rounds):
        q = []
        for v, _n in patterns:
            a, b = prior, 1 - prior
            for j, c in enumerate(v):
                if c != "-":
                    a *= one[j] if c == "y" else 1 - one[j]
                    b *= zero[j] if c == "y" else 1 - zero[j]
            q.append(a / (a + b))
        w = [(v, n, x) for (v, n), x in zip(patterns, q)]
        prior = (1 + sum(n * x for _, n, x in w)) / (2 + sum(n for _, n, _ in w))
        rate = lambda j, held, f: ((held * rules.pseudo + sum(f(n, x) for v, n, x in w if v[j] == "y")) / (
            rules.pseudo + sum(f(n, x) for v, n, x in w if v[j] != "-")))
        one = [rate(j, pii.HELD[j][0], lambda n, x: n * x) for j in range(5)]
        zero = [rate(j, pii.HELD[j][1], lambda n, x: n * (1 - x)) for j in range(5)]
    assert np.allclose(got, [prior, *one, *zero], atol=1e-9)


def test_registered_queries():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(SQL) <= set(QUERIES)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    compressor, rules = zstandard.ZstdCompressor(level=3), quality.QualityRules()
    good = [i for i in sorted(texts) if quality.document_stats(texts[i], rules, compressor)[6]]
    want, _ = similar([texts[i] for i in good], 5, 80)
    stay = [good[i] for i in range(len(good)) if want[i] == i]
    states, df = [], docs
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.materialize(stage(spark, df, FOLDER))
        states.append(df)
    assert [s.columns for s in states[:4]] == [docs.columns] * 4
    assert sorted(r["doc_id"] for r in states[0].collect()) == good
    assert sorted(r["doc_id"] for r in states[1].collect()) == stay
    masked = {r["doc_id"]: r["text"] for r in states[2].collect()}
    assert sorted(masked) == stay
    for i, t in masked.items():
        parts = t.split("[secret]")
        at = 0
        for p in parts:
            at = texts[i].index(p, at) + len(p)
        assert (len(parts) > 1) == bool(re.search(r'(?i)(password|token) ?= ?"?[0-9a-f]{6,}', texts[i])), i
    size = {i: len(WORD.findall(t)) for i, t in masked.items()}
    mixed = {}
    for r in states[3].collect():
        mixed.setdefault(r["doc_id"], []).append(r["text"])
    taken = {i: sum(len(WORD.findall(t)) for t in mixed.get(i, [])) for i in stay}
    assert all(taken[i] <= 2 * size[i] for i in stay)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(set(source.values()))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    encoded = sorted((i, hashlib.sha256(np.array(encoding.encode_ordinary(t), "<u4").tobytes()).hexdigest()) for i, ts in mixed.items() for t in ts)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in states[4].collect()) == encoded


def test_pipeline_on_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (None, "x " * 60, None, None, 120)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
    documents(spark, rows).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
