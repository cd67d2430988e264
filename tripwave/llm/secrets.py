"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order Markov chains over a 67-symbol alphabet are trained from labelled
samples. Random: the values that the base patterns find, and generated strings of the
usual alphabets. Ordinary: all other text of all documents, without long tokens of letters and digits, which may be
either. A token from ``min_length`` characters is a secret if the sum of its log-likelihood ratios beats the odds against one,
so the ratio that each character must show falls with the length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripwave.llm.text import ROWS_AT_ONCE, by_batch

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]"
#: In any case, every assignment holds one of these.
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
K = len(ALPHABET)
#: Random classes; strings over few symbols would blur a chain over many.
MODELS = {"hex": "0123456789abcdef", "lower": ALPHABET[26:52], "capital": ALPHABET[:26], "upper": ALPHABET[:26] + "0123456789",
          "letters": ALPHABET[:52], "mixed": ALPHABET[:64]}
ORDINARY = "ordinary"


@dataclass(frozen=True)
class SecretRules:
    """``samples`` generated strings train each random class; tokens from ``min_length`` characters are scored.

    A token is a secret if its log-likelihood ratios add up to ``odds`` (natural logarithm of a million to one) and to ``min_score``
    for each pair of neighbours. Counts of symbol pairs are smoothed with ``backoff`` pairs that follow the single symbols.
    """

    samples: int = 2000
    sample_length: int = 40
    seed: int = 7
    min_length: int = 16
    odds: float = 14.0
    min_score: float = 0.3
    smoothing: float = 0.5
    backoff: float = 10.0


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """Base matches as (start, kind, end, value start, value end)."""
    out = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII):
            if m.end(2) - m.start(2) >= 6:
                out.append((m.start(), 0, m.end(), *m.span(2)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), *m.span()) for m in re.finditer(HEX, text)]
    return sorted(out)


def token_pattern(rules: SecretRules) -> str:
    return f"{TOKEN}{{{rules.min_length},}}"


def classes() -> np.ndarray:
    """Symbol number of each byte, K for bytes outside the alphabet."""
    table = np.full(256, K, np.int64)
    table[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(K)
    return table


def transitions(data: bytes, table: np.ndarray) -> np.ndarray:
    """Counts of neighbouring symbol pairs."""
    symbols = table[np.frombuffer(data, np.uint8)]
    pairs = symbols[:-1] * (K + 1) + symbols[1:]
    return np.bincount(pairs, minlength=(K + 1) ** 2).reshape(K + 1, K + 1)[:K, :K]


def random_class(value: str) -> str:
    return next(name for name in (*MODELS, "mixed") if name == "mixed" or set(value) <= set(MODELS[name]))


def generated(rules: SecretRules) -> dict[str, np.ndarray]:
    """Transition counts of the generated samples of each random class."""
    rng, table = np.random.RandomState(rules.seed), classes()
    out = {}
    for name, alphabet in MODELS.items():
        symbols = np.frombuffer(alphabet.encode(), np.uint8)
        drawn = symbols[rng.randint(0, len(symbols), (rules.samples, rules.sample_length))]
        lines = np.concatenate([drawn, np.full((rules.samples, 1), 32, np.uint8)], axis=1)
        out[name] = transitions(lines.tobytes(), table)
    return out


def labelled_counts(texts: DataFrame, rules: SecretRules) -> DataFrame:
    """Transition counts by class over all texts: ``class``, ``pair``, ``n``; summed in tasks, then by Spark."""
    token = token_pattern(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unlabelled = classes(), re.compile(token)
        counts = {name: np.zeros((K, K), np.int64) for name in (*MODELS, ORDINARY)}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                plain = []
                for text in batch.column(0).slice(at, ROWS_AT_ONCE).to_pylist():
                    end = 0
                    for start, _, stop, v, w in base_spans(text or ""):
                        counts[random_class(text[v:w])] += transitions(text[v:w].encode(), table)
                        plain.append(text[end:start])
                        end = max(end, stop)
                    plain.append((text or "")[end:])
                plain = [unlabelled.sub(lambda m: " " if looks_mixed(m[0]) else m[0], text) for text in plain]
                counts[ORDINARY] += transitions(" ".join(plain).encode("utf-8", "replace"), table)
        for name, table_of in counts.items():
            pairs = np.flatnonzero(table_of)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(pairs), pa.string()), pa.array(pairs, pa.int32()),
                                              pa.array(table_of.ravel()[pairs], pa.int64())], names=["class", "pair", "n"])

    counted = texts.select("text").mapInArrow(run, "class string, pair int, n long")
    return counted.groupBy("class", "pair").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, rules: SecretRules = SecretRules()) -> np.ndarray:
    """Log-likelihood ratios of symbol pairs, one K x K matrix per random class (at most 4 K^2 counts reach the driver)."""
    counts = {**{name: np.zeros((K, K)) for name in (*MODELS, ORDINARY)}, **generated(rules)}
    for name, pair, n in labelled_counts(texts, rules).collect():
        counts[name].flat[pair] += n
    chance = {}
    for name, c in counts.items():
        single = c.sum(axis=0) + rules.smoothing
        c = c + rules.backoff * single / single.sum()
        chance[name] = np.log(c / c.sum(axis=1, keepdims=True))
    return np.stack([chance[name] - chance[ORDINARY] for name in MODELS])


def scores(tokens: list[str], ratios: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Largest sum of log-likelihood ratios of each token over the random classes."""
    symbols = table[np.frombuffer("".join(tokens).encode(), np.uint8)]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False  # the last symbol of a token starts no pair
    pairs = np.flatnonzero(inside)
    first = np.cumsum(sizes - 1) - (sizes - 1)
    return np.add.reduceat(ratios[:, symbols[pairs], symbols[pairs + 1]], first, axis=1).max(axis=0)


def looks_mixed(token: str) -> bool:
    """Digits, and letters: may be random or an identifier, so it teaches neither model."""
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def find_spans(text: str, ratios: np.ndarray, rules: SecretRules, table: np.ndarray, token: re.Pattern) -> list[tuple]:
    """Base spans, and tokens apart from them that the models call random."""
    base = base_spans(text)
    free, at = [], 0
    for m in token.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        if not any(b[0] < m.end() and b[2] > m.start() for b in base[at:at + 4]):
            free.append(m)
    added = []
    if free:
        for m, total in zip(free, scores([m[0] for m in free], ratios, table).tolist()):
            if total >= max(rules.odds, rules.min_score * (len(m[0]) - 1)):
                added.append((m.start(), 3, m.end()))
    return sorted([b[:3] for b in base] + added)


def scan(docs: DataFrame, rules: SecretRules = SecretRules(), ratios: np.ndarray | None = None) -> DataFrame:
    """Secrets of each document: ``doc_id`` and ``spans``, an array of (start, end, kind) in code points.

    Base spans always stay; ``random`` spans are added where no base span is. NULL and empty
    texts have none, texts of any length are scanned whole, repeated rows one by one; a sum equal to the odds is
    a secret; an empty table gives no rows.
    Without ``ratios`` the models are trained on ``docs``.
    """
    ratios = train(docs, rules) if ratios is None else ratios
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:long,end:long,kind:string>>"
    token = token_pattern(rules)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, pattern = classes(), re.compile(token)
        spans = [[{"start": a, "end": e, "kind": KINDS[k]} for a, k, e in find_spans(t or "", ratios, rules, table, pattern)]
                 for t in batch.column(1).to_pylist()]
        of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, of)], names=["doc_id", "spans"])

    return by_batch(docs.select("doc_id", "text"), step, kind)


def redacted(docs: DataFrame, rules: SecretRules = SecretRules(), mask: str = "[secret]") -> DataFrame:
    """Documents with every secret replaced by ``mask``; ``n_chars``, if there, follows the text.

    Cases as in ``scan``: NULL and empty texts stay as they are, long ones are masked whole, repeated rows each, an
    empty table gives no rows; other columns, NULLs included, are untouched.
    """
    ratios = train(docs, rules)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    token = token_pattern(rules)

    def masked(text: str, table: np.ndarray, pattern: re.Pattern) -> str:
        out, end = [], 0
        for start, _, stop in find_spans(text, ratios, rules, table, pattern):
            if start >= end:
                out += [text[end:start], mask]
            end = max(end, stop)
        return "".join([*out, text[end:]])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, pattern = classes(), re.compile(token)
        old = batch.column(at).to_pylist()
        new = [t and masked(t, table, pattern) for t in old]
        columns = list(batch.columns)
        columns[at] = pa.array(new, batch.schema.field(at).type)
        if count is not None:
            was = batch.column(count).to_pylist()
            columns[count] = pa.array([len(n) if n != o else w for n, o, w in zip(new, old, was)], batch.schema.field(count).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return by_batch(docs, step, docs.schema)
