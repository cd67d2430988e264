"""Plain-Python versions of what the operators compute, and small tables."""

from __future__ import annotations

import re

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def documents(spark, rows):
    """Rows of (doc_id, text) or whole documents; with columns named like what operators use inside."""
    full = [(*r, None, None, None)[:5] if len(r) == 2 else r for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.selectExpr("*", "'x' as size", "1.5 as shard", "'y' as `key`", "'z' as `name`", "0 as _chunk", "'q' as spans")


def sql(text: str, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def same(a, b):
    order = lambda rows: sorted(tuple(sorted((k, repr(v)) for k, v in r.items())) for r in rows)
    return order(a) == order(b)


def groups(n, links):
    """Smallest member reachable from each of n nodes."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def shingles(text, k):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def similar(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return groups(len(sets), links), [len(s) for s in sets]
