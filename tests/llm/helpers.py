"""Fixtures with awkward rows, and brute force versions."""

import os
import random
import re
import sys
from collections import defaultdict

import duckdb
import pandas as pd
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators use for results or inside, as extra input columns.
CLASHES = ["mix_size", "mix_taken", "score", "predicted", "n_tokens", "held_out", "key", "node", "y", "count", "pad_to",
           "_drop", "_again", "_id", "_id_", "_set_", "_node", "_t", "_f", "_digest", "_s", "root", "n", "sketch", "first_id", "x"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, rows, extra=False):
    """rows: (doc_id, text, source)."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    return df


def awkward(seed=1):
    """NULLs, empty, white space, one very long text, ties, copies and repeated rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(rng.randint(1, 60)) for _ in range(30)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for i in range(30, 60):
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(t), "s1"))
    rows += [(60, None, "s0"), (61, "", None), (62, " \n\t ", None), (63, text(20000), "s2"), (64, "Grüße Ü ä é 日本 語", "é"),
             (65, "a", "s0"), (66, "A", "s0"), (67, "a b c d", "s3"), (68, "A  B\tC\nD", "s3"), (None, base[0], "s1"), (None, None, None)]
    return rows


def duck(oracle, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name + "_df", df)
        c.execute(f"create view {name} as select * from {name}_df")
    return c.execute(oracle).df()


def sf_duck(oracle):
    c = duckdb.connect()
    for name in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c.execute(oracle).df()


def shingles(text, width=5):
    w = words(text)
    m = min(width, len(w))
    return frozenset(tuple(w[k : k + m]) for k in range(len(w) - m + 1)) if w else frozenset()


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def similar_classes(rows, width=5, similar=80, of=100):
    """[(doc_id, n_shingles, component_id)] by comparing every pair; rows: (doc_id, text)."""
    sets = [shingles(t, width) for _, t in rows]
    u = Union(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and of * len(x & y) >= similar * len(x | y):
                u.join(i, j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            members[u.find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = members[u.find(i)]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def same_rows(got, want):
    key = lambda r: tuple((x is None or x != x, 0 if x is None or x != x else x) for x in r)
    clean = lambda rows: sorted((tuple(None if isinstance(x, float) and x != x else x for x in r) for r in rows), key=key)
    assert clean(got) == clean(want)


def pandas_docs(rows):
    df = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    df["doc_id"] = df["doc_id"].astype("Int64")
    return df.astype({"text": object, "source": object}).where(df.notna(), None)
