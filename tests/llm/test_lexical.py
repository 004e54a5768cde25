import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from tillmark.llm import lexical, queries

SF_DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k=20):
    """All documents scored for all items."""
    own = [(d, Counter(words(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(words(text))
    out = set()
    for item, terms in asked.items():
        found = []
        for d, c in own:
            score = 0
            for t, reps in terms.items():
                if c[t]:
                    m = 100 - 25 + (25 * c.total() * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += reps * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0 and d is not None:
                found.append((-score, d))
        out |= {(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)}
    return out


def corpus(seed, count):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeéß中", k=rnd.randrange(1, 6))) for _ in range(400)]
    texts = [None, "", " .,;\n", "É é E e", "x" * 50_000, " ".join(rnd.choices(vocabulary, k=30_000)), "a" * 9 + "\x7f\x00A1"]
    for _ in range(count):
        size = int(rnd.paretovariate(0.9)) % 600
        texts.append(" ".join(rnd.choices(vocabulary, k=size)).title() + rnd.choice(["", ".", "!? "]))
    return texts + [texts[9]] * 60 + [" ".join(["same"] * n) for n in range(1, 70)], vocabulary, rnd


@pytest.mark.parametrize("terms", [lexical.TERMS, 12])
def test_equals_scoring_all(spark, documents, monkeypatch, terms):
    monkeypatch.setattr(lexical, "TERMS", terms)
    monkeypatch.setattr(lexical, "BLOCK", 64)
    texts, vocabulary, rnd = corpus(5, 300)
    df = documents(texts).withColumn("item", F.lit(1)).withColumn("items", F.lit(1)).withColumn("rank", F.lit(1)).repartition(3)
    df = df.withColumn("doc_id", F.when(F.col("doc_id") != 40, F.col("doc_id")))
    rows = [(i if i != 40 else None, t) for i, t in enumerate(texts, 1)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 30)))) for i in range(9)]
    items += [(20, "same"), (21, "Same same e"), (22, None), (23, ""), (24, "nowhere"), (25, texts[9]), (26, "a"), (26, "A b"), (None, "é")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = [tuple(r) for r in lexical.search(df, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, items)


def test_repeated_rows_fill_ranks(spark):
    docs = spark.createDataFrame([(1, "ä b"), (1, "ä b"), (1, "c ä"), (2, "d"), (3, "d")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "ä")], "item_id long, text string")
    assert [r["rank"] for r in lexical.search(docs, items).orderBy("rank").collect()] == [1, 2, 3]
    assert lexical.search(docs, items, k=2).count() == 2


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical.search(docs, items).collect() == lexical.search(some, items).collect() == []
    assert lexical.search(docs, some.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_bounds_are_never_below_and_mostly_near(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = next(lexical._groups(spark.read.parquet(f"{SF_DIR}/benchmark.parquet")))
    blocks = lexical.index(docs)
    lengths = [n for r in blocks.collect() for n in r["lengths"]]
    shared = spark.sparkContext.broadcast(lexical._queries(docs, items, len(lengths), sum(lengths)))
    bounds = lexical._bounds(blocks, shared, lambda item, ids, bound: np.flatnonzero(bound > 0))
    bound = {(r["item"], r["doc_id"]): r["bound"] for r in bounds.collect()}
    exact = {(r["item"], r["doc_id"]): r["score"] for r in lexical._exact(docs, bounds, shared).collect()}
    assert all(bound[p] >= s for p, s in exact.items())
    assert set(exact) == set(bound) and sum(bound[p] <= 1.5 * s for p, s in exact.items()) > 0.9 * len(exact)


def test_query_equals_sql(spark):
    assert difference(queries.op12_lexical(spark, SF_DIR), connect(SF_DIR), queries.ORACLES["op12_lexical"]) is None
