import numpy as np
from pyspark.sql import functions as F

from tillmark.llm import vectors


def found(spark, rows, k, schema="vec_id long, embedding array<float>, label int"):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], schema).withColumn("id", F.lit("id")).withColumn("point", F.lit(1))
    out: dict[int, list] = {}
    for r in vectors.search(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def by_hand(rows, k):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            scored = sorted((-(q * x).sum(), j) for j, x in good if j != i)
            out[i] = [(r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return out


def test_small_table_is_exact_with_ties_and_bad_vectors(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.integers(-2, 3, 8).astype(float).tolist()) for i in range(300)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0]) for i in range(300, 420)]
    rows += [(420, None), (440, [0.0] * 8), (460, [float("nan")] + [1.0] * 7), (480, [None] + [1.0] * 7), (500, [float("inf")] + [1.0] * 7), (521, [])]
    got, want = found(spark, rows, 20), by_hand(rows, 20)
    assert got.keys() == want.keys()
    assert got == want


def test_recall_on_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST", 100)
    rnd = np.random.default_rng(2)
    x = (rnd.normal(size=(3000, 24)) * rnd.uniform(0.5, 2, (3000, 1))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows, 20), by_hand(rows, 20)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    hits = [len({g[1] for g in got[q]} & {w[1] for w in want[q]}) for q in want]
    assert sum(hits) / (20 * len(hits)) >= 0.9
    for q, rows_of in got.items():
        assert [r[0] for r in rows_of] == list(range(1, 21))
        assert all(abs(s - float((x[q].astype(np.float64) * x[j]).sum())) < 1e-9 for _, j, s in rows_of)
        assert sorted(rows_of, key=lambda r: (-r[2], r[1])) == rows_of


def test_few_and_no_rows(spark):
    assert found(spark, [], 20) == {}
    assert found(spark, [(0, [1.0, 2.0]), (3, [2.0, 1.0])], 20) == {0: [(1, 3, 4.0)]}
