import random

import numpy as np
import pytest

from tillmark.llm import ngram_join
from tillmark.llm.common import components


def by_hand(texts):
    sets = {}
    for key, text in enumerate(texts, 1):
        words = (text or "").encode().lower().split()
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())
    low = {k: k for k in sets}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    low[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def varied(rnd, count):
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", " \t\n", "one", "One", "a b c d", "a b c d", "a b c", "É b c d e f", "é b c d e f"]
    for _ in range(count):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 120))]
        for _ in range(rnd.choice((1, 1, 2, 5, 12))):
            words = list(base)
            for _ in range(rnd.randrange(0, 6)):
                at = rnd.randrange(0, len(words))
                words[at : at + rnd.randrange(0, 2)] = [rnd.choice(vocabulary)]
            texts.append(" ".join(words))
    texts.append(" ".join(rnd.choice(vocabulary) for _ in range(20_000)))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, documents, seed):
    texts = varied(random.Random(seed), 60)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(documents(texts)).collect()}
    want = by_hand(texts)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 30


def family(rnd, base, count, least, most):
    """Copies of ``base`` with passages replaced, from nearly equal to far apart, some of them by words others use too."""
    pool = [[f"p{rnd.randrange(40)}" for _ in range(6)] for _ in range(12)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rnd.randrange(least, most)):
            at = rnd.randrange(len(words))
            words[at : at + 3] = rnd.choice(pool)[: rnd.randrange(1, 6)] if rnd.random() < 0.5 else [f"u{rnd.randrange(10**6)}"]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_large_groups_equal_brute_force(spark, documents, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", (2, 8)[seed - 3])
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(110)]
    near = base[:30] + [f"n{i}" for i in range(14)] + base[44:]
    texts = family(rnd, base, 90, 0, 9) + family(rnd, near, 50, 1, 7) + family(rnd, base[:80], 30, 0, 4)
    rnd.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(documents(texts)).collect()}
    want = by_hand(texts)
    assert got == want
    sizes = [list(c for _, c in want.values()).count(c) for _, c in want.values()]
    assert max(sizes) > 20 and sizes.count(1) > 20


def grouped(groups):
    """Groups (lists of node, size, place, class) as sorted rows."""
    flat = np.array([(g, *row) for g, rows in enumerate(groups) for row in rows], dtype=np.int64)
    return flat[:, 0], ngram_join._Rows(*flat[:, 1:].T)


def test_alike_groups_give_a_pair_once():
    nodes = np.random.RandomState(5).permutation(300)
    alike = [[(n, 150, g if n == 7 else g + 1, n) for n in nodes[: 290 + g % 10]] + [(900 + g, 150, 20, 900 + g)] for g in range(15)]
    found = [r for b in ngram_join._met(*grouped(alike), 0) for r in b.to_pylist()]
    assert len(found) < 320 and all(7 in (r["a"], r["b"]) for r in found)
    assert all(r["pivot"] == (1 if r["a"] == 7 else 2) for r in found)


def test_rows_without_partner_leave_and_no_link_is_lost():
    rnd = random.Random(6)
    rows = [(n, rnd.randrange(60, 160), rnd.randrange(0, 60), n % 50) for n in range(200)]
    keys, kept = grouped([rows])
    left = set(ngram_join._partnered(kept, np.arange(200)).tolist())
    x, y = np.triu_indices(200, 1)
    may = ngram_join._linkable(kept, x, y)
    needed = set(x[may].tolist()) | set(y[may].tolist())
    assert needed <= left and len(left) < 200
    assert [r for b in ngram_join._met(*grouped([[(n, 150, 40, n) for n in range(100)]]), 0) for r in b.to_pylist()] == []


def test_one_of_each_and_repeated_rows(spark, documents):
    df = documents(["a b c d e f", "A B c d e f", None, "", "x y"])
    twice = df.unionByName(df)
    kept = ngram_join.one_of_each(twice)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3, 3, 4, 4, 5, 5]


def test_empty_table(documents):
    assert ngram_join.classes(documents([])).count() == 0


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in edges)}
