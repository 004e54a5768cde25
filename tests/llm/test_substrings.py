import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tillmark.llm import substrings


def by_hand(texts):
    """Counts all strings of all texts."""
    raw = [(t or "").encode() for t in texts]
    n = substrings.LENGTH
    seen = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = {}
    for key, r in enumerate(raw, 1):
        gone = np.zeros(len(r) + 2, dtype=np.int8)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i + 1 : i + 1 + n] = 1
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out[key] = (len(r), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def made(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefgh \n") for _ in range(n))
    passages = [text(rnd.randrange(300, 1200)) for _ in range(6)]
    texts = [None, "", "short", text(399), "a" * 400, "a" * 401, "a" * 5000 + text(300), text(50) + "ab" * 1000, ("x" * 37 + "ü") * 90]
    texts += [text(700)] * 3 + [text(399)] * 2 + ["\0" * 450 + "q", "z" + "\0" * 450, ("line one is here\n" * 60) + text(200)]
    for _ in range(40):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 200)
            parts += [text(rnd.randrange(0, 150)), p[a : a + rnd.randrange(200, 1200)]]
            if rnd.random() < 0.3 and len(parts[-1]) > 10:
                at = rnd.randrange(len(parts[-1]))
                parts[-1] = parts[-1][:at] + "!" + parts[-1][at + 1 :]
        texts.append("".join(parts))
    texts.append(text(30_000) + passages[0])
    return texts


@pytest.mark.parametrize(("seed", "heavy"), [(1, substrings.HEAVY), (2, 3)])
def test_removed_bytes_equal_brute_force(spark, documents, monkeypatch, seed, heavy):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    texts = made(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.report(documents(texts)).collect()}
    want = by_hand(texts)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert len({w[2] for w in want.values()}) > 2


def test_deep_shallow_orders_and_measures():
    rnd = random.Random(4)
    strings = [b"k" * rnd.choice((0, 60, 70, 150)) + bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 40))) for _ in range(400)]
    group = np.array([rnd.randrange(3) for _ in strings])
    order, shared = substrings.deep_shallow(group, strings, 200)
    padded = [s.ljust(200, b"\0") for s in strings]
    assert [(group[i], padded[i]) for i in order] == sorted((group[i], padded[i]) for i in range(len(strings)))
    for before, here, n in zip(order, order[1:], shared[1:]):
        if group[before] != group[here]:
            assert n == -1
        else:
            a, b = padded[before], padded[here]
            assert n == next((i for i in range(200) if a[i] != b[i]), 200)


def test_anchors_depend_on_their_string_alone(monkeypatch):
    rnd = random.Random(6)
    raw = np.array([rnd.randrange(4) for _ in range(5000)], dtype=np.uint8)
    whole = substrings.anchors(raw)
    monkeypatch.setattr(substrings, "BLOCK", 700)
    assert (substrings.anchors(raw) == whole).all()
    for _, place, first, last in whole.T[:40]:
        for s in (first, last):
            assert substrings.anchors(raw[s : s + substrings.LENGTH])[1, 0] == place - s


def test_empty_table(documents):
    assert substrings.report(documents([])).count() == 0
