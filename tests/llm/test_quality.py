import random
import re
from collections import Counter

import numpy as np

from tillmark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = list(zip(words, words[1:], words[2:]))
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def vectors(stats):
    return np.array([[np.log(n), np.log(c / n), np.log(0.01 + s / n), np.log1p(d), np.log(0.02 + r / n)] for n, c, s, d, r in stats])


RIDGE = np.array([quality.RIDGE[f] for f in quality.FEATURES])


def distances(v, mean, scatter):
    """By the factor of the scatter, whose pivots are raised by the ridge."""
    c = np.zeros((5, 5))
    for i in range(5):
        for j in range(i):
            c[i, j] = (scatter[i, j] - c[i, :j] @ c[j, :j]) / c[j, j]
        c[i, i] = np.sqrt(max(scatter[i, i] - c[i, :i] @ c[i, :i], 0) + RIDGE[i])
    return (np.linalg.solve(c, (v - mean).T) ** 2).sum(axis=0), np.log(np.diag(c)).sum()


def estimate(v):
    """Concentration steps in numpy from each start; the least determinant."""
    median = lambda x: np.sort(x, axis=0)[(len(x) - 1) // 2]
    off = np.abs(v - median(v))
    off = off / (1.4826 * median(off) + RIDGE**0.5)
    found = []
    for start, of in enumerate(quality.STARTS):
        d = off[:, list(of)].sum(axis=1)
        for _ in range(quality.STEPS):
            bins = np.floor(np.log(d + 1e-6) * quality.PER_E)
            near = v[bins <= np.sort(bins)[int(np.ceil(quality.SHARE * len(v))) - 1]]
            mean = near.mean(axis=0)
            scatter = ((near[:, :, None] * near[:, None, :]).mean(axis=0) - np.outer(mean, mean)) * quality.CONSISTENT
            d, det = distances(v, mean, scatter)
        found.append((round(det, 9), start, mean, scatter))
    return min(found, key=lambda f: f[:2])[2:]


def by_hand(rows):
    """(lang, source), text -> counts and verdicts."""
    stats = [counted(t) for _, t in rows]
    failed = [n < 50 or 100 * rep > 50 * n for n, _, _, _, rep in stats]
    sound = [i for i, f in enumerate(failed) if not f]
    kept = [False] * len(rows)
    if sound:
        x = dict(zip(sound, vectors([stats[i] for i in sound])))
        of = lambda test: [i for i in sound if test(rows[i][0])]
        every = estimate(np.array([x[i] for i in sound]))
        for group in {rows[i][0] for i in sound}:
            own, wide = of(lambda g: g == group), of(lambda g: g[0] == group[0])
            a, b = len(own) / (len(own) + quality.LEAST), len(wide) / (len(wide) + quality.LEAST)
            found = zip(estimate(np.array([x[i] for i in own])), estimate(np.array([x[i] for i in wide])), every)
            mixed = [a * e + (1 - a) * (b * f + (1 - b) * g) for e, f, g in found]
            for i, d in zip(own, distances(np.array([x[i] for i in own]), *mixed)[0]):
                kept[i] = bool(d <= quality.REACH)
    return [(*s, f, k) for s, f, k in zip(stats, failed, kept)]


def test_counts_and_verdicts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST", 40)
    rnd = random.Random(2)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = [("a", None), ("a", ""), ("b", " \n\t"), ("a", "same again " * 60), ("a", "x y z " * 9000), (None, "ü " + " ".join(vocabulary))]
    for i in range(200):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(40, 200))]
        if i % 12 == 0:
            words = [w + "***" * (1 + i % 3) for w in words]
        if i % 9 == 0:
            words += words[: rnd.randrange(3, 60)]
        rows.append((rnd.choice(("a", "a", "b", None, "rare")), "".join(w + rnd.choice((" ", " ", " ", "\n", "\r\n")) for w in words)))
    df = spark.createDataFrame([(i, t, g, g, 0) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, cell int")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.verdicts(df).collect()}
    want = dict(enumerate(by_hand([((g, g), t) for g, t in rows])))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert 5 < sum(not w[5] and not w[6] for w in want.values()) < 40
    stay = quality.keep(df.unionByName(df))
    assert stay.columns == df.columns and stay.count() == 2 * sum(w[6] for w in want.values())


def test_rare_junk_source_is_judged_by_its_language(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST", 40)
    rnd = random.Random(4)
    clean = lambda: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randrange(3, 9))) for _ in range(rnd.randrange(90, 160)))
    junk = lambda: " ".join("#$%&|" * 12 + str(rnd.random()) for _ in range(rnd.randrange(90, 160)))
    rows = [(clean(), "x", source) for source in ("one", "two") for _ in range(80)] + [(junk(), "x", "rare") for _ in range(5)]
    rows += [(clean(), "x", "small") for _ in range(5)] + [(junk(), "y", "alone") for _ in range(5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.verdicts(df).where("kept").collect()}
    assert kept == set(range(160)) | set(range(165, 170))


def test_the_estimate_decides(spark):
    """Two languages with other normal ranges: what is usual in one is an outlier in the other, as no fixed scale could say."""
    rnd = np.random.default_rng(5)
    rows, expected = [], {}

    def add(lang, words, chars, keep=None):
        rows.append((len(rows), lang, "s", int(words), int(words * chars), 0, 0, 0))
        if keep is not None:
            expected[len(rows) - 1] = keep

    for _ in range(3000):
        add("narrow", np.exp(rnd.normal(5.0, 0.05)), 5.0)
        size = rnd.normal(6.0, 1.0)  # correlated: longer texts have longer words
        add("wide", 50 + np.exp(size), np.exp(1.6 + 0.6 * (size - 6.0) + rnd.normal(0, 0.02)))
    long, short = 50 + np.exp(8.0), 50 + np.exp(4.0)
    add("wide", long, np.exp(1.6 + 1.2), True)
    add("wide", short, np.exp(1.6 - 1.2), True)
    add("wide", long, np.exp(1.6 - 1.2), False)  # each statistic is usual, the two together are not
    add("narrow", long, 5.0, False)
    add("narrow", 150, 5.0, True)
    columns = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    judged = quality.judge(spark.createDataFrame([tuple(x if isinstance(x, str) else int(x) for x in r) for r in rows], columns))
    got = {r["doc_id"]: r["kept"] for r in judged.where(f"doc_id >= {len(rows) - 5}").collect()}
    assert got == expected
    # a rule of fixed scales from the middle of all cannot give these verdicts: what it must keep lies farther out than what it must reject
    assert abs(np.log(long) - 5.0) >= abs(np.log(long) - 5.5)


def test_empty_table(documents):
    assert quality.verdicts(documents([])).count() == 0 and quality.keep(documents([])).count() == 0
