import hashlib
import random
from collections import Counter

from tillmark.llm import line_chunks


def by_hand(rows):
    """Chunks by first occurrence, compared by their text; lines of first occurrences of what is repeated stay."""
    first, times, out = {}, Counter(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        for begin, end, _ in line_chunks.chunks(text or ""):
            chunk = "\n".join((text or "").split("\n")[begin:end])
            first.setdefault(chunk, (key, begin))
            times[chunk] += 1
    for key, text in rows:
        lines, drop, stay, n = (text or "").split("\n"), set(), set(), 0
        for begin, end, _ in line_chunks.chunks(text or ""):
            chunk = "\n".join(lines[begin:end])
            if first[chunk] != (key, begin):
                drop |= set(range(begin, end))
                n += 1
            elif times[chunk] > 1:
                stay |= set(range(begin, end))
        kept = "\n".join(line for i, line in enumerate(lines) if i not in drop - stay)
        out[key] = (len(lines), n, len(drop - stay), kept)
    return out


def test_repeated_chunks_go(spark, documents):
    rnd = random.Random(3)
    line = lambda: " ".join(rnd.choice("ab cd ef gh ij kl".split()) for _ in range(rnd.randrange(0, 9)))
    passage = [line() + str(i) for i in range(20)]
    texts = [None, "", "\n\n\n", "one line", "x\ny", "x\ny", "ü\nß\nü\nß" * 50]
    for _ in range(60):
        own = [line() for _ in range(rnd.randrange(0, 15))]
        at = rnd.randrange(0, len(own) + 1)
        begin = rnd.randrange(0, 10)
        texts.append("\n".join(own[:at] + passage[begin : begin + rnd.randrange(0, 20)] + own[at:]))
    texts.append("\n".join(passage * 300))
    df = documents(texts)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed_chunks"], r["n_removed_lines"], r["kept_sha256"]) for r in line_chunks.report(df).collect()}
    want = {k: (*v, hashlib.sha256(kept.encode()).hexdigest()) for k, (*v, kept) in by_hand(list(enumerate(texts, 1))).items()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 100
    cleaned = line_chunks.clean(df)
    assert cleaned.columns == df.columns and cleaned.count() == df.count()
    row = cleaned.where("doc_id = 68").first()
    assert row["n_chars"] == len(row["text"]) < len(texts[-1])


def test_what_goes_still_stands_where_it_came_first(documents):
    texts = ["A\nB", "A\nB\nC", "B\nC\nD", "C\nD", "x\nx\nx", "x\nx"]
    left = {r["doc_id"]: r["text"] for r in line_chunks.clean(documents(texts)).collect()}
    assert left == {1: "A\nB", 2: "B\nC", 3: "C\nD", 4: "", 5: "x\nx", 6: ""}
    rnd = random.Random(11)
    texts = ["\n".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 9))) for _ in range(80)]
    stay = [r["text"] for r in line_chunks.clean(documents(texts)).collect()]
    for text in texts:
        lines = text.split("\n")
        for first, end, _ in line_chunks.chunks(text):
            assert any(f"\n{chr(10).join(lines[first:end])}\n" in f"\n{other}\n" for other in stay)


def test_rows_of_one_doc_id(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "q\na\nb"), (2, "b\nc\nz"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"] or "") for r in line_chunks.clean(df).collect())
    assert got == [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "q"), (2, ""), (2, "z")]


def test_boundaries_do_not_shift():
    rnd = random.Random(5)
    lines = [f"line {rnd.random()}" for _ in range(200)]
    whole = {c[2] for c in line_chunks.chunks("\n".join(lines))}
    shifted = {c[2] for c in line_chunks.chunks("\n".join(["new", *lines]))}
    assert len(whole & shifted) >= len(whole) - 2


def test_planted_passages_go_whole(spark, documents):
    """Runs of lines planted in new surroundings: every line of a later copy goes, single repeated lines stay."""
    rnd = random.Random(7)
    fresh = lambda: f"own line {rnd.random()}"
    passages = [[f"planted {p} line {rnd.random()}" for _ in range(2 + p % 5)] for p in range(40)]
    texts, lost = [], 0
    for copy in range(3):
        for passage in passages:
            texts.append("\n".join([*(fresh() for _ in range(rnd.randrange(4))), *passage, *(fresh() for _ in range(rnd.randrange(4)))]))
            lost += len(passage) if copy else 0
    texts += ["\n".join([fresh(), passages[0][0], fresh(), "", passages[0][1]]) for _ in range(5)]
    got = line_chunks.report(documents(texts)).collect()
    assert sum(r["n_removed_lines"] for r in got) == lost
    assert all(r["n_removed_lines"] == 0 for r in got if r["doc_id"] <= 40 or r["doc_id"] > 120)
    left = [r["text"].split("\n") for r in line_chunks.clean(documents(texts)).where("doc_id between 41 and 120").collect()]
    assert all(line.startswith("own") for lines in left for line in lines if line)


def test_empty_table(documents):
    df = documents([])
    assert line_chunks.report(df).count() == 0 and line_chunks.clean(df).count() == 0


def test_rows_of_one_doc_id_with_repeated_chunks(spark, documents):
    texts = ["one line here\ntwo line here\nthree", "x\none line here\ntwo line here", "two\none line here\ntwo line here\nthree"]
    once = documents(texts)
    rows = once.unionByName(once).unionByName(once.where("doc_id = 2"))
    listed = line_chunks.repeated(rows)
    assert listed.count() == listed.distinct().count() == line_chunks.repeated(once).count() == 5
    got = {tuple(r) for r in line_chunks.report(rows).collect()}
    assert got == {tuple(r) for r in line_chunks.report(once).collect()}


def test_texts_found_are_not_shuffled_to_drop_repeats(spark, documents, monkeypatch):
    plans = []
    cut = line_chunks.cut
    monkeypatch.setattr(line_chunks, "cut", lambda df, *a: (plans.append(df), cut(df, *a))[1])
    line_chunks.report(documents(["a b\nc d\ne", "a b\nc d\nf"])).collect()
    found = [p for p in plans if "bytes" in p.columns]
    assert len(found) == 1 and "Aggregate" not in found[0]._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
