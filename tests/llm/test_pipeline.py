import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm import test_line_chunks, test_mixing, test_ngram_join, test_quality
from tillmark.llm import byte_bpe, mixing
from tillmark.llm.queries import MIX_POWER, MIX_SEED


def without_repeats(rows):
    """(doc_id, text) -> text without chunks seen before."""
    return {key: kept for key, (*_, kept) in test_line_chunks.by_hand(rows).items()}


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = [line(12) for _ in range(12)]
    rows = [(1, None, "s0"), (2, "", "s1")]
    for i in range(3, 70):
        lines = [line(rnd.randrange(8, 30)) for _ in range(rnd.randrange(3, 9))]
        if i % 4 == 0:
            lines[2:2] = passage
        if i % 5 == 0 and i > 10:
            lines = [rows[-1][1].replace("\n", " ") + " tail"]
        if i % 11 == 0:
            lines = [x.replace(" ", "### ") for x in lines]
        rows.append((i, "\n".join(lines), "s0" if i % 3 else None))
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    judged = test_quality.by_hand([(("en", s), t) for _, t, s in rows])
    kept = [(i, t, s) for (i, t, s), j in zip(rows, judged) if j[-1]]
    texts = without_repeats([(i, t) for i, t, _ in kept])
    order = [i for i, _, _ in kept]
    classes = test_ngram_join.by_hand([texts[i] for i in order])
    single = [i for n, i in enumerate(order, 1) if classes[n][1] == n]
    source = {i: s for i, _, s in kept}
    sizes = Counter(source[i] for i in single)
    weights = {s: n**MIX_POWER for s, n in sizes.items()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i in single:
        rate = weights[source[i]] / sum(weights.values()) * len(single) / sizes[source[i]]
        pieces = int(np.ceil(rate / mixing.PIECE))
        count = sum(test_mixing.drawn(rate / pieces, test_mixing.unit(MIX_SEED, i, k)) for k in range(pieces))
        ids = own.encode_ordinary(texts[i])
        if count:
            want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()] = count
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert len(kept) < len(rows) and len(single) < len(kept) and any(texts[i] != t for i, t, _ in kept) and want


def test_all_but_the_last_stage_keep_the_columns(spark, documents):
    df = documents(["a b"], extra=False).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and out.count() == 0
