import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tillmark.llm import byte_bpe, token_counts

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def mixed(count):
    rnd = random.Random(9)
    ranges = [(32, 127), (160, 600), (0x400, 0x460), (0x4E00, 0x9FFF), (0x1F300, 0x1F700), (0, 33)]
    words = ["the", " the", "ing", "<s>", "</s>", "<|endoftext|>", "▁", "  ", "\n", "1234567", "don't", "'LL", "==", "____", "<0x0A>"]

    def piece():
        if rnd.random() < 0.4:
            return rnd.choice(words)
        a, b = rnd.choice(ranges)
        return "".join(chr(rnd.randrange(a, b)) for _ in range(rnd.randrange(0, 6)))

    texts = [None, "", " ", "\n", "a" * 3000, " " * 999, "é" * 50, "﻿x", "=" * 700 + "-" * 701]
    return texts + ["".join(piece() for _ in range(rnd.randrange(0, 80))) for _ in range(count)] + ["".join(piece() for _ in range(10_000))]


def test_ids_equal_the_library_and_decode(spark, documents):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    texts = mixed(150)
    df = documents(texts)
    ids = {i: own.encode_ordinary(t or "") for i, t in enumerate(texts, 1)}
    for r in byte_bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect():
        assert r["n_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids[r["doc_id"]], dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"] - 1] or "").encode()).hexdigest()
    encoded = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    for r in encoded.collect():
        text = texts[r["doc_id"] - 1] or ""
        assert r["ids"] == ids[r["doc_id"]]
        if len(text) > 1000:
            continue
        ends = np.cumsum([len(own.decode_single_token_bytes(i)) for i in r["ids"]])
        for i, start, end, byte_end in zip(r["ids"], r["starts"], r["ends"], ends):
            begin = byte_end - len(own.decode_single_token_bytes(i))
            assert len(text[:start].encode()) <= begin < byte_end <= len(text[:end].encode())
            assert begin < len(text[: start + 1].encode()) and byte_end > len(text[: end - 1].encode())
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts, 1)}
    cut = spark.createDataFrame([(1, own.encode_ordinary("😀")[:-1]), (2, None)], "doc_id long, ids array<long>")
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode(cut, RANKS, public_tokenizers.PATTERN).collect()} == {1: "�", 2: ""}


def test_counts_equal_the_library(documents, monkeypatch):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = mixed(200)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(documents(texts), MODEL, 50).collect()}
    for i, t in enumerate(texts, 1):
        n = len(own.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 50)


@pytest.mark.parametrize("chunk", [1, 7])
def test_chunk_borders_and_full_tables_change_nothing(monkeypatch, chunk):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as file:
        machine = token_counts.Transducer(file.read())
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "CELLS", 100)
    texts = [t or "" for t in mixed(60)[:-1]]
    assert machine.counts(texts).tolist() == [len(own.encode(t)) for t in texts]
    assert machine.counts(texts[:20]).tolist() == [len(own.encode(t)) for t in texts[:20]]


def test_empty_tables(documents):
    df = documents([])
    assert byte_bpe.digests(df, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(df, MODEL, 5).count() == 0


def test_texts_of_two_byte_characters_are_split_by_short_classes_alike():
    short, full = byte_bpe.splitter(public_tokenizers.PATTERN, 0x10000), byte_bpe.splitter(public_tokenizers.PATTERN)
    assert len(short.pattern) < len(full.pattern) / 1.5 and r"\U0001" in full.pattern and r"\U0001" not in short.pattern
    codec = byte_bpe.ByteCodec({bytes([b]): b for b in range(256)}, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for letters in ("ab 1'!\t\n", "aß中￿٣ 　'", "a😀𝐀𝟗 \U0010ffff'"):
        for _ in range(300):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert codec.matches(text) == full.findall(text)
