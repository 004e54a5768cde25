"""Byte-level BPE over Arrow batches with the ``tokenizers`` library, and its way back.

The rank file becomes a vocabulary over the printable stand-ins of the 256 bytes and a merge list: a token may come from
any split into two tokens, in rank order. Matches of the splitting pattern repeat, so each worker keeps the ids of the
matches it has met in a bounded table and the library sees a match only when it is new.

Null and empty texts have no ids. Ties and repeated rows are encoded alike; no row or text is dropped or cut. Columns of
the input other than those asked for are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillmark.llm.common import arrow_map, texts_of, whole_text

#: Bytes of matches and their ids that a task keeps; released when it ends.
KEPT_BYTES = 144 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def splitter(pattern: str, end: int = 0x110000) -> re.Pattern[str]:
    r"""The pattern for the standard matcher, its Unicode classes (``\p{L}``, ``\s``, ``\S``) spelled out as ranges.

    The ranges come from the ``regex`` module, which knows the classes; the standard matcher is twice as fast. Texts whose
    characters all lie before ``end`` are split alike by ranges up to there: the matcher looks up characters of two bytes
    in a table and walks the ranges beyond one by one, at the end of every match.
    """
    import regex

    every = "".join(map(chr, [*range(min(end, 0xD800)), *range(0xE000, end)]))

    def ranges(name: str) -> str:
        return "".join(rf"\U{ord(run[0]):08x}-\U{ord(run[-1]):08x}" for run in _runs(regex.findall(f"{name}+", every)))

    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part == r"\S" and not inside:
            part = f"[^{ranges(r'\s')}]"
        elif part == r"\s" or part.startswith(r"\p"):
            part = ranges(part) if inside else f"[{ranges(part)}]"
        inside = part == "[" or inside and part != "]"
        out.append(part)
    return re.compile("".join(out))


def _runs(found: list[str]) -> Iterator[str]:
    """Runs of consecutive code points (the string of all characters steps over the surrogates)."""
    for run in found:
        first = 0
        for i in range(1, len(run) + 1):
            if i == len(run) or ord(run[i]) != ord(run[i - 1]) + 1:
                yield run[first:i]
                first = i


class ByteCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        letters = byte_characters()
        written = {token: "".join(letters[b] for b in token) for token in ranks}
        splits = sorted(
            (rank, ranks[token[:i]], ranks[token[i:]], token[:i], token[i:])
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        )
        self.tokenizer = Tokenizer(
            models.BPE(
                vocab={written[token]: rank for token, rank in ranks.items()},
                merges=[(written[left], written[right]) for *_, left, right in splits],
                ignore_merges=True,  # a match that is a token is that token
            )
        )
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.any_matches, self.short_matches = splitter(pattern).findall, splitter(pattern, 0x10000).findall
        self.forget()
        back = {letter: b for b, letter in enumerate(letters)}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for letters_of_token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[rank] = bytes(back[c] for c in letters_of_token)
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def forget(self) -> None:
        """Empty the cache: matches and their ids, about KEPT_BYTES at most."""
        self.known: dict[str, bytes] = {}
        self.kept = 0

    def matches(self, text: str) -> list[str]:
        short = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return self.short_matches(text) if short else self.any_matches(text)

    def encode(self, text: str) -> np.ndarray:
        found = self.matches(text)
        fresh = [m for m in dict.fromkeys(found) if m not in self.known]
        if fresh:
            if self.kept > KEPT_BYTES:
                self.forget()
                fresh = list(dict.fromkeys(found))
            for match, encoding in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
                self.known[match] = np.array(encoding.ids, dtype="<u4").tobytes()
                self.kept += 200 + 2 * len(match) + 4 * len(encoding.ids)
        return np.frombuffer(b"".join(map(self.known.__getitem__, found)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; a character split over tokens is whole again."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()])

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end (exclusive) character of each id; ids that share a character both cover it."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        if not len(ids):
            return ends, ends
        return character[ends - self.lengths[ids]], character[ends - 1] + 1


_CODECS: dict[tuple[str, str], ByteCodec] = {}


def _kept_codec(name: tuple[str, str], shared: object, pattern: str) -> ByteCodec:
    """A function of the module, not a closure: closures travel with a copy of the table and would build a codec per task."""
    if name not in _CODECS:
        _CODECS[name] = ByteCodec(shared.value, pattern)
    return _CODECS[name]


def _codec(docs: DataFrame, path: str, pattern: str) -> Callable[[], ByteCodec]:
    """The rank file travels with the job, so workers need no file of the driver's; a worker builds its codec once."""
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), pattern

    return lambda: _kept_codec(name, shared, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key``, ``ids`` and the characters each id covers, ``[starts, ends)``."""
    codec = _codec(docs, path, pattern)

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        own = codec()

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            texts = texts_of(batch)
            ids = [own.encode(t) for t in texts]
            spans = [own.offsets(t, i) for t, i in zip(texts, ids)]
            yield {"key": batch.column("key"), "ids": ids, "starts": [s[0] for s in spans], "ends": [s[1] for s in spans]}

        work.close = own.forget
        return work

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), whole_text(column).alias("text"))
    return arrow_map(rows, f"key {kind}, ids array<bigint>, starts array<bigint>, ends array<bigint>", start, 64).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """``key`` and ``text``; bytes that are no UTF-8 (ids of a cut text) become U+FFFD. Null ids give an empty text."""
    codec = _codec(encoded, path, pattern)

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        own = codec()

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            lists = batch.column("ids").to_pylist()
            yield {"key": batch.column("key"), "text": [own.decode(np.array(i or [], dtype="<u4")).decode(errors="replace") for i in lists]}

        return work

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(encoded[key].alias("key"), encoded[column].alias("ids"))
    return arrow_map(rows, f"key {kind}, text string", start, 64).withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the number of ids, and SHA-256 of the ids (little-endian, 32 bits) and of the bytes they decode to."""
    codec = _codec(docs, path, pattern)

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        own = codec()

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            ids = [own.encode(t) for t in texts_of(batch)]
            yield {
                "doc_id": batch.column("doc_id"),
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(i.tobytes()).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(own.decode(i)).hexdigest() for i in ids],
            }

        work.close = own.forget
        return work

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return arrow_map(rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)
