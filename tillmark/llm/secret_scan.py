"""Secrets: fixed kinds by pattern, then strings that a primed compressor finds new.

The fixed kinds are assignments, access keys and long hexadecimal strings, found by the contract's patterns. Beyond them a
candidate is a run of at least LEAST key characters with no letter or digit next to it, that begins within REACH characters
of a word such as secret, key or token, outside the fixed spans. Its novelty is what it adds to a zstandard frame: compressed
bytes of its surroundings (AROUND characters on each side) followed by it, less those of the surroundings alone, both primed
with a dictionary of identifiers, per byte of the candidate. Names that the code around or the corpus uses are copied from
there and add little; random strings add about a byte per character. From NOVEL on a candidate is reported. Other sensitive
occurrences of the same string are taken out of the surroundings, so a key pasted twice does not hide itself.

The identifier dictionary holds the letter runs of long strings that stand in two or more different texts, the most frequent
ones up to DICTIONARY bytes, a size zstandard looks back over; they are counted over all texts with partial sums. Random
strings have few such runs, so copies of a document with a key do not teach its key.

Texts are read twice and shuffled never; a task holds one Arrow batch. Offsets are code points, ends exclusive. Null and empty
texts have no spans. Very long texts are scanned whole, in time linear in their length. Equal rows get equal results, rows of
one doc_id each their own; an empty table gives an empty one. Only ``doc_id`` and ``text`` are read, so other columns cannot
clash. Spans of equal start come in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map, texts_of, whole_text

KINDS = ("assign", "access", "hex", "novel")

#: Candidates: least characters, and how far behind a sensitive word they may begin.
LEAST, REACH = 16, 32
#: Characters of surroundings on each side, bytes of the identifier dictionary, zstandard level.
AROUND, DICTIONARY, LEVEL = 256, 65_536, 19
#: Added bytes per byte from which a candidate counts as incompressible.
NOVEL = 0.8


def _either_case(words: str) -> str:
    """A pattern with ASCII letters in either case; ``(?i)`` would let in letters beyond ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m.group()}{m.group().upper()}]", words)


# The contract's patterns. The look-behinds change no match, as a run is always taken from its beginning.
ASSIGN = re.compile(
    "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
#: Lower-cased texts without any of these have no assignment.
ASSIGN_HINTS = ("passw", "secret", "token", "api")

#: Words that make their surroundings sensitive.
WORDS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "private", "signature")
SENSITIVE = re.compile(_either_case("|".join(WORDS)))
CANDIDATE = re.compile(r"(?<![\w+/.-])[A-Za-z0-9+/_.-]{%d,}+={0,2}(?!\w)" % LEAST)
LONG, RUN = r"[A-Za-z0-9+/_.=-]{12,}", r"[A-Z]?[a-z]{3,}|[A-Z]{4,}"

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """``start, kind, end`` of the fixed kinds, in order."""
    found: list[Span] = []
    folded = text.lower()
    if any(hint in folded for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Sensitive strings outside the spans that are taken; full stops and dashes at their ends do not belong to them."""
    folded = text.lower()
    if not any(word in folded for word in WORDS):
        return []
    found, i = [], 0
    for m in CANDIDATE.finditer(text):
        value = m.group()
        start = m.start() + len(value) - len(value.lstrip(".-"))
        end = m.end() - (len(value) - len(value.rstrip(".-")))
        if end - start < LEAST or not SENSITIVE.search(text, max(0, start - REACH), start):
            continue
        while i < len(taken) and taken[i][2] <= start:
            i += 1
        if not any(a < end and start < b for a, _, b in taken[i : i + len(KINDS)]):
            found.append((start, end))
    return found


class Novelty:
    """Bytes that strings add to their surroundings, by zstandard primed with a dictionary."""

    def __init__(self, dictionary: bytes):
        primed = None
        if dictionary:
            primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=LEVEL)
        bare = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, **bare)

    def size(self, text: bytes) -> int:
        return len(self.compressor.compress(text))

    def of(self, text: str, spans: list[tuple[int, int]]) -> list[float]:
        """Added bytes per byte of each span, whose other occurrences among the spans are not its surroundings."""
        same: dict[str, list[tuple[int, int]]] = {}
        for start, end in spans:
            same.setdefault(text[start:end], []).append((start, end))
        out = []
        for start, end in spans:
            value, at, around = text[start:end], max(0, start - AROUND), []
            last = min(len(text), end + AROUND)
            for a, b in same[value]:
                if b > at and a < last:
                    around.append(text[at : max(at, a)])
                    at = b
            around.append(text[at:last])
            near, own = "".join(around).encode(), value.encode()
            out.append((self.size(near + own) - self.size(near)) / len(own))
        return out


def identifiers(docs: DataFrame) -> bytes:
    """The identifier dictionary of a corpus, the most frequent entries last, where zstandard reaches them most cheaply."""
    text = whole_text()
    runs = F.array_distinct(F.regexp_extract_all(F.array_join(F.regexp_extract_all(text, F.lit(LONG), F.lit(0)), " "), F.lit(RUN), F.lit(0)))
    rows = docs.select(F.xxhash64(text).alias("of"), F.explode(runs).alias("run"))
    counts = rows.groupBy("run").agg(F.count("*").alias("n"), F.min("of").alias("low"), F.max("of").alias("high"))
    # an entry takes four bytes or more, so no more than these can fit
    top = counts.where("low < high").orderBy(F.desc("n"), "run").limit(DICTIONARY // 4).select("run").collect()
    return "\n".join(r["run"] for r in reversed(top)).encode()[-DICTIONARY:]


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and ``spans``: start, kind, end, novelty (of the kind novel) of every secret, in order."""
    dictionary = identifiers(docs)

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        novelty = Novelty(dictionary)

        def secrets(text: str) -> list[dict[str, object]]:
            taken = base_spans(text)
            more = candidates(text, taken)
            spans = [(a, KINDS[kind], b, None) for a, kind, b in taken]
            spans += [(a, "novel", b, n) for (a, b), n in zip(more, novelty.of(text, more)) if n >= NOVEL]
            spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
            return [dict(zip(("start", "kind", "end", "novelty"), s)) for s in spans]

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            texts = texts_of(batch)
            yield {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "spans": [secrets(t) for t in texts]}

        return work

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return arrow_map(rows, "doc_id bigint, text string, spans array<struct<start:int,kind:string,end:int,novelty:double>>", start)


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of spans of each kind, a digest of the fixed ones, and all spans in writing."""
    rows = find(docs).drop("text")
    written = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    fixed = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "novel"), written), ",")
    return rows.select(
        "doc_id",
        *(count(kind) for kind in KINDS[:-1]),
        F.sha2(fixed.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"),
        count(KINDS[-1]),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every span by the name of its kind; of spans that overlap, the first stands for all."""

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def clean(text: str, spans: list[dict[str, object]]) -> str:
            out, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["end"])
            return "".join([*out, text[at:]])

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            texts = [clean(t, s) for t, s in zip(texts_of(batch), batch.column("spans").to_pylist())]
            yield {"doc_id": batch.column("doc_id"), "text": texts}

        return work

    return arrow_map(find(docs), "doc_id bigint, text string", start)
