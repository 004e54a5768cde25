"""Token counts from a compiled transducer.

A merge vocabulary cuts text from left to right in a way that needs little memory: the last token of a prefix is the one
token ending there that stays apart from the last token of what is before it. What the future can depend on is which
suffixes of the text so far may still grow into a piece, the token each of them would follow, and by how much the counts
there differ from the count here. Those facts are the states of a deterministic transducer over characters; a transition
carries the (signed) change of the token count. States are worked out when a text first leads to them and kept in a table.

A slice of texts is cut into chunks that run through the table side by side. A chunk's map from the state it is entered
in to the state it is left in is constant behind its first break, a place no piece can span; so a first pass runs all
chunks from there, and a scan then hands each chunk's last state to the next chunk for what lies before its break.

Null and empty texts have no tokens. Repeated rows count alike. Whole texts are counted, however long; there is no cap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map, texts_of, whole_text

#: What the library writes for a space and puts before a text.
MARK = "▁"
#: Characters a chunk holds, characters handled at once, and cells of the state table after which it starts anew.
CHUNK, SLICE, CELLS = 256, 2_000_000, 24_000_000

State = tuple[tuple[str, str | None, int], ...]


class Transducer:
    """Counts what a sentencepiece BPE model with byte fallback would cut texts into."""

    START, UNKNOWN = 0, 1

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = (library.is_byte, library.is_control, library.is_unknown, library.is_unused)
        self.score = {
            library.id_to_piece(i): library.get_score(i)
            for i in range(library.get_piece_size())
            if not any(kind(i) for kind in special)
        }
        self.whole = {p for p in self.score if self.cut(p) == [p]}
        self.growing = {p[:i] for p in self.score for i in range(1, len(p))}
        letters = sorted({c for p in self.score for c in p if c in self.score})
        self.letters = ["", *letters]  # class 0: no piece has the character, the library spells it in bytes
        self.kind = np.zeros(0x110000, dtype=np.uint16)
        for i, c in enumerate(letters, 1):
            self.kind[ord(c)] = i
        self.kind[ord(" ")] = self.kind[ord(MARK)]
        self.neighbours = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.joined = np.zeros((len(self.letters), len(self.letters)), dtype=bool)
        for pair in self.neighbours:
            self.joined[self.kind[ord(pair[0])], self.kind[ord(pair[1])]] = True
        self.joined = self.joined.ravel()
        self.stays: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[State] = [(("", None, 0),), ()]
        self.numbers: dict[State, int] = {s: i for i, s in enumerate(self.states)}
        self.column = np.full(len(self.letters), -1, dtype=np.int64)
        self.column[0] = 0
        self.kinds = [0]
        self.cells = np.full((1024, 64), -1, dtype=np.int32)

    def cut(self, text: str) -> list[str]:
        """The library's merging on a few characters: best score first, then leftmost."""
        parts = list(text)
        while True:
            best = max(
                ((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None
            )
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def apart(self, left: str, right: str) -> bool:
        pair = left, right
        if pair not in self.stays:
            if len(self.stays) > 500_000:
                self.stays.clear()
            self.stays[pair] = self.cut(left + right) == [left, right]
        return self.stays[pair]

    def step(self, state: State, letter: str) -> tuple[State, int]:
        """The state after one more character, and the change of the count."""
        token, change, rest = "", 0, []
        for grown, after, lag in state:
            text = grown + letter
            if text in self.whole and (after is None or self.apart(after, text)):
                token, change = text, lag + 1
            if text in self.growing:
                if not grown and after is not None and after[-1] + letter not in self.neighbours:
                    after = None  # nothing spans this place, so what is before it no longer matters
                rest.append((text, after, lag))
        return (*((text, after, lag - change) for text, after, lag in rest), ("", token, 0)), change

    def fill(self, missing: np.ndarray) -> None:
        width = self.cells.shape[1]
        for place in missing.tolist():
            number, column = divmod(place, width)
            kind = self.kinds[column]
            if number == self.UNKNOWN:
                following, change = self.UNKNOWN, 0
            elif kind == 0:
                following, change = self.START, 0  # its bytes are counted apart
            else:
                state, change = self.step(self.states[number], self.letters[kind])
                following = self.numbers.setdefault(state, len(self.states))
                if following == len(self.states):
                    self.states.append(state)
            self.cells[number, column] = following << 5 | change + 16
        if len(self.states) > len(self.cells):
            self.cells = np.vstack([self.cells, np.full((len(self.states), width), -1, dtype=np.int32)])

    def advance(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = states * self.cells.shape[1] + columns
        found = self.cells.ravel()[place]
        if found.size and found.min() < 0:
            self.fill(np.unique(place[found < 0]))
            found = self.cells.ravel()[place]
        return found >> 5, (found & 31) - 16

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        totals = np.zeros(len(texts), dtype=np.int64)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return totals
        codes = np.frombuffer("".join(MARK + texts[i] for i in full).encode("utf-32-le"), dtype=np.uint32)
        starts = np.cumsum([0, *(len(texts[i]) + 1 for i in full[:-1])])
        kinds = self.kind[codes].astype(np.int64)
        breaks = np.ones(len(kinds), dtype=bool)
        breaks[1:] = ~self.joined[kinds[:-1] * len(self.letters) + kinds[1:]] | (kinds[1:] == 0)
        breaks[starts] = True

        if self.cells.size > CELLS:
            self.reset()
        for kind in np.flatnonzero(np.bincount(kinds, minlength=len(self.letters))):
            if self.column[kind] < 0:
                self.column[kind] = len(self.kinds)
                self.kinds.append(int(kind))
        if len(self.kinds) > self.cells.shape[1]:
            self.cells = np.hstack([self.cells, np.full((len(self.cells), len(self.kinds)), -1, dtype=np.int32)])

        changes = self.run(self.column[kinds], breaks)
        changes[kinds == 0] = 1 + (codes[kinds == 0] > 0x7F) + (codes[kinds == 0] > 0x7FF) + (codes[kinds == 0] > 0xFFFF)
        totals[full] = np.add.reduceat(changes.astype(np.int64), starts)
        return totals

    def run(self, columns: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """The change of the count at every character."""
        n = len(columns)
        chunks = -(-n // CHUNK)
        spare = chunks * CHUNK - n
        columns = np.ascontiguousarray(np.concatenate([columns, np.zeros(spare, dtype=columns.dtype)]).reshape(chunks, CHUNK).T)
        breaks = np.ascontiguousarray(np.concatenate([breaks, np.ones(spare, dtype=bool)]).reshape(chunks, CHUNK).T)
        changes = np.zeros((CHUNK, chunks), dtype=np.int8)
        left = np.full(chunks, self.UNKNOWN, dtype=np.int64)
        for i in range(CHUNK):
            left[breaks[i]] = self.START
            left, changes[i] = self.advance(left, columns[i])

        first = np.where(breaks.any(axis=0), breaks.argmax(axis=0), CHUNK)
        waiting = np.flatnonzero(first > 0)
        while len(waiting):
            ready = waiting[left[waiting - 1] != self.UNKNOWN]
            waiting = waiting[left[waiting - 1] == self.UNKNOWN]
            states = left[ready - 1]
            for i in range(CHUNK):
                going = first[ready] > i
                if not going.all():
                    ready, states = ready[going], states[going]
                if not len(ready):
                    break
                states, changes[i, ready] = self.advance(states, columns[i, ready])
            left[ready] = states  # those without any break
        return changes.T.ravel()[:n]


_COMPILED: dict[str, Transducer] = {}


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and whether there are more than ``limit`` tokens."""
    with open(path, "rb") as file:
        model = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = hashlib.sha256(model).hexdigest()

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        if name not in _COMPILED:
            _COMPILED[name] = Transducer(shared.value)
        own = _COMPILED[name]

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            counted = [own.counts(texts) for texts in _slices(texts_of(batch))]
            yield {
                "key": batch.column("key"),
                "n_bytes": pc.binary_length(batch.column("text")),
                "n_tokens": np.concatenate(counted) if counted else [],
            }

        return work

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), whole_text(column).alias("text"))
    found = arrow_map(rows, f"key {kind}, n_bytes bigint, n_tokens bigint", start, 1024)
    return found.withColumnRenamed("key", key).withColumn("over_limit", F.col("n_tokens") > limit)
