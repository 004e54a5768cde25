"""Ranked lexical search with bit-sliced Bloom signatures.

Index: documents of similar length form blocks; a block is a bitmap with one row per signature bit and one column per
document. A term sets HASHES rows of its document's column, and once more for every power of two its frequency reaches, so the
rows tell an upper bound of the frequency too. Search: the rows of a query term are ANDed, which finds every document with
the term and a few without. With the bounded frequency and the known length of a document, each term has a greatest share of
the score; weighted sums over a query's terms bound the document's score from above. The documents of the highest bounds are
scored exactly; then every document whose bound does not lie behind the k-th of these scores is scored exactly, and the rest
is provably out. No document is left out for any other reason.

Scores are integers. A term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))``; N, L and the df of a query's terms are counted
over all documents.

Distribution: the index is built and searched by tasks that hold one block at a time (BLOCK documents, BLOCK_BYTES). Items
are read in groups of at most TERMS distinct (item, term) rows (or one item), whatever their number; a group passes over the
index. Candidates meet their texts in a join on doc_id that the optimizer broadcasts while it knows them to be few and
shuffles beyond that. No row of this goes to the driver but the items of one group and their thresholds, k per item.

Null and empty texts have no terms and no score. Rows of one doc_id are scored each by itself; equal ones fill several ranks.
Documents without a doc_id are counted and never returned. Items of one item_id are one item with all their terms; an item
without terms has no rows. Ties are ranked by doc_id. A very long text fills a block of its own. Empty tables give no rows.
Columns are taken from their tables by name before any join, so others cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map, whole_text
from tillmark.session import durable

#: Signature bits per entry (a term, or a power of two its frequency reaches) and rows that an entry sets: 0.1 % false entries.
BITS, HASHES = 15, 7
#: Documents and bitmap bytes of a block at most, and entries that a task holds for blocks it has not finished.
BLOCK, BLOCK_BYTES, HELD = 1024, 1 << 22, 1 << 23
#: Blocks of documents of similar length: lengths of one class differ by less than this factor.
CLASS = 1.25
#: Distinct (item, term) rows that are searched for together.
TERMS = 65_536
#: Documents that are scored for thresholds, as a multiple of k.
SEEDS = 2
#: Term bytes whose hashes a task keeps.
KEPT_BYTES = 1 << 24

#: Stands in a block for a doc_id of null.
MISSING = int(np.iinfo(np.int64).min)

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents with n terms; ``total`` terms in ``n_docs`` documents."""
    return 100 - 25 + (25 * n * n_docs) // total


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


# --- the index -------------------------------------------------------------------------------------------------------


class _Hashes:
    """64-bit hashes of terms, kept up to a number of bytes."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0

    def of(self, terms: list[bytes]) -> np.ndarray:
        out = np.empty(len(terms), np.uint64)
        for i, term in enumerate(terms):
            value = self.known.get(term)
            if value is None:
                value = xxhash.xxh3_64_intdigest(term)
                self.size += len(term) + 100
                if self.size > KEPT_BYTES:
                    self.known, self.size = {}, len(term) + 100
                self.known[term] = value
            out[i] = value
        return out


def _at_level(hashes: np.ndarray, level: int) -> np.ndarray:
    """Another hash for "the frequency reaches 2**level"; level 0 is the term itself."""
    mixed = hashes + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def rows_of(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """Signature rows of entries, HASHES columns."""
    h = _at_level(hashes, level)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(width)).astype(np.int64)


@dataclass
class _Open:
    """A block in the making."""

    width: int
    doc_ids: list
    lengths: list
    entries: list

    def packed(self) -> dict[str, object]:
        bits = np.zeros((self.width, (len(self.doc_ids) + 7) // 8), np.uint8)
        for column, per_level in enumerate(self.entries):
            for level, hashes in enumerate(per_level):
                bits[rows_of(hashes, level, self.width).ravel(), column >> 3] |= np.uint8(1 << (column & 7))
        return {"width": [self.width], "doc_ids": [self.doc_ids], "lengths": [self.lengths], "bits": [bits.tobytes()]}


def index(docs: DataFrame) -> DataFrame:
    """Blocks ``width, doc_ids, lengths, bits`` of all documents that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, open_blocks, held = _Hashes(), {}, 0

        def closed(block: _Open) -> pa.RecordBatch:
            columns = block.packed()
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = Counter(terms_of(text))
                if not found:
                    continue
                own = hashes.of(list(found))
                counts = np.fromiter(found.values(), np.int64, len(found))
                levels = [own] + [own[counts >= 1 << j] for j in range(1, int(counts.max()).bit_length())]
                entries = sum(map(len, levels))
                size = math.ceil(math.log(entries, CLASS))
                block = open_blocks.get(size)
                if block is None:
                    block = open_blocks[size] = _Open(math.ceil(BITS * CLASS**size), [], [], [])
                block.doc_ids.append(MISSING if doc_id is None else doc_id)
                block.lengths.append(int(counts.sum()))
                block.entries.append(levels)
                n, held = len(block.doc_ids), held + entries
                if n == BLOCK or (n % 8 == 0 and block.width * (n // 8 + 1) > BLOCK_BYTES):
                    held -= sum(len(h) for levels in block.entries for h in levels)
                    yield closed(open_blocks.pop(size))
                if held > HELD:
                    yield from (closed(open_blocks.pop(s)) for s in list(open_blocks))
                    held = 0
        yield from (closed(block) for block in open_blocks.values())

    target = pa.schema(
        [("width", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.binary())]
    )
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "width bigint, doc_ids array<bigint>, lengths array<bigint>, bits binary")


# --- queries ---------------------------------------------------------------------------------------------------------


@dataclass
class Queries:
    """Some items: their distinct terms, and for each item the places of its terms and what they weigh, repeats included."""

    terms: list[bytes]
    places: list[np.ndarray]
    weights: list[np.ndarray]
    n_docs: int
    total: int

    def scores(self, m: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> Iterator[np.ndarray]:
        """Per item the scores of documents with length parts ``m``; (term, doc, tf) rows in order of term."""
        parts = saturation(tf, m[doc])
        first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        for places, weights in zip(self.places, self.weights):
            out = np.zeros(len(m), np.int64)
            for place, w in zip(places, weights):
                held = slice(first[place], first[place + 1])
                out[doc[held]] += w * parts[held]
            yield out


def _groups(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Items with their terms, in groups of at most TERMS distinct terms each (or one item)."""
    group, size = [], 0
    texts = items.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list(whole_text())), " ").alias("text"))
    for item in texts.toLocalIterator():
        terms = Counter(terms_of(item["text"]))
        if group and size + len(terms) > TERMS:
            yield group
            group, size = [], 0
        if terms:
            group.append((item["item_id"], terms))
            size += len(terms)
    if group:
        yield group


def _frequencies(docs: DataFrame, wanted: list[bytes]) -> dict[int, int]:
    """Documents of each wanted term, by its place; partial sums per task."""
    places = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(wanted)})

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        known = places.value

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(known.keys() & set(terms_of(text)))
            yield {"place": [known[t] for t in counts], "df": list(counts.values())}

        return work

    sums = arrow_map(docs.select(whole_text().alias("text")), "place int, df bigint", start, 4096)
    out = {r["place"]: r["df"] for r in sums.groupBy("place").agg(F.sum("df").alias("df")).toLocalIterator()}
    places.unpersist()
    return out


def _queries(docs: DataFrame, group: list[tuple[object, Counter]], n_docs: int, total: int) -> Queries:
    terms = sorted({t for _, found in group for t in found})
    at = {t: i for i, t in enumerate(terms)}
    df = _frequencies(docs, terms)
    places = [np.array([at[t] for t in found], np.int64) for _, found in group]
    weights = [
        np.array([n * weight(n_docs, df.get(at[t], 0)) for t, n in found.items()], np.int64) for _, found in group
    ]
    return Queries(terms, places, weights, n_docs, total)


def _bounds(blocks: DataFrame, shared: object, keep: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``item, doc_id, bound`` of the documents of each block that ``keep(item, doc_ids, bounds)`` chooses."""

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        queries = shared.value
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in queries.terms], np.uint64)

        def present(bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
            """(term, document) wherever all rows of the term have the document's bit."""
            step = max(1, (1 << 24) // (HASHES * bits.shape[1] * 8))
            found = []
            for i in range(0, len(hashes), step):
                meet = np.bitwise_and.reduce(bits[rows_of(hashes[i : i + step], 0, width)], axis=1)
                some = np.flatnonzero(meet.any(axis=1))
                term, doc = np.nonzero(np.unpackbits(meet[some], axis=1, bitorder="little"))
                found.append((some[term] + i, doc))
            return np.concatenate([t for t, _ in found]), np.concatenate([d for _, d in found])

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            for width, ids, lengths, packed in zip(*(batch.column(c) for c in ("width", "doc_ids", "lengths", "bits"))):
                width, ids = width.as_py(), ids.values.to_numpy(zero_copy_only=False)
                bits = np.frombuffer(packed.as_buffer(), np.uint8).reshape(width, -1)
                n = lengths.values.to_numpy()
                term, doc = present(bits, width)
                most = n[doc].copy()  # a frequency is no more than the length, and below the first power of two not found
                open_, level = np.arange(len(term)), 1
                while len(open_):
                    rows = rows_of(hashes[term[open_]], level, width)
                    column = doc[open_, None]
                    hit = ((bits[rows, column >> 3] >> (column & 7).astype(np.uint8)) & 1).all(axis=1)
                    most[open_[~hit]] = np.minimum(most[open_[~hit]], (1 << level) - 1)
                    open_, level = open_[hit & (n[doc[open_]] >= 2 << level)], level + 1
                m = length_part(n, queries.n_docs, queries.total)
                for item, bound in enumerate(queries.scores(m, term, doc, most)):
                    chosen = keep(item, ids, bound)
                    if len(chosen):
                        yield {"item": np.full(len(chosen), item), "doc_id": ids[chosen], "bound": bound[chosen]}

        return work

    return arrow_map(blocks, "item int, doc_id bigint, bound bigint", start, 1)


def _exact(docs: DataFrame, pairs: DataFrame, shared: object) -> DataFrame:
    """``item, doc_id, score`` of pairs (item, doc_id), from the texts."""
    asked = durable(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        queries = shared.value
        at = {t: i for i, t in enumerate(queries.terms)}
        weights = [dict(zip(p.tolist(), w.tolist())) for p, w in zip(queries.places, queries.weights)]

        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            rows = []
            for doc_id, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                found = Counter(terms_of(text))
                m = int(length_part(sum(found.values()), queries.n_docs, queries.total))
                held = {at[t]: (1_000_000_000 * tf) // (1000 * tf + 12 * m) for t, tf in found.items() if t in at}
                rows += [(i, doc_id, sum(part * weights[i].get(t, 0) for t, part in held.items())) for i in items]
            item, doc, score = zip(*rows) if rows else ((), (), ())
            yield {"item": item, "doc_id": doc, "score": score}

        return work

    return arrow_map(texts.join(asked, "doc_id").select("doc_id", "text", "items"), "item int, doc_id bigint, score bigint", start)


def _ranked(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(by), "doc_id")
    return scores.where(F.col(by) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents with a score above 0."""
    spark, of_item = docs.sparkSession, f"item_id {items.schema['item_id'].dataType.simpleString()}"
    result = f"{of_item}, rank int, doc_id bigint, score bigint"
    blocks = durable(index(docs))
    sums = blocks.agg(F.sum(F.size("doc_ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    out = spark.createDataFrame([], result)
    if not sums[0]:
        return out
    for group in _groups(items):
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(group)], f"item int, {of_item}")
        best = _best(docs, blocks, group, *sums, k)
        out = out.unionByName(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def _best(docs: DataFrame, blocks: DataFrame, group: list, n_docs: int, total: int, k: int) -> DataFrame:
    """``item, rank, doc_id, score`` of the items of a group, numbered as they stand there."""
    seeds = SEEDS * k
    shared = docs.sparkSession.sparkContext.broadcast(_queries(docs, group, n_docs, total))

    def highest(item: int, ids: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The documents of a block with the highest bounds, among equal ones those that rank first."""
        some = np.flatnonzero((bound > 0) & (ids != MISSING))
        return some[np.lexsort((ids[some], -bound[some]))[:seeds]]

    first = durable(_ranked(_bounds(blocks, shared, highest), seeds, "bound").select("item", "doc_id").distinct())
    last = _ranked(_exact(docs, first, shared), k).where(F.col("rank") == k)
    limits = {r["item"]: (r["score"], r["doc_id"]) for r in last.collect()}  # one row per item of the group

    def possible(item: int, ids: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The documents that may rank at or before the last of the first k exact scores."""
        score, doc_id = limits.get(item, (1, np.iinfo(np.int64).max))
        return np.flatnonzero((ids != MISSING) & ((bound > score) | ((bound == score) & (ids <= doc_id))))

    left = durable(_bounds(blocks, shared, possible).select("item", "doc_id").distinct())
    return durable(_ranked(_exact(docs, left, shared), k))
