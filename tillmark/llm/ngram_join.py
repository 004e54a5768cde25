"""N-gram Jaccard join by vertical partitioning, down to the classes of linked documents.

Every n-gram has a place in one global order: rare ones first (by the count of its bucket in a sketch of the whole
corpus), then by hash. Sets that are alike enough share an n-gram among the first ``n - ceil(T n) + 1`` of either, so those
prefixes give the candidates. A profile (n-grams per bucket of their hashes) bounds what two sets can have in common, and
pairs that cannot reach the similarity go. The order is cut into fragments of equal mass; the overlap of a candidate pair is
counted in each fragment apart and the parts are summed per pair.

Only classes are asked for, so pairs inside a group need not all be tried. Documents with equal sets are one node. Nodes
that share a prefix n-gram are a group; the task that holds a group forms its pairs. A group of at most ``SMALL`` nodes tries
its pairs, where their places in the two prefixes allow for a link: what two sets share from their first common n-gram on is
bounded by what lies behind it. A larger one drops the nodes whose place leaves them no partner and tries a pivot, the node
with the least before the common n-gram, against all others, which merges what lies close to it. Groups of several classes are
left for a next turn. The second turn takes the prefixes again by an order that counts the nodes left alone, so what sets them
apart comes first. In later turns, what two nodes of such a group still may have in common shows in how they differ from the
pivot: sets alike enough differ in at most ``q (n + m)`` elements, ``q = (1 - T) / (1 + T)``, so of two linked nodes one of
which is not linked with the pivot, the differences from the pivot overlap. They are sets with a least overlap again, so their
prefixes, elements rare among the pivot's nodes first, give the groups of the next turn. Nodes that one class holds leave.
After ``TURNS`` turns what groups are left try all pairs across classes. No link between different classes can be missed, and
neither thousands of near copies that link nor thousands that lie just too far apart are tried pair by pair.

Words are cut by ASCII white space, A-Z lower-cased; n-grams and sets are told apart by 64-bit hashes. A
document with fewer words than an n-gram has them all as one; null, empty or blank texts have no n-gram and link with
nothing. Repeated rows link like other equal texts. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.common import components, cut, texts_of, whole_text
from tillmark.session import discard, new_workspace

#: Words of an n-gram and the least similarity in percent.
WORDS, PERCENT = 5, 75
#: Buckets of the sketch that the order rests on (one byte each when broadcast), and buckets sent as one row.
BUCKETS, BLOCK = 1 << 20, 1 << 12
#: Buckets of a set's profile, one byte each.
PROFILE = 256
#: Fragments of the order, rows of a prefix partition.
FRAGMENTS, PART_ROWS = 8, 400_000
#: Nodes of a group that tries all its pairs, turns of one node against the others, and how many of them rest on sketches.
SMALL, TURNS, SKETCHED = 64, 4, 2
#: Rows of texts taken up at a time, pairs formed at a time, n-grams packed at a time.
SLICE, PAIRS, PACKED = 256, 200_000, 400_000

#: Hashes of words, known to a worker while a task runs: KEPT words at most, about 200 bytes each.
KEPT = 250_000
_WORDS: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def _forget() -> None:
    """Called when a task ends, so that a reused worker keeps no words; closures travel with their own copy of the table."""
    _WORDS.clear()


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams of a text."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([_hash(b" ".join(words))], dtype=np.uint64)
    if len(_WORDS) > KEPT:
        _WORDS.clear()
    for word in set(words).difference(_WORDS):
        _WORDS[word] = _hash(word)
    hashed = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    grams = hashed[: len(words) - size + 1].copy()
    for i in range(1, size):
        grams = _mix(grams) + hashed[i : len(words) - size + 1 + i]
    return np.unique(_mix(grams))


def _bucket(grams: np.ndarray, turn: int) -> np.ndarray:
    """The bucket of each n-gram in the sketch of a turn; n-grams that meet in one turn's sketch part in the next one's."""
    return ((grams if not turn else _mix(grams ^ np.array([turn], dtype=np.uint64))) % np.uint64(BUCKETS)).astype(np.int64)


def _node(grams: np.ndarray) -> int:
    """The number that stands for a set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profile(grams: np.ndarray) -> bytes:
    """N-grams per bucket; 255 stands for 255 and more."""
    return np.minimum(np.bincount((grams >> np.uint64(40)).astype(np.int64) % PROFILE, minlength=PROFILE), 255).astype(np.uint8).tobytes()


def _may_link(left: pa.Array, right: pa.Array, n_left: pa.Array, n_right: pa.Array) -> pa.Array:
    """Whether the profiles allow for enough common elements; a full bucket allows for any number."""
    a, b = (np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint8).reshape(-1, PROFILE) for x in (left, right))
    both = np.minimum(a, b).astype(np.int64)
    bound = both.sum(axis=1) + np.where((both == 255).any(axis=1), 1 << 60, 0)
    total = n_left.to_numpy() + n_right.to_numpy()
    return pa.array((100 + PERCENT) * bound.astype(np.float64) >= PERCENT * total)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of SLICE rows: what a task holds as Python objects does not follow the size of a batch."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            yield batch.slice(first, SLICE)


def _surveyed(docs: DataFrame) -> DataFrame:
    """Per document the size ``n``, ``node`` and ``profile`` of its set; besides, per task the sketch counts in rows with a ``block``."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("profile", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())]
    schema = pa.schema(fields)

    def rows(count: int, **columns: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns else pa.nulls(count, t) for f, t in fields], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.uint32)
        for batch in _slices(batches):
            sets = [shingles(text) for text in texts_of(batch)]
            np.add.at(counts, _bucket(np.concatenate(sets), 0), np.uint32(1))
            yield rows(len(sets), doc_id=batch.column("doc_id"), n=[len(s) for s in sets], node=[_node(s) for s in sets], profile=[_profile(s) for s in sets])
        if counts.any():
            blocks = [b.tobytes() for b in counts.reshape(-1, BLOCK)]
            yield rows(len(blocks), block=range(len(blocks)), counts=blocks)
        _forget()

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, n bigint, node bigint, profile binary, block int, counts binary")


def _surveyed_again(texts: DataFrame, turn: int) -> DataFrame:
    """Per task the sketch counts of ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.uint32)
        for batch in _slices(batches):
            np.add.at(counts, _bucket(np.concatenate([shingles(text) for text in texts_of(batch)]), turn), np.uint32(1))
        if counts.any():
            blocks = counts.reshape(-1, BLOCK)
            some = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "counts"])
        _forget()

    return texts.select("text").mapInArrow(run, "block int, counts binary")


def _parts(counts: np.ndarray) -> int:
    """Partitions that prefixes are dealt to."""
    return max(16, int(counts.sum()) // 4 // PART_ROWS)


def _sketch(blocks: DataFrame) -> np.ndarray:
    """The counts of all tasks, added up where a block's rows meet; BUCKETS numbers come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums.setdefault(block, np.zeros(BLOCK, dtype=np.uint64))[:] += np.frombuffer(counts, dtype=np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"]
        )

    total = np.zeros((BUCKETS // BLOCK, BLOCK), dtype=np.uint64)
    for row in blocks.repartition("block").mapInArrow(add, "block int, counts binary").collect():
        total[row["block"]] = np.frombuffer(row["counts"], dtype=np.uint64)
    return total.ravel()


def _ranks(counts: np.ndarray) -> np.ndarray:
    """The place of each bucket in the order, as one byte."""
    return np.minimum(255, np.log2(np.maximum(counts, 1).astype(np.float64)) * 4).astype(np.uint8)


def _prefixes(texts: DataFrame, ranks: object, parts: int, turn: int) -> DataFrame:
    """The first n-grams of every ``text, class`` in the order of a turn, packed by ``part`` of their hashes; class null: the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        names = ("grams", "nodes", "sizes", "places", "classes")

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            part = (columns[0] >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            columns, part = [c[order] if len(c) else c for c in columns], part[order]
            present, first = np.unique(part, return_index=True)
            ends = [*first[1:], len(part)]
            sliced = [pa.array([c[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *sliced], names=["part", *names])

        for batch in _slices(batches):
            for text, known in zip(texts_of(batch), batch.column("class").to_pylist()):
                grams = shingles(text)
                n, node = len(grams), _node(grams)
                if not n:
                    continue
                rank = ranks.value[_bucket(grams, turn)]
                chosen = grams[np.argsort(rank, kind="stable")[: n - (-(-PERCENT * n // 100)) + 1]]
                held.append(
                    (
                        chosen,
                        np.full(len(chosen), node, dtype=np.int64),
                        np.full(len(chosen), n, dtype=np.uint32),
                        np.arange(len(chosen), dtype=np.uint32),
                        np.full(len(chosen) if turn else 0, node if known is None else known, dtype=np.int64),
                    )
                )
                size += len(chosen)
                if size > PACKED:
                    yield packed()
                    held.clear()
                    size = 0
        if held:
            yield packed()
        _forget()

    return texts.select("text", "class").mapInArrow(run, "part int, grams binary, nodes binary, sizes binary, places binary, classes binary")


#: A pair of nodes with their sizes; ``pivot`` says which of them the other one met as a pivot (1 the first, 2 the second, 3 both,
#: 0 none), 4 more that they are of one class already.
TRIED = "a bigint, b bigint, n_a bigint, n_b bigint, pivot int"


class _Rows(NamedTuple):
    """Rows of groups: the node, the size of its set, the place of the group's n-gram in its prefix, its class."""

    nodes: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    classes: np.ndarray


def _tried(rows: _Rows, x: np.ndarray, y: np.ndarray, circle: bool = False) -> pa.RecordBatch:
    """Pairs of rows as distinct pairs with the smaller node first; in a circle the rows ``x`` are pivots."""
    nodes, sizes, classes = rows.nodes, rows.sizes, rows.classes
    swap = nodes[x] > nodes[y]
    a, b = np.where(swap, y, x), np.where(swap, x, y)
    kind = np.where(swap, 2, 1) + 4 * (classes[x] == classes[y]) if circle else np.zeros(len(a), dtype=np.int64)
    order = np.lexsort((kind, nodes[b], nodes[a]))
    a, b, kind = a[order], b[order], kind[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (nodes[a[1:]] != nodes[a[:-1]]) | (nodes[b[1:]] != nodes[b[:-1]]) | (kind[1:] != kind[:-1])
    a, b, kind = a[fresh], b[fresh], kind[fresh]
    columns = [*(pa.array(c.astype(np.int64)) for c in (nodes[a], nodes[b], sizes[a], sizes[b])), pa.array(kind.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n_a", "n_b", "pivot"])


def _linkable(rows: _Rows, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the rows ``x`` and ``y`` are of two classes and can share enough, if they share nothing before their places."""
    n_x, n_y = rows.sizes[x], rows.sizes[y]
    may = (100 + PERCENT) * np.minimum(n_x - rows.places[x], n_y - rows.places[y]) >= PERCENT * (n_x + n_y)
    return may & (rows.classes[x] != rows.classes[y]) & (100 * np.minimum(n_x, n_y) >= PERCENT * np.maximum(n_x, n_y))


def _partnered(rows: _Rows, group: np.ndarray) -> np.ndarray:
    """The rows of a group less those that no row of it can link with by size and place."""
    while True:
        n = rows.sizes[group]
        most = (100 + PERCENT) * (n - rows.places[group]) // PERCENT - n  # the largest set it can link with
        order = np.argsort(n)
        reach = np.maximum.accumulate(most[order])
        last = np.searchsorted(n[order], most, side="right") - 1
        left = group[(last >= 0) & (reach[np.maximum(last, 0)] >= n)]
        if len(left) in (0, len(group)):
            return left
        group = left


def _met(grams: np.ndarray, rows: _Rows, turn: int) -> Iterator[pa.RecordBatch]:
    """Pairs that the groups (rows sorted by ``grams``, a node once in each) have to try.

    Groups of one class have none. Small ones try all pairs across classes. Larger ones drop the rows that cannot link and try
    a pivot with each other node: the one with the least before the common n-gram, so the one nearest to what all share.
    Groups of nearly the same nodes mostly have the same pivot, so they give a pair once, not once each.
    """
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    counts = np.diff([*first, len(grams)])
    across = np.minimum.reduceat(rows.classes, first) < np.maximum.reduceat(rows.classes, first)
    for size in np.unique(counts[across & (counts <= SMALL)]):
        left, right = np.triu_indices(size, 1)
        begins = first[across & (counts == size)]
        step = max(1, PAIRS // len(left))
        for i in range(0, len(begins), step):
            begin = begins[i : i + step, None]
            x, y = (begin + left).ravel(), (begin + right).ravel()
            may = _linkable(rows, x, y)
            yield _tried(rows, x[may], y[may])
    drawn = _mix(rows.nodes.view(np.uint64) ^ np.array([turn], dtype=np.uint64))
    pairs: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}
    waiting = 0
    for i, n in zip(first[across & (counts > SMALL)], counts[across & (counts > SMALL)]):
        group = _partnered(rows, np.arange(i, i + n))
        if not len(group) or (rows.classes[group] == rows.classes[group[0]]).all():
            continue
        if len(group) <= SMALL:
            left, right = np.triu_indices(len(group), 1)
            may = _linkable(rows, group[left], group[right])
            pairs[False].append((group[left][may], group[right][may]))
        else:
            pivot = group[np.lexsort((drawn[group], rows.places[group]))[0]]
            others = group[group != pivot]
            pairs[True].append((np.full(len(others), pivot), others))
        waiting += len(group)
        if waiting > PAIRS:
            yield from (_tried(rows, *map(np.concatenate, zip(*found)), circle) for circle, found in pairs.items() if found)
            pairs, waiting = {False: [], True: []}, 0
    yield from (_tried(rows, *map(np.concatenate, zip(*found)), circle) for circle, found in pairs.items() if found)


def _shared(prefixes: DataFrame, parts: int, turn: int) -> DataFrame:
    """Pairs ``TRIED`` of a turn: nodes that have an n-gram in both their prefixes.

    Of n-grams with equal nodes the first in the global order counts: what its nodes share, they share from there on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"grams": np.uint64, "nodes": np.int64, "sizes": np.uint32, "places": np.uint32, "classes": np.int64}
        held: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
        for batch in batches:
            for c, kind in kinds.items():
                held[c] += [np.frombuffer(b, dtype=kind) for b in batch.column(c).to_pylist()]
        if not held["grams"]:
            return
        grams, nodes, sizes, places, classes = (np.concatenate(held[c]) for c in kinds)
        held.clear()
        classes = classes if turn else nodes
        order = np.lexsort((nodes, grams))
        grams, nodes, sizes, places, classes = grams[order], nodes[order], sizes[order], places[order], classes[order]
        fresh = np.ones(len(grams), dtype=bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])
        grams, nodes, sizes, places, classes = grams[fresh], nodes[fresh], sizes[fresh], places[fresh], classes[fresh]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        counts = np.diff([*first, len(grams)])
        marks = np.add.reduceat(_mix(nodes.view(np.uint64)), first)
        keep = np.zeros(len(first), dtype=bool)
        several = np.flatnonzero(counts > 1)
        several = several[np.argsort(places[first[several]], kind="stable")]  # equal nodes begin with the same node
        keep[several[np.unique(np.stack([marks[several], counts[several].astype(np.uint64)]), axis=1, return_index=True)[1]]] = True
        rows = np.repeat(keep, counts)
        grams, nodes, sizes, places = grams[rows], nodes[rows], sizes[rows].astype(np.int64), places[rows].astype(np.int64)
        if len(grams):
            yield from _met(grams, _Rows(nodes, sizes, places, classes[rows]), turn)

    return prefixes.repartition(parts, "part").mapInArrow(run, TRIED)


def _shared_again(groups: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """Pairs ``TRIED`` of a later turn, from groups ``gram, node, n`` whose nodes lie in several classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(batch.column(c).to_numpy() for c in ("gram", "node", "n", "class")) for batch in batches if batch.num_rows]
        if not held:
            return
        grams, nodes, sizes, known = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.argsort(grams, kind="stable")
        grams, nodes, sizes, known = grams[order], nodes[order], sizes[order], known[order]
        yield from _met(grams, _Rows(nodes, sizes, np.zeros(len(grams), dtype=np.int64), known), turn)

    return _of_classes(groups, classes).repartition("gram").mapInArrow(run, TRIED)


def _refined(texts: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """Pairs ``TRIED`` of ``node, text``, by the order of a sketch that counts these texts alone."""
    counts = _sketch(_surveyed_again(texts, turn))
    parts = _parts(counts)
    known = texts.join(classes, texts["node"] == classes["id"], "left").select("text", F.col("component_id").alias("class"))
    ranks = texts.sparkSession.sparkContext.broadcast(_ranks(counts))
    return _shared(_prefixes(known, ranks, parts, turn), parts, turn)


def _distinct(tried: DataFrame) -> DataFrame:
    return tried.groupBy("a", "b", "n_a", "n_b").agg(F.bit_or("pivot").alias("pivot"))


def _cuts(counts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places that cut the order (rank, then hash) into fragments of equal mass."""
    mass = np.bincount(rank, weights=counts.astype(np.float64), minlength=256)
    below = np.concatenate([[0.0], np.cumsum(mass)])
    out = []
    for goal in np.linspace(0, below[-1], FRAGMENTS + 1)[1:-1]:
        r = int(np.searchsorted(below, goal, side="right")) - 1
        out.append(r + min(1.0, (goal - below[r]) / max(mass[min(r, 255)], 1.0)))
    return np.array(out)


def _segments(docs: DataFrame, ranks: object, cuts: np.ndarray) -> DataFrame:
    """The sets of the given documents (``node, text``) as one row per fragment of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[tuple[int, int, bytes]] = []
            for node, text in zip(batch.column("node").to_pylist(), texts_of(batch)):
                grams = shingles(text)
                if _node(grams) != node:
                    continue  # another row of the same doc_id
                place = ranks.value[_bucket(grams, 0)] + grams / 2.0**64
                fragment = np.searchsorted(cuts, place, side="right")
                out += [(node, int(f), grams[fragment == f].tobytes()) for f in np.unique(fragment)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))],
                names=["node", "fragment", "grams"],
            )
        _forget()

    return docs.mapInArrow(run, "node bigint, fragment int, grams binary")


def _common(left: pa.Array, right: pa.Array) -> pa.Array:
    """Elements that two packed sorted sets share."""
    pairs = zip(left.to_pylist(), right.to_pylist())
    read = lambda b: np.frombuffer(b, dtype=np.uint64)
    return pa.array([len(np.intersect1d(read(a), read(b), assume_unique=True)) for a, b in pairs], pa.int64())


def _possible(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs whose profiles do not rule a link out."""
    left = profiles.select(F.col("node").alias("a"), F.col("profile").alias("profile_a"))
    right = profiles.select(F.col("node").alias("b"), F.col("profile").alias("profile_b"))
    may = F.arrow_udf(_may_link, "boolean")("profile_a", "profile_b", "n_a", "n_b")
    return pairs.join(left, "a").join(right, "b").where(may).select("a", "b", "n_a", "n_b")


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the first document of each wanted node."""
    first = cut(sets.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("first")))
    texts = docs.select(docs["doc_id"].cast("long").alias("of"), whole_text().alias("text"))
    return texts.join(first, texts["of"] == first["first"]).select("node", "text")


def _linked(pairs: DataFrame, texts: DataFrame, ranks: object, places: np.ndarray) -> DataFrame:
    """Of pairs ``a, b, n_a, n_b`` those alike enough: partial overlaps by fragment, summed per pair."""
    segments = cut(_segments(texts, ranks, places))
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    parts = pairs.join(left, "a").join(right, ["b", "fragment"])
    parts = parts.select("a", "b", "n_a", "n_b", "fragment", F.arrow_udf(_common, "bigint")("grams_a", "grams_b").alias("common"))
    once = parts.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("common").alias("common"))  # rows may repeat
    whole = once.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return whole.where(100 * F.col("common") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _close_in_size(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _of_classes(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows ``gram, node, n`` of groups with the ``class`` of each node."""
    rows = groups.join(classes, groups["node"] == classes["id"], "left")
    return rows.select("gram", "node", "n", F.coalesce("component_id", "node").alias("class"))


def _all_within(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs ``TRIED`` across classes of groups ``gram, node, n``, whatever their size."""
    rows = _of_classes(groups, classes)
    split = rows.groupBy("gram").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    rows = rows.join(split.select("gram"), "gram")
    other = rows.select("gram", *(F.col(c).alias(f"{c}_y") for c in ("node", "n", "class")))
    may = (F.col("node") < F.col("node_y")) & (F.col("class") != F.col("class_y")) & _close_in_size(F.col("n"), F.col("n_y"))
    pairs = rows.join(other, "gram").where(may)
    return pairs.select(F.col("node").alias("a"), F.col("node_y").alias("b"), F.col("n").alias("n_a"), F.col("n_y").alias("n_b"), F.lit(0).alias("pivot"))


def _circles(pairs: DataFrame) -> DataFrame:
    """``c, node, n_c, n``: the pivots with every node that met them."""
    one = pairs.where("pivot & 1 = 1").select(F.col("a").alias("c"), F.col("b").alias("node"), F.col("n_a").alias("n_c"), F.col("n_b").alias("n"))
    two = pairs.where("pivot & 2 = 2").select(F.col("b").alias("c"), F.col("a").alias("node"), F.col("n_b").alias("n_c"), F.col("n_a").alias("n"))
    return one.unionByName(two)


def _open_circles(circles: DataFrame, classes: DataFrame) -> DataFrame:
    """The circles with two nodes or more besides the pivot that do not lie in one class all."""
    held = circles.join(classes, circles["node"] == classes["id"], "left").select(
        "c", "node", "n_c", "n", F.coalesce("component_id", "node").alias("class")
    )
    several = held.groupBy("c").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    return held.join(several.select("c"), "c").select("c", "node", "n_c", "n")


def _whole_sets(texts: DataFrame) -> DataFrame:
    """``node, grams`` (all n-grams, sorted) of texts ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for node, text in zip(batch.column("node").to_pylist(), texts_of(batch)):
                grams = shingles(text)
                if _node(grams) == node:  # else another row of the same doc_id
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([node], pa.int64()), pa.array([grams.view(np.int64)], pa.list_(pa.int64()))], names=["node", "grams"]
                    )
        _forget()

    return texts.mapInArrow(run, "node bigint, grams array<bigint>").dropDuplicates(["node"])


def _differences(circles: DataFrame, sets: DataFrame, scratch: str) -> DataFrame:
    """The groups ``gram, node, n`` of the next turn: nodes of a circle that differ from its pivot alike.

    With ``d`` elements in which a node differs from its pivot ``c``, two nodes that link share at least
    ``(d + d' - q (n + n')) / 2`` of them. As ``d' - q n' >= -q n_c`` always, and ``> q n_c`` for the partner of a node that links
    with ``c`` (two such nodes are of one class), the least overlap of a node is known from its own numbers.
    """
    of_node = sets.select("node", F.col("grams").alias("own"))
    of_pivot = sets.select(F.col("node").alias("c"), F.col("grams").alias("pivot"))
    both = circles.join(of_node, "node").join(of_pivot, "c")
    apart = F.concat(F.array_except("own", "pivot"), F.array_except("pivot", "own"))
    differ = both.select("c", "node", "n_c", "n", apart.alias("apart")).withColumn("d", F.size("apart").cast("long"))
    scaled, twice = (100 + PERCENT) * F.col("d"), 2 * (100 + PERCENT)
    beyond = scaled - (100 - PERCENT) * (F.col("n") + F.col("n_c"))
    within = scaled - (100 - PERCENT) * (F.col("n") - F.col("n_c"))
    least = F.when(beyond > 0, F.ceil(beyond / twice)).otherwise(F.floor(within / twice) + 1)
    reach = (F.col("d") - least + 1).alias("reach")
    differ = cut(differ.select("c", "node", "n", "d", reach, "apart").where("reach > 0"), scratch)
    rows = differ.select("c", "node", F.explode("apart").alias("element"))
    often = rows.groupBy("c", "element").agg(F.count("*").alias("often")).where("often > 1")
    shared = rows.join(often, ["c", "element"])
    by_node = Window.partitionBy("c", "node")
    at = F.row_number().over(by_node.orderBy("often", "element")) - F.count("*").over(by_node)  # elements of one node alone come before
    ranked = shared.withColumn("at", at).join(differ.select("c", "node", "n", "d", "reach"), ["c", "node"])
    prefixes = ranked.where("at + d <= reach").select(F.xxhash64("c", "element").alias("gram"), "node", "n")
    groups = prefixes.distinct()
    marks = groups.groupBy("gram").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark")).where("size > 1")
    first = marks.groupBy("size", "mark").agg(F.min("gram").alias("gram"))  # of groups with equal nodes one
    return groups.join(first.select("gram"), "gram").select("gram", "node", "n")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (the smallest doc_id that links reach, itself included) per row of ``docs``."""
    spark = docs.sparkSession
    surveyed = cut(_surveyed(docs))
    counts = _sketch(surveyed.where("block is not null").select("block", "counts"))
    rank = _ranks(counts)
    ranks = spark.sparkContext.broadcast(rank)
    parts = _parts(counts)

    sets = surveyed.where("block is null").select("doc_id", "n", "node")
    profiles = surveyed.where("block is null").groupBy("node").agg(F.min_by("profile", "doc_id").alias("profile"))
    scratch = new_workspace(spark, "ngram-join")
    places = _cuts(counts, rank)

    met = _shared(_prefixes(docs.select(whole_text().alias("text"), F.lit(None).cast("long").alias("class")), ranks, parts, 0), parts, 0)
    tried = spark.createDataFrame([], "a long, b long")
    found = spark.createDataFrame([], "id long, component_id long")
    for turn in range(TURNS + 1):
        pairs = cut(_distinct(met), scratch)
        circles = _circles(pairs)
        near = pairs.where("pivot < 4").where(_close_in_size(F.col("n_a"), F.col("n_b"))).drop("pivot").join(tried, ["a", "b"], "left_anti")
        close = cut(_possible(near, profiles), scratch)
        tried = tried.unionByName(pairs.select("a", "b"))
        if not close.isEmpty():
            wanted = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            links = cut(_linked(close, _texts(docs, sets, cut(wanted, scratch)), ranks, places), scratch)
            if not links.isEmpty():
                known = found.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
                found = cut(components(links.unionByName(known)))
        left = cut(_open_circles(circles, found), scratch)
        if left.isEmpty():
            break
        wanted = left.select(F.explode(F.array("c", "node")).alias("node")).distinct()
        texts = cut(_texts(docs, sets, cut(wanted, scratch)), scratch)
        if turn + 1 < SKETCHED:
            met = _refined(texts, found, turn + 1)
            continue
        groups = cut(_differences(left, cut(_whole_sets(texts), scratch), scratch), scratch)
        met = _shared_again(groups, found, turn + 1) if turn + 1 < TURNS else _all_within(groups, found)
    discard(spark, scratch)

    members = sets.join(found, sets["node"] == found["id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "node").alias("class")
    )
    low = members.groupBy("class").agg(F.min("doc_id").alias("low"))
    alone = F.col("n_shingles") == 0
    return members.join(low, "class").select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its class; equal rows of one doc_id all stay."""
    first = classes(docs).where("doc_id = component_id").select(F.col("doc_id").alias("of")).distinct()
    return docs.join(first, docs["doc_id"].cast("long") == first["of"], "left_semi")
