"""Exact substring dedup by a sparse suffix array, sorted deep and shallow.

Every byte that a LENGTH-byte string covers which also starts anywhere else goes. Comparing all positions of a corpus is
not needed: in every LENGTH-byte string the GRAM-byte substring with the smallest hash (the first of equals) is its anchor,
and equal strings have equal anchors at equal places. So only anchors are sampled, about one position in a hundred, and
only anchors whose hash occurs again are looked at further.

For these the bytes before and behind are cut out and grouped by hash. A group's suffixes are sorted by what follows the
anchor and, reversed, by what precedes it: first a multikey quicksort on words of eight bytes down to SHALLOW bytes, then,
for groups that still agree, a blind trie: it remembers only the places where suffixes part, walks down it without looking
at the bytes between, and compares once with the suffix it ends at. Sorting gives the length of the common prefix of
neighbours, so for each distance ``d`` of a string's start before its anchor, the strings that are equal are those with
the same class of ``LENGTH - d`` bytes behind and of ``d`` bytes before. Those classes come from the orders alone.

Documents with equal texts are told by SHA-256 first and only one of them takes part; the copies' bytes all go if there are
LENGTH of them. Anchors with equal surroundings are one member that counts as repeated. Groups of more than HEAVY members
are not sorted in one task: their strings are counted by 128-bit hashes with partial sums over all tasks instead.

Null texts count as empty. Rows that share a doc_id are separate documents when their texts differ and copies when not.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map, cut, whole_text

#: Bytes of a string, and of the substrings that anchors are chosen from.
LENGTH, GRAM = 400, 100
#: Bytes that quicksort orders before blind tries take over.
SHALLOW = 64
#: Members of a group that are sorted in one task.
HEAVY = 100_000
#: Strings between whose starts the smallest hash is sought.
SPREAD = LENGTH - GRAM + 1
#: Windows whose anchors are sought at once, and members that a task sorts on average.
BLOCK, TASK_MEMBERS = 1 << 20, 20_000
BASE = 0x9E3779B97F4A7C15

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [
            np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, b, dtype=np.uint64))])
            for b in (BASE, pow(BASE, -1, 1 << 64))
        ]
    return _POWERS[0][:n], _POWERS[1][:n]


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: running minima from both ends of blocks."""
    count = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(raw: np.ndarray) -> np.ndarray:
    """Rows ``hash, place, first, last``: the anchor of all strings that start from first to last."""
    total = len(raw) - LENGTH + 1
    found = []
    for begin in range(0, max(total, 0), BLOCK):
        part = raw[begin : min(begin + BLOCK, total) + LENGTH - 1].astype(np.uint64)
        powers, inverse = _powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[1:])])
        h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(part) - GRAM + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low = _lowest((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), SPREAD)
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        found.append(np.stack([h[place[first]].view(np.int64), place[first] + begin, first + begin, last + begin]))
    if not found:
        return np.empty((4, 0), dtype=np.int64)
    rows = np.concatenate(found, axis=1)
    same = np.flatnonzero(rows[1, 1:] == rows[1, :-1])  # an anchor of two blocks
    rows[2, same + 1] = rows[2, same]
    return np.delete(rows, same, axis=1)


def own_repeats(raw: np.ndarray, rows: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Stretches that repeat themselves with the distance of neighbouring equal anchors, and the anchors still needed.

    In a stretch where every byte equals the one ``step`` on, each string but the first ``step`` equals an earlier one; the
    anchors of those later strings alone stand for nothing new.
    """
    spans, needed = [], np.ones(rows.shape[1], dtype=bool)
    differs: dict[int, np.ndarray] = {}
    i = 0
    equal = np.flatnonzero(rows[0, 1:] == rows[0, :-1])
    for i in equal.tolist():
        at, step = int(rows[1, i]), int(rows[1, i + 1] - rows[1, i])
        if spans and spans[-1][2] == step and at < spans[-1][1]:
            continue
        if step not in differs:
            differs[step] = np.flatnonzero(raw[:-step] != raw[step:])
        k = int(np.searchsorted(differs[step], at))
        start = int(differs[step][k - 1]) + 1 if k else 0
        end = int(differs[step][k]) if k < len(differs[step]) else len(raw) - step
        if end - start >= LENGTH and start <= at:
            spans.append((start, end + step, step))
            needed &= ~((rows[2] >= start + step) & (rows[3] <= end + step - LENGTH))
    return [s[:2] for s in spans], needed


def common_prefix(a: bytes, b: bytes) -> int:
    """Of two strings of one length."""
    parting = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (parting.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings of one length by where they part: a node is ``[depth, branches by byte]``, a leaf a list of numbers."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    def add(self, number: int) -> None:
        text = self.strings[number]
        if self.root is None:
            self.root = [len(text), [number]]
            return
        node = self.root
        while node[0] < len(text):  # without a look at the bytes between
            branches = node[1]
            node = branches.get(text[node[0]]) or next(iter(branches.values()))
        other = self.strings[node[1][0]]
        depth = common_prefix(text, other)
        parent, node = None, self.root
        while node[0] < depth:
            parent, node = node, node[1][text[node[0]]]
        if node[0] == depth:
            if depth == len(text):
                node[1].append(number)
            else:
                node[1][text[depth]] = [len(text), [number]]
            return
        new = [depth, {other[depth]: node, text[depth]: [len(text), [number]]}]
        if parent is None:
            self.root = new
        else:
            parent[1][text[parent[0]]] = new

    def walk(self) -> tuple[list[int], list[int]]:
        """The numbers in order, and for each the bytes it shares with the one before (0 for the first)."""
        order, shared = [], []
        stack = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if isinstance(node[1], list):
                order += node[1]
                shared += [before] + [node[0]] * (len(node[1]) - 1)
            else:
                keys = sorted(node[1], reverse=True)
                stack += [(node[1][k], node[0] if k != keys[-1] else before) for k in keys]
        return order, shared


def deep_shallow(group: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings (padded to ``width``) within their groups, and the bytes each shares with the one before.

    A string that begins a group has -1.
    """
    wide = -(-width // 8) * 8
    padded = [s.ljust(wide, b"\0") for s in strings]
    shallow = np.frombuffer(b"".join(p[:SHALLOW].ljust(SHALLOW, b"\0") for p in padded), dtype=">u8").reshape(len(strings), -1).astype(np.uint64)
    order = np.argsort(group, kind="stable")
    segment = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]])) if len(order) else order
    shared = np.where(np.concatenate([[True], segment[1:] != segment[:-1]]), -1, SHALLOW) if len(order) else order
    for k in range(shallow.shape[1]):  # quicksort by one word of a key after the other, within what agreed so far
        word = shallow[order, k]
        again = np.lexsort((word, segment))
        order, word, segment = order[again], word[again], segment[again]
        parts = np.concatenate([[False], (word[1:] != word[:-1]) & (shared[1:] == SHALLOW)])
        apart = word[1:] ^ word[:-1]
        zeros = np.array([(64 - int(x).bit_length()) // 8 for x in apart[parts[1:]]], dtype=np.int64)
        shared[parts] = 8 * k + zeros
        segment = np.cumsum(shared < SHALLOW) - 1
    begins = np.flatnonzero(shared < SHALLOW)
    ends = np.append(begins[1:], len(order))
    for begin, end in zip(begins.tolist(), ends.tolist()):
        if end - begin > 1 and wide > SHALLOW:
            members = order[begin:end].tolist()
            trie = BlindTrie([padded[m] for m in members])
            for i in range(len(members)):
                trie.add(i)
            inside, common = trie.walk()
            order[begin:end] = [members[i] for i in inside]
            shared[begin + 1 : end] = common[1:]
    return order, shared


def repeated_strings(grams: list, before: list[bytes], behind: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For members of anchor groups the least and greatest ``d`` whose string occurs with another member; -1 if none.

    ``before`` is reversed. The string at ``d`` has ``d`` bytes before the anchor and ``LENGTH - d`` behind; a member has
    those from ``LENGTH - len(behind)`` to ``len(before)``.
    """
    distinct: dict[tuple, int] = {}
    of = np.array([distinct.setdefault(m, len(distinct)) for m in zip(grams, before, behind)], dtype=np.int64)
    times = np.bincount(of, minlength=len(distinct))
    keys = list(distinct)
    numbers: dict[tuple, int] = {}
    group = np.array([numbers.setdefault((g, b[:GRAM]), len(numbers)) for g, _, b in keys], dtype=np.int64)
    low = np.array([LENGTH - len(b) for _, _, b in keys], dtype=np.int64)
    high = np.array([len(a) for _, a, _ in keys], dtype=np.int64)

    right, shared_right = deep_shallow(group, [b[GRAM:] for _, _, b in keys], LENGTH - GRAM)
    left, shared_left = deep_shallow(group, [a for _, a, _ in keys], SPREAD - 1)
    shared_right = np.where(shared_right < 0, -1, shared_right + GRAM)
    least = np.where(times > 1, low, -1)
    most = np.where(times > 1, high, -1)
    class_right, class_left = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    for d in range(SPREAD):
        has = np.flatnonzero((low <= d) & (d <= high))
        if not len(has):
            continue
        class_right[right] = np.cumsum(shared_right < LENGTH - d)
        class_left[left] = np.cumsum(shared_left < d) if d else 0
        both = class_right[has] * (len(keys) + 1) + class_left[has]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        again = has[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        least[again] = np.where(least[again] < 0, d, np.minimum(least[again], d))
        most[again] = np.maximum(most[again], d)
    return least[of], most[of]


SKETCH = (
    "doc_id bigint, n_bytes bigint, digest string, text_id bigint, "
    "anchors array<struct<hash:bigint,place:bigint,first:bigint,last:bigint>>, spans array<struct<start:bigint,end:bigint>>"
)


def _structs(names: tuple[str, ...], rows: list[np.ndarray]) -> pa.Array:
    """A list of structs per row, from an array of columns per row."""
    flat = np.concatenate(rows, axis=1) if rows else np.empty((len(names), 0), dtype=np.int64)
    offsets = np.cumsum([0, *(r.shape[1] for r in rows)])
    inner = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat], names=list(names))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _sketch(docs: DataFrame) -> DataFrame:
    """Per row the digest of its text, its anchors, and the stretches that repeat themselves."""

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            digests = [hashlib.sha256(t) for t in texts]
            rows, spans = [], []
            for text in texts:
                raw = np.frombuffer(text, dtype=np.uint8)
                found = anchors(raw)
                own, needed = own_repeats(raw, found) if found.shape[1] > 1 else ([], slice(None))
                rows.append(found[:, needed])
                spans.append(np.array(own, dtype=np.int64).reshape(-1, 2).T)
            yield {
                "doc_id": batch.column("doc_id"),
                "n_bytes": [len(t) for t in texts],
                "digest": [d.hexdigest() for d in digests],
                "text_id": [_number(d.digest()) for d in digests],
                "anchors": _structs(("hash", "place", "first", "last"), rows),
                "spans": _structs(("start", "end"), spans),
            }

        return work

    return arrow_map(_raw(docs), SKETCH, start)


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))


def _members(rows: DataFrame) -> DataFrame:
    """What stands around the wanted anchors of ``doc_id, text_id, text, wanted``."""

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            out = []
            for key, number, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "text", "wanted"))):
                if _number(hashlib.sha256(text).digest()) != number:
                    continue  # another text under the same doc_id
                for a in wanted:
                    place, first, last = a["place"], a["first"], a["last"]
                    out.append((a["hash"], key, number, place, text[first:place][::-1], text[place : last + LENGTH]))
            yield {n: [r[i] for r in out] for i, n in enumerate(("hash", "doc_id", "text_id", "place", "before", "behind"))}

        return work

    return arrow_map(rows, "hash bigint, doc_id bigint, text_id bigint, place bigint, before binary, behind binary", start, 64)


FOUND = "doc_id bigint, text_id bigint, start bigint, end bigint"


def _sorted(members: DataFrame, parts: int) -> DataFrame:
    """The repeated stretch around every member whose group is sorted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {c: [] for c in ("hash", "doc_id", "text_id", "place", "before", "behind")}
        for batch in batches:
            for name, values in columns.items():
                values += batch.column(name).to_pylist()
        if not columns["hash"]:
            return
        least, most = repeated_strings(columns["hash"], columns["before"], columns["behind"])
        hit = np.flatnonzero(least >= 0)
        place = np.array(columns["place"], dtype=np.int64)[hit]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(columns["doc_id"], dtype=np.int64)[hit]),
                pa.array(np.array(columns["text_id"], dtype=np.int64)[hit]),
                pa.array(place - most[hit]),
                pa.array(place - least[hit] + LENGTH),
            ],
            names=["doc_id", "text_id", "start", "end"],
        )

    return members.repartition(parts, "hash").mapInArrow(run, FOUND)


def _counted(members: DataFrame) -> DataFrame:
    """The same for groups too large for a task: every string by a 128-bit hash, counted with partial sums."""

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            out = []
            for key, number, place, before, behind in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "place", "before", "behind"))
            ):
                around = before[::-1] + behind
                for at in range(len(around) - LENGTH + 1):
                    digest = hashlib.blake2b(around[at : at + LENGTH], digest_size=16).digest()
                    out.append((digest, key, number, place - len(before) + at))
            yield {n: [r[i] for r in out] for i, n in enumerate(("string", "doc_id", "text_id", "start"))}

        return work

    strings = arrow_map(members, "string binary, doc_id bigint, text_id bigint, start bigint", start, 64)
    again = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1")
    hits = strings.join(again.select("string"), "string")
    return hits.select("doc_id", "text_id", "start", (F.col("start") + LENGTH).alias("end"))


def _kept(text: bytes, spans: list[dict]) -> tuple[int, int, str]:
    """Bytes and runs that go, and the digest of what stays."""
    gone, runs, at, kept = 0, 0, 0, hashlib.sha256()
    last = -1
    for span in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if span["end"] <= at:
            continue
        begin = max(span["start"], at)
        kept.update(text[at:begin])
        gone += span["end"] - begin
        runs += span["start"] > last
        at = last = span["end"]
    kept.update(text[at:])
    return gone, runs, kept.hexdigest()


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and the repeated stretches of the first document of every text."""
    sketch = cut(_sketch(docs))
    texts = sketch.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    first = sketch.join(texts, "digest").where(F.col("doc_id") == F.col("first_id"))
    places = cut(first.select("doc_id", "text_id", F.explode("anchors").alias("a")).select("doc_id", "text_id", "a.*").distinct())
    again = places.groupBy("hash").agg(F.count("*").alias("members")).where("members > 1")
    wanted = cut(places.join(again, "hash"))
    n_members = wanted.count()
    heavy = wanted.where(F.col("members") > HEAVY).select("hash").distinct()

    lists = wanted.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("hash", "place", "first", "last")).alias("wanted"))
    raw = _raw(docs)
    members = raw.join(lists, "doc_id").select("doc_id", "text_id", "text", "wanted")
    members = cut(_members(members))
    found = _sorted(members.join(heavy, "hash", "left_anti"), max(16, n_members // TASK_MEMBERS))
    if not heavy.isEmpty():
        found = found.unionByName(_counted(members.join(heavy, "hash", "left_semi")))
    own = first.select("doc_id", "text_id", F.explode("spans").alias("s")).select("doc_id", "text_id", "s.*")
    return sketch, cut(found.unionByName(own))


def report(docs: DataFrame) -> DataFrame:
    """Per document its bytes, how many go and in how many runs, and SHA-256 of the rest."""
    sketch, found = repeats(docs)
    lists = found.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            out = []
            for key, number, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "text", "spans"))):
                if _number(hashlib.sha256(text).digest()) == number:
                    out.append((key, number, *_kept(text, spans)))
            yield {n: [r[i] for r in out] for i, n in enumerate(("of", "of_text", "gone", "runs", "rest"))}

        return work

    rows = _raw(docs).join(lists, "doc_id").select("doc_id", "text_id", "text", "spans")
    partly = arrow_map(rows, "of bigint, of_text bigint, gone bigint, runs bigint, rest string", start, 64).distinct()
    copies = sketch.groupBy("digest").agg(F.count("*").alias("copies"))
    rows = sketch.select("doc_id", "n_bytes", "digest", "text_id").join(copies, "digest")
    rows = rows.join(partly, (rows["doc_id"] == partly["of"]) & (rows["text_id"] == partly["of_text"]), "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "digest")).alias("kept_sha256"),
    )
