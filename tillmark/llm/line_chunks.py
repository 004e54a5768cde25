"""Line dedup by content-defined chunks.

A text is a list of lines. Every line with words begins a chunk, which ends behind the next line with words; a window rolls
over the lines, and chunks overlap. Where a chunk lies thus depends on nothing but its own lines: any passage of two or more
lines with words that occurs again is made of the same chunks, whatever stands before or behind it. A chunk that occurs
again anywhere is removed there, after its bytes are compared with those of its first occurrence (smallest doc_id, then
place). The lines of a first occurrence stay, also where a repeated chunk reaches into them, so every chunk that goes still
stands whole where it came first: of a line written three times in a row two copies are left.

Only chunk digests are grouped over all documents, with partial minima, so a passage in a third of all documents makes no
heavy group; texts of repeated chunks alone are shuffled for the comparison. A very long text is one row; its chunks are
dealt by digest like those of others.

Lines without words count as part of a chunk only between its two lines with words, and then have to be equal too. Null and
empty texts have no chunks and stay as they are. Rows that share a doc_id are told apart by digest: a chunk goes where place
and digest are both on the list. Repeated rows of one doc_id are one occurrence. Other columns are kept, whatever their
names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import arrow_map, cut, texts_of, whole_text
from tillmark.session import durable

#: Lines with words in a chunk.
WINDOW = 2

Chunk = tuple[int, int, bytes]


def chunks(text: str) -> list[Chunk]:
    """First line, end line and digest of every chunk: WINDOW lines with words in a row, and what lies between them."""
    lines = text.encode().split(b"\n")
    worded = [i for i, line in enumerate(lines) if line.strip()]
    spans = [(first, last + 1) for first, last in zip(worded, worded[WINDOW - 1 :])]
    return [(first, end, hashlib.blake2b(b"\n".join(lines[first:end]), digest_size=16).digest()) for first, end in spans]


def _listed(docs: DataFrame) -> DataFrame:
    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            rows = [
                (key, digest, first)
                for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch))
                for first, _, digest in chunks(text)
            ]
            yield {"doc_id": [r[0] for r in rows], "digest": [r[1] for r in rows], "place": [r[2] for r in rows]}

        return work

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return arrow_map(rows, "doc_id bigint, digest binary, place int", start)


def _texts(rows: DataFrame) -> DataFrame:
    """The bytes of the listed chunks of ``doc_id, text, listed``."""

    def start() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            keys, texts, listed = (batch.column(c).to_pylist() for c in ("doc_id", "text", "listed"))
            out = []
            for key, text, wanted in zip(keys, texts, listed):
                places = {(w["place"], w["digest"]): w["leads"] for w in wanted}
                lines = text.encode().split(b"\n")
                for first, end, digest in chunks(text):
                    if (first, digest) in places:
                        out.append((key, digest, first, places[first, digest], b"\n".join(lines[first:end])))
            yield {n: [r[i] for r in out] for i, n in enumerate(("doc_id", "digest", "place", "leads", "bytes"))}

        return work

    return arrow_map(rows, "doc_id bigint, digest binary, place int, leads boolean, bytes binary", start)


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, place, digest`` of every chunk to remove, and with ``leads`` of every first occurrence to keep."""
    listed = durable(_listed(docs))
    at = F.struct("doc_id", "place")
    leads = listed.groupBy("digest").agg(F.min(at).alias("lead"), F.max(at).alias("last")).where("lead < last")
    again = listed.join(leads.select("digest", "lead"), "digest").withColumn("leads", at == F.col("lead"))
    wanted = cut(again.groupBy("doc_id").agg(F.collect_set(F.struct("place", "digest", "leads")).alias("listed")))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    found = cut(_texts(texts.join(wanted, "doc_id")))  # rows of one doc_id may repeat; texts are not shuffled again to drop them here
    columns = ["doc_id", "place", "digest", "leads"]
    first = found.where("leads").select("digest", F.col("bytes").alias("first_bytes")).distinct()
    same = found.where("not leads").join(first, "digest").where(F.col("bytes") == F.col("first_bytes"))
    return same.select(*columns).unionByName(found.where("leads").select(*columns)).distinct()


def _without(text: str, cuts: list[dict]) -> tuple[str, int, int]:
    """The text without the listed chunks but for lines of first occurrences, and how many chunks and lines went."""
    listed = {(c["place"], c["digest"]): c["leads"] for c in cuts}
    lines = text.encode().split(b"\n")
    found = [(first, end, listed[first, digest]) for first, end, digest in chunks(text) if (first, digest) in listed]
    spans = [(first, end) for first, end, leads in found if not leads]
    stay = {i for first, end, leads in found if leads for i in range(first, end)}
    drop = {i for first, end in spans for i in range(first, end)} - stay
    left = b"\n".join(line for i, line in enumerate(lines) if i not in drop)
    return left.decode(), len(spans), len(drop)


#: Name of the added column; no table has it.
CUT = "cut by line_chunks"
RESULT = "struct<text:string,chunks:bigint,lines:bigint>"


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one more column: ``CUT`` (text without repeated chunks, chunks and lines removed)."""

    @F.arrow_udf(RESULT)
    def left(text: pa.Array, cuts: pa.Array) -> pa.Array:
        kind = pa.struct([("text", pa.string()), ("chunks", pa.int64()), ("lines", pa.int64())])
        rows = zip(text.to_pylist(), cuts.to_pylist())
        done = [_without(t, c) if c and t is not None else None for t, c in rows]  # null where nothing is listed
        return pa.array([d and dict(zip(("text", "chunks", "lines"), d)) for d in done], kind)

    listed = F.collect_list(F.struct("place", "digest", "leads")).alias("gone_chunks")
    some = F.bool_or(~F.col("leads")).alias("some")
    gone = cut(repeated(docs).groupBy(F.col("doc_id").alias("of")).agg(listed, some).where("some").drop("some"))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone["of"], "left")
    text = F.when(gone["of"].isNotNull(), docs["text"].cast("string"))
    return joined.select(*(docs[c] for c in docs.columns), left(text, gone["gone_chunks"]).alias(CUT))


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without repeated chunks; ``n_chars`` follows the text where it changed."""
    done = deduplicate(docs)
    cut = done[CUT]
    new = {"text": F.when(cut.isNotNull(), cut["text"]).otherwise(done["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut.isNotNull(), F.length(cut["text"])).otherwise(done["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.withColumns(new).drop(CUT)


def report(docs: DataFrame) -> DataFrame:
    """Per document how many lines it had, what was removed, and a digest of what is left."""
    done = deduplicate(docs)
    text, cut = whole_text(), done[CUT]
    return done.select(
        done["doc_id"].cast("long").alias("doc_id"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce(cut["chunks"], F.lit(0)).cast("long").alias("n_removed_chunks"),
        F.coalesce(cut["lines"], F.lit(0)).cast("long").alias("n_removed_lines"),
        F.sha2(F.coalesce(cut["text"], text).cast("binary"), 256).alias("kept_sha256"),
    )
