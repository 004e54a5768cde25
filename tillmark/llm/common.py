"""What the text operators share: reading the given tables, typed Arrow maps, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.session import durable

#: ASCII white space: what separates words in every contract.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def arrow_map(
    df: DataFrame,
    schema: str,
    start: Callable[[], Callable[[pa.RecordBatch], Iterator[dict[str, object]]]],
    rows: int = 256,
) -> DataFrame:
    """``mapInArrow`` with bounded slices.

    ``start`` runs once per task and gives the function that turns a slice of at most ``rows`` rows into any number of
    column dictionaries; they get the types of ``schema``. Where that function has a ``close``, it is called when the task
    ends, so that a reused worker does not keep what the task had cached.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        try:
            for batch in batches:
                for first in range(0, batch.num_rows, rows):
                    for columns in work(batch.slice(first, rows)):
                        arrays = [
                            columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
                            for f in target
                        ]
                        yield pa.RecordBatch.from_arrays(arrays, schema=target)
        finally:
            getattr(work, "close", lambda: None)()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``durable``, and a hint to Spark's cleaner: what was shuffled for this table is not needed any more.

    The cleaner deletes shuffle files once the driver's garbage collector has met their owners, which a driver with little
    to do can put off for half an hour; an operator of many steps would pile them up until then.
    """
    out = durable(df, folder)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """``(id, component_id)`` for every id in ``links``: the smallest id that links reach.

    Alternating large-star and small-star rounds, each written to the shared folder. A hub is never collected: every
    round only aggregates minima by id. Ends when a round changes nothing.
    """
    edges = durable(
        links.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = durable(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    leaves = edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id")
    roots = edges.select(F.col("v").alias("id")).distinct().join(leaves, "id", "left_anti")
    return leaves.unionByName(roots.withColumn("component_id", F.col("id")))
