import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F
from tests.compare import connect, difference

from tillmark.llm import mixing
from tillmark.llm.queries import ORACLES, RUNNERS

SF = "/root/testdata/sf0.001"


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def drawn(mean, u):
    p = c = math.exp(-mean)
    k = 0
    while c <= u and k < 1000:
        k += 1
        p *= mean / k
        c += p
    return k


def test_plan_equals_sql(spark):
    assert difference(RUNNERS["op8_mixing"](spark, SF), connect(SF), ORACLES["op8_mixing"]) is None


def test_counts_are_poisson_draws(spark, documents):
    df = documents(["t", None, ""] * 40 + ["long " * 50_000])
    sources = [None if i % 7 == 0 else f"s{i % 3}" for i in range(1, 122)]
    weights = {None: 300.0, "s0": 1.0, "s1": 5.0}
    targets = spark.createDataFrame([(k, v) for k, v in weights.items()] + [("unseen", 9.0)], "source string, weight double")
    named = Counter(s for s in sources if s in weights)
    scale = sum(named.values()) / sum(weights.values())
    want = {}
    for key, source in enumerate(sources, 1):
        if source in weights:
            rate = weights[source] * scale / named[source]
            pieces = math.ceil(rate / mixing.PIECE)
            n = sum(drawn(rate / pieces, unit(5, key, i)) for i in range(pieces))
            if n:
                want[key] = n
    got = mixing.mix(df, targets, 5)
    assert got.columns == df.columns
    order = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert Counter(order) == want and max(want.values()) > 4
    places = sorted((unit(5, "place", k, c), k) for k, n in want.items() for c in range(n))
    assert order == [k for _, k in places]


def test_shares_meet_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("source"))
    targets = spark.createDataFrame([("hot", 1.0), ("rest", 3.0)], "source string, weight double")
    got = {r["source"]: r["count"] for r in mixing.mix(docs, targets, 1).groupBy("source").count().collect()}
    assert abs(got["hot"] / 5_000 - 1) < 0.05 and abs(got["rest"] / 15_000 - 1) < 0.05


def test_empty_table(spark, documents):
    df = documents([])
    assert mixing.mix(df, mixing.tempered(df, 0.5), 1).count() == 0
