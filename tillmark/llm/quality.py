"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Only DataFrame functions. Each text gives a few counts; their transformed rates form a vector. For every language and
source, every language and the whole table a minimum-covariance-determinant estimate gives centre and scatter: from several
starts, each concentration step keeps the share of documents nearest to the current estimate and estimates again from those;
the start that ends with the least determinant counts, and its scatter is scaled for the share it rests on. A source is
judged by its own estimate and that of its language, and this by its own and that of the table, weighted by their documents
(n of them weigh n / (n + LEAST)), so small sources lean on their language without a step in size. Documents whose squared
Mahalanobis distance lies beyond a quantile of the chi-square distribution are rejected.

The steps run on a small table of vectors cut to the shared folder and aggregate by group with partial sums. What they
exchange is one row per group, itself written, so the optimizer broadcasts it while it is small; no row of a document is
dealt by its group, and a source that holds a third of all rows is no heavier than the rest.

Null texts count as empty, null languages and sources as groups of their own. Repeated rows and ties count as often as they
occur. Very long texts are one row of five counts like others. Columns but doc_id, text, lang and source are not read, so
their names cannot clash. An empty table gives an empty result. Documents that fail a base rule take no part in the estimates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.common import NOT_SPACE, SPACE, whole_text
from tillmark.session import durable

FEATURES = ("words", "length", "symbols", "lines", "repeats")
#: Share of a group that an estimate rests on, concentration steps, and the documents at which a group weighs half.
SHARE, STEPS, LEAST = 0.75, 6, 200
#: What the scatter of the nearest SHARE of normal vectors falls short by: SHARE / P(chi2(7) <= the SHARE quantile of chi2(5)).
CONSISTENT = 1.413
#: Largest accepted squared distance: the 1 - 1e-9 quantile of the chi-square distribution with five degrees.
REACH = 50.8
#: The coordinates each start looks at.
STARTS = ((0, 1, 2, 3, 4), (0, 1), (2, 3, 4))
#: Bins to a factor of e in the histogram that the share is read from.
PER_E = 50



def base_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """The input's rows as ``doc_id, lang, source`` and the five counts."""
    text = whole_text(column)
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["lang"].cast("string").alias("lang"),
        docs["source"].cast("string").alias("source"),
        words.alias("words"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    windows = F.when(
        F.size("words") > 2,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        ),
    )
    # each step is a column of its own: an expression inside a lambda would be worked out for every element
    rows = rows.withColumn("windows", windows)
    repeat = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.withColumn("placed", F.when(repeat, F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    rows = rows.withColumn("places", F.transform("placed", _place_if_repeated))
    rows = rows.withColumn("places", F.array_sort(F.filter("places", lambda i: i >= 0)))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), _cover, lambda acc: acc["n"]), F.lit(0))
        .cast("long")
        .alias("n_repeat_words"),
    )


def _place_if_repeated(here: Column, k: Column) -> Column:
    """Of windows sorted with their places: the place if a neighbour is the same window, else -1."""
    same = (F.get("placed", k - 1)["w"] == here["w"]) | (F.get("placed", k + 1)["w"] == here["w"])
    return F.when(F.coalesce(same, F.lit(False)), here["i"]).otherwise(-1)


def _cover(acc: Column, i: Column) -> Column:
    """Words in the union of three-word windows, met in the order of their places."""
    return F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vectors() -> dict[str, Column]:
    """The transformed statistics of a document that passed the base rules."""
    n = F.col("n_words").cast("double")
    return {
        "words": F.log(n),
        "length": F.log(F.col("word_chars") / n),
        "symbols": F.log(0.01 + F.col("n_symbols") / n),
        "lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "repeats": F.log(0.02 + F.col("n_repeat_words") / n),
    }


#: Variances that counting alone gives the statistics, added to every estimate so that it can be inverted: of the words and
#: their mean length in the shortest document, and of one symbol, line or window more in a document of 200 words.
RIDGE = {"words": 0.02, "length": 0.005, "symbols": 0.16, "lines": 0.48, "repeats": 0.31}
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _named(*columns: str) -> Column:
    return F.to_json(F.array(*(F.coalesce(F.col(c), F.lit("\u0000")) for c in columns)))


def _moments(rows: DataFrame) -> DataFrame:
    """Per cell and start the mean ``m_*``, the scaled scatter ``s_*_*`` and the logarithm ``det`` of its determinant."""
    sums = [F.avg(a).alias(f"m_{i}") for i, a in enumerate(FEATURES)]
    sums += [F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"r_{i}_{j}") for i, j in PAIRS]
    out = rows.groupBy("cell", "start").agg(*sums)
    scatter = {f"s_{i}_{j}": (F.col(f"r_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * CONSISTENT for i, j in PAIRS}
    out = _factored(out.withColumns(scatter))
    return out.withColumn("det", sum((F.log(F.col(f"c_{i}_{i}")) for i in range(P)), F.lit(0.0)))


def _factored(out: DataFrame) -> DataFrame:
    """With the Cholesky factor ``c_*_*`` of scatter and RIDGE, and its inverse ``i_*_*``."""
    for i, j in PAIRS:
        value = F.col(f"s_{i}_{j}")
        for k in range(j):
            value = value - F.col(f"c_{i}_{k}") * F.col(f"c_{j}_{k}")
        if i == j:
            # what counting gives is a lower bound of what is left of each statistic's variance
            value = F.sqrt(F.greatest(value, F.lit(0.0)) + F.lit(RIDGE[FEATURES[i]]))
        else:
            value = value / F.col(f"c_{j}_{j}")
        out = out.withColumn(f"c_{i}_{j}", value)
    for i, j in PAIRS:
        value = F.lit(1.0 if i == j else 0.0)
        for k in range(j, i):
            value = value - F.col(f"c_{i}_{k}") * F.col(f"i_{k}_{j}")
        out = out.withColumn(f"i_{i}_{j}", value / F.col(f"c_{i}_{i}"))
    return out


def _squared() -> Column:
    """Squared Mahalanobis distance to an estimate."""
    total = F.lit(0.0)
    for i in range(P):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"i_{i}_{j}") * (F.col(FEATURES[j]) - F.col(f"m_{j}"))
        total = total + part * part
    return total


def _nearest(rows: DataFrame) -> DataFrame:
    """Per cell and start the rows up to the smallest bin of ``off`` that has SHARE of them in it or below; from exact counts."""
    rows = rows.withColumn("bin", F.floor(F.log(F.least(F.col("off"), F.lit(1e12)) + 1e-6) * PER_E))
    bins = rows.groupBy("cell", "start", "bin").agg(F.count("*").alias("n"))
    of = Window.partitionBy("cell", "start")  # a few thousand bins at most
    ranked = bins.withColumn("upto", F.sum("n").over(of.orderBy("bin"))).withColumn("all", F.sum("n").over(of))
    edges = durable(ranked.where(F.col("upto") >= SHARE * F.col("all")).groupBy("cell", "start").agg(F.min("bin").alias("edge")))
    return rows.join(edges, ["cell", "start"]).where(F.col("bin") <= F.col("edge"))


def _medians(rows: DataFrame, suffix: str, *more: Column) -> DataFrame:
    columns = more or tuple(F.col(f) for f in FEATURES)
    return durable(rows.groupBy("cell").agg(*(F.percentile_approx(c, 0.5, 10_000).alias(f"{suffix}_{f}") for f, c in zip(FEATURES, columns))))


def estimates(sound: DataFrame) -> DataFrame:
    """Per ``cell`` of ``cell`` and FEATURES the estimate of least determinant: ``m_*`` and ``s_*_*``."""
    middle = _medians(sound, "q")
    centred = sound.join(middle, "cell")
    spread = _medians(centred, "d", *(F.abs(F.col(f) - F.col(f"q_{f}")) for f in FEATURES))
    near = centred.join(spread, "cell")
    off = [F.abs(F.col(f) - F.col(f"q_{f}")) / (1.4826 * F.col(f"d_{f}") + RIDGE[f] ** 0.5) for f in FEATURES]
    starts = F.array(*(F.struct(F.lit(n).alias("start"), sum((off[i] for i in of), F.lit(0.0)).alias("off")) for n, of in enumerate(STARTS)))
    near = near.select("cell", *FEATURES, F.explode(starts).alias("s")).select("cell", *FEATURES, "s.start", "s.off")
    for _ in range(STEPS):
        found = durable(_moments(_nearest(near)))
        near = sound.join(found, "cell").withColumn("off", _squared()).select("cell", *FEATURES, "start", "off")
    values = [f"m_{i}" for i in range(P)] + [f"s_{i}_{j}" for i, j in PAIRS]
    best = found.groupBy("cell").agg(F.min(F.struct(F.round("det", 9), "start", *values)).alias("best"))
    return durable(best.select("cell", *(F.col(f"best.{v}").alias(v) for v in values)))


def _weighted(sound: DataFrame, found: DataFrame) -> DataFrame:
    """Per language and source the estimate it is judged by: its own, its language's and the table's by their documents."""
    sized = sound.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sized = durable(sized.withColumn("own", _named("lang", "source")).withColumn("wide", _named("lang")))
    total = sized.groupBy("wide").agg(F.sum("n").alias("n_wide"))
    values = [c for c in found.columns if c != "cell"]
    joined = sized.join(total, "wide")
    for level in ("own", "wide"):
        joined = joined.join(found.select(F.col("cell").alias(level), *(F.col(v).alias(f"{level}_{v}") for v in values)), level)
    joined = joined.crossJoin(found.where("cell = ''").drop("cell"))  # one row
    weight, outer = F.col("n") / (F.col("n") + LEAST), F.col("n_wide") / (F.col("n_wide") + LEAST)
    mixed = {v: weight * F.col(f"own_{v}") + (1 - weight) * (outer * F.col(f"wide_{v}") + (1 - outer) * F.col(v)) for v in values}
    out = _factored(joined.withColumns(mixed))
    keep_columns = [f"m_{i}" for i in range(P)] + [f"i_{i}_{j}" for i, j in PAIRS]
    return durable(out.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *keep_columns))


def judge(stats: DataFrame, reach: float = REACH) -> DataFrame:
    """``stats`` (see :func:`base_counts`) with ``base_failed``, squared ``distance`` (null if failed) and ``kept``."""
    features = {name: F.when(~F.col("base_failed"), value) for name, value in vectors().items()}
    stats = durable(stats.withColumn("base_failed", base_failed()).withColumns(features))
    sound = stats.where(~F.col("base_failed"))
    cells = F.explode(F.array(_named("lang", "source"), _named("lang"), F.lit(""))).alias("cell")
    found = estimates(durable(sound.select(cells, *FEATURES)))
    groups = _weighted(sound, found)
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    judged = stats.join(groups, same, "left").withColumn("distance", F.when(~F.col("base_failed"), _squared()))
    kept = ~F.col("base_failed") & (F.col("distance") <= reach)
    return judged.withColumn("kept", F.coalesce(kept, F.lit(False))).select(*stats.columns, "distance", "kept")


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, whether a base rule fails, whether it stays."""
    return judge(base_counts(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays. A document that occurs in several rows stays if one of them does."""
    stays = verdicts(docs).where("kept").select(F.col("doc_id").alias("of")).distinct()
    return docs.join(stays, docs["doc_id"].cast("long") == stays["of"], "left_semi")
