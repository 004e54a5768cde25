"""Personal data: fixed kinds by pattern, then terms that reveal a protected entity.

Only DataFrame functions. E-mail addresses, IP addresses, card and phone numbers are protected entities. How much a term
tells about an entity is estimated from the corpus: over distinct texts, the pointwise mutual information of term and
entity, ``ln(N * both / (entity * term))``, as a share of the entity's own information ``ln(N / entity)``. A share of 1
means that whoever reads the term knows the entity. A term discloses an entity from GENERALISE on: there it is replaced by
its kind, from REMOVE on it is dropped, in the texts that hold the entity.

Every entity is estimated, whatever the number of its texts, and every word is a term, whatever its length. The share of a
term's texts that hold the entity is taken at its lower confidence bound (Wilson, CONFIDENCE standard deviations): few texts
count as little evidence, and as more evidence the more texts the corpus has that the term is not in. Entities are pooled
besides, by mail domain and by prefix of address or number, and a pool is estimated like an entity of its own.

Entities and pools held by the same texts have the same estimates and are one class. Counts are made with partial sums per
(class, term), so an entity in a third of all texts makes no heavy group, and a text is paired once with all that only it
holds. Copies of a text under other doc_ids count once.

The first reading of the texts leaves narrow rows: spans, entities and, where there are any, 64-bit hashes of the distinct
terms. Terms are counted over all rows with partial sums, and what copies count too much is taken off again, so that texts
need not be brought together; only the first of each group of copies, and of each text that holds a disclosed entity, is
looked up once more by its doc_id. The look-up of copies is a merge join at every size, the one step that shuffles the texts:
the list of copies grows with the table. A window runs over the words of one text.

Offsets are code points, ends exclusive. Null texts count as empty. A text's entities are its own: rows that share a doc_id
with other texts lend it none. Repeated rows get equal results; equal shares need no order, since all of them count. Very long
texts take linear time. Other columns are not looked at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.common import SPACE, cut, whole_text
from tillmark.session import durable

# The contract's patterns. Possessive repeats and the look-behinds change no match: what they keep the matcher from trying
# cannot match either, and long runs take linear time and no stack.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Shares of the entity's information from which a term discloses it.
GENERALISE, REMOVE = 0.90, 0.97
#: Standard deviations to the lower bound of a count: 95 % of one side.
CONFIDENCE = 1.645
#: Digits that a pool of numbers has in common, and parts that a pool of addresses has.
PREFIX = {"card": 6, "phone": 4, "ip": 2}
SPANS = "array<struct<start:int,end:int,value:string>>"
SHOWN = "array<struct<start:int,end:int,share:double>>"
#: What stands before the first and behind the last letter or digit of a word.
LEAD = r"^[^\p{L}\p{N}]++"
EDGES = LEAD + r"|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    digits = F.split(F.reverse(value), "")

    def worth(digit: Column, place: Column) -> Column:
        n = digit.cast("int")
        return F.when(place % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    worths = F.transform(F.filter(digits, lambda d: d != ""), worth)
    return F.aggregate(worths, F.lit(0), lambda a, b: a + b) % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda part: F.length(F.regexp_replace(part, "^0+", "")) <= 3
        return F.forall(F.split(value, r"\."), lambda part: small(part) & (F.right(part, F.lit(3)).cast("int") <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    return F.length(digits).between(10, 15)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda m: _sound(kind, m["value"])


def _span(*more: Column) -> Callable[[Column], Column]:
    """Start, what is given, end."""
    return lambda m: F.struct(m["start"].alias("start"), *more, m["end"].alias("end"))


def _value(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.concat(F.lit(f"{kind}:"), m["value"] if kind in ("email", "ip") else _digits(m["value"]))


def _matches(text: Column, pattern: Column) -> Column:
    """All matches with their offsets: lengths of what lies between them, summed up from the left."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern), lambda gap: F.length(gap))
    begin = F.struct(F.array().cast(SPANS).alias("out"), F.lit(0).alias("at"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(F.concat(acc["out"], F.array(one)).alias("out"), end.alias("at"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    return F.aggregate(pairs, begin, add, lambda acc: acc["out"])


def find(docs: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, text`` and an array of ``start, end, value`` for each kind of PATTERNS."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(column).alias("text"))
    # a column for each step: an expression that a lambda names would be worked out again for every element
    for kind, pattern in PATTERNS.items():
        hint = F.col("text").rlike("[0-9][0-9 -]{13}") if HINTS[kind] is None else F.contains(F.col("text"), F.lit(HINTS[kind]))
        rows = rows.withColumn(kind, F.when(hint, _matches(F.col("text"), F.lit(pattern))).otherwise(F.array().cast(SPANS)))
    for kind in PATTERNS:
        rows = rows.withColumn(kind, F.filter(kind, _check(kind)))
    return rows


def _listed(kinds: tuple[str, ...]) -> Column:
    """The spans of these kinds as ``start, kind`` (its place in KINDS), ``end``, in order."""
    parts = [
        F.transform(kind, _span(F.lit(n).alias("kind"))) for n, kind in enumerate(kinds)
    ]
    return F.array_sort(F.concat(*parts))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _term(word: Column) -> Column:
    """The term of a word: without outer punctuation, in lower case."""
    return F.lower(F.regexp_replace(word, EDGES, ""))


def _terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    terms = F.array_distinct(F.transform(F.array_distinct(F.split(text, f"{SPACE}+")), _term))
    return F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.xxhash64(t))


def _entities() -> Column:
    """The distinct protected values of a row of :func:`find`; numbers by their digits."""
    return F.array_distinct(F.concat(*(F.transform(kind, _value(kind)) for kind in PATTERNS)))


def _pool(kind: str) -> Callable[[Column], Column]:
    if kind == "email":
        return lambda m: F.concat(F.lit("pool email:"), F.lower(F.substring_index(m["value"], "@", -1)))
    if kind == "ip":
        return lambda m: F.concat(F.lit("pool ip:"), F.substring_index(m["value"], ".", PREFIX["ip"]))
    return lambda m: F.concat(F.lit(f"pool {kind}:"), F.left(_digits(m["value"]), F.lit(PREFIX[kind])))


def _pools() -> Column:
    """The distinct pools of the protected values of a row of :func:`find`."""
    return F.array_distinct(F.concat(*(F.transform(kind, _pool(kind)) for kind in PATTERNS)))


def _may_hold(text: Column) -> Column:
    """False only where no pattern can match."""
    some = F.contains(text, F.lit("@")) | F.contains(text, F.lit("+"))
    return some | text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]") | text.rlike("[0-9][0-9 -]{13}")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _share(n_texts: int, n_entity: Column, n_term: Column, n_both: Column) -> Column:
    """Of the entity's information, what the term tells, from the lower bound of the term's texts that hold the entity."""
    p, z = n_both / n_term, CONFIDENCE**2
    low = (p + z / (2 * n_term) - F.sqrt(z * (p * (1 - p) / n_term + z / (4 * n_term * n_term)))) / (1 + z / n_term)
    share = F.log(F.lit(float(n_texts)) * low / n_entity) / F.log(F.lit(float(n_texts)) / n_entity)
    return F.least(share, F.lit(1.0))


def survey(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, digest``, the base spans of each kind, ``entities`` (pools too) and, beside entities, ``terms`` (hashes)."""
    found = find(docs)
    spans_of = [F.transform(kind, _span()).alias(kind) for kind in PATTERNS]
    found = found.withColumn("entities", F.concat(_entities(), _pools()))
    terms = F.when(F.size("entities") > 0, _terms(F.col("text"))).alias("terms")
    return found.select("doc_id", _digest(F.col("text")).alias("digest"), *spans_of, "entities", terms)


def classes(holders: DataFrame, n_texts: int) -> DataFrame:
    """``digest, class, n_entity`` of all entities and pools that a text holds; ``holders`` has ``digest, entities`` once per text."""
    holds = holders.select("digest", F.explode("entities").alias("entity"))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "digest")).alias(f"mark_{seed}") for seed in range(2)]
    of = holds.groupBy("entity").agg(F.count("*").alias("n_entity"), *marks).where(F.col("n_entity") < n_texts)
    of = of.select("entity", "n_entity", F.xxhash64("n_entity", "mark_0", "mark_1").alias("class"))
    return holds.join(of, "entity").select("digest", "class", "n_entity").distinct()


def _firsts(docs: DataFrame, wanted: DataFrame, may_hold: bool = False) -> DataFrame:
    """``digest, text`` and the other columns of ``wanted`` (``digest, first``), the smallest doc_id of each text."""
    texts = docs.select(docs["doc_id"].cast("long").alias("first"), whole_text().alias("text"))
    if may_hold:
        texts = texts.where(_may_hold(F.col("text")))
    texts = texts.withColumn("digest", _digest(F.col("text"))).join(wanted, ["digest", "first"])
    return texts.drop("first").dropDuplicates(["digest"])


def _counted(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """``term, n_term``: distinct texts that hold a term; ``copies`` has ``digest, first, n`` of the texts of several rows."""
    every = docs.select(F.explode(_terms(whole_text())).alias("term"), F.lit(1).cast("long").alias("n"))
    again = _firsts(docs, copies.hint("merge")).select(F.explode(_terms(F.col("text"))).alias("term"), (1 - F.col("n")).alias("n"))
    return every.unionByName(again).groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosures(docs: DataFrame, texts: DataFrame, holders: DataFrame) -> DataFrame:
    """``digest, term, share`` of every term that discloses an entity of the text.

    ``texts`` has ``digest, first, n`` (smallest doc_id, rows) of every text, ``holders`` ``digest, entities, terms`` of those
    with an entity.
    """
    nothing = docs.sparkSession.createDataFrame([], "digest binary, term bigint, share double")
    n_texts = texts.count()
    hold = cut(classes(holders, n_texts))
    if hold.isEmpty():
        return nothing

    lists = hold.groupBy("digest").agg(F.collect_list(F.struct("class", "n_entity")).alias("classes"))
    pairs = holders.join(lists, "digest").select("classes", F.explode("terms").alias("term")).select(F.explode("classes").alias("e"), "term")
    both = pairs.groupBy("e.class", "e.n_entity", "term").agg(F.count("*").alias("n_both"))
    # a term has at least the texts it shares: what cannot disclose with these alone need not be counted elsewhere
    both = cut(both.where(_share(n_texts, F.col("n_entity"), F.col("n_both"), F.col("n_both")) >= GENERALISE))
    if both.isEmpty():
        return nothing

    of_term = _counted(docs, cut(texts.where("n > 1")))
    share = _share(n_texts, F.col("n_entity"), F.col("n_term"), F.col("n_both"))
    told = both.join(of_term, "term").withColumn("share", share).where(F.col("share") >= GENERALISE).select("class", "term", "share")
    return hold.select("digest", "class").join(told, "class").groupBy("digest", "term").agg(F.max("share").alias("share"))


def _places(docs: DataFrame, revealed: DataFrame, firsts: DataFrame) -> DataFrame:
    """``digest, term``: start, end and share of the words of a text that are a term revealed for it.

    ``firsts`` has ``digest, first``, the smallest doc_id of a text; only that copy is read.
    """
    wanted = cut(firsts.join(revealed.select("digest").distinct(), "digest").select("digest", "first"))
    pieces = _firsts(docs, wanted, may_hold=True).select("digest", F.posexplode(F.split("text", SPACE)).alias("at", "word"))
    before = Window.partitionBy("digest").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    words = pieces.withColumn("begin", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)))
    start = F.col("begin") + F.length("word") - F.length(F.regexp_replace("word", LEAD, ""))
    end = start + F.length(F.regexp_replace("word", EDGES, ""))
    words = words.select("digest", F.xxhash64(_term(F.col("word"))).alias("term"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    # words lie by text already, so a text's terms come to them as one row and nothing is shuffled again
    lists = revealed.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    words = words.join(lists, "digest").withColumn("share", F.try_element_at("shares", F.col("term"))).where("share is not null")
    return words.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("term"))


def terms(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``digest, term`` (start, end, share) for the texts in which terms disclose an entity; ``rows`` is their :func:`survey`."""
    texts = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    values = [F.any_value(c).alias(c) for c in ("entities", "terms")]
    holders = cut(rows.where(F.size("entities") > 0).groupBy("digest").agg(F.min("doc_id").alias("first"), *values))
    return cut(_places(docs, cut(disclosures(docs, texts, holders)), holders.select("digest", "first")))


def _with_terms(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """``rows`` (``digest`` and base spans) with the column ``term``; words that overlap a base span are left out."""
    rows = rows.join(shown, "digest", "left").withColumn("base", _listed(tuple(PATTERNS)))
    clear = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    term = F.filter(F.coalesce("term", F.array().cast(SHOWN)), clear)
    return rows.withColumn("term", term).drop("digest", "base")


def spans(docs: DataFrame) -> DataFrame:
    """:func:`find` with the column ``term``: start, end and share of the words that disclose an entity of their text."""
    shown = terms(docs, durable(survey(docs)))
    return _with_terms(find(docs).withColumn("digest", _digest(F.col("text"))), shown)


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of base spans of each kind, a digest of them, and all spans in writing."""
    rows = durable(survey(docs))
    rows = _with_terms(rows.select("doc_id", "digest", *PATTERNS), terms(docs, rows))
    rows = rows.withColumn("base", _listed(tuple(PATTERNS))).withColumn("all", _listed(KINDS))
    return rows.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("all")).alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: base spans by the name of their kind, disclosing terms generalised to ``[TERM]`` or removed.

    Of spans that overlap, the one that begins first is replaced, and the rest of the others goes with it.
    """
    rows = spans(docs)
    parts = [F.transform(kind, _span(F.lit(f"[{kind.upper()}]").alias("by"))) for kind in PATTERNS]
    by = lambda m: F.when(m["share"] >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]")).alias("by")
    parts.append(F.transform("term", lambda m: _span(by(m))(m)))
    rows = rows.withColumn("cuts", F.array_sort(F.concat(*parts)))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc: Column, cut: Column) -> Column:
        between = F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), cut["start"] - acc["at"]))
        new = F.when(cut["start"] >= acc["at"], F.concat(acc["out"], between, cut["by"])).otherwise(acc["out"])
        return F.struct(new.alias("out"), F.greatest(acc["at"], cut["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return rows.select("doc_id", F.aggregate("cuts", begin, put, rest).alias("text"))
