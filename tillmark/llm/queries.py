"""The dealt operators as queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.llm import (
    byte_bpe,
    conversations,
    lexical,
    line_chunks,
    mixing,
    ngram_join,
    private_data,
    quality,
    secret_scan,
    substrings,
    token_counts,
    toxicity,
    vectors,
)
from tillmark.llm.common import table

Runner = Callable[[SparkSession, str], DataFrame]


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, fitted, threshold=0.3)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.report(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


#: Target weights grow with the square root of a source's documents; the seed of the draw.
MIX_POWER, MIX_SEED = 0.5, 17


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.plan(docs, mixing.tempered(docs, MIX_POWER), MIX_SEED)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.report(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")))


RUNNERS: dict[str, Runner] = {
    "op1_vectors": op1_vectors,
    "op2_substrings": op2_substrings,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_private_data": op6_private_data,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_mixing": op8_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_line_chunks": op10_line_chunks,
    "op11_secrets": op11_secrets,
    "op12_lexical": op12_lexical,
    "op13_conversations": op13_conversations,
}



def _unit(parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 13))::bigint / 4503599627370496.0)"


MIX_SQL = f"""
with recursive own as (select source, count(*) n_docs, pow(count(*), {MIX_POWER}) weight from documents group by source),
r as (select source, weight / (select sum(weight) from own) * (select sum(n_docs) from own) / n_docs rate from own),
p as (select source, rate, cast(ceil(rate / {mixing.PIECE}) as int) pieces from r),
terms(source, mean, k, p, c) as (
 select source, rate / pieces, 0, exp(-rate / pieces), exp(-rate / pieces) from p
 union all
 select source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from terms where k < {mixing.TERMS}),
draws as (select doc_id, p.source, rate, {_unit(f"{MIX_SEED}, doc_id, i")} u
 from documents d join p on d.source is not distinct from p.source, unnest(range(pieces)) s(i)),
counts as (select doc_id, d.source, rate, cast(count(*) filter (c <= u) as int) n_copies
 from draws d join terms t on d.source is not distinct from t.source group by all)
select doc_id, source, round(rate, 9) rate, n_copies, cast(copy as int) as "copy", {_unit(f"{MIX_SEED}, 'place', doc_id, copy")} place
from counts, unnest(range(n_copies)) s(copy)
"""

def _words(columns: str, table: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"select {columns}, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{pattern}')) term from {table}"


SEARCH_SQL = f"""
with words as ({_words("doc_id", "documents")}),
tfs as (select doc_id, term, count(*) tf from words group by all),
sizes as (select doc_id, count(*) n from words group by doc_id),
totals as (select count(*) n_docs, cast(sum(n) as bigint) total from sizes),
asked as (select item_id, term, count(*) reps from ({_words("item_id", "benchmark")}) group by all),
weights as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1))) as bigint) w
 from tfs, totals where term in (select term from asked) group by term, n_docs),
scores as (select item_id, doc_id,
 cast(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total)))) as bigint) score
 from asked join weights using (term) join tfs using (term) join sizes using (doc_id), totals group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) "rank", doc_id, score
from scores where score > 0 qualify "rank" <= 20
"""

ORACLES: dict[str, str] = {"op8_mixing": MIX_SQL, "op12_lexical": SEARCH_SQL}
