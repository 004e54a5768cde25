"""Files, the raw store, attempts, jobs and the import history."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark import testbed as tb
from tillmark.functions.marks import error_summary, file_status, is_report, published_file_status, storage_key
from tillmark.functions.numbers import plain_text
from tillmark.functions.times import iso_text
from tillmark.operators import bookkeeping as books
from tillmark.operators.joins import lookup_join
from tillmark.operators.paging import take_page
from tillmark.plans.imports import (
    attempt_revenue, file_summaries, import_file, import_job, import_jobs, jobs_with_files, product_samples,
    quantity_checks, validations_of,
)
from tillmark.registered.base import iso, movement_cte, query
from tillmark.schemas import TABLES
from tillmark.session import durable, new_workspace
from tillmark.sources.audits import constraint_audit, integrity_audit, orphan_files
from tillmark.sources.files import admitted, scan_reports, with_admission, with_fingerprint
from tillmark.sources.store import ReportStore, put_if_absent

FILES = """
f as (select doc_id file_id, sha256(text) sha256, strlen(text) byte_size, source import_job_id,
 timestamp '2026-01-01 00:00:00' + to_seconds(doc_id) created_at, lang, text,
 concat('doc-', doc_id, case lang when 'en' then '.QRP' when 'fr' then '.qrp' when 'de' then '.pdf' else '.Qrp' end) path
 from documents)"""
STATUS = "case lang when 'en' then 'IMPORTED' when 'fr' then 'WARNING' when 'de' then 'INVALID' else 'FAILED' end"
FILE_LIMIT = 8_000


def _documents(spark, sf_dir):
    """Documents as scanned files with their bytes."""
    files = tb.import_files(spark, sf_dir)
    text = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("content"))
    return files.withColumn("length", F.col("byte_size")).join(text, "file_id")


@query("sc1_report_scan", "select source, cast(sum(coalesce(strlen(text), 0) + 1) as bigint) bytes from documents group by 1")
def sc1_report_scan(spark, sf_dir):
    """The documents as text files, a folder for each source, scanned again; names and lengths only, no bytes are read."""
    folder = new_workspace(spark, "sc1")
    tb.table(spark, sf_dir, "documents").select("text", "source").write.partitionBy("source").text(folder)
    files = scan_reports(spark, folder, "*.txt")
    return files.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum("length").alias("bytes"))


@query("sc2_admission", f"""with {FILES}
select path, case when byte_size = 0 then 'EMPTY' when byte_size > {FILE_LIMIT} then 'TOO_LARGE'
 when lower(path) not like '%.qrp' then 'WRONG_EXTENSION' end reject_reason from f""")
def sc2_admission(spark, sf_dir):
    files = tb.import_files(spark, sf_dir).withColumn("length", F.col("byte_size"))
    return with_admission(files, FILE_LIMIT).select("path", "reject_reason")


@query("sc2_admitted", f"with {FILES} select path, byte_size from f where byte_size between 1 and {FILE_LIMIT} and lower(path) like '%.qrp'")
def sc2_admitted(spark, sf_dir):
    files = tb.import_files(spark, sf_dir).withColumn("length", F.col("byte_size"))
    return admitted(files, FILE_LIMIT).select("path", "byte_size")


@query("sc3_batch_cap", f"with {FILES} select import_job_id, count(*) files, count(*) > 20 over_cap from f group by 1")
def sc3_batch_cap(spark, sf_dir):
    from tillmark.fixed import MAX_FILES_PER_BATCH

    return tb.import_files(spark, sf_dir).groupBy("import_job_id").agg(F.count(F.lit(1)).alias("files")).withColumn(
        "over_cap", F.col("files") > MAX_FILES_PER_BATCH
    )


@query("sc4_fingerprint", f"""with {FILES}
select file_id, sha256, cast(byte_size as bigint) byte_size, substr(sha256,1,2)||'/'||substr(sha256,3,2)||'/'||sha256 storage_key from f""")
def sc4_fingerprint(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("content")
    )
    return with_fingerprint(rows).select("file_id", "sha256", "byte_size", "storage_key")


@query("sf13_storage_key", f"""with {FILES}
select file_id, case when lang = 'en' then substr(sha256,1,2)||'/'||substr(sha256,3,2)||'/'||sha256 end storage_key from f""")
def sf13_storage_key(spark, sf_dir):
    cut = F.when(F.col("lang") == "en", F.col("sha256")).otherwise(F.substring("sha256", 1, 63))
    return tb.import_files(spark, sf_dir).select("file_id", storage_key(cut).alias("storage_key"))


@query("sc7_format_support", f"""with {FILES}
select file_id, (lang = 'de' or lower(path) like '%.qrp') supported from f""")
def sc7_format_support(spark, sf_dir):
    kind = F.when(F.col("lang") == "de", F.lit("qrp")).when(F.col("lang") == "fr", F.lit("PDF"))
    return tb.import_files(spark, sf_dir).select("file_id", is_report(kind, F.col("path")).alias("supported"))


_STORED = """select parse_attempt_id, source_record_index, direction, external_product_id, external_sale_id,
 cast(quantity as varchar) quantity, cast(unit_price as varchar) unit_price, cast(total as varchar) total from mv"""


def finish(store, batch_seq):
    """The last write of a batch, without any publication."""
    store.write("artifact_publication", store.spark.createDataFrame([], TABLES["artifact_publication"]), batch_seq)


@query("sk1_table_sink", f"with {movement_cte(True)} {_STORED}")
def sk1_table_sink(spark, sf_dir):
    """A batch written again with other rows, and a batch that was never finished: the last rows of the done one are read."""
    store = ReportStore(spark, new_workspace(spark, "sk1"))
    # The three writes take their rows from one table; ranking and joining the lines costs several times as much.
    kept = [f.name for f in TABLES["parsed_movement"]]
    moved = tb.movements(spark, sf_dir, indexed=True)
    rows = durable(moved.select(*[c for c in moved.columns if c in kept]))
    shaped = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in TABLES["parsed_movement"] if f.name not in rows.columns})
    store.write("parsed_movement", shaped.withColumn("direction", F.lit("first write")), 0)
    store.write("parsed_movement", shaped, 0)
    finish(store, 0)
    store.write("parsed_movement", shaped.withColumn("direction", F.lit("unfinished")), 1)
    back = store.read("parsed_movement")
    return back.select(
        "parse_attempt_id", "source_record_index", "direction", "external_product_id", "external_sale_id",
        *[plain_text(F.col(c)).alias(c) for c in ("quantity", "unit_price", "total")],
    )


@query("sc8_canonical_scan", f"""with sale as (select cast(o_orderkey as varchar) id, case when o_orderstatus <> 'P' then o_orderdate end t from orders)
select 'sale' as tab, id, {iso('t')} detail from sale
union all select 'product', cast(p_partkey as varchar), p_name from part
union all select 'artifact_publication', 'raw-'||s_suppkey, cast(s_suppkey as varchar) from supplier where s_acctbal >= 0""")
def sc8_canonical_scan(spark, sf_dir):
    """Canonical tables written and scanned with their explicit schemas."""
    store = ReportStore(spark, new_workspace(spark, "sc8"))
    tables = {"sale": tb.sales(spark, sf_dir), "product": tb.products(spark, sf_dir), "artifact_publication": tb.publication(spark, sf_dir)}
    for name, rows in tables.items():
        missing = {f.name: F.lit(None).cast(f.dataType) for f in TABLES[name] if f.name not in rows.columns}
        store.write(name, rows.withColumns(missing) if missing else rows, 0)
    one = lambda name, key, detail: store.current(name).select(
        F.lit(name).alias("tab"), F.col(key).alias("id"), detail.alias("detail")
    )
    return (
        one("sale", "id", iso_text(F.col("occurred_at")))
        .unionByName(one("product", "id", F.col("name")))
        .unionByName(one("artifact_publication", "raw_artifact_id", F.col("active_parse_attempt_id")))
    )


@query("sk2_raw_store", f"""with {FILES}
select sha256, substr(sha256,1,2)||'/'||substr(sha256,3,2)||'/'||sha256 storage_key, cast(min(byte_size) as bigint) byte_size
from f group by 1""")
def sk2_raw_store(spark, sf_dir):
    """Two batches that overlap: the second adds only what the first did not bring."""
    store = ReportStore(spark, new_workspace(spark, "sk2"))
    files = with_fingerprint(_documents(spark, sf_dir).select("file_id", "lang", "content"))
    store.write("raw_content", put_if_absent(files.filter("lang = 'en'"), store.read("raw_content", 0)), 0)
    finish(store, 0)
    store.write("raw_content", put_if_absent(files, store.read("raw_content", 1)), 1)
    finish(store, 1)
    return store.read("raw_content").select("sha256", "storage_key", F.octet_length("content").cast("long").alias("byte_size"))


@query("jn10_orphans", f"""with {FILES}, stored as (select distinct on (sha256) sha256, byte_size, created_at from f order by sha256, created_at)
select sha256, cast(byte_size as bigint) length from stored where sha256 not in (select sha256 from f where lang = 'en')
 and created_at <= (select max(created_at) from f) - interval 60 second""")
def jn10_orphans(spark, sf_dir):
    """Stored contents of all documents against a registry that only knows the English ones, but for the last minute's."""
    files = tb.import_files(spark, sf_dir).withColumn("storage_key", storage_key(F.col("sha256")))
    stored = files.groupBy("storage_key", "sha256").agg(
        F.min("byte_size").alias("length"), F.min("created_at").alias("modificationTime")
    )
    cutoff = files.agg((F.max("created_at") - F.expr("interval 60 seconds")).alias("cutoff")).first()["cutoff"]
    return orphan_files(stored, files.filter("lang = 'en'"), F.lit(cutoff)).select("sha256", "length")


@query("so3_known_storage_keys", f"with {FILES} select file_id, sha256 in (select sha256 from f where lang = 'en') known from f")
def so3_known_storage_keys(spark, sf_dir):
    """Membership of stored files in the registry's keys, every stored file marked."""
    files = tb.import_files(spark, sf_dir).withColumn("storage_key", storage_key(F.col("sha256")))
    registry = files.filter("lang = 'en'").select("storage_key").distinct().withColumn("known", F.lit(True))
    return lookup_join(files, registry, ["storage_key"], "left").select("file_id", F.col("known").isNotNull().alias("known"))


@query("jn11_integrity_audit", f"""with {FILES}
select file_id, case when lang = 'de' then 'MISSING' when lang = 'es' then 'SIZE_MISMATCH'
 when lang = 'fr' and contains(text, ' ') then 'HASH_MISMATCH' else 'OK' end integrity from f""")
def jn11_integrity_audit(spark, sf_dir):
    """Registered documents against stored bytes that are missing, longer, or altered by language."""
    docs = tb.table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("storage_key")
    registry = docs.select(
        F.col("doc_id").alias("file_id"), key, F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("byte_size"),
    )
    bytes_now = (
        F.when(F.col("lang") == "es", F.concat("text", F.lit("x")))
        .when(F.col("lang") == "fr", F.translate("text", " ", "_"))
        .otherwise(F.col("text"))
    )
    stored = docs.filter("lang <> 'de'").select(key, bytes_now.cast("binary").alias("content"))
    return integrity_audit(registry, stored).select("file_id", "integrity")


@query("wn1_exact_dedup", f"""with {FILES}
select file_id, first_value(file_id) over w owner_file_id, file_id <> first_value(file_id) over w deduplicated
from f window w as (partition by sha256 order by created_at, file_id)""")
def wn1_exact_dedup(spark, sf_dir):
    return books.mark_duplicates(tb.import_files(spark, sf_dir)).select("file_id", "owner_file_id", "deduplicated")


@query("wn2_latest_attempt", """with a as (select *, case o_orderstatus when 'F' then 'FAILED' when 'O' then 'VALID' else 'WARNING' end status
 from orders where o_orderpriority not like '5%')
select 'raw-'||o_custkey raw_artifact_id, cast(max(o_orderkey) as varchar) latest_attempt_id, arg_max(status, o_orderkey) latest_status,
 cast(max(o_orderkey)+1 as int) latest_count from a group by 1""")
def wn2_latest_attempt(spark, sf_dir):
    return books.latest_attempts(tb.attempts(spark, sf_dir))


@query("wn3_duplicate_of", f"""with {FILES}, g as (select file_id id, sha256, created_at, f.lang = 'en' and n_chars % 2 = 0 deduplicated
 from f join documents d on d.doc_id = f.file_id)
select id, sha256, case when deduplicated then (select min(o.id) from g o where o.sha256 = g.sha256 and not o.deduplicated) end duplicate_of_import_file_id from g""")
def wn3_duplicate_of(spark, sf_dir):
    chars = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "n_chars")
    files = tb.import_files(spark, sf_dir).join(chars, "file_id").select(
        F.col("file_id").alias("id"), "sha256", F.col("sha256").alias("raw_artifact_id"), "created_at",
        ((F.col("lang") == "en") & (F.col("n_chars") % 2 == 0)).alias("deduplicated"),
    )
    return books.with_duplicate_of(files).select("id", "sha256", "duplicate_of_import_file_id")


@query("wn4_next_attempt", """select 'raw-'||c_custkey raw_artifact_id, cast(coalesce((select max(o_orderkey)+1 from orders
 where o_custkey = c_custkey and o_orderpriority not like '5%'), 0) + 1 as int) next_attempt from customer""")
def wn4_next_attempt(spark, sf_dir):
    artifacts = tb.table(spark, sf_dir, "customer").select(F.concat(F.lit("raw-"), F.col("c_custkey").cast("string")).alias("raw_artifact_id"))
    latest = books.latest_attempts(tb.attempts(spark, sf_dir))
    return artifacts.join(latest, "raw_artifact_id", "left").select(
        "raw_artifact_id", books.next_attempt_number(F.col("latest_count")).alias("next_attempt")
    )


@query("vr8_duplicate_states", """with p as (select distinct o_custkey from orders where o_orderpriority like '1%'),
a as (select c_custkey, (select arg_max(o_orderstatus, o_orderkey) from orders where o_custkey = c_custkey and o_orderpriority not like '5%') st,
 c_custkey in (select o_custkey from p) pub from customer)
select 'raw-'||c_custkey raw_artifact_id, case when st is null or st = 'F' then 'PROCESSING' when pub or st = 'O' then 'IMPORTED' else 'WARNING' end file_status,
 st is null or st = 'F' needs_parse from a""")
def vr8_duplicate_states(spark, sf_dir):
    raw = lambda c: F.concat(F.lit("raw-"), F.col(c).cast("string")).alias("raw_artifact_id")
    published = tb.table(spark, sf_dir, "orders").filter("o_orderpriority like '1%'").select(raw("o_custkey")).distinct()
    known = (
        tb.table(spark, sf_dir, "customer").select(raw("c_custkey"))
        .join(books.latest_attempts(tb.attempts(spark, sf_dir)), "raw_artifact_id", "left")
        .join(published.withColumn("published", F.lit(True)), "raw_artifact_id", "left")
    )
    state, shown = F.col("latest_status"), F.col("published").isNotNull()
    return known.select(
        "raw_artifact_id", books.arriving_file_status(state, shown).alias("file_status"), books.needs_parse(state).alias("needs_parse")
    )


@query("sf8_vr7_file_status", """select o_orderkey, case o_orderstatus when 'F' then 'FAILED' when 'O' then 'IMPORTED' else 'WARNING' end file_status,
 case when o_orderpriority like '1%' then 'IMPORTED' when o_orderstatus = 'F' then 'FAILED' when o_orderstatus = 'O' then 'IMPORTED' else 'WARNING' end shown_status from orders""")
def sf8_vr7_file_status(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "orders").withColumn(
        "status", F.expr("case o_orderstatus when 'F' then 'FAILED' when 'O' then 'VALID' else 'WARNING' end")
    )
    return rows.select(
        "o_orderkey", file_status(F.col("status")).alias("file_status"),
        published_file_status(F.expr("o_orderpriority like '1%'"), F.col("status")).alias("shown_status"),
    )


@query("jn13_sync_linked", f"""with {FILES}, g as (select *, case when lang = 'en' then 'PROCESSING' else {STATUS} end status from f),
s as (select sha256, arg_min(status, file_id) st from g where status <> 'PROCESSING' group by 1)
select file_id id, case when g.status = 'PROCESSING' then coalesce(st, 'PROCESSING') else g.status end status from g left join s using (sha256)""")
def jn13_sync_linked(spark, sf_dir):
    files = tb.settled_files(spark, sf_dir).withColumn(
        "status", F.when(F.col("lang") == "en", "PROCESSING").otherwise(F.col("status"))
    )
    return books.sync_linked(files).select("id", "status")


_ROLLUP = f"""with {FILES}, c as (select import_job_id, count(*) n, sum(case when st = 'PROCESSING' then 1 else 0 end) w,
 sum(case when st in ('IMPORTED','WARNING') then 1 else 0 end) i, sum(case when st in ('INVALID','FAILED') then 1 else 0 end) b
 from (select import_job_id, case when file_id % 331 = 5 then 'PROCESSING' else {STATUS} end st from f) group by 1),
j as (select distinct source id from documents union select 'empty-'||n_name from nation)
select j.id, coalesce(n, 0) files, case when w > 0 then null when coalesce(n,0) = 0 or (b > 0 and i = 0) then 'FAILED' when b > 0 then 'PARTIAL_SUCCESS' else 'SUCCEEDED' end rolled_status
from j left join c on c.import_job_id = j.id"""


@query("ag7_job_rollup", _ROLLUP)
def ag7_job_rollup(spark, sf_dir):
    files = tb.settled_files(spark, sf_dir).withColumn(
        "status", F.when(F.col("id") % 331 == 5, "PROCESSING").otherwise(F.col("status"))
    )
    empty = tb.table(spark, sf_dir, "nation").select(F.concat(F.lit("empty-"), "n_name").alias("id"))
    jobs = files.select(F.col("import_job_id").alias("id")).distinct().unionByName(empty)
    return books.job_rollup(jobs, files).select("id", "files", "rolled_status")


@query("ag10_import_counters", f"""with {FILES}, g as (select *, {STATUS} status, sha256 in (select sha256 from f f2 where f2.file_id < f.file_id) dup from f)
select 'imports.completed' as name, count(distinct import_job_id) as value from g
union all select 'imports.duplicates', count(*) from g where dup
union all select 'imports.warnings', count(*) from g where status = 'WARNING'
union all select 'imports.failures', count(*) from g where status in ('INVALID','FAILED')
union all select 'imports.duration.ms', cast(sum((byte_size % 7) * 1000) as bigint) from g
union all select 'raw.storage.bytes', cast((select sum(b) from (select min(byte_size) b from f group by sha256)) as bigint)""")
def ag10_import_counters(spark, sf_dir):
    marks = books.mark_duplicates(tb.import_files(spark, sf_dir)).select(F.col("file_id").alias("id"), "deduplicated")
    files = tb.settled_files(spark, sf_dir).join(marks, "id")
    jobs = files.select(F.col("import_job_id").alias("id")).distinct().withColumn("status", F.lit("SUCCEEDED"))
    artifacts = tb.import_files(spark, sf_dir).groupBy("sha256").agg(F.min("byte_size").alias("byte_size"))
    return books.import_counters(jobs, files, artifacts)


@query("pf11_error_summary", "select doc_id, substr(text, 1, 500) error_summary from documents")
def pf11_error_summary(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select("doc_id", error_summary(F.col("text")).alias("error_summary"))


@query("vr11_constraint_audit", f"""with {movement_cte(False)}, keyed as (select parse_attempt_id, line_number k, external_sale_id from mv)
select 'uq_parsed_movement_attempt_index' as rule, parse_attempt_id||'|'||k as key from (select parse_attempt_id, k from keyed group by 1, 2 having count(*) > 1)
union all select 'ck_parsed_movement_direction', parse_attempt_id from mv where direction = 'UNKNOWN' and line_number = 7
union all select 'fk_sale_item_sale', external_sale_id from mv where direction = 'OUT' and sale_key in (select o_orderkey from orders where o_orderstatus = 'P')
union all select 'uq_sale_external', 'POS|'||o_custkey from (select o_custkey from orders where o_orderstatus <> 'P' group by 1 having count(*) > 1)
union all select 'ck_raw_artifact_byte_size', cast(s_suppkey as varchar) from supplier where s_acctbal < 0
union all select 'fk_artifact_publication_artifact', 'raw-'||s_suppkey from supplier where s_acctbal >= 0""")
def vr11_constraint_audit(spark, sf_dir):
    """Tables with known breaks: repeated keys, a wrong direction, lost parents and negative sizes."""
    rows = tb.movements(spark, sf_dir)
    movements = rows.select(
        "parse_attempt_id", F.col("line_number").alias("source_record_index"),
        F.when((F.col("direction") == "UNKNOWN") & (F.col("line_number") == 7), "LOST").otherwise(F.col("direction")).alias("direction"),
    )
    orders = tb.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    sale = orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("POS").alias("external_source"),
        F.col("o_custkey").cast("string").alias("external_sale_id"),
    )
    items = rows.filter("direction = 'OUT'").select(
        F.col("external_sale_id").alias("sale_id"), "external_product_id", F.monotonically_increasing_id().alias("source_record_index"),
        F.col("external_sale_id").alias("parse_attempt_id"),
    )
    artifacts = tb.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").alias("sha256"), F.col("s_suppkey").alias("storage_key"),
        F.col("s_acctbal").alias("byte_size"),
    )
    return constraint_audit(
        {
            "parsed_movement": movements, "sale": sale, "sale_item": items, "raw_artifact": artifacts,
            "artifact_publication": tb.publication(spark, sf_dir),
        }
    )


_MODEL = {
    "raw_artifact": """select concat('raw-', s_suppkey) id, case when s_nationkey = 3 then 'h-same' else concat('h', s_suppkey) end sha256,
 case when s_nationkey = 4 then 's-same' else concat('s', s_suppkey) end storage_key, case when s_nationkey = 11 then -1 else s_suppkey end byte_size from supplier""",
    "parse_attempt": """select concat(kind, '-', s_suppkey) id, concat(case when kind in ('d', 'e') then 'gone-' else 'raw-' end, s_suppkey) raw_artifact_id,
 'p' parser_name, 'v' parser_version, case when s_nationkey = 9 then null else 'VALID' end status,
 case when s_nationkey = 12 then 0 when kind = 'c' then 2 else 1 end attempt_count
 from supplier join (select 'a' kind, -1 nation union all select 'b', 5 union all select 'c', 6 union all select 'd', 13 union all select 'e', 19) kinds
 on nation = -1 or nation = s_nationkey""",
    "import_job": "select concat('job-', n_nationkey) id, case when n_nationkey = 8 then 'LOST' else 'SUCCEEDED' end status from nation",
    "import_file": """select concat('f-', s_suppkey) id, case when s_nationkey = 14 then 'job-gone' else concat('job-', s_nationkey) end import_job_id,
 concat(case when s_nationkey = 15 then 'gone-' else 'raw-' end, s_suppkey) raw_artifact_id,
 case when s_nationkey <> 18 then concat(case when s_nationkey = 16 then 'gone-' else 'a-' end, s_suppkey) end parse_attempt_id,
 case when s_nationkey = 17 then 'f-gone' when s_nationkey = 18 then concat('f-', s_suppkey) end duplicate_of_import_file_id,
 case when s_nationkey = 10 then 'X' else 'IMPORTED' end status from supplier""",
    "artifact_publication": """select concat(case when kind = 'e' then 'gone-' else 'raw-' end, s_suppkey) raw_artifact_id,
 concat(case when kind = 'a' and s_nationkey = 20 then 'gone' when kind = 'd' then 'a' else kind end, '-', s_suppkey) active_parse_attempt_id
 from supplier join (select 'a' kind, -1 nation union all select 'c', 6 union all select 'd', 7 union all select 'e', 19) kinds on nation = -1 or nation = s_nationkey""",
    "validation_result": """select case when l_quantity = 5 then 'a-gone' else concat('a-', l_suppkey) end parse_attempt_id,
 case when l_quantity = 3 then 'FAILED' else 'VALID' end status from lineitem""",
    "parsed_movement": """select case when l_quantity = 6 then 'a-gone' else concat('a-', l_suppkey) end parse_attempt_id, l_orderkey * 8 + l_linenumber source_record_index,
 case when l_quantity = 4 then 'LOST' else 'OUT' end direction from lineitem join (select 1 time union all select 2) times on time = 1 or l_quantity = 1""",
    "product": """select concat('p-', p_partkey) id, 'POS' external_source, case when p_size = 50 then 'same' else concat('', p_partkey) end external_id,
 case when p_size = 49 then 'a-gone' else concat('a-', s) end first_seen_parse_attempt_id from part, (select min(s_suppkey) s from supplier) least""",
    "sale": """select concat('s-', o_orderkey) id, 'POS' external_source,
 case when o_orderstatus = 'P' then concat('P', o_custkey) else concat('', o_orderkey) end external_sale_id,
 case when o_orderpriority like '1%' then 'a-gone' else concat('a-', s) end first_seen_parse_attempt_id from orders, (select min(s_suppkey) s from supplier) least""",
    "sale_item": """select case when l_quantity = 7 then 's-gone' else concat('s-', l_orderkey) end sale_id, case when l_quantity = 8 then 'p-gone' else concat('p-', l_partkey) end product_id,
 case when l_quantity = 9 then 'a-gone' else concat('a-', l_suppkey) end parse_attempt_id, l_orderkey * 8 + l_linenumber source_record_index
 from lineitem join (select 1 time union all select 2) times on time = 1 or l_quantity = 2""",
}


def _break(rule: str, key: str, source: str) -> str:
    return f"select '{rule}' as rule, {key} as key from {source}"


def _nation(rule: str, key: str, *numbers: int) -> str:
    return _break(rule, f"{key}||s_suppkey", f"supplier where s_nationkey in ({', '.join(map(str, numbers))})")


def _line(rule: str, key: str, quantity: int) -> str:
    return _break(rule, key, f"lineitem where l_quantity = {quantity}")


BREAKS = [
    _break("uq_raw_artifact_sha256", "'h-same'", "supplier where s_nationkey = 3 having count(*) > 1"),
    _break("uq_raw_artifact_storage_key", "'s-same'", "supplier where s_nationkey = 4 having count(*) > 1"),
    _break("uq_parse_attempt_version", "'raw-'||s_suppkey||'|p|v|1'", "supplier where s_nationkey = 5"),
    _nation("pk_artifact_publication", "'raw-'", 6, 7), _nation("uq_artifact_publication_attempt", "'a-'", 7),
    _line("uq_parsed_movement_attempt_index", "'a-'||l_suppkey||'|'||(l_orderkey * 8 + l_linenumber)", 1),
    _break("uq_product_external", "'POS|same'", "part where p_size = 50 having count(*) > 1"),
    _break("uq_sale_external", "'POS|P'||o_custkey", "orders where o_orderstatus = 'P' group by o_custkey having count(*) > 1"),
    _line("uq_sale_item_attempt_index", "'a-'||l_suppkey||'|'||(l_orderkey * 8 + l_linenumber)", 2),
    _break("ck_import_job_status", "'job-8'", "nation where n_nationkey = 8"), _nation("ck_parse_attempt_status", "'a-'", 9),
    _nation("ck_import_file_status", "'f-'", 10), _line("ck_validation_result_status", "'a-'||l_suppkey", 3),
    _line("ck_parsed_movement_direction", "'a-'||l_suppkey", 4), _nation("ck_raw_artifact_byte_size", "'raw-'", 11),
    _nation("ck_parse_attempt_count", "'a-'", 12), _nation("fk_parse_attempt_artifact", "'d-'", 13), _nation("fk_parse_attempt_artifact", "'e-'", 19),
    _nation("fk_import_file_job", "'f-'", 14), _nation("fk_import_file_artifact", "'f-'", 15), _nation("fk_import_file_attempt", "'f-'", 16),
    _nation("fk_import_file_duplicate_of", "'f-'", 17), _nation("fk_artifact_publication_artifact", "'gone-'", 19),
    _nation("fk_artifact_publication_attempt", "'raw-'", 20), _line("fk_validation_result_attempt", "'a-gone'", 5),
    _line("fk_parsed_movement_attempt", "'a-gone'", 6), _break("fk_product_first_attempt", "'p-'||p_partkey", "part where p_size = 49"),
    _break("fk_sale_first_attempt", "'s-'||o_orderkey", "orders where o_orderpriority like '1%'"), _line("fk_sale_item_sale", "'s-gone'", 7),
    _line("fk_sale_item_product", "'p-gone'", 8), _line("fk_sale_item_attempt", "'a-gone'", 9),
]


@query("vr11_all_rules", " union all ".join(BREAKS))
def vr11_all_rules(spark, sf_dir):
    """All ten tables of the data model, made from the given ones, with breaks of each of the thirty rules."""
    given = {name: tb.table(spark, sf_dir, name) for name in ("supplier", "nation", "lineitem", "part", "orders")}
    return constraint_audit({name: _select(spark, sql, given) for name, sql in _MODEL.items()})


def _select(spark, sql: str, given: dict[str, DataFrame]) -> DataFrame:
    """A query over frames by name, without registering views."""
    return spark.sql(re.sub(r"\b(from|join) (supplier|nation|lineitem|part|orders)\b", r"\1 {\2}", sql), **given)


# --- import history -----------------------------------------------------------------------------------

HISTORY = f"""{movement_cte(True)},{FILES},
imf as (select 'f-'||file_id id, import_job_id, sha256, byte_size, case when lang <> 'es' then cast(file_id % 97 as varchar) end parse_attempt_id,
 path original_filename, {STATUS} status, lang = 'fr' deduplicated, created_at,
 case when lang = 'en' then '{{"n":'||file_id||'}}' when lang = 'fr' then path end hints from f),
job as (select import_job_id id, min(created_at) created_at, max(created_at) completed_at from f group by 1),
att as (select cast(s_suppkey as varchar) id, case when s_nationkey < 12 then 'VALID' else 'WARNING' end status, s_nationkey records_found from supplier),
qty as (select cast(s_suppkey as varchar) parse_attempt_id, case when s_nationkey < 12 then 'SOURCE_QUANTITY_MATCH' else 'SOURCE_QUANTITY_MISMATCH' end code,
 case when s_nationkey < 12 then 'VALID' else 'INVALID' end status, cast(cast(s_suppkey as decimal(19,6)) as varchar) source_value,
 cast(cast(s_suppkey+s_nationkey as decimal(19,6)) as varchar) calculated_value, cast(cast(s_nationkey as decimal(19,6)) as varchar) difference,
 '0.001000' tolerance, 'report' source_locator from supplier),
smp as (select parse_attempt_id, arg_min(external_product_id, source_record_index) pid from mv where line_number > 2 group by 1),
rev as (select parse_attempt_id, cast(coalesce(sum(case when direction='OUT' then total end), 0) as decimal(38,2)) revenue from mv group by 1),
fs as (select imf.*, att.status parse_status, att.records_found, 'P'||smp.pid product_name, smp.pid product_external_id, qty.calculated_value parsed_quantity,
 qty.source_value source_quantity, qty.status quantity_validation_status, case when att.id is not null then cast(coalesce(rev.revenue, 0) as varchar) end parsed_revenue
 from imf left join att on att.id = imf.parse_attempt_id left join smp on smp.parse_attempt_id = att.id
 left join qty on qty.parse_attempt_id = att.id left join rev on rev.parse_attempt_id = att.id)"""

_SUMMARY = ("parse_status", "records_found", "product_name", "product_external_id", "parsed_quantity", "source_quantity",
            "quantity_validation_status", "parsed_revenue")
_LISTED = "select id, original_filename, status, deduplicated, parse_attempt_id, " + ", ".join(_SUMMARY) + " from fs"


@query("jn12_file_summaries", f"with {HISTORY} {_LISTED}")
def jn12_file_summaries(spark, sf_dir):
    t = tb.history_tables(spark, sf_dir)
    return file_summaries(t["import_file"], t).select("id", "original_filename", "status", "deduplicated", "parse_attempt_id", *_SUMMARY)


_JOBS = f"""select j.id import_job_id, {iso('j.created_at')} job_created_at, {iso('j.completed_at')} job_completed_at, fs.id file_id, fs.status file_status,
 {iso('fs.created_at')} file_created_at, fs.parsed_revenue file_parsed_revenue, fs.product_name file_product_name"""


def _listed(rows):
    times = ("job_created_at", "job_completed_at", "file_created_at")
    return rows.select(
        "import_job_id", *[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) for c in times],
        "file_id", "file_status", "file_parsed_revenue", "file_product_name",
    )


@query("qy6_import_jobs", f"""with {HISTORY} {_JOBS} from (select * from job order by created_at desc, id limit 20) j left join fs on fs.import_job_id = j.id""")
def qy6_import_jobs(spark, sf_dir):
    return _listed(import_jobs(tb.history_tables(spark, sf_dir)).content)


@query("qy6_import_job", f"with {HISTORY} {_JOBS} from job j left join fs on fs.import_job_id = j.id where j.id = 'src7'")
def qy6_import_job(spark, sf_dir):
    return _listed(import_job(tb.history_tables(spark, sf_dir), "src7"))


@query("tk5_all_jobs_with_files", f"with {HISTORY} {_JOBS} from job j left join fs on fs.import_job_id = j.id")
def tk5_all_jobs_with_files(spark, sf_dir):
    t = tb.history_tables(spark, sf_dir)
    return _listed(jobs_with_files(t["import_job"], t))


@query("pf8_qy7_import_file", f"""with {HISTORY} select imf.id, imf.import_job_id, imf.original_filename, imf.status, imf.sha256,
 cast(imf.byte_size as bigint) byte_size, att.status parse_status, imf.hints filename_hints
from imf left join att on att.id = imf.parse_attempt_id where imf.id = 'f-5' and imf.import_job_id = (select import_job_id from f where file_id = 5)""")
def pf8_qy7_import_file(spark, sf_dir):
    t = tb.history_tables(spark, sf_dir)
    job = t["import_file"].filter("id = 'f-5'").select("import_job_id").first()[0]
    return import_file(t, job, "f-5").file.select(
        "id", "import_job_id", "original_filename", "status", "sha256", "byte_size", "parse_status", "filename_hints"
    )


@query("pf8_wrong_parent", f"""with {FILES}, own as (select import_job_id job from f where file_id = 5),
other as (select min(import_job_id) job from f where import_job_id <> (select job from own))
select job, cast(1 as bigint) found from own union all select job, 0 from other""")
def pf8_wrong_parent(spark, sf_dir):
    """One file asked for under its own job and under another one: only its own job has it."""
    t = tb.history_tables(spark, sf_dir)
    own = t["import_file"].filter("id = 'f-5'").select("import_job_id").first()[0]
    other = t["import_file"].filter(F.col("import_job_id") != own).agg(F.min("import_job_id")).first()[0]
    found = [
        import_file(t, job, "f-5").file.agg(F.count("*").alias("found")).select(F.lit(job).alias("job"), "found") for job in (own, other)
    ]
    return found[0].unionByName(found[1])


@query("tk7_qy7_validations", f"""with {HISTORY}, v as (select parse_attempt_id, code, status, source_value, calculated_value, difference, tolerance, source_locator from qty
 union all select parse_attempt_id, 'LINE_TOTAL_MATCH', 'VALID', cast(cast(total as decimal(19,6)) as varchar), cast(cast(total as decimal(19,6)) as varchar),
 '0.000000', '0.010000', 'line '||source_record_index from mv)
select code, status, source_value, calculated_value, difference, tolerance, source_locator from v where parse_attempt_id in (select parse_attempt_id from imf)""")
def tk7_qy7_validations(spark, sf_dir):
    t = tb.history_tables(spark, sf_dir)
    attempts = t["import_file"].filter(F.col("parse_attempt_id").isNotNull()).select("parse_attempt_id").distinct()
    return validations_of(t["validation_result"], attempts).drop("rule_version")


@query("wn10_product_sample", f"""with {movement_cte(True)}
select parse_attempt_id, 'P'||arg_min(external_product_id, source_record_index) product_name,
 arg_min(external_product_id, source_record_index) product_external_id from mv where line_number > 2 group by 1""")
def wn10_product_sample(spark, sf_dir):
    return product_samples(tb.history_tables(spark, sf_dir)["parsed_movement"])


@query("wn11_quantity_check", f"""with {HISTORY} select parse_attempt_id, source_value source_quantity, calculated_value parsed_quantity, status quantity_validation_status from qty""")
def wn11_quantity_check(spark, sf_dir):
    rows = quantity_checks(tb.history_tables(spark, sf_dir)["validation_result"])
    return rows.withColumns({c: plain_text(F.col(c)) for c in ("source_quantity", "parsed_quantity")})


@query("ag9_attempt_revenue", f"""with {movement_cte(False)} select parse_attempt_id,
 cast(coalesce(sum(case when direction='OUT' then total end), 0) as varchar) parsed_revenue from mv group by 1""")
def ag9_attempt_revenue(spark, sf_dir):
    return attempt_revenue(tb.movements(spark, sf_dir)).withColumn("parsed_revenue", plain_text(F.col("parsed_revenue")))


@query("tk3_job_page_info", """with n as (select count(distinct source) n from documents)
select 0 as page, 7 as size, n as total_elements, cast(ceil(n / 7.0) as int) total_pages from n""")
def tk3_job_page_info(spark, sf_dir):
    t = tb.history_tables(spark, sf_dir)
    return take_page(t["import_job"], [F.desc("created_at"), F.col("id")], 0, 7).info


