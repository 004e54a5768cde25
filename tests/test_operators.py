"""Operators against small fixtures and brute force, and the joins."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillmark.operators import bookkeeping as books
from tillmark.operators import joins, paging, publishing, validation
from tillmark.operators.series import hour_histogram, leader_share, series_summary
from tillmark.sources.audits import constraint_audit, integrity_audit, orphan_files, rule_events
from tillmark.sources.files import BatchRejected, check_batch, with_admission

HOW = ["inner", "left", "left_semi", "left_anti"]


@pytest.mark.parametrize("how", HOW)
def test_lookup_join_equals_plain_join(spark, how):
    rng = random.Random(7)
    facts = spark.createDataFrame([(rng.choice([1, 1, 1, 1, 2, 3, None, 9]), i) for i in range(3000)], "k int, v int")
    lookup = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, name string")
    want = sorted(map(str, facts.join(lookup, "k", how).collect()))

    def rows(joined):
        return sorted(map(str, joined.collect()))

    assert rows(joins.lookup_join(facts, lookup, ["k"], how)) == want


def test_adaptive_execution_splits_a_hot_key(spark):
    changed = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
               "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        lookup = spark.range(200_000).select(F.col("id").alias("k"), F.col("id").alias("n"))
        joined = joins.lookup_join(facts, lookup, ["k"])
        assert len(joined.collect()) == 200_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rank_in_slices_equals_row_number(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.choice("aab"), i, rng.random()) for i in range(500)], "k string, n int, r double")
    got = joins.rank_in_slices(rows, ["k"], F.expr("n div 37"), [F.col("n")], "rank").select("k", "n", "rank").collect()
    want = {}
    for k, n in sorted((r.k, r.n) for r in got):
        want[(k, n)] = sum(1 for r in got if r.k == k and r.n < n)
    assert {(r.k, r.n): r["rank"] for r in got} == want


def brute_force_turns(reports, sales, held):
    """One report after another: active sale ids per artifact, replaced only on publication."""
    active = {}
    for artifact, sale in held:
        active.setdefault(artifact, set()).add(sale)
    result = {}
    for artifact, _, accepted, has_product in sorted(reports, key=lambda r: r[1]):
        mine = [(s, out) for a, s, out in sales if a == artifact]
        others = set().union(*[v for a, v in active.items() if a != artifact], set())
        overlap = accepted and any(out and s in others for s, out in mine)
        published = accepted and has_product and not overlap
        if published:
            active[artifact] = {s for s, _ in mine}
        result[artifact] = (overlap, published)
    return result


@pytest.mark.parametrize("seed", range(4))
def test_turn_by_turn_publication_equals_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    n = 25
    reports = [(f"a{i}", rng.random() if seed else float(i), rng.random() < 0.85, rng.random() < 0.85) for i in range(n)]
    # Seed 0 is a chain: each report shares one sale with the one before it.
    if seed == 0:
        sales = [(f"a{i}", f"s{j}", True) for i in range(n) for j in (i, i + 1)]
        held = []
    else:
        sales = list({(f"a{rng.randrange(n)}", f"s{rng.randrange(18)}"): rng.random() < 0.7 for _ in range(70)}.items())
        sales = [(a, s, out) for (a, s), out in sales]
        held = list({(rng.choice([f"a{rng.randrange(n)}", f"old{rng.randrange(3)}"]), f"s{rng.randrange(25)}") for _ in range(6)})
    got = publishing.decide_publication(
        spark.createDataFrame(reports, "raw_artifact_id string, turn double, accepted boolean, has_product boolean"),
        spark.createDataFrame(sales, "raw_artifact_id string, external_sale_id string, is_out boolean"),
        spark.createDataFrame(held, "raw_artifact_id string, external_sale_id string"),
        str(tmp_path),
    ).collect()
    assert {r.raw_artifact_id: (r.overlap, r.published) for r in got} == brute_force_turns(reports, sales, held)


def decided(spark, folder, reports, sales, held):
    got = publishing.decide_publication(
        spark.createDataFrame(reports, "raw_artifact_id string, turn double, accepted boolean, has_product boolean"),
        spark.createDataFrame(sales, "raw_artifact_id string, external_sale_id string, is_out boolean"),
        spark.createDataFrame(held, "raw_artifact_id string, external_sale_id string"),
        str(folder),
    )
    return {r.raw_artifact_id: (r.overlap, r.published) for r in got.collect()}


@pytest.mark.parametrize("seed", range(5))
def test_chains_equal_brute_force(spark, tmp_path, seed):
    """Links of both kinds: sale ids a rival gains by publishing, and sale ids it gives up by publishing."""
    rng = random.Random(100 + seed)
    n = 30
    reports = [(f"a{i}", float(i), rng.random() < 0.95, rng.random() < 0.9) for i in range(n)]
    sales, held = {(f"a{i}", f"own{i}"): True for i in range(n)}, set()
    for i in range(1, n):
        to = i - 1 if rng.random() < 0.7 else rng.randrange(i)
        sales[(f"a{i}", f"link{i}")] = True
        kind = rng.random()
        if kind < 0.6:
            sales[(f"a{to}", f"link{i}")] = rng.random() < 0.5
        if kind > 0.5:
            held.add((f"a{to}", f"link{i}"))
        if rng.random() < 0.15:
            sales[(f"a{i}", f"link{rng.randrange(1, n)}")] = True
    sales = [(a, s, out) for (a, s), out in sales.items()]
    assert decided(spark, tmp_path, reports, sales, sorted(held)) == brute_force_turns(reports, sales, held)


@pytest.mark.parametrize("n, cuts", [(40, 12), (1000, 25)])
def test_a_chain_takes_few_cuts(spark, tmp_path, n, cuts):
    reports = [(f"a{i}", float(i), True, True) for i in range(n)]
    sales = [(f"a{i}", f"s{j}", True) for i in range(n) for j in (i, i + 1)]
    assert decided(spark, tmp_path, reports, sales, [("old", "nothing")]) == brute_force_turns(reports, sales, [])
    assert sum(path.name.startswith("cut-") for path in tmp_path.iterdir()) <= cuts


def test_many_reports_wait_for_one(spark, tmp_path):
    reports = [(f"a{i}", float(i), i != 5, True) for i in range(60)]
    sales = [("a0", "s0", True), ("a1", "s0", True), ("a1", "s1", True)]
    sales += [(f"a{i}", s, True) for i in range(2, 60) for s in ("s1", f"t{i % 20}")]
    assert decided(spark, tmp_path, reports, sales, [("a1", "s1")]) == brute_force_turns(reports, sales, [("a1", "s1")])


def movement(i, direction="OUT", quantity="1", price="10", discount="0", total="10", previous=None, resulting=None):
    number = lambda v: None if v is None else Decimal(v)
    return ("r", i, direction, number(quantity), number(price), number(discount), number(total), number(previous), number(resulting), (1, i, None, f"y={i}"), None)


MOVEMENT = (
    "k string, source_record_index int, direction string, quantity decimal(19,6), unit_price decimal(19,6), discount_percentage decimal(19,6), "
    "total decimal(19,6), previous_stock decimal(19,6), resulting_stock decimal(19,6), "
    "locator struct<page:int,record_index:int,byte_offset:bigint,detail:string>, invalid_time string"
)


def test_movement_checks(spark):
    rows = spark.createDataFrame(
        [
            movement(0, previous="5", resulting="4"), movement(1, total="99"), movement(2, "IN", discount=None, previous="5", resulting="1"),
            movement(3, "UNKNOWN", None, None, None, None), movement(4, previous="5", resulting="1"),
            movement(5, quantity="0.416", price="56.90", discount="8", total="21.78"), movement(6, total="10.01"), movement(7, total="10.02"),
            movement(8, previous="5", resulting="4.001"), movement(9, previous="5", resulting="4.002"),
        ],
        MOVEMENT,
    )
    got = sorted((r.locator.record_index, r.code, r.severity) for r in validation.movement_issues(rows, "k").collect())
    match, mismatch, stock = ("LINE_TOTAL_MATCH", "Info"), ("LINE_TOTAL_MISMATCH", "Warning"), ("STOCK_CONTINUITY_MISMATCH", "Warning")
    assert got == sorted(
        [(i, *match) for i in (0, 2, 4, 5, 6, 8, 9)] + [(i, *mismatch) for i in (1, 7)] + [(i, *stock) for i in (4, 9)]
    )


def test_outcome_order(spark):
    cases = [((1, 1, 1, 1), "FAILED"), ((0, 1, 1, 1), "INVALID"), ((0, 0, 0, 1), "WARNING"), ((0, 0, 1, 0), "WARNING"), ((0, 0, 0, 0), "VALID")]
    rows = spark.createDataFrame([tuple(bool(v) for v in c) + (w,) for c, w in cases], "f boolean, e boolean, w boolean, o boolean, want string")
    assert all(r[0] == r[1] for r in rows.select(validation.parse_outcome(*[F.col(c) for c in "fewo"]), "want").collect())


def test_duplicate_states(spark):
    cases = [(None, False, "PROCESSING", True), ("FAILED", False, "PROCESSING", True), ("PENDING", True, "PROCESSING", False), ("PROCESSING", False, "PROCESSING", False),
             ("VALID", True, "IMPORTED", False), ("VALID", False, "IMPORTED", False), ("WARNING", True, "IMPORTED", False), ("WARNING", False, "WARNING", False), ("INVALID", False, "INVALID", False)]
    rows = spark.createDataFrame(cases, "s string, p boolean, want string, parse boolean")
    got = rows.select(books.arriving_file_status(F.col("s"), F.col("p")), "want", books.needs_parse(F.col("s")), "parse").collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_job_rollup(spark):
    files = [("good", "IMPORTED"), ("warned", "WARNING"), ("mixed", "IMPORTED"), ("mixed", "FAILED"), ("bad", "FAILED"), ("open", "IMPORTED"), ("open", "PROCESSING")]
    rows = spark.createDataFrame(files, "import_job_id string, status string")
    jobs = spark.createDataFrame([(j,) for j in ("good", "warned", "mixed", "bad", "open", "empty")], "id string")
    got = {r.id: r.rolled_status for r in books.job_rollup(jobs, rows).collect()}
    assert got == {"good": "SUCCEEDED", "warned": "SUCCEEDED", "mixed": "PARTIAL_SUCCESS", "bad": "FAILED", "open": None, "empty": "FAILED"}


def test_counters(spark):
    t = dt.datetime(2026, 1, 1)
    files = [("IMPORTED", False, 0), ("WARNING", True, 5), ("INVALID", False, 1), ("FAILED", True, 2), ("PROCESSING", True, 9)]
    rows = spark.createDataFrame([(s, d, t, t + dt.timedelta(milliseconds=ms)) for s, d, ms in files], "status string, deduplicated boolean, created_at timestamp, completed_at timestamp")
    jobs = spark.createDataFrame([("PROCESSING",), ("SUCCEEDED",), ("PARTIAL_SUCCESS",), ("FAILED",)], "status string")
    artifacts = spark.createDataFrame([(0,), (10,)], "byte_size long")
    got = {r.name: r.value for r in books.import_counters(jobs, rows, artifacts).collect()}
    assert got == {"imports.completed": 3, "imports.duplicates": 2, "imports.warnings": 1, "imports.failures": 2, "imports.duration.ms": 8, "raw.storage.bytes": 10}


def test_admission(spark):
    rows = spark.createDataFrame([("/a.QRP", 1), ("/b.qrp", 0), ("/c.qrp", 11), ("/d.txt", 5)], "path string, length long")
    got = {r.path: r.reject_reason for r in with_admission(rows, 10).collect()}
    assert got == {"/a.QRP": None, "/b.qrp": "EMPTY", "/c.qrp": "TOO_LARGE", "/d.txt": "WRONG_EXTENSION"}
    check_batch(rows.limit(1), max_bytes=10)
    with pytest.raises(BatchRejected):
        check_batch(rows, max_bytes=10)
    with pytest.raises(BatchRejected):
        check_batch(spark.range(21).selectExpr("concat('/', id, '.qrp') path", "1L length"))


def test_orphans(spark):
    t = dt.datetime(2026, 1, 1)
    stored = spark.createDataFrame(
        [("aa/known", 1, t), ("aa/old", 2, t), ("aa/young", 3, t + dt.timedelta(hours=3)), ("aa/.hidden", 4, t)], "storage_key string, length long, modificationTime timestamp"
    )
    registry = spark.createDataFrame([("aa/known",)], "storage_key string")
    assert [r.storage_key for r in orphan_files(stored, registry, t + dt.timedelta(hours=1)).collect()] == ["aa/old"]


def test_integrity_order(spark):
    import hashlib

    def sha(b):
        return hashlib.sha256(b).hexdigest()

    registry = spark.createDataFrame([("ok", sha(b"abc"), 3), ("gone", "x", 1), ("size", sha(b"abcd"), 3), ("hash", "x", 3)], "storage_key string, sha256 string, byte_size long")
    stored = spark.createDataFrame([("ok", bytearray(b"abc")), ("size", bytearray(b"abcd")), ("hash", bytearray(b"abc"))], "storage_key string, content binary")
    got = {r.storage_key: r.integrity for r in integrity_audit(registry, stored).collect()}
    assert got == {"ok": "OK", "gone": "MISSING", "size": "SIZE_MISMATCH", "hash": "HASH_MISMATCH"}


def test_audit_scans_each_table_once(spark, tmp_path):
    schemas = {
        "raw_artifact": "id string, sha256 string, storage_key string, byte_size long",
        "parse_attempt": "id string, raw_artifact_id string, parser_name string, parser_version string, status string, attempt_count int",
        "artifact_publication": "raw_artifact_id string, active_parse_attempt_id string",
    }
    rows = {"raw_artifact": [("r", "h", "s", 1)], "parse_attempt": [("a", "r", "p", "v", "VALID", 1)], "artifact_publication": [("r", "a")]}

    def audit(**more):
        tables = {}
        for name, schema in schemas.items():
            path = str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}")
            spark.createDataFrame(rows[name] + more.get(name, []), schema).write.parquet(path)
            tables[name] = spark.read.schema(schema).parquet(path)
        return tables, sorted((r.rule, r.key) for r in constraint_audit(tables).collect())

    tables, found = audit()
    plan = rule_events(tables).groupBy("space", "value").count()._jdf.queryExecution().executedPlan().toString()
    assert found == [] and plan.count("FileScan") == 3
    hot = [(f"a{i}", "gone", "p", "v", "VALID", 1 if i else 0) for i in range(30)]
    _, found = audit(parse_attempt=hot, artifact_publication=[("r", "a5")])
    assert found == sorted(
        [("fk_parse_attempt_artifact", f"a{i}") for i in range(30)]
        + [("uq_parse_attempt_version", "gone|p|v|1"), ("ck_parse_attempt_count", "a0"), ("pk_artifact_publication", "r"), ("fk_artifact_publication_attempt", "r")]
    )


def test_far_pages(spark, monkeypatch):
    """Page 100,000, ties, pages across ranges, the last page and pages behind it; only a small part is sorted at the end."""
    rows = spark.range(1_000_500).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), "id")
    order = [F.desc("k"), F.col("id")]
    want = sorted(((-r.k, r.id) for r in rows.toLocalIterator()))
    for page, size in ((100_000, 10), (100_049, 10), (10_004, 100), (10_005, 100)):
        content = paging.take_page(rows, order, page, size).content
        assert [(-r.k, r.id) for r in content.collect()] == want[page * size : (page + 1) * size]
    part, offset = paging.narrowed(rows, order, 1_000_000, 10)
    assert part.count() <= paging.SMALL and offset < paging.SMALL
    monkeypatch.setattr(paging, "SMALL", 50)  # several levels, and rows that cannot be told apart
    monkeypatch.setattr(paging, "RANGES", 7)
    few = spark.range(3_000).select(F.least("id", F.lit(2_000)).alias("k"), "id")
    for offset in (0, 1_234, 1_990, 2_500):
        part, left = paging.narrowed(few, [F.col("k")], offset, 20)
        assert [r.k for r in part.orderBy("k").offset(left).limit(20).collect()] == [min(i, 2_000) for i in range(offset, offset + 20)]


def test_series_summary(spark):
    def summary(*values):
        rows = spark.createDataFrame([(dt.date(2026, 1, i + 1), Decimal(v)) for i, v in enumerate(values)], "date date, v decimal(28,6)")
        r = series_summary(rows, "v").first()
        return r and (r.points, float(r.peak), r.peak_date and r.peak_date.day, float(r.scale_max), r.clipped)

    assert summary("1", "5", "5") == (3, 5.0, 3, 5.0, False)
    assert summary("1", "10", "2") == (3, 10.0, 2, 2.5, True)
    assert summary("1", "10") == (2, 10.0, 2, 10.0, False)
    assert summary("0", "10", "0") == (3, 10.0, 2, 10.0, False)
    assert summary("0", "0") == (2, 0.001, None, 0.001, False)
    assert spark.createDataFrame([], "date date, v decimal(28,6)").transform(lambda d: series_summary(d, "v")).count() == 0


def test_share_and_hours(spark):
    rows = spark.createDataFrame([(Decimal("100"), Decimal("100")), (Decimal("1"), Decimal("100")), (Decimal("0"), Decimal("0"))], "v decimal(9,2), m decimal(9,2)")
    assert [r[0] for r in rows.select(leader_share(F.col("v"), F.col("m"))).collect()] == [100.0, 4.0, 4.0]
    hours = spark.createDataFrame([(8, Decimal("1")), (11, Decimal("2")), (11, None), (None, Decimal("9"))], "hour int, exits decimal(9,2)")
    assert [(r.hour, int(r.quantity)) for r in hour_histogram(hours).orderBy("hour").collect()] == [(8, 1), (9, 0), (10, 0), (11, 2)]
