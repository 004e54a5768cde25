"""From decided reports to the product, sale and sale-item tables, and the pointer that makes them visible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.fixed import DEFAULT_PROFILE, ReportProfile
from tillmark.functions.marks import stable_id
from tillmark.operators.joins import absent_from, lookup_join
from tillmark.schemas import MONEY, QUANTITY
from tillmark.session import durable

# The contested rows are written anew whenever only one in this many unsettled reports is left.
COMPACT_AT = 4


def active_movements(movements: DataFrame, publication: DataFrame) -> DataFrame:
    """Movements of active attempts, with the artifact that owns them."""
    pointer = publication.select(
        F.col("active_parse_attempt_id").alias("parse_attempt_id"), F.col("raw_artifact_id")
    )
    return lookup_join(movements, pointer, ["parse_attempt_id"])


def out_sale_ids(movements: DataFrame, key: str = "parse_attempt_id") -> DataFrame:
    """AG12: distinct sale ids of the OUT rows."""
    return movements.filter((F.col("direction") == "OUT") & F.col("external_sale_id").isNotNull()).select(
        key, "external_sale_id"
    ).distinct()


def overlapping_artifacts(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """JN8: artifacts whose OUT sale ids are held by the active attempt of another artifact.

    ``incoming`` and ``held`` are (raw_artifact_id, external_sale_id). Only the lowest and highest holder
    of a sale id are kept: some holder differs from an artifact exactly when one of these two does.
    """
    holders = held.groupBy("external_sale_id").agg(
        F.min("raw_artifact_id").alias("_low"), F.max("raw_artifact_id").alias("_high")
    )
    met = lookup_join(incoming, holders, ["external_sale_id"])
    own = F.col("raw_artifact_id")
    return met.filter((F.col("_low") != own) | (F.col("_high") != own)).select("raw_artifact_id").distinct()


def decide_publication(
    reports: DataFrame, sales: DataFrame, held: DataFrame, folder: str | None = None
) -> DataFrame:
    """JN8 and VR6 for a batch of reports that take their turn one after another.

    reports: raw_artifact_id, turn (unique, increasing), accepted (no fatal, no error), has_product.
    sales:   raw_artifact_id, external_sale_id, is_out; one row per report and sale id.
    held:    raw_artifact_id, external_sale_id of what is published before the batch.
    Returns reports with ``overlap`` and ``published``.

    A report is kept out when, at its turn, another artifact's active attempt holds one of its OUT sale
    ids. Each round settles every report whose earlier rivals are settled; rivals are compared through
    the two smallest turns per sale id, so no pairs of reports are formed. A report that waits for one rival
    alone publishes if that one does or if it does not; such links are followed by doubling, so a chain of n
    reports takes about log2(n) joins in one round. A round only reads what is still contested, and the
    smallest open turn is always settled, so the rounds end.
    """
    state = durable(
        reports.select(
            "raw_artifact_id",
            "turn",
            F.col("accepted").alias("open"),
            (F.col("accepted") & F.col("has_product")).alias("may_publish"),
            F.lit(False).alias("overlap"),
            F.lit(False).alias("published"),
        ),
        folder,
    )
    contested = durable(_contested_sales(state, sales, held), folder)
    unsettled = None
    while unsettled != 0:
        links = _followed(durable(_verdicts(state, contested), folder), folder)
        state = durable(_settled(state, links), folder)
        still_open = state.filter("open").count()
        if still_open and (unsettled is None or still_open * COMPACT_AT <= unsettled):
            contested = durable(_still_asked(contested, state), folder)
            unsettled = still_open
        elif not still_open:
            unsettled = 0
    return reports.join(state.select("raw_artifact_id", "overlap", "published"), "raw_artifact_id")


def _still_asked(contested: DataFrame, state: DataFrame) -> DataFrame:
    """Contested rows of the sale ids that some unsettled report still asks for."""
    asking = lookup_join(contested.filter("is_out"), state.filter("open").select("turn"), ["turn"], "left_semi")
    return lookup_join(contested, asking.select("external_sale_id").distinct(), ["external_sale_id"], "left_semi")


def _contested_sales(state: DataFrame, sales: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (sale id, turn, is_out, old) of sale ids wanted by a report and held by more than that report."""
    turns = state.select("raw_artifact_id", "turn")
    new = lookup_join(sales, turns, ["raw_artifact_id"]).select(
        "external_sale_id", "turn", "is_out", F.lit(False).alias("old")
    )
    wanted = new.filter("is_out").select("external_sale_id").distinct()
    # A turn of null marks a holder that is not part of the batch and therefore stays published.
    old = lookup_join(lookup_join(held, wanted, ["external_sale_id"], "left_semi"), turns, ["raw_artifact_id"], "left")
    rows = new.unionByName(
        old.select("external_sale_id", "turn", F.lit(False).alias("is_out"), F.lit(True).alias("old"))
    )
    rivals = (
        rows.groupBy("external_sale_id")
        .agg(
            F.bool_or("is_out").alias("wanted"),
            F.min("turn").alias("low"),
            F.max("turn").alias("high"),
            F.bool_or(F.col("turn").isNull()).alias("outside"),
        )
        .filter(F.col("wanted") & (F.col("outside") | (F.col("low") != F.col("high"))))
        .select("external_sale_id")
    )
    return lookup_join(rows, rivals, ["external_sale_id"], "left_semi")


def _verdicts(state: DataFrame, contested: DataFrame) -> DataFrame:
    """Every open report: ``free`` (null while it waits), and the one rival it waits ``for``.

    With ``opposite`` the report is free exactly when that rival does not publish, else exactly when it does, which
    is the case where the rival holds the sale id from before and gives it up by publishing.
    """
    known = state.select("turn", "open", "may_publish", "published")
    rows = lookup_join(contested, known, ["turn"], "left")
    undecided = F.col("open") & F.col("may_publish")
    never = ~F.coalesce(F.col("published"), F.lit(False)) & ~undecided
    at = F.col("turn")
    per_sale = rows.groupBy("external_sale_id").agg(
        F.bool_or(at.isNull()).alias("outside"),
        F.min(F.when(F.col("published") & ~F.col("old"), at)).alias("new_holder"),
        F.min(F.when(never & F.col("old"), at)).alias("kept_holder"),
        F.max(F.when(F.col("old"), at)).alias("later_holder"),
        F.min(F.when(undecided, at)).alias("first"),
    )
    is_first = at == F.col("first")
    seconds = lookup_join(rows, per_sale.select("external_sale_id", "first"), ["external_sale_id"]).groupBy("external_sale_id").agg(
        F.min(F.when(undecided & ~is_first, at)).alias("second"),
        F.bool_or(is_first & ~F.col("old")).alias("gains"),
        F.bool_or(is_first & F.col("old")).alias("gives_up"),
    )
    asking = rows.filter(F.col("is_out") & F.col("open")).select("external_sale_id", "turn")
    met = lookup_join(asking, per_sale.join(seconds, "external_sale_id"), ["external_sale_id"])
    blocked = (
        F.col("outside")
        | F.coalesce(F.col("new_holder") < at, F.lit(False))
        | F.coalesce(F.col("kept_holder") < at, F.lit(False))
        | F.coalesce(F.col("later_holder") > at, F.lit(False))
    )
    waits = F.coalesce(F.col("first") < at, F.lit(False))
    found = met.groupBy("turn").agg(
        F.bool_or(blocked).alias("blocked"),
        F.min(F.when(waits, F.col("first"))).alias("low"),
        F.max(F.when(waits, F.col("first"))).alias("high"),
        F.bool_or(F.coalesce(F.col("second") < at, F.lit(False))).alias("more"),
        F.bool_or(waits & F.col("gains")).alias("gains"),
        F.bool_or(waits & F.col("gives_up")).alias("gives_up"),
    )
    verdicts = state.filter("open").select("turn").join(found, "turn", "left")
    alone = (F.col("low") == F.col("high")) & ~F.col("more")
    # A rival that holds a sale id from before and again holds it whatever becomes of it.
    kept_out = F.coalesce(F.col("blocked") | (alone & F.col("gains") & F.col("gives_up")), F.lit(False))
    return verdicts.select(
        "turn",
        F.when(kept_out, False).when(F.col("low").isNull(), True).alias("free"),
        F.when(~kept_out & alone, F.col("low")).alias("for"),
        F.coalesce("gains", F.lit(False)).alias("opposite"),
    )


def _followed(links: DataFrame, folder: str | None) -> DataFrame:
    """Links of :func:`_verdicts` followed to their ends: each step doubles how far every link reaches.

    A report that others wait for may publish, so it publishes exactly when it is free. A link that ends at a report
    with several rivals stays unknown.
    """
    while not links.filter(F.col("for").isNotNull()).isEmpty():
        ends = links.select(
            F.col("turn").alias("for"), F.col("free").alias("_free"), F.col("for").alias("_for"), F.col("opposite").alias("_opposite")
        )
        farther = lookup_join(links.filter(F.col("for").isNotNull()), ends, ["for"]).select(
            "turn",
            (F.col("opposite") != F.col("_free")).alias("free"),
            F.when(F.col("_free").isNull(), F.col("_for")).alias("for"),
            (F.col("opposite") != F.col("_opposite")).alias("opposite"),
        )
        links = durable(links.filter(F.col("for").isNull()).unionByName(farther), folder)
    return links


def _settled(state: DataFrame, links: DataFrame) -> DataFrame:
    joined = state.join(links.select("turn", "free"), "turn", "left")
    settled = F.col("open") & F.col("free").isNotNull()
    free = F.coalesce(F.col("free"), F.lit(False))
    return joined.select(
        "raw_artifact_id",
        "turn",
        (F.col("open") & ~settled).alias("open"),
        "may_publish",
        (F.col("overlap") | (settled & ~free)).alias("overlap"),
        (F.col("published") | (settled & F.col("may_publish") & free)).alias("published"),
    )


def publishable(movements: DataFrame) -> DataFrame:
    """PF5: complete OUT rows."""
    needed = ("external_sale_id", "quantity", "unit_price", "total")
    keep = F.col("direction") == "OUT"
    for name in needed:
        keep = keep & F.col(name).isNotNull()
    return movements.filter(keep)


def sale_items(movements: DataFrame, profile: ReportProfile = DEFAULT_PROFILE) -> DataFrame:
    """VR9: fact rows. Keys are derived from natural keys, so no lookup is needed to write them."""
    source = F.lit(profile.source)
    return publishable(movements).select(
        stable_id(F.col("parse_attempt_id"), F.col("source_record_index")).alias("id"),
        stable_id(source, F.col("external_sale_id")).alias("sale_id"),
        stable_id(source, F.col("external_product_id")).alias("product_id"),
        "parse_attempt_id",
        "source_record_index",
        F.col("quantity").cast(QUANTITY).alias("quantity"),
        F.col("unit_price").cast(MONEY).alias("unit_price"),
        "discount_percentage",
        F.col("total").cast(MONEY).alias("total"),
        "previous_stock",
        "resulting_stock",
    )


def first_sales(movements: DataFrame, profile: ReportProfile = DEFAULT_PROFILE) -> DataFrame:
    """JN15: sale headers as first observed, by turn and then record order."""
    order = F.struct("turn", "source_record_index")
    first = publishable(movements).groupBy("external_sale_id").agg(
        F.min(F.struct(order.alias("order"), "occurred_at", "parse_attempt_id")).alias("first")
    )
    return first.select(
        stable_id(F.lit(profile.source), F.col("external_sale_id")).alias("id"),
        F.lit(profile.source).alias("external_source"),
        "external_sale_id",
        F.col("first.occurred_at").alias("occurred_at"),
        F.col("first.parse_attempt_id").alias("first_seen_parse_attempt_id"),
    )


def new_sales(movements: DataFrame, existing: DataFrame, profile: ReportProfile = DEFAULT_PROFILE) -> DataFrame:
    """JN15: insert if absent; a sale that exists keeps its time and first attempt."""
    return absent_from(first_sales(movements, profile), existing, ["external_source", "external_sale_id"])


def changed_products(existing: DataFrame, published: DataFrame, profile: ReportProfile = DEFAULT_PROFILE) -> DataFrame:
    """JN14: product rows that are new or renamed.

    published: external_product_id, product_name, parse_attempt_id, turn; one row per published report.
    The last non-null name in turn order wins, a null name never replaces one, first_seen stays.
    """
    named = F.when(F.col("product_name").isNotNull(), F.col("turn"))
    seen = published.groupBy(F.col("external_product_id").alias("external_id")).agg(
        F.max_by("product_name", named).alias("last_name"),
        F.min_by("parse_attempt_id", "turn").alias("first_attempt"),
    ).withColumn("external_source", F.lit(profile.source))
    keys = ["external_source", "external_id"]
    current = existing.select(*keys, "id", "name", "unit", "first_seen_parse_attempt_id")
    name = F.coalesce("last_name", "name", "external_id")
    return (
        seen.join(lookup_join(current, seen, keys, "left_semi"), keys, "left")
        .filter(F.col("id").isNull() | (F.col("name") != name))
        .select(
            F.coalesce(F.col("id"), stable_id(F.col("external_source"), F.col("external_id"))).alias("id"),
            "external_source",
            "external_id",
            name.alias("name"),
            "unit",
            F.coalesce("first_seen_parse_attempt_id", "first_attempt").alias("first_seen_parse_attempt_id"),
            F.col("id").isNull().alias("is_new"),
        )
    )


def upsert_products(existing: DataFrame, published: DataFrame, profile: ReportProfile = DEFAULT_PROFILE) -> DataFrame:
    """JN14: the whole product table after the published reports."""
    changed = changed_products(existing, published, profile).drop("is_new")
    kept = absent_from(existing.select(*changed.columns), changed, ["external_source", "external_id"])
    return kept.unionByName(changed)


def upsert_publication(existing: DataFrame, published: DataFrame) -> DataFrame:
    """JN16: one pointer per artifact; the latest published attempt replaces the older one.

    ``turn`` of the new rows may be of any orderable type; existing pointers come before all of them.
    """
    columns = ["raw_artifact_id", "active_parse_attempt_id", "published_at"]
    both = existing.select(*columns, F.lit(None).cast(published.schema["turn"].dataType).alias("turn")).unionByName(
        published.select(*columns, "turn")
    )
    # Nulls sort lowest inside a struct, so an existing pointer only stays where nothing new came.
    latest = both.groupBy("raw_artifact_id").agg(
        F.max(F.struct("turn", "active_parse_attempt_id", "published_at")).alias("p")
    )
    return latest.select("raw_artifact_id", "p.active_parse_attempt_id", "p.published_at")
