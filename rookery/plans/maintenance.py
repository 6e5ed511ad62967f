"""The scheduled maintenance run: fixed step order, failures stay in their step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rookery import schemas
from rookery.operators import extract, ingest, replication, retention
from rookery.operators.joins import split_join
from rookery.session import materialise
from rookery.sources.store import Store


@dataclass
class Outcomes:
    """Step results, one small row each."""

    rows: list[tuple] = field(default_factory=list)

    def add(self, step: str, ok: bool, items: int = 0, message: str = "", subject: str = "") -> None:
        self.rows.append((step, subject, ok, items, message))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, schemas.OUTCOME)


def run_summary(outcomes: DataFrame, *by: str) -> DataFrame:
    """Attempted, succeeded, failed and items of a run."""
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("attempted"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.sum("items").alias("items"),
    )


def progress(outcomes: DataFrame, skipped: DataFrame) -> DataFrame:
    """Refresh progress as rows: start, one per account, done."""
    each = outcomes.select(
        F.when(F.col("ok"), F.lit("success")).otherwise(F.lit("error")).alias("event"),
        F.col("subject"),
        F.col("items"),
    )
    done = outcomes.agg(F.count_if(~F.col("ok")).alias("items")).select(
        F.lit("done").alias("event"), F.lit(None).cast("string").alias("subject"), "items"
    )
    totals = outcomes.select(F.lit(1).alias("one")).unionByName(skipped.select(F.lit(1).alias("one")))
    start = totals.agg(F.count("*").alias("items")).select(
        F.lit("start").alias("event"), F.lit(None).cast("string").alias("subject"), "items"
    )
    return start.unionByName(each).unionByName(done)


def sync_following(store: Store, raw: DataFrame, now_ms: int) -> int:
    """Replace the follow lists of all viewers whose load is clean."""
    fresh = ingest.accepted_following(raw)
    old = store.read("subscription")
    if old is None:
        new = fresh.withColumn("created_ms", F.lit(now_ms).cast("long"))
    else:
        loaded = ingest.load_summary(raw).filter("accepted").select("viewer_id")
        kept = split_join(old, loaded, ["viewer_id"], "left_anti")
        new = replication.replace_snapshot(old, fresh, now_ms).unionByName(kept)
    store.publish({"subscription": new})
    return store.read("subscription").count()


def _head(store: Store) -> int:
    """Highest sequence ever used. Kept apart from the log, which retention shortens."""
    kept = store.read("head")
    stored = kept.first()["head_seq"] if kept is not None else 0
    return ingest.head_seq(store.read("change"), stored)


def _head_row(store: Store, head: int) -> DataFrame:
    return store.spark.createDataFrame([(head,)], "head_seq long")


def _gate_row(store: Store, proved_ms: int | None) -> DataFrame:
    epoch = _epoch(store)
    proof = (epoch, epoch if proved_ms is not None else None, proved_ms, proved_ms)
    return store.spark.createDataFrame([proof], schemas.GATE)


def _epoch(store: Store) -> str:
    gate = store.read("gate")
    return gate.first()["data_epoch"] if gate is not None else "epoch-1"


def gate_open(store: Store, now_ms: int) -> bool:
    """A fresh proof of a clean audit exists."""
    gate = store.read("gate")
    return gate is not None and bool(retention.gate(gate, now_ms).first()["open"])


def reconcile_if_needed(store: Store, users: DataFrame, now_ms: int) -> bool:
    """Reuse a fresh proof; else close the gate, repair, and open it after a clean audit."""
    if gate_open(store, now_ms):
        return True
    store.publish({"gate": _gate_row(store, None)})
    clean = reconcile(store, users)
    if clean:
        store.publish({"gate": _gate_row(store, now_ms)})
    return clean


def reconcile(store: Store, users: DataFrame) -> bool:
    """Audit, repair what the audit found, audit again; true when clean.

    A repair rewrites or extends a table only when its count is not zero, so a
    clean store costs one audit and the per-actor marks.
    """
    head = _head(store)
    found = _audit(store)
    blank = found["unnormalised"]
    if blank:
        store.publish({"activity": retention.normalise_keys(store.read("activity"), users)})
    if blank or found["mismatched"]:
        fixed = retention.repair_changes(store.read("change"), store.read("activity"))
        store.publish({"change": fixed.drop("repaired")})
    if blank or found["without_change"]:
        log = store.read("change")
        more = retention.sequence_missing(store.read("activity"), log, head)
        store.publish(append={"change": more.select(*log.columns)})
        head = _head(store)
    store.publish({"head": _head_row(store, head)})
    marks = retention.upsert_retention(store.read("retention"), store.read("activity"))
    if found["orphans"]:
        log, marks = retention.drop_orphans(store.read("change"), store.read("activity"), marks)
        store.publish({"change": log, "retention": marks})
    else:
        store.publish({"retention": marks})
    repaired = any(found[c] for c in found.asDict() if c != "ready")
    return bool(_audit(store)["ready"]) if repaired else True


def _audit(store: Store) -> Row:
    tables = (store.read(name) for name in ("activity", "change", "retention"))
    return retention.audit(*tables).first()


# The place of an extracted entry. Rows of one id are ordered by all their columns in
# the order of the names: this one is the last of them, so it decides between equal rows.
_ENTRY = "written_at"


def _keyed(entries: DataFrame, users: DataFrame, source: str, now_ms: int) -> DataFrame:
    """Entries as activities. A body decides between entries of one id only, so the
    others leave it behind: bodies do not travel to accounts and stored ids."""
    several = entries.groupBy("activity_id").agg(F.count("*").alias("n")).filter("n > 1")
    # Written, so that its size is known: few ids go to the entries, not the reverse.
    several = materialise(several.select("activity_id", F.lit(True).alias("_several")), "several")
    slim = entries.join(several, "activity_id", "left").withColumn(
        "content", F.when(F.col("_several"), F.col("content"))
    )
    return extract.to_activities(slim, users, source, now_ms, _ENTRY)


def _entries_of(entries: DataFrame, fresh: DataFrame, n_fresh: int) -> DataFrame:
    """The entries that became rows, by the shorter list: of those, or of the others."""
    places = fresh.select(_ENTRY)
    others = materialise(entries.select(_ENTRY).join(places, _ENTRY, "left_anti"), "others")
    if others.count() < n_fresh:
        return entries.join(others, _ENTRY, "left_anti")
    return entries.join(places, _ENTRY, "left_semi")


def refresh(store: Store, raw_feed: DataFrame, users: DataFrame, source: str, now_ms: int) -> int:
    """Extract raw documents, append unseen activities, their bodies and log rows."""
    entries = extract.extract_entries(raw_feed, now_ms).drop("actor_name")
    # Extraction is the costly part: written once, read for keys, rows and bodies.
    entries = materialise(entries.withColumn(_ENTRY, F.monotonically_increasing_id()), "extracted")
    batch = materialise(_keyed(entries, users, source, now_ms), "keyed")
    fresh = ingest.ingest_activity(store.read("activity"), batch).drop("content")
    fresh = materialise(fresh, "fresh")
    n_fresh = fresh.count()
    head = _head(store)
    log = materialise(ingest.append_changes(store.read("change"), fresh, head), "sequenced")
    cleaner = extract.HTML_CLEANER
    bodies = _entries_of(entries, fresh, n_fresh).select(
        "activity_id",
        "summary",
        cleaner.clean(F.col("content")).alias("content"),
        F.lit(cleaner.version).alias("version"),
    )
    store.publish(
        {"head": _head_row(store, ingest.head_seq(log, head))},
        append={
            "activity": fresh.select(*store.read("activity").columns),
            "change": log.select(*store.read("change").columns),
            "body": bodies,
        }
    )
    return n_fresh


def cleanup(store: Store, n: int, now_ms: int) -> int:
    """Keep the newest ``n`` rows per actor; rewrites nothing when none has more."""
    if not gate_open(store, now_ms):
        return 0
    before = store.read("activity")
    if retention.over_limit(before, n).isEmpty():
        return 0
    kept, log, floors = retention.retention_run(
        before, store.read("change"), store.read("retention"), n
    )
    had = before.count()
    store.publish(
        {
            "activity": kept,
            "change": log,
            "retention": floors,
            "head": _head_row(store, _head(store)),
        }
    )
    return had - store.read("activity").count()


def run_maintenance(
    spark: SparkSession,
    steps: dict[str, Callable[[], int | bool | None]],
) -> DataFrame:
    """Run the five steps and return their outcomes.

    ``steps``: following, reconcile (True when the audit is clean), refresh,
    cleanup, compact. Clean-up runs only behind a clean audit. A failing refresh
    or clean-up ends the run; the other failures stay in their step.
    """
    out, clean = Outcomes(), False
    for name in ("following", "reconcile", "refresh", "cleanup", "compact"):
        if name == "cleanup" and not clean:
            out.add(name, True, message="skipped: reconciliation-failed")
            continue
        try:
            result = steps[name]()
        except Exception as error:
            out.add(name, False, message=str(error))
            if name in ("refresh", "cleanup"):
                break
            continue
        if name == "reconcile":
            clean = result is True
            out.add(name, True, message="clean" if clean else "not clean")
        else:
            out.add(name, True, int(result or 0))
    return out.frame(spark)
