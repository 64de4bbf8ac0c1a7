"""References to records that do not exist: distributed left anti-join of distinct keys, joined back for counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Tasks over which the references to one key are spread when they meet their faulty key.
SALTS = 16


@dataclass(frozen=True)
class Reference:
    """One referring column. at: time of the reference; target: name of the parent table it points into."""

    table_name: str
    field_name: str
    df: DataFrame
    record_id: str
    at: str
    target: str


@dataclass(frozen=True)
class Target:
    """A parent table: its key, when a row came to exist, and when it was deleted (null: live)."""

    name: str
    df: DataFrame
    key: str
    created: str
    deleted: str


def clean_key(c: Column | str) -> Column:
    """Key without surrounding white space, in upper case; a blank key is null."""
    c = F.upper(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", ""))
    return F.when(c != "", c)


def reference_rows(refs: list[Reference]) -> DataFrame:
    """All references in one long table: table_name, field_name, record_id, target, key, at. Arrays are exploded."""
    out = None
    for r in refs:
        column = F.explode(r.field_name) if dict(r.df.dtypes)[r.field_name].startswith("array") else F.col(r.field_name)
        rows = (
            r.df.select(F.col(r.record_id).alias("record_id"), F.col(r.at).cast("timestamp").alias("at"), column.alias("raw"))
            .select(F.lit(r.table_name).alias("table_name"), F.lit(r.field_name).alias("field_name"), "record_id", F.lit(r.target).alias("target"), clean_key("raw").alias("key"), "at")
            .where("key IS NOT NULL")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def target_rows(targets: list[Target]) -> DataFrame:
    """One row per parent key: target, key, created_at (the earliest) and deleted_at (null if any row is live)."""
    out = None
    for t in targets:
        rows = t.df.select(F.lit(t.name).alias("target"), clean_key(t.key).alias("key"), F.col(t.created).cast("timestamp").alias("c"), F.col(t.deleted).cast("timestamp").alias("d")).where("key IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("target", "key").agg(F.min("c").alias("created_at"), F.when(F.count("d") == F.count("*"), F.max("d")).alias("deleted_at"))


def orphan_references(refs: list[Reference], targets: list[Target]) -> DataFrame:
    """References without a valid target: table_name, field_name, record_id, missing_id, reason, period (distinct rows).

    The distinct keys of all references are reduced first (map-side), anti-joined with the parent keys for
    'missing', and matched with the parents' times otherwise; only keys that can be faulty are joined back. That side
    is small, so it goes to SALTS places per key, and the rows of a key that a third of all references name are spread
    over as many tasks. 'late': the parent came to exist after the reference; 'deleted': it was
    gone by then. With no reference time only 'missing' applies, and period is 'unknown'.

    Null or blank keys, null or empty arrays and empty tables give no rows. A null record_id is kept as null.
    Repeated rows give one result row. Columns other than those named are not read, so clashing names do no harm.
    """
    rows, parents = reference_rows(refs), target_rows(targets)
    keys = rows.groupBy("target", "key").agg(F.max("at").alias("last_at"), F.min("at").alias("first_at"))
    missing = keys.join(parents, ["target", "key"], "left_anti").select("target", "key", F.lit(True).alias("missing"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    doubtful = keys.join(parents, ["target", "key"]).where("created_at > first_at OR deleted_at <= last_at").select("target", "key", F.lit(False).alias("missing"), "created_at", "deleted_at")
    reason = F.when(F.col("missing"), "missing").when(F.col("created_at") > F.col("at"), "late").when(F.col("deleted_at") <= F.col("at"), "deleted")
    faulty = missing.unionByName(doubtful).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("record_id", "at"), F.lit(SALTS)).cast("int"))
        .join(faulty, ["target", "key", "salt"])
        .withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .select("table_name", "field_name", "record_id", F.col("key").alias("missing_id"), "reason", period("at").alias("period"))
        .distinct()
    )


def period(at: str) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown"))


def orphan_counts(refs: list[Reference], targets: list[Target]) -> DataFrame:
    """Per table, field, period and reason: faulty references, distinct keys they name, and all references of that period.

    Periods without a fault are left out. References are counted as distinct (record, key, time).
    """
    orphans = orphan_references(refs, targets).groupBy("table_name", "field_name", "period", "reason").agg(F.count("*").alias("n_orphans"), F.countDistinct("missing_id").alias("n_missing_ids"))
    total = reference_rows(refs).select("table_name", "field_name", "record_id", "key", period("at").alias("period")).distinct().groupBy("table_name", "field_name", "period").agg(F.count("*").alias("n_references"))
    share = F.round(F.col("n_orphans") / F.col("n_references"), 6)
    return orphans.join(total, ["table_name", "field_name", "period"]).withColumn("orphan_share", share)


def most_wanted(refs: list[Reference], targets: list[Target], n: int) -> DataFrame:
    """The n absent keys named by most records, per table and field (ties by key)."""
    w = W.partitionBy("table_name", "field_name").orderBy(F.desc("n_records"), "missing_id")
    counts = orphan_references(refs, targets).groupBy("table_name", "field_name", "missing_id").agg(F.countDistinct("record_id").alias("n_records"))
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
