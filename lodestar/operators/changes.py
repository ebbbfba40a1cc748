"""Snapshots, change log and master table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fields whose changes are logged (fixed list).
TRACKED = ["isin", "symbol", "name", "currency", "clearing_place", "issuer_name", "category", "fee",
           "dividend_policy", "is_tradable"]


def as_text(df: DataFrame, col: str) -> Column:
    """Value as comparable text: booleans as 0/1, whole numbers without decimals."""
    kind, c = dict(df.dtypes)[col], F.col(col)
    if kind == "boolean":
        return c.cast("int").cast("string")
    if kind in ("double", "float"):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def tracked_fields(df: DataFrame) -> list[str]:
    return [f for f in TRACKED if f in df.columns]


def snapshot_diff(master: DataFrame, found: DataFrame, partial: bool = False) -> DataFrame:
    """(instrument_id, change): new, reappeared, and on full runs gone."""
    both = (master.select("instrument_id", "active", F.lit(True).alias("known"))
            .join(found.select("instrument_id", F.lit(True).alias("seen")), "instrument_id", "full"))
    change = (F.when(F.col("known").isNull(), "new").when(F.col("seen") & ~F.col("active"), "reappeared")
              .when(F.col("seen").isNull() & F.col("active") & F.lit(not partial), "gone"))
    return both.select("instrument_id", change.alias("change")).where(F.col("change").isNotNull())


def field_changes(master: DataFrame, found: DataFrame) -> DataFrame:
    """(instrument_id, field, old, new) where the text differs and the new value is present."""
    fields = tracked_fields(found)
    old = master.select("instrument_id", *[as_text(master, f).alias(f"{f}_old") for f in fields])
    new = found.select("instrument_id", *[as_text(found, f).alias(f"{f}_new") for f in fields])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_old").alias("old"), F.col(f"{f}_new").alias("new")) for f in fields]))
    return (old.join(new, "instrument_id").select("instrument_id", cells.alias("_cell")).select("instrument_id", "_cell.*")
            .where(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))))


def master_merge(master: DataFrame, found: DataFrame, now: Column, partial: bool = False) -> DataFrame:
    """Master after a run: missing new values keep the old ones, nothing is deleted."""
    keep = ["instrument_id", "first_seen", "last_seen", "delisted_at", "active"]
    data = [c for c in master.columns if c not in keep]
    o, n = master.alias("o"), found.select("instrument_id", *data, F.lit(True).alias("seen")).alias("n")
    j = o.join(n, F.col("o.instrument_id") == F.col("n.instrument_id"), "full")
    seen, gone = F.col("n.seen").isNotNull(), F.lit(not partial)
    was = F.coalesce("o.active", F.lit(False))
    return j.select(
        F.coalesce("n.instrument_id", "o.instrument_id").alias("instrument_id"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in data],
        F.coalesce("o.first_seen", now).alias("first_seen"), F.when(seen, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(seen, F.lit(None)).when(was & gone, now).otherwise(F.col("o.delisted_at")).alias("delisted_at"),
        (seen | (was & ~gone)).alias("active"))


def change_log(snaps: DataFrame, runs: DataFrame) -> DataFrame:
    """The change log of a whole snapshot history in one pass: (run_id, instrument_id, change, field, old, new).

    An instrument is gone at the first full run after it was last seen, and has reappeared when it is seen
    again after that. Windows are per instrument over its runs; the run table has one row per run."""
    later = W.orderBy(F.col("run_id").desc()).rowsBetween(W.unboundedPreceding, -1)      # run table: one row per run
    full = F.when(~F.col("partial"), F.col("run_id"))
    calendar = runs.select("run_id", F.min(full).over(later).alias("next_full"))
    fields = tracked_fields(snaps)
    w = W.partitionBy("instrument_id").orderBy("run_id")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = snaps.select("run_id", "instrument_id", "name", *[as_text(snaps, f).alias(f"{f}_new") for f in fields])
    rows = (rows.join(calendar, "run_id")
            .withColumn("prev_full", F.lag("next_full").over(w)).withColumn("is_first", F.lag("run_id").over(w).isNull())
            .withColumn("next_run", F.lead("run_id").over(w)))
    for f in fields:
        rows = rows.withColumn(f"{f}_old", F.last(f"{f}_new", ignorenulls=True).over(before))
    none = F.lit(None).cast("string")
    head = ["run_id", "instrument_id"]
    change = F.when(F.col("is_first"), "new").when(F.col("prev_full") < F.col("run_id"), "reappeared")
    status = (rows.withColumn("change", change).where(F.col("change").isNotNull())
              .select(*head, "change", none.alias("field"), none.alias("old"), F.col("name").alias("new")))
    gone = (rows.where(F.col("next_full").isNotNull() & (F.col("next_run").isNull() | (F.col("next_run") > F.col("next_full"))))
            .select(F.col("next_full").alias("run_id"), "instrument_id", F.lit("gone").alias("change"), none.alias("field"),
                    F.col("name").alias("old"), none.alias("new")))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_old").alias("old"), F.col(f"{f}_new").alias("new")) for f in fields]))
    changed = (rows.where(~F.col("is_first")).select(*head, F.lit("changed").alias("change"), cells.alias("_cell"))
               .select(*head, "change", "_cell.*").where(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))))
    return reduce(DataFrame.unionByName, [status, gone, changed])


def run_summary(runs: DataFrame, log: DataFrame) -> DataFrame:
    counts = log.groupBy("run_id").agg(*[F.count_if(F.col("change") == k).alias(f"n_{k}") for k in ("new", "gone", "reappeared", "changed")])
    return runs.select("run_id").join(counts, "run_id", "left").na.fill(0)


def change_log_rollup(log: DataFrame, runs: DataFrame, master: DataFrame) -> DataFrame:
    """Newest run first: count per kind of change, and the items with the instrument's current attributes.

    Items stay rows (a run can hold a third of the log); the first run lists counts only."""
    first = log.agg(F.min("run_id")).scalar()
    counts = log.groupBy("run_id", "change").agg(F.count(F.lit(1)).alias("n"))
    items = log.where(F.col("run_id") > first).join(master.select("instrument_id", "isin", F.col("name").alias("instrument")), "instrument_id", "left")
    return (counts.join(items, ["run_id", "change"], "left").join(runs.select("run_id", "run_at"), "run_id")
            .select("run_id", "run_at", "change", "n", "instrument_id", "field", "old", "new", "isin", "instrument")
            .orderBy(F.col("run_id").desc(), "change", "instrument_id", "field"))


def latest_snapshot(snaps: DataFrame, master: DataFrame) -> DataFrame:
    """Row of the last run per active instrument with an ISIN."""
    live = master.where(F.col("active") & F.col("isin").isNotNull()).select("instrument_id")
    rest = [c for c in snaps.columns if c != "instrument_id"]
    return (snaps.join(live, "instrument_id", "left_semi").groupBy("instrument_id")
            .agg(F.max_by(F.struct(*rest), "run_id").alias("_row")).select("instrument_id", "_row.*"))


def stale_work_list(items: DataFrame, fetched: DataFrame, key: str, fresh: Column) -> DataFrame:
    """Items without a fresh, accepted fetch; the order of work is most owners first."""
    return items.join(fetched.where(fresh).select(key).distinct(), key, "left_anti").orderBy(F.col("owners").desc_nulls_last(), key)


def missing_names(holdings: DataFrame, names: DataFrame) -> DataFrame:
    return holdings.select("holding_id").distinct().join(names.select("holding_id"), "holding_id", "left_anti")


def schema_evolve(columns: list[str], *tables: DataFrame) -> DataFrame:
    """Union of tables with different column sets, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).select(*columns)


def universe_history(history: DataFrame, current: DataFrame, built_at: Column) -> DataFrame:
    """History with the current build appended."""
    return history.unionByName(current.select(built_at.alias("built_at"), "isin", "cluster_id", "is_representative"))


def mapping_invalidate(mappings: DataFrame, failures: DataFrame) -> DataFrame:
    """Mark chosen tickers that failed; ``valid`` mappings are chosen and still ok."""
    bad = failures.groupBy("ticker").agg(F.min("error").alias("new_error"))
    j = mappings.join(bad, "ticker", "left")
    broken = F.col("chosen") & F.col("new_error").isNotNull()
    return (j.withColumn("ok", F.col("ok") & ~broken).withColumn("error", F.when(broken, F.col("new_error")).otherwise(F.col("error")))
            .drop("new_error").withColumn("valid", F.col("chosen") & F.col("ok")))


def page_round_union(rows: DataFrame, total: Column) -> DataFrame:
    """Union of repeated list passes, first-seen record per id; later passes count only while ids are missing."""
    rest = [c for c in rows.columns if c not in ("instrument_id",)]
    first = (rows.groupBy("instrument_id")
             .agg(F.min_by(F.struct(*rest), F.struct("round", "page", "pos")).alias("_row")).select("instrument_id", "_row.*"))
    per = first.groupBy("round").agg(F.count(F.lit(1)).alias("n"))            # one row per round
    seen = per.withColumn("seen", F.sum("n").over(W.orderBy("round").rowsBetween(W.unboundedPreceding, 0)))
    stop = seen.withColumn("total", total).agg(F.min(F.when(F.col("seen") >= F.col("total"), F.col("round")))).scalar()
    return first.where(stop.isNull() | (F.col("round") <= stop))
