"""The list run as one job: raw pages to typed rows, gate, change log and new master."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.operators.changes import field_changes, master_merge, snapshot_diff
from lodestar.operators.checks import run_gate
from lodestar.params import DEFAULTS, Params
from lodestar.session import stored
from lodestar.sources.pages import first_per_instrument, normalise_rows, results

KEPT = ("instrument_id", "first_seen", "last_seen", "delisted_at", "active")


class ListRun(NamedTuple):
    master: DataFrame     # after the run
    log: DataFrame        # instrument_id, change, field, old, new


def ingest_list(pages: DataFrame, master: DataFrame, now: Column, partial: bool = False, p: Params = DEFAULTS) -> ListRun:
    """``pages``: page_id, html. ``master``: ``KEPT`` and fields of a normalised row. Raises before anything is merged if the
    gate fails: no instrument found, or in a full run too few of the active ones."""
    found = stored(normalise_rows(first_per_instrument(results(pages))).select("instrument_id", *[c for c in master.columns if c not in KEPT]))
    counts = found.agg(F.count(F.lit(1)).alias("found")).select("found", master.agg(F.count_if("active")).scalar().alias("prior"))
    gate = counts.select("*", run_gate(F.col("found"), F.col("prior"), F.lit(partial), p).alias("ok")).first()
    if not gate["ok"]:
        raise ValueError(f"list run stopped: {gate['found']} instruments found, {gate['prior']} active before")
    none = F.lit(None).cast("string")
    status = snapshot_diff(master, found, partial).select("instrument_id", "change", none.alias("field"), none.alias("old"), none.alias("new"))
    changed = field_changes(master, found).select("instrument_id", F.lit("changed").alias("change"), "field", "old", "new")
    return ListRun(master_merge(master, found, now, partial), status.unionByName(changed))
