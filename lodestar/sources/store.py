"""A versioned store of closes, dividends, exchange rates and policy rates.

Every save writes the parts that changed into a folder of its own and then one manifest, a small file that names the folder of each
part of each table. The newest complete manifest is the store: it appears by one rename, so a reader sees all tables as they were
before a save or all as they are after it, and an interrupted save leaves folders that no manifest names. Parts are years, so a
save costs what changed. Two savers at once: the second rename finds its number taken and fails; nothing is lost.

A table without a part has no rows. Rows without a date are not kept. Old versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.operators.incremental import changed_partitions, refetch_cuts, upsert
from lodestar.session import stored

SCHEMAS = {"close": "asset string, date date, close double", "dividend": "asset string, date date, amount double",
           "fx": "currency string, date date, rate double", "rate": "date date, rate double"}
#: What a save sorts by inside a year.
KEYS = {"close": "asset", "dividend": "asset", "fx": "currency", "rate": "date"}
Manifest = dict[str, dict[str, str]]      # table -> year -> folder below the root


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """Number and content of a version (the newest by default); 0 and no tables for a store that doesn't exist yet."""
    found = versions(spark, root)
    if version is None and not found:
        return 0, {"tables": {t: {} for t in SCHEMAS}, "batches": {}}
    number = found[-1] if version is None else version
    fs, p = _fs(spark, f"{root}/manifest/{number:010d}.json")
    data = fs.open(p)
    try:
        return number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
    finally:
        data.close()


def read(spark: SparkSession, root: str, table: str, since_year: int | None = None, version: int | None = None) -> DataFrame:
    """Rows of a table with their ``year``; only folders from ``since_year`` on are opened."""
    parts = manifest(spark, root, version)[1]["tables"][table]
    paths = [f"{root}/{folder}" for year, folder in sorted(parts.items()) if since_year is None or int(year) >= since_year]
    rows = spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[table])
    return rows.withColumn("year", F.year("date"))


def _commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """The manifest under its number, by a rename that fails if the number is taken."""
    fs, target = _fs(spark, f"{root}/manifest/{number:010d}.json")
    fs.mkdirs(target.getParent())
    _, draft = _fs(spark, f"{root}/manifest/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} was saved by another writer")


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None, base: int | None = None) -> int:
    """Replace whole tables in one version; returns its number. Only years whose rows differ are written, vanished ones are left out.
    ``base``: the version the tables were worked out from; the save fails if there is a newer one by now. ``batch``: (feed, number),
    kept in the manifest. Nothing is saved if nothing changed and no batch is named."""
    number, content = manifest(spark, root, base)
    parts: Manifest = {t: dict(p) for t, p in content["tables"].items()}
    changed_any = False
    for table, rows in tables.items():
        new = stored(rows.where(F.col("date").isNotNull()).select(*[c.split()[0] for c in SCHEMAS[table].split(", ")]).withColumn("year", F.year("date")))
        changed = [(str(r["year"]), r["status"]) for r in changed_partitions(read(spark, root, table, version=base if number else None), new).collect()]
        keep = [y for y, s in changed if s != "gone"]
        if keep:
            folder = f"{table}/v{number + 1:010d}-{uuid.uuid4().hex[:8]}"
            (new.where(F.col("year").isin([int(y) for y in keep])).repartitionByRange("year", KEYS[table]).sortWithinPartitions("year", KEYS[table], "date")
             .write.partitionBy("year").parquet(f"{root}/{folder}"))
        parts[table] = {y: f for y, f in parts[table].items() if y not in dict(changed)} | {y: f"{folder}/year={y}" for y in keep}
        changed_any = changed_any or bool(changed)
    batches = dict(content["batches"]) | ({batch[0]: batch[1]} if batch else {})
    if not changed_any and batches == content["batches"]:
        return number
    _commit(spark, root, number + 1, {"tables": parts, "batches": batches})
    return number + 1


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete manifests before the newest ``keep`` and the folders that no kept manifest names; returns how many folders went.
    Not to run while a save is under way: its folders are named by no manifest yet."""
    found = versions(spark, root)
    live = {f for n in found[-keep:] for p in manifest(spark, root, n)[1]["tables"].values() for f in p.values()}
    for n in found[:-keep]:
        fs, p = _fs(spark, f"{root}/manifest/{n:010d}.json")
        fs.delete(p, False)
    gone = 0
    for table in SCHEMAS:
        fs, p = _fs(spark, f"{root}/{table}")
        for save_folder in fs.listStatus(p) if fs.exists(p) else []:
            for year in fs.listStatus(save_folder.getPath()):
                name = f"{table}/{save_folder.getPath().getName()}/{year.getPath().getName()}"
                if year.isDirectory() and name not in live:
                    fs.delete(year.getPath(), True)
                    gone += 1
    return gone


def apply(spark: SparkSession, root: str, closes: DataFrame | None = None, dividends: DataFrame | None = None, fx: DataFrame | None = None,
          rates: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
    """One update of all tables in one version. ``closes`` (asset, date, close, is_full) replace an asset's closes and dividends from its
    first fetched date on, or all of them if it is fetched in full (a row without a date then says that nothing came); dividends
    of assets without fetched closes are left out, as there is nothing to tell what they replace. Rates replace those of the same currency and day, the last given
    wins by value. A batch that the manifest already has is not applied again."""
    number, content = manifest(spark, root)
    if batch and content["batches"].get(batch[0], -1) >= batch[1]:
        return number
    old = lambda table: read(spark, root, table, version=number or None).drop("year")
    new: dict[str, DataFrame] = {}
    if closes is not None:
        cuts = refetch_cuts(closes.where(F.col("date").isNotNull() | F.col("is_full")))
        cuts = stored(cuts.withColumn("cut", F.when(F.col("is_full"), F.lit("0001-01-01").cast("date")).otherwise(F.col("cut"))))
        new["close"] = upsert(old("close"), closes.where(F.col("date").isNotNull()), cuts)
        fetched = dividends if dividends is not None else old("dividend").limit(0)
        new["dividend"] = upsert(old("dividend"), fetched.join(cuts, "asset", "left_semi"), cuts)
    for table, rows, keys in (("fx", fx, ["currency", "date"]), ("rate", rates, ["date"])):
        if rows is not None:
            both = old(table).withColumn("_new", F.lit(0)).unionByName(rows.select(*keys, "rate").withColumn("_new", F.lit(1)))
            new[table] = both.groupBy(*keys).agg(F.max_by("rate", F.struct("_new", "rate")).alias("rate"))
    return save(spark, root, new, batch, number or None)
