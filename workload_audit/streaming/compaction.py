"""Archive compaction (ST3): the many small batch folders of closed days folded into few sorted files.

A compaction writes the wanted days, up to a committed batch, to a folder of its own below ``_compacted``. It becomes visible by
one rename of a manifest, ``_manifest/<version>.json``, which tells for each day where its folded rows are and up to which batch
they go. Readers follow the highest version: folded batches are read there, later ones (late rows) from their own folders. Only
then are folded batch folders deleted. So at any step a row is read once: before the rename from its batch, after it from the folded
files, whether or not the batch folder is still there or is written again by a replay. Two compactions at a time cannot both switch,
as a version can be named only once.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

MANIFESTS, FOLDED = "_manifest", "_compacted"
NO_DAYS = {"version": 0, "days": {}}


def manifest(spark: SparkSession, archive: str) -> dict:
    """The current manifest: {"version": n, "days": {day: {"folder": ..., "upto": batch}}}."""
    root = f"{archive.rstrip('/')}/{MANIFESTS}"
    versions = [int(m[1]) for name, _ in files.children(spark, root) if (m := re.fullmatch(r"(\d+)\.json", name))]
    return json.loads(files.read_text(spark, f"{root}/{max(versions)}.json")) if versions else NO_DAYS


def committed_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that the stream of this checkpoint has committed; -1 (the backfill) before any."""
    return max((int(name) for name, _ in files.children(spark, f"{checkpoint.rstrip('/')}/commits") if name.isdigit()), default=-1)


def _day_folders(spark: SparkSession, archive: str) -> dict[str, str]:
    """{day: its folder} of the archive's batch folders."""
    out = {}
    for month, is_folder in files.children(spark, archive):
        if is_folder and month.startswith("event_month="):
            for day, _ in files.children(spark, f"{archive.rstrip('/')}/{month}"):
                out[day.removeprefix("event_date=")] = f"{archive.rstrip('/')}/{month}/{day}"
    return out


def read_folded(spark: SparkSession, archive: str) -> DataFrame | None:
    """The archive's rows, folded days from their folded files; None if it has no files at all."""
    root, days = archive.rstrip("/"), manifest(spark, archive)["days"]
    parts = []
    if any(files.children(spark, folder) for folder in _day_folders(spark, archive).values()):
        rows = spark.read.parquet(root)
        for day, known in days.items():  # conditions on partition columns: folded folders are not opened
            rows = rows.where(~((F.col("event_date") == F.lit(dt.date.fromisoformat(day))) & (F.col("batch_id") <= known["upto"])).eqNullSafe(F.lit(True)))
        parts.append(rows)
    for folder in sorted({known["folder"] for known in days.values()}):
        own = [F.lit(dt.date.fromisoformat(day)) for day, known in days.items() if known["folder"] == folder]
        if files.children(spark, f"{root}/{folder}"):
            parts.append(spark.read.parquet(f"{root}/{folder}").where(F.col("event_date").isin(own)))
    out = None
    for part in parts:
        part = part.withColumns({"batch_id": F.col("batch_id").cast("bigint"), "event_month": F.col("event_month").cast("string")})
        out = part if out is None else out.unionByName(part.select(out.columns))
    return out


def compact(spark: SparkSession, archive: str, days: Iterable[dt.date], upto: int) -> list[str]:
    """Fold the batches up to ``upto`` of the given days; days with nothing new to fold are left alone. Returns the folded days.

    ``upto`` must be committed (``committed_batch``): a batch that is still being written would be cut in two.
    """
    root, now = archive.rstrip("/"), manifest(spark, archive)
    folders = _day_folders(spark, archive)
    wanted = {}
    for day in map(str, days):
        folded = now["days"].get(day, {}).get("upto")
        batches = [int(name.removeprefix("batch_id=")) for name, _ in files.children(spark, folders[day])] if day in folders else []
        if any(b <= upto and (folded is None or b > folded) for b in batches):
            wanted[day] = batches
    if wanted:
        folder = f"{FOLDED}/{uuid.uuid4().hex}"
        own = F.col("event_date").isin([F.lit(dt.date.fromisoformat(d)) for d in wanted]) & (F.col("batch_id") <= upto)
        rows = read_folded(spark, archive).where(own)
        rows = rows.repartitionByRange("event_date", "normalized_query_hash").sortWithinPartitions("event_date", "normalized_query_hash")
        rows.write.partitionBy("event_month", "event_date").parquet(f"{root}/{folder}")
        version = now["version"] + 1
        changed = {"version": version, "days": now["days"] | {d: {"folder": folder, "upto": upto} for d in wanted}}
        draft = f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}"
        files.write_text(spark, draft, json.dumps(changed))
        if not files.rename(spark, draft, f"{root}/{MANIFESTS}/{version}.json"):
            raise RuntimeError(f"another compaction of {archive} was faster")
    tidy(spark, archive)
    return sorted(wanted)


def tidy(spark: SparkSession, archive: str) -> None:
    """Delete batch folders that are folded and folded files that no day uses any more: what a compaction leaves, finished or not."""
    root, days = archive.rstrip("/"), manifest(spark, archive)["days"]
    for day, folder in _day_folders(spark, archive).items():
        if day in days:
            for name, _ in files.children(spark, folder):
                if int(name.removeprefix("batch_id=")) <= days[day]["upto"]:
                    files.delete(spark, f"{folder}/{name}")
    used = {known["folder"] for known in days.values()}
    for name, _ in files.children(spark, f"{root}/{FOLDED}"):
        folder = f"{FOLDED}/{name}"
        if folder not in used:
            files.delete(spark, f"{root}/{folder}")
        else:
            for month, _ in files.children(spark, f"{root}/{folder}"):
                for day, _ in files.children(spark, f"{root}/{folder}/{month}"):
                    if day.startswith("event_date=") and days.get(day.removeprefix("event_date="), {}).get("folder") != folder:
                        files.delete(spark, f"{root}/{folder}/{month}/{day}")
