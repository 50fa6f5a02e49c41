"""Incremental ingest: a stream of observations kept as the latest row per listing.

The state is cut into buckets by a hash of the id. Every micro-batch writes one small delta with a
single, already reduced row per id; a batch that is retried after a failure replaces its own delta,
and arrival order never matters. Compaction rewrites only the buckets that the deltas since the last
one touch, into new files, and then publishes a version: one small file that names the files of every
bucket and the last delta they contain. Readers start from the newest version, so they see all of a
compaction or nothing of it. Files no version of interest names are deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import _file_system, path_exists

_SEEN, _FIRST, _LAST, _BUCKET = "observation_count", "first_batch", "last_batch", "bucket"
# Buckets of a new state; an existing one keeps its number.
BUCKETS = 64


@dataclass(frozen=True)
class Version:
    """Where the rows of each bucket are, and the name of the last delta they include."""

    number: int = 0
    through: str = ""
    buckets: int = BUCKETS
    tables: dict[str, str] = field(default_factory=dict)  # bucket: name of a folder below base


def _reduce(rows: DataFrame, id: str, time: str, batch: str) -> DataFrame:
    """Newest row per id by (time, batch name, remaining columns), with merged accounting."""
    age = -F.unix_micros(F.col(time).cast("timestamp"))
    rest = [name for name in rows.columns if name not in (id, time, batch, _SEEN, _FIRST, _LAST)]
    grouped = rows.groupBy(id).agg(
        F.min(F.struct(age.alias("__age"), batch, time, *rest)).alias("r"),
        F.sum(_SEEN).alias(_SEEN), F.min(_FIRST).alias(_FIRST), F.max(_LAST).alias(_LAST),
    )
    return grouped.select(id, f"r.{time}", f"r.{batch}", *[f"r.{name}" for name in rest], _SEEN, _FIRST, _LAST)


def batch_writer(path: str, *, id: str, time: str, batch: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """What a streaming query does with each micro-batch: reduce it and write it as a delta, by bucket."""

    def write(rows: DataFrame, number: int) -> None:
        version = current_version(rows.sparkSession, path)
        if version is None:
            version = Version(buckets=buckets)
            _publish(rows.sparkSession, path, version)
        counted = rows.withColumns({_SEEN: F.lit(1).cast("bigint"), _FIRST: F.lit(number), _LAST: F.lit(number)})
        bucket = F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(version.buckets)).cast("int")
        placed = _reduce(counted, id, time, batch).withColumn(_BUCKET, bucket).repartition(_BUCKET)
        placed.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/delta/{number:010d}")

    return write


def start_ingest(
    observations: DataFrame, path: str, *, id: str = "listing_id", time: str = "collected_at", batch: str = "source_batch",
    repeats_within: str | None = None, available_now: bool = True, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Start the ingest of a streaming DataFrame into ``path``.

    ``buckets`` counts for a new state only.

    ``repeats_within`` is a watermark delay inside which exact repeats are dropped before
    they count as observations; it never drops an observation that differs.
    """
    stream = observations
    if repeats_within:
        stream = stream.withWatermark(time, repeats_within).dropDuplicatesWithinWatermark(stream.columns)
    writer = (
        stream.writeStream.foreachBatch(batch_writer(path, id=id, time=time, batch=batch, buckets=buckets))
        .option("checkpointLocation", f"{path}/progress").outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _names(spark: SparkSession, folder: str) -> list[str]:
    location, files = _file_system(spark, folder)
    return sorted(status.getPath().getName() for status in files.listStatus(location)) if files.exists(location) else []


def _publish(spark: SparkSession, path: str, version: Version) -> None:
    """Make a version the newest one: its file appears under its name only when it is complete."""
    target, files = _file_system(spark, f"{path}/versions/{version.number:010d}.json")
    if files.exists(target):
        raise ValueError(f"Version {version.number} of {path} exists; one compaction runs at a time")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/_draft-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    if not files.rename(draft, target):
        raise ValueError(f"Version {version.number} of {path} could not be published")


def _version(spark: SparkSession, path: str, name: str) -> Version:
    location, files = _file_system(spark, f"{path}/versions/{name}")
    source = files.open(location)
    try:
        return Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
    finally:
        source.close()


def _published(spark: SparkSession, path: str) -> list[str]:
    return [name for name in _names(spark, f"{path}/versions") if name.endswith(".json") and not name.startswith("_")]


def current_version(spark: SparkSession, path: str) -> Version | None:
    """The newest published version of a state, or none before its first batch."""
    published = _published(spark, path)
    return _version(spark, path, published[-1]) if published else None


def _deltas(spark: SparkSession, path: str, version: Version) -> list[str]:
    """Complete deltas that the version does not include."""
    return [n for n in _names(spark, f"{path}/delta") if n > version.through and path_exists(spark, f"{path}/delta/{n}/_SUCCESS")]


def _filled(spark: SparkSession, path: str, deltas: list[str]) -> dict[str, set[str]]:
    """Deltas that have rows, and the buckets of these, as their folders tell."""
    found = {d: {n.split("=", 1)[1] for n in _names(spark, f"{path}/delta/{d}") if n.startswith(f"{_BUCKET}=")} for d in deltas}
    return {delta: buckets for delta, buckets in found.items() if buckets}


def _base(spark: SparkSession, path: str, version: Version, wanted: set[str]) -> list[DataFrame]:
    """Rows of the wanted buckets in the files of a version: one scan per folder, pruned to its buckets."""
    folders: dict[str, list[int]] = {}
    for bucket, name in version.tables.items():
        if bucket in wanted:
            folders.setdefault(name, []).append(int(bucket))
    return [spark.read.parquet(f"{path}/base/{name}").where(F.col(_BUCKET).isin(*of)) for name, of in sorted(folders.items())]


def _merged(spark: SparkSession, path: str, version: Version, filled: dict[str, set[str]], keys: tuple[str, str, str]) -> DataFrame:
    """Touched buckets with their deltas folded in, one row per id."""
    new = [spark.read.parquet(f"{path}/delta/{name}") for name in filled]
    rows = reduce(DataFrame.unionByName, [*_base(spark, path, version, set().union(*filled.values())), *new])
    # The bucket follows from the id, so it comes through the reduction unchanged.
    return _reduce(rows, *keys)


def latest_state(
    spark: SparkSession, path: str, *, id: str = "listing_id", time: str = "collected_at", batch: str = "source_batch",
) -> DataFrame:
    """Latest row per id over everything ingested so far.

    Buckets without new deltas are read as they are; only the others are reduced anew.
    """
    version = current_version(spark, path)
    filled = _filled(spark, path, _deltas(spark, path, version)) if version else {}
    if not filled and not (version and version.tables):
        raise ValueError(f"{path} holds no state yet")
    parts = _base(spark, path, version, version.tables.keys() - set().union(*filled.values()))
    if filled:
        parts.append(_merged(spark, path, version, filled, (id, time, batch)))
    return reduce(DataFrame.unionByName, parts).drop(_BUCKET)


def compact(
    spark: SparkSession, path: str, *, id: str = "listing_id", time: str = "collected_at", batch: str = "source_batch",
) -> Version | None:
    """Fold all deltas into the buckets they touch and publish the result as a new version.

    Readers of older versions keep their files until ``vacuum``. A compaction that fails leaves a
    folder no version names, and the state as it was. One compaction runs at a time.
    """
    version = current_version(spark, path)
    deltas = _deltas(spark, path, version) if version else []
    if not deltas:
        return version
    filled = _filled(spark, path, deltas)
    tables = dict(version.tables)
    if filled:
        name = f"{version.number + 1:010d}-{uuid.uuid4().hex}"
        merged = _merged(spark, path, version, filled, (id, time, batch)).repartition(_BUCKET)
        merged.write.partitionBy(_BUCKET).parquet(f"{path}/base/{name}")
        tables |= {bucket: name for bucket in set().union(*filled.values())}
    newer = Version(version.number + 1, deltas[-1], version.buckets, tables)
    _publish(spark, path, newer)
    return newer


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete versions before the newest ``keep`` and the files that no kept version needs.

    Readers that started before must be done; files of a running compaction are newer than all
    versions and stay.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    published = _published(spark, path)
    kept = [_version(spark, path, name) for name in published[-keep:]]
    if not kept:
        return
    used = {name for version in kept for name in version.tables.values()}
    newest, through = kept[-1].number, min(version.through for version in kept)
    old = [f"{path}/versions/{name}" for name in published[:-keep]]
    old += [f"{path}/base/{n}" for n in _names(spark, f"{path}/base") if n not in used and int(n.split("-")[0]) <= newest]
    old += [f"{path}/delta/{n}" for n in _names(spark, f"{path}/delta") if n <= through]
    for item in old:
        location, files = _file_system(spark, item)
        files.delete(location, True)


def arrival_counts(state: DataFrame) -> DataFrame:
    """Per micro-batch: ids first seen in it; and, over all, repeats of known ids."""
    return state.groupBy(F.col(_FIRST).alias("batch_number")).agg(
        F.count(F.lit(1)).alias("first_seen"), F.sum(F.col(_SEEN) - 1).alias("later_observations")
    )
