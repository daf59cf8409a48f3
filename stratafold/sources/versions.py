"""Versioned tables: immutable generations of hashed partitions, and one small file per version that names them.

A version is committed when its file appears under its number, by a rename that fails where another writer has taken that number; so a
reader finds the version before or the version after, never nothing and never half a table. An upsert writes only the partitions that
its keys fall into; the others are named again as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.sources.sinks import _fs, same_rows

PART = "_part"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, the newest last."""
    fs, path_of = _fs(spark, path)
    folder = path_of(f"{path}/_versions")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    fs, path_of = _fs(spark, path)
    stream = fs.open(path_of(f"{path}/_versions/{version}"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    fs, path_of = _fs(spark, path)
    staged, final = path_of(f"{path}/_versions/.{uuid.uuid4().hex}"), path_of(f"{path}/_versions/{version}")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, False)
        raise Conflict(f"version {version} of {path} is taken")


def _written(df: DataFrame, path: str, key: str, buckets: int) -> dict[str, str]:
    """Partition number to folder of a new generation; empty partitions have none."""
    spark = df.sparkSession
    generation = f"data/{uuid.uuid4().hex}"
    placed = df.withColumn(PART, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    placed.repartition(PART).write.partitionBy(PART).parquet(f"{path}/{generation}")
    fs, path_of = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(path_of(f"{path}/{generation}"))]
    return {n.split("=")[1]: f"{generation}/{n}" for n in names if n.startswith(f"{PART}=")}


def _read(spark: SparkSession, path: str, manifest: dict, parts: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    folders = [f"{path}/{f}" for p, f in manifest["parts"].items() if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version or the one of this number; ``FileNotFoundError`` where there is none."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{path} has no version {'at all' if version is None else version}")
    return _read(spark, path, _manifest(spark, path, known[-1] if version is None else version))


def write_version(df: DataFrame, path: str, key: str = "image", buckets: int = 64) -> int:
    """``df`` as the next version; the number. The versions before stay until ``expire``."""
    spark = df.sparkSession
    number = (versions(spark, path) or [0])[-1] + 1
    _commit(spark, path, number, {"schema": df.schema.jsonValue(), "key": key, "buckets": buckets, "parts": _written(df, path, key, buckets)})
    return number


def upsert(run: DataFrame, path: str, buckets: int = 64, key: str = "image") -> dict[str, int]:
    """``run`` replaces its keys' rows: ``version``, rows ``kept`` and ``replaced`` in the partitions touched, and how many were ``rewritten``.

    ``run`` is evaluated once. Columns that only the table or only the run has are null in the other's rows. A run that changes nothing commits
    nothing. Where another writer commits first, ``Conflict`` is raised and the table is the other writer's.
    """
    from stratafold.session import cut_lineage

    spark, run = run.sparkSession, cut_lineage(run)
    known = versions(spark, path)
    if not known:
        return {"version": write_version(run, path, key, buckets), "kept": 0, "replaced": 0, "rewritten": min(buckets, run.select(key).distinct().count())}
    manifest = _manifest(spark, path, known[-1])
    key, buckets = manifest["key"], manifest["buckets"]
    touched = [str(r[0]) for r in run.select(F.pmod(F.xxhash64(key), F.lit(buckets))).distinct().collect()]  # as many as there are partitions
    old = _read(spark, path, manifest, touched)
    mine = run.select(F.col(key).alias("_key")).distinct()
    kept = old.join(mine, old[key].eqNullSafe(F.col("_key")), "left_anti")
    new = kept.unionByName(run, allowMissingColumns=True)
    counts = {"kept": kept.count(), "replaced": 0}
    counts["replaced"] = old.count() - counts["kept"]
    schema = T.StructType.fromJson(manifest["schema"])
    if sorted(new.columns) == sorted(old.columns) and same_rows(old.select(*new.columns), new):
        return {"version": known[-1], **counts, "rewritten": 0}
    made = _written(new.select(*[F.col(f"`{c}`") for c in new.columns]), path, key, buckets)
    parts = {p: f for p, f in manifest["parts"].items() if p not in touched} | made
    wider = T.StructType([*schema.fields, *[f for f in new.schema.fields if f.name not in schema.fieldNames()]])
    _commit(spark, path, known[-1] + 1, {"schema": wider.jsonValue(), "key": key, "buckets": buckets, "parts": parts})
    return {"version": known[-1] + 1, **counts, "rewritten": len(made)}


def append_run(run: DataFrame, path: str, run_id: str) -> None:
    """History rows of one run, under its id: the same run written again replaces itself."""
    run.write.mode("overwrite").parquet(f"{path}/run={run_id}")


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Forget all but the newest ``keep`` versions and delete partitions that none of those names; the number of deleted folders."""
    fs, path_of = _fs(spark, path)
    known = versions(spark, path)
    old, held = known[:-keep], known[-keep:]
    used = {f for v in held for f in _manifest(spark, path, v)["parts"].values()}
    gone = {f for v in old for f in _manifest(spark, path, v)["parts"].values()} - used
    for v in old:
        fs.delete(path_of(f"{path}/_versions/{v}"), False)
    for f in gone:
        fs.delete(path_of(f"{path}/{f}"), True)
    return len(gone)
