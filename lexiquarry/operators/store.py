"""Several tables written as one: parts are staged by batch, a manifest is written last, and readers go by manifests.

    folder/parts/<batch>/<table>/*.parquet
    folder/manifests/<batch>.json

A batch is there once its manifest is, whole; until then, or if the job dies in between, readers see the state before.  A batch
that has been committed is not written again, so a job that is run again adds nothing.  ``sweep`` deletes the parts of
batches that never came to a manifest.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_batch() -> str:
    return uuid.uuid4().hex


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def committed(spark: SparkSession, folder: str, batch: str) -> bool:
    fs, path = _fs(spark, folder)
    return fs.exists(path(f"{folder}/manifests/{batch}.json"))


@contextmanager
def commit(spark: SparkSession, folder: str, batch: str, **facts) -> Iterator[Callable[[str, DataFrame], DataFrame]]:
    """``with commit(...) as add``: ``add(table, rows)`` stages rows and gives them back as they are stored.

    The manifest, with the tables' schemas, the time and ``facts`` (of JSON), is written when the block ends without an error: to a
    file beside it first, which is then renamed.  Staging replaces what an earlier attempt of the batch left.
    """
    staged: dict[str, str] = {}

    def add(table: str, rows: DataFrame) -> DataFrame:
        where = f"{folder}/parts/{batch}/{table}"
        rows.write.mode("overwrite").parquet(where)
        staged[table] = rows.schema.json()
        return spark.read.schema(rows.schema).parquet(where)

    yield add
    fs, path = _fs(spark, folder)
    if committed(spark, folder, batch):
        return
    text = json.dumps({"batch": batch, "at": time.time(), "tables": staged, "facts": facts}, sort_keys=True)
    draft = path(f"{folder}/manifests/.{batch}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, path(f"{folder}/manifests/{batch}.json")):
        fs.delete(draft, False)
        if not committed(spark, folder, batch):
            raise OSError(f"the manifest of {batch} could not be written")


def write(spark: SparkSession, folder: str, batch: str, tables: dict[str, DataFrame], **facts) -> bool:
    """All of ``tables`` as one commit; False if the batch is there already."""
    if committed(spark, folder, batch):
        return False
    with commit(spark, folder, batch, **facts) as add:
        for name, rows in tables.items():
            add(name, rows)
    return True


def manifests(spark: SparkSession, folder: str) -> list[dict]:
    """The manifests of committed batches, oldest first: one small file a batch."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(f"{folder}/manifests")):
        return []
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "[!.]*.json").text(f"{folder}/manifests").collect()
    return sorted((json.loads(r.value) for r in rows), key=lambda m: (m["at"], m["batch"]))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """The rows of ``table`` in all committed batches, with ``batch`` and ``committed_at``; None if it is in none."""
    own = [m for m in manifests(spark, folder) if table in m["tables"]]
    if not own:
        return None
    schema = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(own[-1]["tables"][table]).toDDL()
    rows = spark.read.schema(schema).option("basePath", f"{folder}/parts").parquet(*[f"{folder}/parts/{m['batch']}/{table}" for m in own])
    rows = rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/parts/([^/]+)/[^/]+/[^/]*$", 1))
    times = spark.createDataFrame([(m["batch"], m["at"]) for m in own], "batch string, committed_at double")
    return rows.join(F.broadcast(times), "batch")  # one row a batch


def latest(spark: SparkSession, folder: str, table: str, keys: list[str]) -> DataFrame | None:
    """``read``, of equal keys only what was committed last: how changed rows replace older ones."""
    rows = read(spark, folder, table)
    if rows is None:
        return None
    w = Window.partitionBy(*keys).orderBy(F.desc("committed_at"), F.desc("batch"))
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def sweep(spark: SparkSession, folder: str, older_than_s: float = 86_400.0) -> list[str]:
    """Delete the parts of batches without a manifest whose folder was last changed before that; their names."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(f"{folder}/parts")):
        return []
    kept = {m["batch"] for m in manifests(spark, folder)}
    old = [s for s in fs.listStatus(path(f"{folder}/parts")) if s.getPath().getName() not in kept and s.getModificationTime() / 1000 <= time.time() - older_than_s]
    for status in old:
        fs.delete(status.getPath(), True)
    return sorted(s.getPath().getName() for s in old)
