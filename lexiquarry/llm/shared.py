"""Helpers that several operators use: written tables in the shared folder, size-checked broadcasts, bounded batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a one-row-per-key table may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Rows up to which a table of one long integer may be broadcast.
BROADCAST_KEYS = 1_000_000
#: Bytes of an Arrow batch, so that long texts make no large buffers in the JVM or in Python.
BATCH_BYTES = "4m"

#: The characters that count as white space in the contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"

_local_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves in local mode, as in tests; a cluster has no folder that all
    its machines share, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        if context.applicationId not in _local_roots:
            _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="lexiquarry-")
        root = _local_roots[context.applicationId]
    return f"{root.rstrip('/')}/lexiquarry/{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there and rows are fixed.

    The settled tables of ``done``, which only ``df`` needed, are deleted then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    discard(*done)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "settled_at", None)
        if path:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where.getParent(), True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_uid(docs: DataFrame, name: str, *columns) -> tuple[DataFrame, str]:
    """``docs`` as a settled table with a number for each row, and that column's name.

    Ids may repeat or be null; the number tells rows apart, and once written it is the same for every reader.
    ``columns`` are added to the table (Columns with names of their own).
    """
    uid = free_name(docs, "row_uid")
    return settle(docs.select("*", F.monotonically_increasing_id().alias(uid), *columns), name), uid


def join_keyed(left: DataFrame, keyed: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a settled table of one row per key: broadcast if its counted rows are few, else by shuffle."""
    return left.join(F.broadcast(keyed) if keyed.count() <= BROADCAST_ROWS else keyed, on, how)


def without_rows(docs: DataFrame, uid: str, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose numbers are in ``gone`` (a settled table of one column), and less the numbers."""
    few = gone.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone, uid, "left_anti").drop(uid)


def without_blanks(text):
    """``text`` less every character of BLANKS; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches, keys: list[str]):
    """From Arrow batches in which equal keys (integers) stand together: (table, bounds) with whole groups."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        same = bool(held) and all(held[-1][k][-1].as_py() == table[k][0].as_py() == table[k][-1].as_py() for k in keys)
        held.append(table)
        if same:  # the batch goes on with one group: nothing to give out yet
            continue
        table = pa.concat_tables(held)
        starts = _starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
            table = table.slice(starts[-1]).combine_chunks()
        held = [table]
    if held:
        table = pa.concat_tables(held)
        yield table, np.array([0, table.num_rows])


def _starts(table, keys: list[str]):
    import numpy as np

    new = np.zeros(table.num_rows - 1, bool)
    for k in keys:
        v = table[k].to_numpy()
        new |= v[1:] != v[:-1]
    return np.r_[0, np.flatnonzero(new) + 1]


def in_groups(df: DataFrame, keys: list[str], partitions: int, do, schema: str) -> DataFrame:
    """``df.mapInArrow(do)`` with the rows of equal keys together, in order."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(freeing(do), schema)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES from now on: always the same value, so queries that run at once don't disturb each other."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release() -> None:
    """Give memory that a task has freed back to the system; idle Python workers then hold little."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def freeing(do):
    """``do`` for mapInArrow, giving back its memory when the task ends."""

    def run(batches):
        try:
            yield from do(batches)
        finally:
            release()

    return run


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
