"""Written tables that cut lineage.

The folder is the one the session names in ``spark.checkpoint.dir``: it is shared
by all executors, so a table written there outlives any of them.  Parquet is used
rather than ``checkpoint()`` because later reads can still prune columns.

Tables stay until they are removed: ``managed`` removes what was written inside it,
``tables`` lists what is left, ``remove`` takes such a list.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}
_OUTLIVING: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="millrace-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, label: str, listed: bool = True) -> str:
    """A path for a new table; one that is not listed is the caller's and never removed here."""
    path = f"{scratch_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    if listed:
        _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def tables(spark: SparkSession) -> list[str]:
    """Paths of the scratch tables that this session has made and not removed, oldest first."""
    return list(_TABLES.get(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables that no DataFrame in use reads any more."""
    listed = _TABLES.get(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in list(paths):
        if name in listed:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(hadoop).delete(path, True)
            listed.remove(name)


@contextmanager
def managed(spark: SparkSession) -> Iterator[None]:
    """Remove at the end the scratch tables written inside.

    What is made inside must be used up inside, but for tables written with ``outlives``.
    """
    before = set(tables(spark))
    try:
        yield
    finally:
        remove(spark, [p for p in tables(spark) if p not in before and p not in _OUTLIVING])


def written(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """Write the table once and go on from the files; it may outlive the ``managed`` block it is made in."""
    path = new_path(df.sparkSession, label)
    if outlives:
        _OUTLIVING.add(path)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
