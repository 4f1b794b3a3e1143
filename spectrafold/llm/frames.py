"""Small helpers around DataFrames for the operators of this package."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

import spectrafold
from spectrafold.session import shared_folder

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and have Python given small batches: texts may be very long."""
    if int(spark.conf.get(BATCH_ROWS)) > 500:
        spark.conf.set(BATCH_ROWS, "500")
    ship(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder."""
    prepare(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()
_offered: list[tempfile.TemporaryDirectory] = []


def offered(name: str) -> str:
    """Path of a file the driver offers to its workers; it stays until the driver ends."""
    _offered.append(tempfile.TemporaryDirectory(prefix="spectrafold-"))
    return os.path.join(_offered[-1].name, name)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(spectrafold.__file__).parent
    path = offered("spectrafold.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def extended(df: DataFrame, added: str) -> T.StructType:
    """Schema of ``df`` with the added columns last; of equal names (case aside) the added one."""
    new = T._parse_datatype_string(added)
    taken = {f.name.lower() for f in new}
    return T.StructType([f for f in df.schema if f.name.lower() not in taken] + list(new))


def mapped(
    df: DataFrame, added: str, start: Callable[[], Callable[..., dict]], inputs: Sequence[str], drop: Sequence[str] = ()
) -> DataFrame:
    """``df`` with columns computed in Python from whole batches of ``inputs``.

    ``start`` is called once a task and returns the function that is given the inputs as lists
    and returns the added columns by name. Other columns pass untouched, whatever their type.
    """
    schema = extended(df.drop(*drop), added)
    names = schema.names
    types = {f.name: to_arrow_type(f.dataType) for f in T._parse_datatype_string(added)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            made = compute(*(batch.column(c).to_pylist() for c in inputs))
            arrays = [
                pa.array(made[c], type=types[c]) if c in types else batch.column(c) for c in names
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of the tables that ``stored`` returned


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned (KeyError for any other) and nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop(table))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of finished work, before the next step writes as much again.

    It does so when the driver's garbage is collected, by itself every half hour at least. The
    news of a query's end still holds the query for a moment, hence the second time.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def bounded_rows(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of ``key``: alike on any layout."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(limit)
