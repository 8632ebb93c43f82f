"""What several operators share: shared-folder tables, size-checked look-ups and Arrow maps over whole texts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: The white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many rows and characters may be broadcast; both are measured on the written table.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; on a local master without it, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="screenwright-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors cost one task and not the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame) -> bool:
    """Whether a written table is within the broadcast bound; counts its rows and the characters of its strings."""
    chars = [F.sum(F.length(F.col(f"`{f.name}`").cast("string"))) for f in df.schema]
    rows, *lengths = df.agg(F.count(F.lit(1)), *chars).first()
    return rows <= BROADCAST_ROWS and sum(x or 0 for x in lengths) <= BROADCAST_CHARS


def look_up(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a written table with one row a key: broadcast within the bound, else a shuffle whose hot keys AQE splits.

    Keys compare null-safe; the table's key columns are dropped.
    """
    named = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = None
    for k in keys:
        same = df[k].eqNullSafe(named[f"_key_{k}"])
        on = same if on is None else on & same
    named = F.broadcast(named) if small_enough(table) else named
    return df.join(named, on, how).drop(*(f"_key_{k}" for k in keys))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the Python workers once an application, unless their path has it."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='screenwright-')}/screenwright", "zip", root, "screenwright")
    sc.addPyFile(archive)


def mapped(df: DataFrame, work: Callable, schema: StructType | str) -> DataFrame:
    """``df`` through a function over Arrow batches."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def map_texts(docs: DataFrame, text: str, carry: list[str], result: str,
              make: Callable[[], Callable[[list], list]], struct: str = "_found") -> DataFrame:
    """Add a struct column ``struct`` with the fields ``result`` (DDL), worked out in Arrow batches from whole texts.

    ``make`` runs once a task and gives the function from a list of texts (None for null) to one list a field. The
    columns of ``carry`` travel in one struct, so their names cannot clash with anything.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"), F.col(f"`{text}`").alias("_text"))
    fields = StructType.fromDDL(result)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            row = batch.column(0)
            for at in range(0, max(1, batch.num_rows), 2000):
                texts = batch.column(1).slice(at, 2000).to_pylist()
                columns = [pa.array(x, t) for x, t in zip(work(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([row.slice(at, 2000), *columns], ["_row", *names])

    schema = StructType([packed.schema["_row"], *fields])
    out = mapped(packed, run, schema)
    return out.select(*(F.col("_row").getField(c).alias(c) for c in carry),
                      F.struct(*(F.col(f"`{n}`") for n in names)).alias(struct))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
