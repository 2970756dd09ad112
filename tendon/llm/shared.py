"""Tables and files in the folder that the driver and all executors share, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table is sent to every executor; above it the lookup is a shuffled join.
BROADCAST_ROWS = 100_000
#: A key that holds at least one row in HOT_PARTS is joined apart from the others; there are at most HOT_PARTS such keys.
HOT_PARTS = 1_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and all runs on one machine (tests), a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("tendon.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tendon-shared-")
        spark.conf.set("tendon.shared.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads need neither the plan above nor the executors that ran it."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def local_path(uri: str) -> str | None:
    """The path that ``open`` takes if the shared folder is a mounted one, else None."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put_file(uri: str, data: bytes) -> None:
    """Write a file whole or not at all; a task that is run twice writes the same bytes twice."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(at), recursive=True)
        with store.open_output_stream(at) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def mapped_path(uri: str) -> str:
    """A path that can be memory-mapped; a file in a remote store is first copied beside the worker, which removes it when it ends."""
    path = local_path(uri)
    if path is not None:
        return path
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    path = os.path.join(tempfile.gettempdir(), "tendon-mapped", f"{os.getpid()}-" + at.strip("/").replace("/", "_"))
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        atexit.register(lambda: os.path.exists(path) and os.remove(path))
        with store.open_input_stream(at) as src, open(part := f"{path}.part", "wb") as out:
            while block := src.read(1 << 22):
                out.write(block)
        os.replace(part, path)
    return path


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int, wide: bool = False) -> DataFrame:
    """Left join of ``left`` with ``right``, which is saved and has one row per key.

    ``weight`` is a column of ``right``: how many rows of ``left`` have the key; ``rows`` is the number of rows of
    ``left``. A small ``right`` is broadcast after its rows were counted. Otherwise a key that holds one row in
    HOT_PARTS or more (at most HOT_PARTS keys) is copied, and the rows of ``left`` that have it are dealt among the
    copies; only these keys and the numbers of their copies are broadcast, and no task gets a large key. So it is at
    any size with ``wide``, for rows of ``right`` that have no bound in bytes. Keys must not be null.
    """
    if not wide and right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, "left")
    hot_from = max(2, -(-rows // HOT_PARTS))
    copies = F.ceil(F.col(weight) / F.lit(hot_from)).cast("int")
    hot = right.where(F.col(weight) >= hot_from).select(*keys, copies.alias("__copies"))
    dealt = left.join(F.broadcast(hot), keys, "left")
    # by the row's contents and not by chance, so that a task that runs again deals its rows alike
    contents = F.xxhash64(*(F.col(f"`{c}`") for c, t in left.dtypes if "map<" not in t))
    dealt = dealt.withColumn("__copy", F.coalesce(F.pmod(contents, F.col("__copies")).cast("int"), F.lit(0))).drop("__copies")
    spread = F.when(F.col(weight) >= hot_from, copies).otherwise(1)
    copied = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), spread - 1)))
    return dealt.join(copied, [*keys, "__copy"], "left").drop("__copy")


def text_of(column: str = "text") -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
