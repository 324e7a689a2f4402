"""Sessions, and getting this package to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's Python files to the workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_lodeframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    place = os.path.join(tempfile.mkdtemp(prefix="lodeframe-"), "lodeframe.zip")
    with zipfile.ZipFile(place, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    context.addPyFile(place)
    context._lodeframe_shipped = True


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder that ``spark.checkpoint.dir`` names.

    Where that is unset, a temporary folder will do as long as one machine is all there is; on a
    cluster, where a lost executor would take it along, it is an error.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    """Where checkpoints go, a folder of this application's own in ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = os.path.join(tempfile.gettempdir(), "lodeframe-checkpoints")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, as a Parquet table: columns are read apart, and repeated values take little room."""
    place = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to as many parts as shuffles have, for work that takes far longer than the bytes of its input tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns[:1])


#: Narrow rows that are work enough for a task.
ROWS_A_TASK = 16_384


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` narrow rows at most, in no more tasks than these are work for, and no more than it has."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint that does not remember the size its plan was estimated at.

    For loops whose rounds join what the last one wrote: a join is estimated at the product of its
    sides, so the digits of the estimate double with each round until they fill the driver's memory.
    """
    kept = checkpoint(df)
    session = kept.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), session)
