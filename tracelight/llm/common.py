"""Shared helpers of the training-data operators."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of these six.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where nothing is set, a local session gets a temporary folder; a cluster is refused,
    because one machine's folder is not visible to the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tracelight-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read back.

    Cuts the lineage without running the plan twice, as checkpoint() would, and survives the
    loss of any executor. Whoever owns spark.checkpoint.dir clears what clearing() leaves.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    _STORED.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that stored() has made within the innermost clearing().
_STORED: ContextVar[list[str]] = ContextVar("stored", default=[])


def clearing(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """make, which deletes the folders that it has stored but those that its result still reads."""

    @functools.wraps(make)
    def run(*args, **options) -> DataFrame:
        own: list[str] = []
        token = _STORED.set(own)
        try:
            df = make(*args, **options)
        finally:
            _STORED.reset(token)
        read = {name for f in df.inputFiles() for name in re.findall(r"/(tracelight-[0-9a-f]{32})/", f)}
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for path in own:
            if path.rpartition("/")[2] in read:
                _STORED.get().append(path)
            else:
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)
        return df

    return run


def small(df: DataFrame, rows: int) -> DataFrame:
    """A stored df, broadcast if it has at most so many rows; larger ones are shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def words(text) -> F.Column:
    """Words of a text column as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")


def ascii_lower(c) -> F.Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)
