"""Where intermediate tables live.

A stage that several later stages read (the vocabulary, the encoded vectors) is
written once as a Parquet table under the shared folder the session names in
``spark.checkpoint.dir`` and read back.  That cuts the lineage, survives the loss of
executors, and gives the optimizer real file sizes to choose join strategies by.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be sent to every executor in place of shuffling what it is joined to.
MOST_SENT_BYTES = 128 << 20

#: The folder of each local application that names none; the setting itself cannot be changed later.
_FALLBACKS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a local session may do without the setting: its application then gets a temporary
    folder of its own, which all sessions of the application share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _FALLBACKS:
        _FALLBACKS[application] = tempfile.mkdtemp(prefix="nearprint-")
    return _FALLBACKS[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sent_if_small(stored: DataFrame) -> DataFrame:
    """A stored table, marked to be broadcast if its rows, as executors hold them, stay below a bound.

    For a side that is far smaller than the pairs it is joined to, of which there is one for each
    two articles: Spark's own threshold would have all of them shuffled.
    """
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in stored.dtypes if kind == "string"]
    row = sum(texts, F.lit(32 + 16 * len(stored.columns))).cast("long")
    held = stored.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(stored) if held <= MOST_SENT_BYTES else stored


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
