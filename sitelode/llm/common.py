"""What the operators of this subpackage share: tables, the shared folder, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; the same pattern works in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local sessions that name none, as in tests.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local session may name none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        path = _LOCAL[app] = _LOCAL.get(app) or tempfile.mkdtemp(prefix="sitelode-")
    return path.rstrip("/")


#: What this process has written into shared folders, for remove_intermediates().
_WRITTEN: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sitelode/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def remove_intermediates(spark: SparkSession) -> None:
    """Deletes what this process has written by the way. Results that are not yet written themselves can't be read any more."""
    for (name,) in spark.sql("SHOW TABLES LIKE 'sitelode_katz_*'").select("tableName").collect():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: bytes | str | None) -> list[bytes]:
    """The words of a text with A-Z lowered. bytes.split() splits at exactly the six ASCII white-space characters."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a document. A null id has the fold of an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")
