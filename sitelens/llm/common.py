"""What the training-data operators share: word splitting, safe columns and pinned tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace, the separators of plain words.
SPACE = r"\x20\x09-\x0D"
#: Bytes to lower-cased letters, digits and everything from 0x80 on; the rest becomes a blank.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII whitespace, A-Z lower-cased; no words in a null."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; no words in a null."""
    return text.translate(ALNUM).split() if text else []


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under column names that no operator adds, and the new name of each old one."""
    new = {c: f"column {k}" for k, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), new


def restored(df: DataFrame, new: dict[str, str], extra: list[str] | None = None) -> DataFrame:
    """The columns of before renamed(), and then extra ones."""
    return df.select(*[F.col(f"`{n}`").alias(c) for c, n in new.items()], *(extra or []))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where none is named, a session on one machine gets a temporary folder, and one on a cluster an error: its machines don't see each other's folders.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        at = sc._jsc.sc().getCheckpointDir()
        if at.isEmpty():
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sitelens-"))
            at = sc._jsc.sc().getCheckpointDir()
        root = at.get()
    return root.rstrip("/")


#: Removes the shuffle files of a write as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders of pinned tables that nothing has deleted yet.
_pinned: list[str] = []


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: computed once, its lineage is cut, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pinned-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    _pinned.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unpin(*dfs: DataFrame) -> None:
    """Delete what pin() wrote, once nothing reads it any more."""
    for df in dfs:
        names = df.inputFiles()[:1]
        for path in [p for p in _pinned if names and f"/{p.rpartition('/')[2]}/" in names[0]]:
            _delete(df.sparkSession, path)
            _pinned.remove(path)


def unpin_since(spark: SparkSession, mark: int) -> None:
    """Delete all that was pinned after ``mark`` tables stood; for a caller that has written its result."""
    while len(_pinned) > mark:
        _delete(spark, _pinned.pop())


def pinned() -> int:
    """How many pinned tables stand, as a mark for unpin_since()."""
    return len(_pinned)
