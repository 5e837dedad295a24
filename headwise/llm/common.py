"""What the operators share: tables, cut points in the shared folder, tokens, columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import headwise
from headwise.sources.store import shared_root

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of an application this package, once, as a zip that Spark
    distributes. Needed only where it is not installed on the executors."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(headwise.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="headwise-")) / "headwise.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def with_package(build: Callable) -> Callable:
    """A query or stage that ships the package first."""
    @wraps(build)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return build(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a relation to the shared folder once and go on from the written table."""
    path = f"{shared_root(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that an operator is about to add (compared as Spark does,
    ignoring case): an operator's own column replaces one of the same name."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether the row belongs to the fold that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(-1)) == fold


def tokens(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. `bytes` knows exactly these blanks
    and lowers only these letters."""
    return text.encode().lower().split() if text else []
