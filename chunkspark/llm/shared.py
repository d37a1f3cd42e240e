"""What the operators share: written tables, samples by hash, kernels over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.folder import drop, materialize, new_path, shared_dir  # noqa: F401
from . import kernels as K

def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def sample_by_hash(df: DataFrame, by: list[str], key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each group, those with the lowest hash of the key: the same rows however the input is partitioned."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def extend(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def map_text(df: DataFrame, keep: list[str], text_col: str, make: Callable[[], Callable[[pa.Array], list]], ddl: str, lower: bool = True) -> DataFrame:
    """Columns that are computed from each text, beside those of ``keep``. make() runs once in a task; what it returns gets a slice of the texts and gives an array for each column of the ddl."""
    head = df.select(*map(quoted, keep))
    names, n = [*head.columns, *StructType.fromDDL(ddl).names], len(keep)
    at = keep.index(text_col) if text_col in keep else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            texts = K.plain(batch.column(at), lower)
            for a, b in K.slices(texts):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in f(texts[a:b])]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:n]), *made], names)
        K.release()

    return small_batches(df).select(*map(quoted, keep), *[quoted(text_col)] * (at == n)).mapInArrow(run, extend(head, ddl))


def small_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """df, after a lowering of its session's limit on the bytes of an Arrow batch: tasks then need less memory beside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(df.sparkSession.conf.get(name)).rstrip("b")
    if not now.isdigit() or int(now) > most:
        df.sparkSession.conf.set(name, str(most))
    return df


def stable_order(*columns: pa.ChunkedArray) -> list[int]:
    """Row numbers, sorted by the columns."""
    rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
    return sorted(range(len(rows)), key=rows.__getitem__)


def small_side(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """ids, to be broadcast in a join if it has at most ``most`` rows (some 50 MB); beyond that the join shuffles, with the same result. ids should be written already, or cheap to count."""
    return F.broadcast(ids) if ids.count() <= most else ids
