"""Small helpers of the operators: reading a table, Arrow batches in and out, staged tables."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recollect import session
from recollect.session import drop_staged as drop, staging_root

__all__ = ["arrow_filter", "arrow_map", "doc_bytes", "drop", "read", "stage", "stage_narrow", "staging_root"]
#: Shuffle files of a query go when it has ended, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared staging folder and read back; its shuffle files are removed afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return session.stage(df, name)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def stage_narrow(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for a table of a few narrow columns: at most four tasks and files for each core, however many the shuffle has."""
    return stage(df.coalesce(max(16, 4 * df.sparkSession.sparkContext.defaultParallelism)), name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str | Column) -> DataFrame:
    """(doc_id, data): the id as bigint and the text's UTF-8 bytes, null for a null text."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("data"), *more)


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], dict | None], schema: str, rows: int = 0) -> DataFrame:
    """``mapInArrow`` with one function per batch that returns the columns of the output.

    ``rows`` splits large batches, so that the work arrays of a task stay small.
    """
    target = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = rows or max(1, batch.num_rows)
            for at in range(0, batch.num_rows, size):
                out = step(batch.slice(at, size))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, column: str, keep: Callable[[str | None], bool]) -> DataFrame:
    """The rows of ``df`` whose ``column`` passes ``keep``. Only this column goes to Python, and only the verdicts come back."""
    def verdicts(values: pa.Array) -> pa.Array:
        return pa.array([keep(x.as_py()) for x in values], pa.bool_())

    return df.where(F.arrow_udf(verdicts, "boolean")(F.col(column)))


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
