"""Answers kept between processes: a folder of Parquet files in generations, one file an answer."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from recollect import schemas
from recollect.operators import answers

#: Files of a generation from which on it is rewritten as one, without what is too old.
FILES = 64


class AnswerCache:
    """``root/g<number>`` is the newest generation. A lost answer is only asked again, so writers need no lock."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _generations(self) -> list[int]:
        fs, root = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "g" and n[1:].isdigit())

    def table(self) -> DataFrame:
        done = self._generations()
        return self.spark.read.schema(schemas.ANSWERS).parquet(f"{self.root}/g{done[-1]}") if done else self.spark.createDataFrame([], schemas.ANSWERS)

    def find(self, key: str, now: float):
        """The newest answer under ``key`` that isn't too old, or None. The key reaches the scan."""
        return answers.fresh(self.table().where(F.col("key") == key), now).orderBy(F.desc("cached_at_unix")).first()

    def keep(self, row: tuple, now: float) -> None:
        """Adds one row of ``schemas.ANSWERS``; rewrites the generation when it has many files."""
        no = self._generations()[-1:] or [1]
        at = f"{self.root}/g{no[0]}"
        self.spark.createDataFrame([row], schemas.ANSWERS).coalesce(1).write.mode("append").parquet(at)
        fs, folder = self._fs(at)
        if sum(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(folder)) < FILES:
            return
        newest = answers.fresh(self.table(), now).groupBy("key").agg(F.max_by(F.struct(*schemas.ANSWERS.fieldNames()), "cached_at_unix").alias("r"))
        newest.select("r.*").coalesce(1).write.parquet(f"{self.root}/.g{no[0] + 1}")
        fs.rename(self._fs(f"{self.root}/.g{no[0] + 1}")[1], self._fs(f"{self.root}/g{no[0] + 1}")[1])
        fs.delete(folder, True)
