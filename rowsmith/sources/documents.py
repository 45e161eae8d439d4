"""Documents and their lines."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_END = "\r\n|\r|\n"
#: Characters of a text that Python takes at once; a batch has 10,000 such pieces at most, whatever the size of the texts.
PIECE = 2000


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the folder that the session names for checkpoints: cuts lineage, and survives lost executors.

    A temporary folder only where the session names none, as in tests on one machine.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-kept-"))
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """All rows of a key in one task, for Python that needs them together.

    Dealt by a hash of the keys: Spark drops a repartition() by columns that a join below already deals rows by, and then
    may read that join's rows where they were written, which tears the rows of a key apart.
    """
    return df.repartition(F.xxhash64(*keys))


def lines_of(text: Column) -> Column:
    """Array of the lines of a text; CR, LF and CRLF each end one."""
    return F.split(text, LINE_END)


def pieces_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_k, _i (from 0), _x: each text in pieces, one behind the other, for Texts. An empty text is one piece; a null text has none."""
    x = F.col(text)
    # No piece ends between CR and LF.
    pieces = F.regexp_extract_all(x, F.lit(rf"(?s).{{1,{PIECE}}}(?:(?<=\r)\n)?"), F.lit(0))
    return docs.select(F.col(key).alias("_k"), F.posexplode(F.when(x == "", F.array(F.lit(""))).otherwise(pieces)).alias("_i", "_x"))


class Texts:
    """(key, its lines one after the other) of the texts in the Arrow batches of pieces_of(); the lines of a text are to be used up
    before the next one. kind: the Arrow type of the keys."""

    def __init__(self, batches):
        self.batches, self.kind = batches, None

    def _lines(self):
        """(key, line, whether it is the last of its text)."""
        parts, key = None, None
        for batch in self.batches:
            self.kind = batch.column("_k").type
            for k, i, x in zip(*(batch.column(n).to_pylist() for n in ("_k", "_i", "_x"))):
                if i == 0:
                    if parts is not None:
                        yield key, "".join(parts), True
                    parts, key = [], k
                first, *more = re.split(LINE_END, x)
                parts.append(first)
                for line in more:
                    yield key, "".join(parts), False
                    parts = [line]
        if parts is not None:
            yield key, "".join(parts), True

    def __iter__(self):
        each = self._lines()

        def own(line, last):
            yield line
            while not last:
                _, line, last = next(each)
                yield line

        for k, line, last in each:
            yield k, own(line, last)


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 0), line. A null text has no lines."""
    return docs.select(key, F.posexplode(lines_of(F.col(text))).alias("n", "line")).select(key, F.col("n").cast("long").alias("line_no"), "line")


def write_records(records: DataFrame, path: str, template: str | None = None) -> None:
    """Records as Parquet, in a folder for each template where there is such a column."""
    w = records.write.mode("overwrite")
    (w.partitionBy(template) if template else w).parquet(path)
