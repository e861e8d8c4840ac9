"""What several operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempofeat.storage import fixed as cut  # noqa: F401  (a reliable checkpoint in the folder all executors share)
from tempofeat.storage import new_folder


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and reread: for wide rows, of which a reader takes some columns."""
    folder = new_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column in `columns` has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Arrow batches of this session have at most `rows` rows.

    Rows are whole documents: with the default of 10,000 a batch, and what both
    sides keep of it, takes several times 30 MB in each task. Spark reads the
    setting when a plan runs, not when it is made, so it cannot be put back
    here; a session that already asks for other than the default is left alone.
    """
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", 10_000
    if int(spark.conf.get(key, str(default))) == default:
        spark.conf.set(key, str(rows))
