"""What a run leaves behind: tables, CSV of its evidence, a JSON summary and a marker that it is complete."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_run(folder: str, tables: dict[str, DataFrame], summary: DataFrame) -> None:
    """Writes each table as parquet, ``evidence`` and ``events`` as CSV with a header too, the summary as JSON lines; the marker comes last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        if name in ("evidence", "events"):
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/summary.json")
    summary.sparkSession.range(1).select(F.lit("complete").alias("value")).write.mode("overwrite").text(f"{folder}/_COMPLETE")


def arrow_streams(df: DataFrame) -> DataFrame:
    """(content): one Arrow stream per partition, also of empty ones, for readers that want files of them."""
    schema = df.schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, writer = pa.BufferOutputStream(), None
        for batch in batches:
            writer = writer or pa.ipc.new_stream(sink, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            writer = pa.ipc.new_stream(sink, pa.schema([(n, pa.null()) for n in names]))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["content"])

    return df.mapInArrow(run, "content binary")


def console(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text, for a report."""
    return pd.DataFrame([r.asDict() for r in df.take(rows)], columns=df.columns).to_string(index=False)
