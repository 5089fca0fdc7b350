"""Quality findings of newly arrived table files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import table_findings
from ..rules import RulePack


def findings_per_batch(
    arrivals: DataFrame,
    table: str,
    pack: RulePack,
    as_of: date,
    out_path: str,
    checkpoint_path: str,
    related: dict[str, DataFrame] | None = None,
) -> StreamingQuery:
    """Run the table checks on each batch of a streaming DataFrame.

    A batch writes the folder of its own id with overwrite, so a batch that runs again after a
    failure replaces its findings instead of repeating them.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the checks read it several times
        found = table_findings(table, batch, pack, as_of, related)
        found.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out_path.rstrip('/')}/batch={batch_id}"
        )
        batch.unpersist()

    return (
        arrivals.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
