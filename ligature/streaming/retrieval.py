"""Candidates for a stream of query records against a static corpus. An entity's candidates, and so its rank and gaps, lie within its
micro-batch: each record is retrieved when it comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.retrieval import DF_CAP, TOP_K, retrieve
from ..sources.staging import dropped
from ..sources.tables import prepare_records


def retrieve_stream(records: DataFrame, corpus: DataFrame, sink: Callable[[DataFrame, int], None], top_k: int = TOP_K, df_cap: int = DF_CAP) -> DataStreamWriter:
    """Raw records of a stream to sink(candidates, batch id). The sink is called again with the same id if a batch is repeated; tables behind its
    candidates go when it returns."""

    def each(batch: DataFrame, batch_id: int) -> None:
        with dropped(batch.sparkSession):
            sink(retrieve(prepare_records(batch.dropDuplicates(["entity_id"])), corpus, top_k, df_cap), batch_id)

    return records.writeStream.foreachBatch(each)
