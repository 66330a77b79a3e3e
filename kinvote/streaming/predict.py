"""Predictions for queries that arrive as a stream, against static references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinvote.operators.transfer import LabelTransferConfig, predict
from kinvote.operators.votes import annotation_density, annotation_frequency
from kinvote.sources.scratch import cut, scope


def predict_stream(queries: DataFrame, refs: DataFrame, annotations: DataFrame, terms: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: LabelTransferConfig | None = None, trigger: dict | None = None, **inputs) -> StreamingQuery:
    """Run ``predict`` on every micro-batch and hand its rows and the batch number to ``sink``.

    Queries are independent of each other, so the rows are those of one batch
    over all queries. Deciding on calibration from the scores at hand would make
    them depend on the batches: with a model, ``calibration`` must be set to
    ``always`` or ``never``. A sink that overwrites by batch number is exactly-once.
    The counts over the annotations are taken once; intermediate tables of a
    batch are deleted when the sink has returned.
    """
    config = config or LabelTransferConfig()
    if (inputs.get("model") or inputs.get("models_by_aspect")) and config.calibration == "auto":
        raise ValueError("streams need a fixed calibration")
    counts = tuple(cut(count(annotations), "counts") for count in (annotation_frequency, annotation_density))

    def run(batch: DataFrame, number: int) -> None:
        with scope():
            sink(predict(batch, refs, annotations, terms, config, counts=counts, **inputs), number)

    writer = queries.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(run).start()
