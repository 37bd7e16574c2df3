"""Models of one's own in place of rules, with the rules as fall-back."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def answered(rows: DataFrame, inputs: list[str], model: Callable[[list[dict]], list], answer: str, kind: str) -> DataFrame:
    """``rows`` with the column ``answer`` of type ``kind``: what ``model`` says of each row.

    model takes a list of dicts of the input columns and gives a list of as many answers, None where
    it has none. It is called once for each Arrow batch of at most 1,000 rows. If it raises or gives a
    list of another length, the whole batch has null answers, so that rules can step in.
    """
    shape = rows.limit(0).selectExpr("*", f"CAST(NULL AS {kind}) AS `{answer}`").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        field = to_arrow_schema(shape).field(answer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                try:
                    said = list(model(some.select(inputs).to_pylist()))
                    if len(said) != some.num_rows:
                        raise ValueError("a model must give one answer for each row")
                    column = pa.array(said, field.type)
                except Exception:  # a failing model must not fail the job
                    column = pa.nulls(some.num_rows, field.type)
                yield pa.RecordBatch.from_arrays([*some.columns, column], [*some.schema.names, answer])

    return rows.mapInArrow(run, shape)
