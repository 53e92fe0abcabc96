"""Sequential folds over groups whose rows need an order and a state that no window can hold."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS_AT_ONCE = 4000


def fold(df: DataFrame, by: list[str], order: list[str], schema: str, work: Callable[[Iterator], Iterable[tuple]]) -> DataFrame:
    """``work`` gets the rows of each group in ``order``, one at a time, and gives rows of ``schema``.

    Groups follow each other in sorted partitions, so that small groups cost no call of their own and a large one
    is never held as a whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)
    names = [*by, *[c for c in df.columns if c not in by]]
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = namedtuple("Row", names)
        source = (kind(*row) for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        ahead = next(source, None)

        def group() -> Iterator:
            nonlocal ahead
            key = ahead[:width]
            while ahead is not None and ahead[:width] == key:
                row = ahead
                ahead = next(source, None)
                yield row

        def worked() -> Iterator[Iterable[tuple]]:
            while ahead is not None:
                rows = group()
                yield work(rows)
                for _ in rows:
                    pass

        made = chain.from_iterable(worked())
        while out := list(islice(made, ROWS_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    dealt = df.select(*names).repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(run, spark_schema)
