"""Tables in one order over all partitions, and words about turns of a conversation that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import durable

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def in_order(df: DataFrame, *keys: Column | str) -> DataFrame:
    """A durable copy dealt by ranges of the keys and sorted: partition after partition, row after row, it is in order.

    Ranges follow a sample of the keys, so a key that many rows begin with is spread where the later keys differ.
    """
    return durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys))


def turn_digest(role: Column, text: Column) -> Column:
    """MD5 (hex) of a role and a text; the length in front keeps the two apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, pa.Table]]:
    """Consecutive rows with one value of a column, over the edges of batches: ``(value, rows)``."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        keys, start = batch.column(column).to_pylist(), 0
        for i, key in enumerate(keys):
            if (held or i > start) and key != value:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield value, pa.Table.from_batches(held)
                held, start = [], i
            value = key
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield value, pa.Table.from_batches(held)
