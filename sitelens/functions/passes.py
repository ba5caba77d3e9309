"""Plain Python over a column of pages, in pieces: a batch of rows may hold thousands of pages, whose parsed form is many
times as large as their text, so that only a few pages are held as Python objects at a time, whatever the batches' size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: A piece ends after so many rows, or with the row that fills it to so many characters (and, of parsed pages, names around nodes).
ROWS, SIZE = 64, 1 << 18


def pieces(values: Iterator[pa.Array], make: Callable[[str | None], dict | None], size: Callable[[dict], int] | None = None) -> Iterator[list[dict | None]]:
    """make() of every value, in order, as lists of a bounded size."""
    for batch in values:
        made, held = [], 0
        for value in batch:  # one at a time: no list of the whole batch
            said = value.as_py()
            row = make(said)
            made.append(row)
            held += len(said or "") + (size(row) if size and row else 0)
            if len(made) >= ROWS or held >= SIZE:
                yield made
                made, held = [], 0
        if made:
            yield made


def column(value: Column, make: Callable[[str | None], dict | None], schema: str, size: Callable[[dict], int] | None = None) -> Column:
    """make() of every value as a struct; size: what a result holds beside its text, in about characters."""
    kind = to_arrow_type(_parse_datatype_string(schema))

    def made(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return (pa.array(rows, type=kind) for rows in pieces(values, make, size))

    return F.arrow_udf(made, schema)(value)
