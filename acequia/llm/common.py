"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The blanks that part words, and a pattern of everything else.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Upper-case ASCII letters to lower case; every other byte stays.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def annotate(
    df: DataFrame,
    name: str,
    kind: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], pa.Array]],
) -> DataFrame:
    """``df`` with a struct column ``name`` computed per Arrow batch, without a shuffle.

    ``make`` runs once per task and returns the function of a batch.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if batch.num_rows:
                arrays = [*batch.columns, compute(batch)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def utf8(array: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow array; nothing for null."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)
    ends = ends[array.offset : array.offset + len(array) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    nulls = array.is_null().to_pylist() if array.null_count else None
    for i in range(len(array)):
        yield b"" if nulls and nulls[i] else bytes(view[ends[i] : ends[i + 1]])


def struct_array(kind: T.StructType, columns: list) -> pa.Array:
    """An Arrow struct array from Python or numpy columns, typed as the Spark struct."""
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in kind.fields]
    arrays = [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
    return pa.StructArray.from_arrays(arrays, names=kind.names)


def batch_of(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """An Arrow record batch from Python or numpy columns, typed as the Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrays = [
        pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)
