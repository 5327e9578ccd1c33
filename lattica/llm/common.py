"""What the operators of this subpackage share: batch handling and shipping of modules; and, from the library, the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship_modules
from ..storage import file_system, new_path, released, rows_total, shared_dir, stored, stored_with  # noqa: F401

#: Characters of text that a Python step turns into arrays at a time; longer texts go alone.
SLICE_CHARS = 1 << 21


def column(df: DataFrame, name: str):
    """The column of exactly this name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def sliced(batches: Iterator[pa.RecordBatch], at: int | str = 1, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (column ``at``) have at most ``limit`` bytes; longer texts come alone.

    Nothing is copied, and no text becomes a Python string before its slice is at hand.
    """
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), np.int64)
        first = have = 0
        for i, n in enumerate(size.tolist()):
            if have and have + n > limit:
                yield batch.slice(first, i - first)
                first, have = i, 0
            have += n
        if first < batch.num_rows:
            yield batch.slice(first)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once for each application.

    Texts are long rows: where the session leaves Arrow's batches at the default
    number of rows, it is set lower, so that a batch stays small.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")
    ship_modules(spark)
