"""The memory of Python workers: the size of Arrow batches, and what is handed back after a task."""

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

TEXT_ROWS = 1_000
BATCH_BYTES = 8 << 20
_ROWS, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_BYTES, _DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def short_batches(spark: SparkSession) -> None:
    """Let a batch hold `TEXT_ROWS` rows and `BATCH_BYTES` bytes at most.

    A setting of the session that differs from Spark's own stays. The defaults are meant for short
    rows; a batch of long documents would cost each worker hundreds of MB. A row larger than a batch
    is a batch of its own. It changes the layout only, never a result.
    """
    if spark.conf.get(_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS, str(TEXT_ROWS))
    if spark.conf.get(_BYTES) == _DEFAULT_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def hand_back() -> None:
    """Return freed memory to the system; allocators would keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """`run` over the batches of a task, after which the worker forgets its tables and hands memory back.

    Workers live on from task to task and from stage to stage, and what each stage leaves would add up.
    """

    @wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            hand_back()

    return tidy
