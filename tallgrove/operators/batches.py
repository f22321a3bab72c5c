"""Arrow batches of a bounded size."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands at most ``ARROW_BYTES`` (and one row) at once to Python workers: rows of words or texts are as long as they like."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(key)
    if not re.fullmatch(r"\d+b?", now) or int(now.rstrip("b")) > ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df
