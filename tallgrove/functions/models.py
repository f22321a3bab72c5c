"""Model calls as Columns: completions with usage and errors as text, embedders in batches with retries.

A model is a Python function given by the caller; it runs on the workers in Arrow batches. A completion is a struct of
text, calls, prompt_tokens, completion_tokens and latency_ms; a call that fails is a text that starts with ``ERROR``, never an exception.
"""
from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: how the text of a failed call starts.
ERROR = "[LLM Error]"
USAGE = "struct<calls:long,prompt_tokens:long,completion_tokens:long>"
COMPLETION = "text string, calls long, prompt_tokens long, completion_tokens long, latency_ms double"

#: (system, user) to a text, or to (text, prompt tokens, completion tokens).
Call = Callable[[str, str], "str | tuple[str, int, int]"]


def completion(call: Call | None, system: str, user: Column) -> Column:
    """A struct ``COMPLETION`` for each prompt; without a model every text says so and no call is counted."""
    kind = pa.struct([("text", pa.string()), ("calls", pa.int64()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("latency_ms", pa.float64())])

    def one(prompt: str | None) -> dict:
        start = time.perf_counter()
        if call is None:
            return {"text": f"{ERROR} No model configured.", "calls": 0, "prompt_tokens": 0, "completion_tokens": 0, "latency_ms": 0.0}
        try:
            got = call(system, prompt or "")
            text, given, made = (got, 0, 0) if isinstance(got, str) else got
            calls = 1
        except Exception as e:  # noqa: BLE001  a model that fails must not end the run; its text says what was wrong
            text, given, made, calls = f"{ERROR} {e}", 0, 0, 0
        return {"text": text or "", "calls": calls, "prompt_tokens": given or 0, "completion_tokens": made or 0, "latency_ms": 1000 * (time.perf_counter() - start)}

    @F.arrow_udf(COMPLETION)
    def run(prompts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in prompts:
            yield pa.array([one(x.as_py()) for x in p], kind)

    return run(user)


def failed(text: Column) -> Column:
    return F.startswith(F.coalesce(text, F.lit("")), F.lit(ERROR))


def usage(*completions: Column) -> Column:
    """The added usage of some completions; null ones count nothing."""
    add = lambda f: sum((F.coalesce(c[f], F.lit(0)) for c in completions), F.lit(0)).cast("long").alias(f)
    return F.struct(add("calls"), add("prompt_tokens"), add("completion_tokens"))


def total_usage(column: str) -> Column:
    """Aggregate: the usage of all rows of a group."""
    add = lambda f: F.coalesce(F.sum(F.col(column)[f]), F.lit(0)).cast("long").alias(f)
    return F.struct(add("calls"), add("prompt_tokens"), add("completion_tokens"))


def embedder(encode: Callable[[list[str]], list[list[float]]], batch: int = 32, retries: int = 3, wait_s: float = 1.0) -> Callable[[Column], Column]:
    """An embedding hook for ``Index``: texts in batches of ``batch``, a failed batch again after 1, 2, 4 ... times ``wait_s``; the last failure ends the run."""

    def embed(text: Column) -> Column:
        @F.arrow_udf("array<double>")
        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for t in texts:
                out: list[list[float]] = []
                rows = [x.as_py() or "" for x in t]
                for i in range(0, len(rows), batch):
                    for attempt in range(retries + 1):
                        try:
                            out += [[float(v) for v in row] for row in encode(rows[i : i + batch])]
                            break
                        except Exception:
                            if attempt == retries:
                                raise
                            time.sleep(wait_s * 2**attempt)
                yield pa.array(out, pa.list_(pa.float64()))

        return run(text)

    return embed
