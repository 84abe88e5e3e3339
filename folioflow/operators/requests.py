"""Requests to drivers of image-language models as rows: answers, errors, attempts, and how far jobs are."""

from __future__ import annotations

import asyncio
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.errors import DriverError

REQUEST = ["request_id", "task", "image_sha256", "anchor_sha256", "language_hints"]
ANSWER = "request_id {}, result string, error struct<code: string, retryable: boolean, message: string>, attempts int, latency_ms bigint"


async def _asked(driver, request: dict, most: int, seconds: float | None, free: asyncio.Semaphore) -> tuple:
    """One request until it is answered, fails for good, or has been tried ``most`` times."""
    async with free:
        began, error = time.monotonic(), None
        for n in range(1, most + 1):
            try:
                found = await asyncio.wait_for(driver.run({**request, "attempt": n}), seconds)
                return json.dumps(found, ensure_ascii=False, sort_keys=True), None, n, int((time.monotonic() - began) * 1000)
            except TimeoutError:
                error = {"code": "timeout", "retryable": True, "message": f"no answer within {seconds} s"}
            except DriverError as e:
                error = {"code": e.code, "retryable": e.retryable, "message": str(e)}
            if not error["retryable"]:
                break
        return None, error, n, int((time.monotonic() - began) * 1000)


def answered(requests: DataFrame, driver: Callable[[], object], at_once: int = 8, attempts: int = 2, seconds: float | None = 120.0) -> DataFrame:
    """One answer (``ANSWER``) a request: the driver's result as JSON, or its last error.

    requests: request_id, task, image_sha256, anchor_sha256, language_hints.
    ``driver`` makes a driver (``async run(request) -> dict``) in each task,
    which awaits at most ``at_once`` requests at a time: with p tasks running
    a service sees at most p * at_once.  Errors that may pass are tried again
    up to ``attempts`` times in all, and no answer within ``seconds`` is such
    an error; any other exception of a driver fails the task.  A task that
    runs again asks again, so drivers should be idempotent by request_id.
    """
    kind = T.StructType.fromDDL(ANSWER.format(requests.schema["request_id"].dataType.simpleString()))
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = driver()
        with asyncio.Runner() as loop:  # one loop a task: drivers may keep connections

            async def all_of(rows: list[dict]) -> list[tuple]:
                free = asyncio.Semaphore(at_once)
                return await asyncio.gather(*[_asked(own, r, attempts, seconds, free) for r in rows])

            for batch in batches:
                for lo in range(0, batch.num_rows, 64 * at_once):
                    rows = batch.slice(lo, 64 * at_once).to_pylist()
                    made = loop.run(all_of(rows))
                    yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (r["request_id"], *m))) for r, m in zip(rows, made)], schema=arrow)

    return requests.select(*REQUEST).mapInArrow(run, kind)


def job_progress(requests: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, answered, failed, waiting, progress of jobs: requests (keys, request_id) against the answers there are so far."""
    said = answers.groupBy("request_id").agg(F.max(F.col("error").isNull().cast("int")).alias("good"))
    own = requests.select(*keys, "request_id").join(said, "request_id", "left")
    count = lambda cond: F.count_if(cond)
    out = own.groupBy(*keys).agg(F.count("*").alias("total"), count(F.col("good") == 1).alias("answered"), count(F.col("good") == 0).alias("failed"), count(F.col("good").isNull()).alias("waiting"))
    return out.withColumn("progress", (F.col("answered") + F.col("failed")) / F.col("total"))
