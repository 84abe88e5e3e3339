"""Drivers without a model: one plays a script, one plays recordings; a request is a dict with task, image, anchor and hints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.errors import DriverError
from folioflow.operators.figures import png_of


class ReplayMiss(AssertionError):
    """A request without a recording: a fault of the test, not of a driver."""


CAPABILITIES = {"tasks": ["TABLE", "OCR", "FIGURE"], "max_pixels": 40_000_000, "local": True}


def fingerprint(request: dict) -> str:
    """First 32 hex digits of the SHA-256 of the request's sorted JSON; ids take no part, hints count as a sorted list."""
    body = {"task": request["task"], "image_sha256": request["image_sha256"], "language_hints": sorted(request.get("language_hints") or [])}
    if request.get("anchor_sha256") is not None:
        body["anchor_sha256"] = request["anchor_sha256"]
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:32]


class ScriptedDriver:
    """Gives its steps in turn: results, or errors to raise."""

    def __init__(self, steps: Iterable[dict | DriverError], driver_id: str = "scripted"):
        self.id, self._steps, self.calls = driver_id, iter(steps), []

    def capabilities(self) -> dict:
        return CAPABILITIES

    async def health(self) -> bool:
        return True

    async def run(self, request: dict) -> dict:
        self.calls.append(request)
        step = next(self._steps, None)
        if step is None:
            raise AssertionError(f"script ended after {len(self.calls) - 1} steps")
        if isinstance(step, DriverError):
            raise step
        return {**step, "request_id": request.get("request_id")}


class FunctionDriver(ScriptedDriver):
    """Gives what a function makes of each request; DriverErrors that it raises are the driver's."""

    def __init__(self, answer, driver_id: str = "function"):
        super().__init__((), driver_id)
        self._answer = answer

    async def run(self, request: dict) -> dict:
        return {**self._answer(request), "request_id": request.get("request_id")}


class ReplayDriver(ScriptedDriver):
    """Gives the recording of a request's fingerprint."""

    def __init__(self, recordings: Iterable[dict], driver_id: str = "replay"):
        super().__init__((), driver_id)
        self._by: dict[str, dict] = {}
        for r in recordings:
            if r["fingerprint"] in self._by:
                raise ValueError(f"recorded twice: {r['fingerprint']}")
            self._by[r["fingerprint"]] = r["result"]

    async def run(self, request: dict) -> dict:
        self.calls.append(request)
        key = fingerprint(request)
        if key not in self._by:
            raise ReplayMiss(f"no recording for {key} ({request['task']})")
        return {**self._by[key], "request_id": request.get("request_id")}


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint and result (as JSON) of the recordings in a folder; a fingerprint recorded twice is an error."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path)
    rows = raw.select(F.get_json_object("value", "$.fingerprint").alias("fingerprint"), F.get_json_object("value", "$.result").alias("result"))
    if (twice := rows.groupBy("fingerprint").count().where("count > 1").first()) is not None:
        raise ValueError(f"recorded twice: {twice['fingerprint']}")
    return rows


def tiny_png(width: int = 1, height: int = 1, grey: int = 0) -> bytes:
    return png_of(np.full((height, width), grey, np.uint8))
