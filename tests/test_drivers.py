"""Drivers without a model, recordings, and the small set helpers."""

import asyncio
import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import provenance as R
from folioflow.operators import sets
from folioflow.testing import drivers as D

REQUEST = {"task": "TABLE", "image_sha256": "ab" * 32, "language_hints": ["ko", "en"], "request_id": "r1"}


def test_fingerprints_agree_with_the_column(spark):
    rows = [("TABLE", "ab" * 32, None, ["ko", "en"]), ("OCR", "cd" * 32, "ef" * 32, []), ("한", "00", 'q"uote', ["x"])]
    df = spark.createDataFrame(rows, "task string, image string, anchor string, hints array<string>")
    got = [r["f"] for r in df.select(R.request_fingerprint(F.col("task"), F.col("image"), F.col("anchor"), F.col("hints")).alias("f")).collect()]
    assert got == [D.fingerprint({"task": t, "image_sha256": i, "anchor_sha256": a, "language_hints": h}) for t, i, a, h in rows]
    assert D.fingerprint(REQUEST) == D.fingerprint({**REQUEST, "request_id": "other", "language_hints": ["en", "ko"]})


def test_scripts_and_recordings(spark, tmp_path):
    script = D.ScriptedDriver([{"text": "a"}, D.DriverError("timeout", True, "slow")])
    assert asyncio.run(script.run(REQUEST)) == {"text": "a", "request_id": "r1"} and asyncio.run(script.health())
    with pytest.raises(D.DriverError) as e:
        asyncio.run(script.run(REQUEST))
    assert e.value.retryable and len(script.calls) == 2
    with pytest.raises(AssertionError, match="script ended"):
        asyncio.run(script.run(REQUEST))
    record = {"fingerprint": D.fingerprint(REQUEST), "result": {"text": "b"}}
    replay = D.ReplayDriver([record])
    assert asyncio.run(replay.run(REQUEST))["text"] == "b" and replay.capabilities()["tasks"]
    with pytest.raises(D.ReplayMiss):
        asyncio.run(replay.run({**REQUEST, "task": "OCR"}))
    with pytest.raises(ValueError, match="twice"):
        D.ReplayDriver([record, record])
    (tmp_path / "a.json").write_text(json.dumps(record))
    got = D.read_recordings(spark, f"file://{tmp_path}").first()
    assert got["fingerprint"] == record["fingerprint"] and json.loads(got["result"]) == {"text": "b"}
    (tmp_path / "b.json").write_text(json.dumps(record))
    with pytest.raises(ValueError, match="twice"):
        D.read_recordings(spark, f"file://{tmp_path}")


def test_first_ones_caps_and_modules(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (2, "a", 1), (1, "c", 0)], "k int, v string, o int")
    assert sorted((r["k"], r["v"], r["seq"]) for r in sets.distinct_first(df, ["k"], "v", "o").collect()) == [(1, "a", 2), (1, "b", 1), (1, "c", 0), (2, "a", 0)]
    assert sorted((r["k"], r["o"]) for r in sets.first_n(df, ["k"], ["o"], 2).collect()) == [(1, 0), (1, 1), (2, 1)]
    assert sets.missing_modules("json", "no_such_module_here", "no_such.inner") == ["no_such_module_here", "no_such.inner"]


def test_requests_are_awaited_a_few_at_once(spark):
    from folioflow.operators import requests as RQ

    class Crowd:
        """Counts how many requests it holds at once; the slow one never answers in time."""

        def __init__(self):
            self.now = self.most = 0

        async def run(self, request):
            self.now += 1
            self.most = max(self.most, self.now)
            most = self.most
            try:
                await asyncio.sleep(5 if request["image_sha256"] == "slow" else 0.001)
            finally:  # also when it is given up
                self.now -= 1
            return {"most": most}

    rows = spark.createDataFrame([(i, "OCR", "slow" if i == 5 else str(i), None, ["ko"]) for i in range(300)], "request_id int, task string, image_sha256 string, anchor_sha256 string, language_hints array<string>").coalesce(1)
    got = {r["request_id"]: r for r in RQ.answered(rows, Crowd, at_once=3, attempts=2, seconds=0.2).collect()}
    assert len(got) == 300 and max(json.loads(r["result"])["most"] for r in got.values() if r["result"]) == 3
    assert (got[5]["result"], got[5]["error"]["code"], got[5]["attempts"]) == (None, "timeout", 2) and sum(r["error"] is None for r in got.values()) == 299
    assert RQ.answered(rows.limit(0), Crowd).count() == 0
    with pytest.raises(Exception, match="KeyError"):
        RQ.answered(rows.limit(1), lambda: D.FunctionDriver(lambda r: {}["gone"])).collect()
