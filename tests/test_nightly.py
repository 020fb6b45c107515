"""The scheduled run with a clock, a runner and a transport of the test's own."""

import json
import os
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkwell.plans import nightly as N
from inkwell.sources import readers, sinks


class World:
    """A clock that moves when somebody sleeps, a runner that plays back event logs, a list of what was sent."""

    def __init__(self, *plays):
        self.now, self.plays, self.sent, self.prompts, self.slept = datetime(2026, 1, 1, 21, 30), list(plays), [], [], []

    def clock(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += timedelta(seconds=seconds)

    def run(self, prompt, captured):
        self.prompts.append(open(prompt).read())
        code, events = self.plays.pop(0)
        sinks.put(captured, "".join(json.dumps(e, separators=(",", ":")) + "\n" for e in events))
        return code

    def send(self, url, body):
        self.sent.append(json.loads(body)["text"])
        return True, "ok"


def result(error, text):
    return {"type": "result", "num_turns": 2, "duration_ms": 2500, "is_error": error, "result": text}


def go(spark, tmp_path, world, **more):
    sinks.put(f"{tmp_path}/template.txt", "{{MIN_COUNT}} to {{MAX_COUNT}}")
    return N.nightly(spark, f"{tmp_path}/run", f"{tmp_path}/template.txt", 4, world.run, world.clock, world.sleep, "hook", world.send, **more)


def test_a_run_that_works(spark, tmp_path):
    w = World((0, [{"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}]}}, result(False, "done")]))
    assert go(spark, tmp_path, w) == N.Outcome(0, "", 1)
    assert w.prompts == ["4 to 6"] and w.sent == [] and readers.cell_text(f"{tmp_path}/run/last-run") == "2026-01-01"
    [log] = [f for f in os.listdir(f"{tmp_path}/run") if f.endswith("-summary.log")]
    assert re.fullmatch(r"\[\d\d:\d\d:\d\d\]   💬 hi\n\[\d\d:\d\d:\d\d\] 処理完了。ターン数: 2 / 所要時間: 2秒\n", open(f"{tmp_path}/run/{log}").read())
    said = open(f"{tmp_path}/run/control.log").read().splitlines()
    assert said == [f"[2026-01-01 21:30:00] {x}" for x in ("attempt 1", "2 lines, 0 of them no events", "自動リサーチが完了しました")]
    raw = spark.read.parquet(f"{tmp_path}/run/raw")
    assert raw.count() == 2 and [r.run for r in raw.select("run").distinct().collect()] == ["20260101-213000-1"]
    assert not os.path.exists(f"{tmp_path}/run/run.pid")


def test_one_retry_after_the_limit(spark, tmp_path):
    limited = (1, [result(True, "limit resets 10pm")])
    w = World(limited, (0, [result(False, "done")]))
    assert go(spark, tmp_path, w) == N.Outcome(0, "", 2)
    assert w.now == datetime(2026, 1, 1, 22, 5) and max(w.slept) == 30 and w.sent == []
    said = open(f"{tmp_path}/run/control.log").read().splitlines()
    assert [x[22:] for x in said if "until" in x] == ["35 minutes until the next attempt", "25 minutes until the next attempt", "15 minutes until the next attempt", "5 minutes until the next attempt"]
    w = World(limited, limited)
    assert go(spark, tmp_path, w) == N.Outcome(1, "exit code 1", 2) and len(w.sent) == 1
    w = World(limited)
    assert go(spark, tmp_path, w, no_retry=True) == N.Outcome(1, "exit code 1", 1) and w.slept == []
    w = World((0, []))
    assert go(spark, tmp_path, w).reason == "no output"


def test_tidying_up(spark, tmp_path):
    for k in range(6):
        sinks.put(f"{tmp_path}/logs/{k}.log", "x")
        os.utime(f"{tmp_path}/logs/{k}.log", (1000 + k, 1000 + k))
    N.delete_newest_logs(spark, f"{tmp_path}/logs")
    assert sorted(os.listdir(f"{tmp_path}/logs")) == ["0.log", "1.log"]
    sinks.put(f"{tmp_path}/articles-batch-x.json", "[]")
    status = "?? automation/articles-batch-x.json\n?? automation/articles-batch-y.json\n M automation/other.json"
    assert N.delete_stale_batches(spark, status, str(tmp_path)) == [f"{tmp_path}/articles-batch-x.json"]


def test_stop_sees_that_the_process_ended(spark, tmp_path):
    running, slept, w = {7, 8}, [], World()
    table = lambda: spark.createDataFrame([(p, w.now - timedelta(minutes=90)) for p in sorted(running)], "pid long, started timestamp")
    stop = lambda end: N.stop(spark, str(tmp_path), table, end, w.clock, slept.append)
    for text in (None, "x", "9"):
        if text:
            sinks.put(f"{tmp_path}/run.pid", text)
        assert stop(running.remove) == N.Stopped(0, False) and not os.path.exists(f"{tmp_path}/run.pid")
    sinks.put(f"{tmp_path}/run.pid", "8")
    assert stop(lambda pid: None) == N.Stopped(1, False, 90.0) and os.path.exists(f"{tmp_path}/run.pid") and slept == [2]
    sinks.put(f"{tmp_path}/1-summary.log", "".join(f"line {k}\n" for k in range(30)))
    got = stop(running.remove)
    assert (got.exit_code, got.ended, got.minutes) == (0, True, 90.0) and got.log.endswith("/1-summary.log")
    assert got.lines == tuple(f"line {k}" for k in range(20, 30)) and not os.path.exists(f"{tmp_path}/run.pid") and running == {7}


def test_raw_lines_of_a_batch_are_kept_once(spark, tmp_path):
    lines = spark.createDataFrame([("a", 1), ("b", 2)], "value string, pos long")
    for run, batch in (("r", 0), ("r", 0), ("r", 1), ("s", 0), ("r", 1)):
        sinks.keep_raw(lines, str(tmp_path / "raw"), run, batch)
    assert spark.read.parquet(str(tmp_path / "raw")).groupBy("run", "batch").count().orderBy("run", "batch").collect() == [("r", 0, 2), ("r", 1, 2), ("s", 0, 2)]


def test_small_readers(spark, tmp_path):
    sinks.put(f"{tmp_path}/cell", "　 2026-01-01 \n")
    assert readers.cell(spark, f"{tmp_path}/cell").first().value == "2026-01-01"
    sinks.put(f"{tmp_path}/log.txt", "".join(f"line {k}\n" for k in range(30)))
    assert [r.value for r in readers.last_lines(readers.lines(spark, f"{tmp_path}/log.txt"), 3).collect()] == ["line 27", "line 28", "line 29"]
    sinks.put(f"{tmp_path}/c/1.json", '{"url":"u","status":200,"published":"2026-01-01"}\n{"url":"v"}\n')
    found = readers.candidates(spark, f"{tmp_path}/c").orderBy("url").select("url", "status", F.col("published").cast("string")).collect()
    assert [tuple(r) for r in found] == [("u", 200, "2026-01-01"), ("v", None, None)]
