"""Streams over growing logs and folders, keyed state, and the stamped log, each over a restart."""

import json
import os
import re
import threading
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkwell.operators import events as E
from inkwell.operators import runs
from inkwell.plans.watch import watch
from inkwell.sources import sinks
from inkwell.streaming import state, summary
from inkwell.streaming.log_sink import LogWriter, Written, append_log
from inkwell.streaming.tail import TailReader, new_files, tail


def append(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write(text)


def drain(df, out, checkpoint, mode="append"):
    """One run of a query over what is there, its rows added to ``out``."""
    def keep(batch, _):
        out.extend(tuple(r) for r in batch.collect())

    q = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()


def again(checkpoint):
    """Make a query forget that its last batch was done, as when it dies just before noting it."""
    last = max((int(n) for n in os.listdir(checkpoint / "commits") if n.isdigit()), default=0)
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(checkpoint / "commits" / name):
            os.unlink(checkpoint / "commits" / name)


def test_a_raw_batch_that_is_repeated_adds_no_row(spark, tmp_path):
    log, table = str(tmp_path / "in.log"), str(tmp_path / "raw")
    for k, text in enumerate(("a\nb\n", "c\n", None, "d\n")):
        if text is None:
            again(tmp_path / "cp")
        else:
            append(log, text)
        q = summary.raw_log(tail(spark, log).select("pos", "value"), table, "r", str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert [r.value for r in spark.read.parquet(table).orderBy("pos").collect()] == ["a", "b", "c", "d"]
    assert spark.read.parquet(table).select("run", "batch").distinct().count() == 3


def test_a_growing_file_is_followed_over_a_restart(spark, tmp_path):
    log, got = str(tmp_path / "logs/a.log"), []
    append(log, "one\r\ntwo\nhal")
    run = lambda: drain(tail(spark, str(tmp_path / "logs")).select("value", "pos"), got, tmp_path / "cp")
    run()
    assert sorted(got) == [("one", 0), ("two", 5)]
    run()
    append(log, "f\n")
    append(str(tmp_path / "logs/b.log"), "é\n\nlast")
    run()
    append(str(tmp_path / "logs/b.log"), "\n")
    run()
    assert sorted(got) == sorted([("one", 0), ("two", 5), ("half", 9), ("é", 0), ("", 3), ("last", 4)])


def test_a_range_is_split_without_losing_a_line(tmp_path):
    path = str(tmp_path / "a.log")
    lines = ["x" * (k * 7 % 23) for k in range(200)]
    append(path, "\n".join(lines) + "\n")
    for split in (1, 5, 64, 10_000):
        reader = TailReader({"path": path, "split": split})
        parts = reader.partitions({path: 0}, reader.latestOffset())
        rows = [r for p in parts for r in reader.read(p)]
        assert [r[2] for r in rows] == lines and len({r[1] for r in rows}) == 200
    reader = TailReader({"path": path})
    assert [p.begin for p in reader.partitions({path: 10**6}, reader.latestOffset())] == [0]
    append(path, "y" * 200_000)
    assert reader.latestOffset() == {path: sum(map(len, lines)) + 200}
    assert TailReader({"path": str(tmp_path / "none")}).latestOffset() == {}


def test_a_new_file_is_waited_for(spark, tmp_path):
    folder = str(tmp_path / "logs")
    append(f"{folder}/OLD-summary.log", "x")
    wait = lambda seconds, cp: summary.wait_for_file(spark, folder, ["old-summary.log"], str(tmp_path / cp), seconds=seconds)
    began = time.time()
    assert wait(2, "cp1") is None and time.time() - began < 20
    timer = threading.Timer(2, append, (f"{folder}/new-summary.log", "x"))
    timer.start()
    append(f"{folder}/new-control.log", "x")
    assert wait(30, "cp2") == f"{folder}/new-summary.log"
    got = []
    drain(new_files(spark, folder, "*", ["OLD-summary.log"]).select("name", "length"), got, tmp_path / "cp3")
    append(f"{folder}/third", "abc")
    drain(new_files(spark, folder, "*", ["OLD-summary.log"]).select("name", "length"), got, tmp_path / "cp3")
    assert sorted(got) == [("new-control.log", 1), ("new-summary.log", 1), ("third", 3)]


def test_following_ends_at_the_line_that_ends_the_run(spark, tmp_path):
    log, shown = str(tmp_path / "a.log"), []
    append(log, "[09:00:00] start\n 失敗: not at the start\n")
    assert summary.follow(tail(spark, log), shown.append, str(tmp_path / "cp"), seconds=3) is False
    timer = threading.Timer(1, append, (log, "[09:01:00] 失敗: x\n[09:02:00] later\n"))
    timer.start()
    assert summary.follow(tail(spark, log), shown.append, str(tmp_path / "cp"), seconds=60) is True
    assert shown == ["[09:00:00] start", " 失敗: not at the start", "[09:01:00] 失敗: x"] and not spark.streams.active


def test_a_run_is_started_and_watched(spark, tmp_path):
    folder, shown, asked = str(tmp_path), [], []
    append(f"{folder}/0-summary.log", "[08:00:00] 失敗: an older run\n")

    def start(options):
        asked.append(options)
        for seconds, text in ((1, "[09:00:00] first\n"), (4, "[09:00:01] sec"), (6, "ond\n[09:00:02] 自動リサーチが完了しました\n")):
            threading.Timer(seconds, append, (f"{folder}/1-summary.log", text)).start()

    assert watch(spark, folder, start, shown.append, effort="high", seconds=60) == 0
    assert asked == [["--effort", "high"]] and shown == [
        "モデル: 既定 / 推論レベル: high", "[09:00:00] first", "[09:00:01] second", "[09:00:02] 自動リサーチが完了しました",
    ]
    assert watch(spark, folder, asked.append, shown.append, wait=2) == 1 and "no log file" in shown[-1]


def test_a_query_is_stopped_by_its_id(spark, tmp_path):
    append(str(tmp_path / "a.log"), "x\n")
    q = tail(spark, str(tmp_path / "a.log")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.isActive and summary.stop_query(spark, q.id) and not q.isActive and summary.stop_query(spark, q.id)


def test_lines_are_stamped_when_they_are_written(spark, tmp_path):
    log, out = str(tmp_path / "in.jsonl"), str(tmp_path / "out.log")
    event = lambda text: json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": text}]}}) + "\n"
    append(log, event("first") + "no event\n")
    start = lambda: summary.summary_log(tail(spark, log), out, str(tmp_path / "cp"))
    q = start()
    q.processAllAvailable()
    time.sleep(2)
    append(log, event("second"))
    q.processAllAvailable()
    q.stop()
    assert summary.line_counts(q) == (3, 1)
    append(log, event("third"))
    q = start()
    q.processAllAvailable()
    q.stop()
    again(tmp_path / "cp")
    q = start()
    q.processAllAvailable()
    q.stop()
    found = re.findall(r"\[(\d\d:\d\d:\d\d)\]   💬 (\w+)\n", open(out).read())
    assert [w for _, w in found] == ["first", "second", "third"] and found[0][0] != found[1][0]
    assert sorted(os.listdir(tmp_path)) == ["cp", "in.jsonl", "out.log", "out.log.state"]


def test_a_batch_is_appended_once_and_half_an_append_is_cut_off(tmp_path):
    writer = LogWriter({"path": str(tmp_path / "a.log"), "stamp": ""})
    commit = lambda batch, *lines: writer.commit([writer.write(iter([(x,) for x in lines])), None], batch)
    commit(0, "a", "b")
    commit(0, "a", "b")
    append(str(tmp_path / "a.log"), "half of a batch that did not")
    commit(1, "c")
    lost = writer.write(iter([("d",)]))
    writer.abort([lost, None], 2)
    writer.commit([Written(lost.part)] if os.path.exists(lost.part) else [], 2)
    assert open(tmp_path / "a.log").read() == "a\nb\nc\n" and sorted(os.listdir(tmp_path)) == ["a.log", "a.log.state"]
    assert append_log.__doc__


def checks(spark, folder, rows):
    sinks.put(f"{folder}/{time.time_ns()}.json", "".join(json.dumps(dict(zip(("key", "last_run_date", "today"), r, strict=True))) + "\n" for r in rows))
    return spark.readStream.schema("key string, last_run_date string, today string").json(folder)


def test_notices_are_given_once_over_a_restart(spark, tmp_path):
    folder, got = str(tmp_path / "in"), []
    batches = [
        [("a", "2026-01-01", "2026-01-02"), ("a", "2026-01-01", "2026-01-04"), ("a", "2026-01-01", "2026-01-05"), ("b", "2026-01-03", "2026-01-05")],
        [("a", "2026-01-01", "2026-01-06"), ("b", "2026-01-08", "2026-01-08"), ("b", None, "2026-01-09")],
        [("a", "2026-01-07", "2026-01-09"), ("a", "2026-01-01", "2026-01-10"), ("b", "2026-01-02", "2026-01-12"), ("b", "2026-01-03", "2026-01-12")],
    ]
    for rows in batches:
        drain(state.notices(checks(spark, folder, rows)), got, tmp_path / "cp")
    every = spark.createDataFrame([r for b in batches for r in b], "key string, last_run_date string, today string")
    want = runs.notices(every).select("key", "last_run_date", "today", "missed").collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(got) == 4
    assert ("a", "2026-01-01", "2026-01-04", 2) in got


def test_the_last_result_of_every_run_in_a_stream(spark, tmp_path):
    folder, got = str(tmp_path / "in"), []
    at = datetime(2026, 1, 1, 9)
    result = lambda text, bad=False: json.dumps({"type": "result", "is_error": bad, "result": text}, separators=(",", ":"))
    batches = [
        [("r", 0, 1, result("one")), ("r", 1, 3, "no event"), ("s", 0, 1, result("s1", True))],
        [("r", 2, 9, result("nine")), ("r", 3, 5, result("five")), ("s", 2, 2, "[09:02:00] 失敗: x")],
        [("r", 5, 10, "自動リサーチが完了しました"), ("t", 6, 1, result("t1"))],
        [("u", 600, 1, result("u1"))],
        [("u", 1200, 2, result("u2"))],
    ]
    rows = []
    for k, batch in enumerate(batches):
        rows += batch
        text = "".join(json.dumps({"run": r, "ts": (at + timedelta(minutes=m)).isoformat(), "pos": p, "value": v}) + "\n" for r, m, p, v in batch)
        sinks.put(f"{folder}/{k}.json", text)
        stream = spark.readStream.schema("run string, ts timestamp, pos long, value string").json(folder)
        drain(state.last_results(stream, "1 hour"), got, tmp_path / "cp", "update")
    closed = {r[0]: r[1:4] for r in got if r[4]}
    lines = spark.createDataFrame([(r, p, v) for r, _, p, v in rows], "run string, pos long, value string")
    want = {r.run: (r.pos, r.is_error, r.result) for r in E.last_result(lines, ("run",)).collect()}
    assert {k: closed[k] for k in "rst"} == {k: want[k] for k in "rst"} and "t" in closed
    latest = {r[0]: r[1:4] for r in got}
    assert latest == want and [r[1] for r in got if r[0] == "r"] == [1, 9, 9]


def test_many_runs_share_groups_of_state(spark, tmp_path):
    folder, got, sizes = str(tmp_path / "in"), [], []
    at, big = datetime(2026, 1, 1, 9), 1 << 60
    result = lambda text: json.dumps({"type": "result", "is_error": text.endswith("1"), "result": text}, separators=(",", ":"))
    names = [None, *(f"r{k}" for k in range(2999))]
    batches = [  # (run, minute, pos, value); the third is late for all, the last lets all but the first five end
        [(r, k % 50, big + k, result(f"a{k}")) for k, r in enumerate(names)] + [(r, 1, 0, result("old")) for r in names[::7]],
        [(r, 70, big + 5000, "自動リサーチが完了しました" if k % 4 else result("b")) for k, r in enumerate(names[::3])],
        [(r, 0, big + 9000, result("late")) for r in names[:50]],
        [(r, 200, 1, result("small")) for r in names[:5]],
    ]
    for k, batch in enumerate(batches):
        sinks.put(f"{folder}/{k}.json", "".join(json.dumps({"run": r, "ts": (at + timedelta(minutes=m)).isoformat(), "pos": p, "value": v}) + "\n" for r, m, p, v in batch))
        stream = spark.readStream.schema("run string, ts timestamp, pos long, value string").json(folder)
        keep = lambda rows, _, k=k: got.extend((k, *r) for r in rows.collect())
        q = state.last_results(stream, "1 hour").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        q = q.trigger(availableNow=True).start()
        q.awaitTermination()
        sizes += [p.stateOperators[0].numRowsTotal for p in q.recentProgress]
    first = {(r, big + k, f"a{k}", False) for k, r in enumerate(names)}
    ended = {(r, big + 3 * k, f"a{3 * k}", True) for k, r in enumerate(names[::3]) if k % 4}
    newer = {(r, big + 5000, "b", False) for r in names[::12]}
    assert {(r, p, text, closed) for k, r, p, _, text, closed in got if k == 0} == first
    assert {(r, p, text, closed) for k, r, p, _, text, closed in got if k == 1} == ended | newer
    assert not [g for g in got if g[0] == 2]
    last = {r: (p, text) for r, p, text, _ in [*first, *newer]} | {r: (big + 5000, "b") for r in names[::12]}
    there = {r for r, *_ in ended}
    silent = {(r, *last[r], True) for r in names if r not in there}
    again_ = {(r, p, text, closed) for k, r, p, _, text, closed in got if k == 3}
    assert silent - again_ == {(r, *last[r], True) for r in names[:5] if r not in there} and len(got) == len(set(got))
    assert all(is_error == text.endswith("1") for _, _, _, is_error, text, _ in got)
    assert 0 < max(sizes) <= state.GROUPS < len(names) and sizes[-1] <= 5


def test_a_run_is_not_silent_before_its_newest_line_is_old(spark, tmp_path):
    folder, got = str(tmp_path / "in"), []
    at = datetime(2026, 1, 1, 9)
    result = json.dumps({"type": "result"}, separators=(",", ":"))
    for k, batch in enumerate([[("r", 100, 1)], [("r", 45, 2)], [("s", 200, 1)], [("s", 230, 2)]]):
        sinks.put(f"{folder}/{k}.json", "".join(json.dumps({"run": r, "ts": (at + timedelta(minutes=m)).isoformat(), "pos": p, "value": result}) + "\n" for r, m, p in batch))
        stream = spark.readStream.schema("run string, ts timestamp, pos long, value string").json(folder)
        drain(state.last_results(stream, "1 hour"), got, tmp_path / "cp", "update")
        if k == 2:  # the watermark is at 140 minutes: past 45 and an hour, not past 100 and an hour
            assert [r[:2] for r in got] == [("r", 1), ("r", 2), ("s", 1)]
    assert ("r", 2, None, None, True) in got


def test_many_keys_share_groups_of_notices(spark, tmp_path):
    folder, got, sizes = str(tmp_path / "in"), [], []
    names = [None, *(f"k{k}" for k in range(2999))]
    batches = [
        [(r, "2026-01-01", f"2026-01-0{d}") for d in (5, 4, 2) for r in names],
        [(r, last, "2026-01-09") for last in ("2026-01-01", "2026-01-06") for r in names[::2]] + [("new", "2026-01-01", "2026-01-03")],
        [(r, "2026-01-06", "2026-01-08") for r in names],
    ]
    for rows in batches:
        stream = state.notices(checks(spark, folder, rows))
        keep = lambda batch, _: got.extend(tuple(r) for r in batch.collect())
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes += [p.stateOperators[0].numRowsTotal for p in q.recentProgress]
    first = [(r, "2026-01-01", "2026-01-04", 2) for r in names]
    second = [(r, "2026-01-06", "2026-01-09", 2) for r in names[::2]] + [("new", "2026-01-01", "2026-01-03", 1)]
    third = [(r, "2026-01-06", "2026-01-08", 1) for r in names[1::2]]
    assert sorted(got, key=str) == sorted(first + second + third, key=str)
    assert 0 < max(sizes) <= state.GROUPS < len(names)


def test_sessions_are_left_as_they_were(spark):
    assert not spark.streams.active and spark.range(3).agg(F.count("*")).first()[0] == 3
