"""Streams over literal events, stopped and started again."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql.streaming import StreamingQueryException

from sitelens.streaming import sink, stateful, streams

START = datetime(2024, 1, 1)


def lines(folder, part, events):
    """Events (seq, minute, run, type, item) as one file of JSON lines."""
    (folder / "lines").mkdir(exist_ok=True)
    rows = [{"seq": s, "ts": (START + timedelta(minutes=m)).isoformat(), "run_id": r, "type": t, "item_key": i, "cost": 0.5} for s, m, r, t, i in events]
    (folder / "lines" / f"{part}.json").write_text("".join(json.dumps(x) + "\n" for x in rows))


def run(spark, folder, build, **table):
    with stateful.keyed_state(spark):
        return sink.run_to_table(build(streams.read_event_lines(spark, f"file://{folder}/lines").drop("bad")), f"file://{folder}/out", **table)


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"seq": 1, "run_id": "r", "type": "error"}\nnot json\n\n{"seq": "two"}\n')
    got = streams.read_event_lines(spark, f"file://{tmp_path}/x.json", stream=False).collect()
    assert [(r.seq, r.run_id, r.bad is None) for r in got] == [(1, "r", True), (None, None, False), (None, None, False)]


def test_last_lines_over_restarts(spark, tmp_path):
    build = lambda e: stateful.recent_log(e, most=3)
    table = {"mode": "update", "keys": ["run_id"]}
    lines(tmp_path, 0, [(k, k, "a", f"t{k}", None) for k in (1, 2, 5, 4)] + [(1, 0, "b", "t1", None)])
    assert rows(run(spark, tmp_path, build, **table)) == [("a", 2, "t2"), ("a", 4, "t4"), ("a", 5, "t5"), ("b", 1, "t1")]
    # After a restart: a replayed line counts once, one that comes late takes its place.
    lines(tmp_path, 1, [(5, 5, "a", "t5", None), (3, 3, "a", "t3", None)])
    assert rows(run(spark, tmp_path, build, **table)) == [("a", 3, "t3"), ("a", 4, "t4"), ("a", 5, "t5"), ("b", 1, "t1")]


def test_batch_that_runs_again_counts_once(spark, tmp_path):
    def stop(batch_id):
        if batch_id == 1:
            raise RuntimeError("stopped between the write and its being noted")

    lines(tmp_path, 0, [(1, 0, "a", "page-start", "i"), (2, 1, "a", "page-done", "i")])
    run(spark, tmp_path, lambda e: e.select("run_id", "seq"))
    lines(tmp_path, 1, [(3, 2, "a", "page-start", "j")])
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path, lambda e: e.select("run_id", "seq"), after=stop)
    assert rows(run(spark, tmp_path, lambda e: e.select("run_id", "seq"))) == [("a", 1), ("a", 2), ("a", 3)]


def test_upserts_keep_the_last_by_seq(spark, tmp_path):
    table = {"keys": ["run_id", "item_key"], "order": ["seq"]}
    lines(tmp_path, 0, [(1, 0, "a", "page-start", "i"), (9, 1, "a", "page-done", "i"), (2, 1, "a", "page-start", "j")])
    run(spark, tmp_path, streams.latest_by_key, **table)
    lines(tmp_path, 1, [(4, 2, "a", "gap-done", "i"), (5, 2, "a", "error", "j")])  # seq 4 comes late
    done = run(spark, tmp_path, streams.latest_by_key, **table)
    want = [("a", "i", "page-done", 9), ("a", "j", "error", 5)]
    assert rows(done) == want
    done.compact()
    assert rows(done) == want and len(done._parts()[1]) == 0
    lines(tmp_path, 2, [(10, 3, "a", "error", "i")])
    assert rows(run(spark, tmp_path, streams.latest_by_key, **table)) == [("a", "i", "error", 10), ("a", "j", "error", 5)]


def test_a_snapshot_that_is_not_whole_is_no_snapshot(spark, tmp_path):
    lines(tmp_path, 0, [(1, 0, "a", "page-start", "i")])
    table = run(spark, tmp_path, streams.latest_by_key, keys=["run_id", "item_key"], order=["seq"])
    (tmp_path / "out" / "rows" / "upto-000000000007").mkdir()  # its writer was stopped
    assert rows(table) == [("a", "i", "page-start", 1)]


def test_replays_are_not_counted(spark, tmp_path):
    events = [(1, 0, "a", "page-done", "i"), (2, 1, "a", "error", "i")]
    table = {"mode": "complete", "keys": ["run_id"]}
    lines(tmp_path, 0, events)
    run(spark, tmp_path, streams.live_counters, **table)
    lines(tmp_path, 1, [*events, (3, 2, "a", "page-done", "j"), (3, 2, "a", "page-done", "j")])
    assert rows(run(spark, tmp_path, streams.live_counters, **table)) == [("a", 2, 0, 0, 1, 1.5)]


def test_starts_that_time_out(spark, tmp_path):
    build = lambda e: stateful.pending_timeouts(e, wait_seconds=3600)
    lines(tmp_path, 0, [(1, 0, "a", "page-start", "in time"), (2, 0, "a", "page-start", "too late"), (3, 0, "a", "page-start", "never"), (4, 5, "a", "page-done", "done first"), (5, 6, "a", "page-start", "done first")])
    run(spark, tmp_path, build)
    # Out of order: a start from before a done that is there already; twice started, one of them in time.
    lines(tmp_path, 1, [(6, 60, "a", "page-done", "in time"), (7, 61, "a", "page-done", "too late"), (8, 4, "a", "page-start", "done first"), (9, 62, "a", "page-start", "twice"), (10, 62, "a", "page-start", "twice")])
    run(spark, tmp_path, build)
    lines(tmp_path, 2, [(11, 500, "a", "page-done", "twice"), (12, 500, "z", "error", None)])
    run(spark, tmp_path, build)
    assert rows(run(spark, tmp_path, build)) == [("a", "done first", 5), ("a", "never", 3), ("a", "too late", 2), ("a", "twice", 9), ("a", "twice", 10)]


def test_slots_keep_lone_sides(spark, tmp_path):
    build = lambda e: streams.rival_slots(e, wait="1 hour")
    lines(tmp_path, 0, [(1, 0, "a", "page-start", "x"), (2, 1, "a", "page-done", "lone"), (3, 2, "a", "page-start", "left")])
    run(spark, tmp_path, build)
    lines(tmp_path, 1, [(4, 30, "a", "page-done", "x"), (5, 90, "a", "page-done", "left")])
    run(spark, tmp_path, build)
    lines(tmp_path, 2, [(6, 900, None, "page-start", None), (7, 900, None, "page-done", None)])
    got = run(spark, tmp_path, build).read().filter("run_id is not null").collect()
    assert sorted((r.item_key, r.started, r.done) for r in got if r.started) == [("left", 3, None), ("x", 1, 4)]
    assert sorted((r.item_key, r.done) for r in got if not r.started) == [("left", 5), ("lone", 2)]


def test_slots_count_replays_once(spark, tmp_path):
    build = lambda e: streams.rival_slots(e, wait="1 hour")
    events = [(1, 0, "a", "page-done", "lone"), (2, 1, "a", "page-start", "x"), (3, 2, "a", "page-done", "x")]
    lines(tmp_path, 0, events)
    run(spark, tmp_path, build)
    lines(tmp_path, 1, [*events, (4, 2, "a", "page-done", "x"), (6, 900, None, "page-start", None), (7, 900, None, "page-done", None)])
    got = run(spark, tmp_path, build).read().filter("run_id is not null").collect()
    assert sorted((r.item_key, r.started or 0, r.done) for r in got) == [("lone", 0, 1), ("x", 2, 3), ("x", 2, 4)]


def test_starts_that_nothing_finished(spark, tmp_path):
    build = lambda e: streams.pending_items(e, wait="1 hour")
    lines(tmp_path, 0, [(1, 0, "a", "page-start", "in time"), (2, 0, "a", "page-start", "too late"), (3, 0, "a", "page-start", "never"), (4, 5, "a", "page-done", "done first"), (5, 6, "a", "page-start", "done first")])
    run(spark, tmp_path, build)
    lines(tmp_path, 1, [(3, 0, "a", "page-start", "never"), (5, 6, "a", "page-start", "done first"), (6, 12, "a", "page-done", "in time"), (8, 4, "a", "page-start", "done first"), (9, 13, "a", "page-start", "twice"), (10, 13, "a", "page-start", "twice")])
    run(spark, tmp_path, build)
    lines(tmp_path, 2, [(7, 61, "a", "page-done", "too late"), (11, 500, "a", "page-done", "twice"), (12, 500, "z", "page-start", None)])
    run(spark, tmp_path, build)
    assert rows(run(spark, tmp_path, build)) == [("a", "done first", 5), ("a", "never", 3), ("a", "too late", 2), ("a", "twice", 9), ("a", "twice", 10)]
