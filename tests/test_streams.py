"""Streams against replays in plain Python, across micro-batches and restarts."""

from __future__ import annotations

import datetime
import os
import random

import pytest

from shelfmark.sources import events
from shelfmark.streaming import watch


def run(rows, checkpoint, found, fail=()):
    """Process what is available; batches numbered in ``fail`` raise once they are done."""

    def take(batch, number):
        got = batch.collect()
        if number in fail:
            raise RuntimeError("lost")
        found.append(got)

    query = rows.writeStream.foreachBatch(take).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def at(look):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=look)


def brute_settled(looks):
    """Which files settle at which look, of all files of every look one after the other."""
    state, out = {}, set()
    for k, files in enumerate(looks):
        now = {}
        for path, value in files.items():
            known = state.get(path)
            same = known is not None and known[0] == value
            if same and not known[1]:
                out.add((path, k))
            now[path] = (value, k == 0 or same)
        state = now
    return out


def test_settled_files_and_forgotten_ones(spark, tmp_path):
    rng = random.Random(1)
    looks = [{f"p{i}": (rng.randrange(2), rng.randrange(2)) for i in range(25) if rng.random() < 0.75} for _ in range(8)]
    looks += [{"p1": (0, 0)}] * 3
    found, used = [], None
    for k, files in enumerate(looks):
        rows = [("w", p, *v, k, at(k)) for p, v in files.items()]
        spark.createDataFrame(rows + rows[:2], watch.SIGHTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "looks"))
        stream = watch.settled_files(watch.event_stream(spark, str(tmp_path / "looks"), watch.SIGHTING), grace_ms=90_000)
        query = run(stream, tmp_path / "state", found)
        used = query.lastProgress["stateOperators"][0]["customMetrics"] if query.lastProgress and query.lastProgress["stateOperators"] else used
    rows = [(r.path, r.look) for batch in found for r in batch]
    assert sorted(rows) == sorted(brute_settled(looks)) and rows
    # Only the file of the last looks is left in the state.
    state = spark.read.format("statestore").option("stateVarName", "known").load(str(tmp_path / "state"))
    assert {r.key.path for r in state.collect()} <= {"p1"}


def brute_dirty(batches, root):
    dirty = set()
    for kind, directory in batches:
        if kind == "reconciled":
            dirty.discard(directory)
        elif not any(directory == d or directory.startswith(f"{d}/") for d in dirty):
            dirty = {d for d in dirty if not d.startswith(f"{directory}/")} | {directory}
    return {root} if root in dirty else dirty


@pytest.mark.parametrize("overflow", [False, True])
def test_dirty_directories_over_batches(spark, tmp_path, overflow):
    rng = random.Random(2)
    every, found, n = [], [], 0
    for batch in range(3):
        rows = []
        for _ in range(25):
            n += 1
            directory = "/r" + "".join(f"/{rng.choice('abc')}" for _ in range(rng.randint(1, 4)))
            kind = "reconciled" if rng.random() < 0.25 else "modify"
            rows.append((directory if kind == "reconciled" else f"{directory}/file", kind, n))
            every.append((kind, directory))
        rows.append(("/elsewhere/x", "modify", n))
        if overflow and batch == 2:
            rows.append(("", "overflow", n + 1))
            every.append(("overflow", "/r"))
        spark.createDataFrame(rows, watch.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        run(watch.dirty_changes(watch.event_stream(spark, str(tmp_path / "events")), "/r"), tmp_path / "state", found)
    changes = spark.createDataFrame([tuple(r) for batch in found for r in batch], watch.CHANGE)
    assert {r.directory for r in watch.still_dirty(changes, "/r").collect()} == brute_dirty(every, "/r")
    assert {r.change for r in changes.collect()} == {"dirty", "absorbed", "clean"}


def test_file_events_are_neither_lost_nor_repeated(spark, tmp_path, monkeypatch):
    root, log = tmp_path / "tree", tmp_path / "tree" / "log"
    (root / "sub").mkdir(parents=True)
    for name in ("a", ".hidden", "sub/b"):
        (root / name).write_text(name)
    source = lambda: events.file_events(spark, str(root), str(log))
    found = []
    run(source(), tmp_path / "state", found)
    paths = lambda batch: {(os.path.relpath(r.path, root), r.event) for r in batch}
    assert [paths(b) for b in found] == [{("a", "create"), (".hidden", "create"), ("sub/b", "create")}]
    (root / "a").write_text("longer")
    (root / "sub/b").unlink()
    (root / "sub/c").write_text("c")
    wanted = {("a", "modify"), ("sub/b", "delete"), ("sub/c", "create")}
    # The batch is lost after its offsets are logged: a new run reads the same events again.
    with pytest.raises(Exception, match="lost"):
        run(source(), tmp_path / "state", found, fail={1})
    (root / "d").write_text("d")
    # One run may end with the batch it had to repeat; the next ones find what is new, once.
    for _ in range(3):
        run(source(), tmp_path / "state", found)
    rows = [x for b in found[1:] for x in paths(b)]
    assert sorted(rows) == sorted([*wanted, ("d", "create")])
    assert len([n for n in os.listdir(log) if n.startswith("segment-")]) <= 2
