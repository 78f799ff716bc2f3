"""A streaming source of what happens to the files below a folder.

Each poll compares the tree with the one of the poll before and writes what differs as a numbered
segment: the events in files of bounded size, and the tree, published by one rename. Offsets are
segment numbers, so a restart reads the same events again and none twice, and events between two
runs of the stream are found by the next poll. Segments that the stream has committed are
deleted, but for the newest, whose tree the next poll is compared with.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..streaming.watch import EVENT

#: Events of a file of a segment; a file is read by one task.
EVENTS_A_FILE = 50_000


@dataclass
class Part(InputPartition):
    path: str


def tree(root: str, without: str) -> dict[str, list[int]]:
    """Size and modification time of every ordinary file below ``root``, links not followed; the folder ``without`` is left out."""
    found, waiting = {}, [root]
    while waiting:
        at = waiting.pop()
        try:
            entries = list(os.scandir(at))
        except FileNotFoundError:
            continue  # gone since it was listed
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                if entry.path != without:
                    waiting.append(entry.path)
            elif entry.is_file(follow_symlinks=False):
                try:
                    stat = entry.stat(follow_symlinks=False)
                    found[entry.path] = [stat.st_size, stat.st_mtime_ns]
                except FileNotFoundError:
                    continue
    return found


class FileEvents(DataSource):
    """``file_events``: options ``root`` (the folder watched) and ``log`` (a folder that driver and executors share).

    The first poll finds every file as created. The tree is held by the driver, as a watcher's
    is; larger trees are scanned by ``directory`` and reconciled.
    """

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FileEventReader(self.options["root"].rstrip("/"), self.options["log"].rstrip("/"))


class FileEventReader(DataSourceStreamReader):
    def __init__(self, root: str, log: str):
        self.root, self.log = root, log

    def segment(self, number: int) -> str:
        return f"{self.log}/segment-{number:012d}"

    def newest(self) -> int:
        names = os.listdir(self.log) if os.path.isdir(self.log) else []
        return max((int(n.removeprefix("segment-")) for n in names if n.startswith("segment-")), default=0)

    def poll(self) -> int:
        """Publish a segment if the tree has changed; the newest segment's number."""
        number, before = self.newest(), {}
        if number:
            with open(f"{self.segment(number)}/tree.json") as file:
                before = json.load(file)
        now, at = tree(self.root, self.log), time.time_ns() // 1_000_000
        kinds = {p: "create" if p not in before else "modify" for p, seen in now.items() if before.get(p) != seen} | {p: "delete" for p in before if p not in now}
        if not kinds:
            return number
        staged = f"{self.log}/staged-{uuid.uuid4().hex}"
        os.makedirs(staged)
        events = [json.dumps([path, kind, at]) for path, kind in sorted(kinds.items())]
        for i in range(0, len(events), EVENTS_A_FILE):
            with open(f"{staged}/events-{i // EVENTS_A_FILE:06d}.jsonl", "w") as file:
                file.write("\n".join(events[i : i + EVENTS_A_FILE]))
        with open(f"{staged}/tree.json", "w") as file:
            json.dump(now, file)
        os.rename(staged, self.segment(number + 1))
        return number + 1

    def initialOffset(self) -> dict:
        return {"segment": 0}

    def latestOffset(self) -> dict:
        return {"segment": self.poll()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        folders = [self.segment(n) for n in range(start["segment"] + 1, end["segment"] + 1)]
        return [Part(f"{folder}/{name}") for folder in folders for name in sorted(os.listdir(folder)) if name.startswith("events-")]

    def read(self, partition: Part) -> Iterator[tuple]:
        with open(partition.path) as file:
            for line in file:
                yield tuple(json.loads(line))

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.log):
            if name.startswith("segment-") and int(name.removeprefix("segment-")) < min(end["segment"], self.newest()):
                shutil.rmtree(f"{self.log}/{name}", ignore_errors=True)


def file_events(spark, root: str, log: str):
    """A stream of ``EVENT`` for the files below ``root``."""
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("file_events").options(root=root, log=log).load()
