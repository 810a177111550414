"""Versions of a set of tables in one folder: published snapshots, a pointer to the live one, undo, retention.

The pointer is a log of small numbered files. Each is written whole and gets its number by
a rename that fails if the number is taken, so a switch is one step, two writers cannot
both win, and readers see the state before or after it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.sources import snapshots

_LOG = "_pointers"
_STATE = "number long, action string, folder string, live string, standby string"


class SwitchError(RuntimeError):
    """A switch that the state does not allow, or that another writer has been ahead of."""


@dataclass(frozen=True)
class State:
    number: int = -1
    live: str | None = None
    standby: str | None = None


class Versions:
    """The versions under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        settings = spark._jsparkSession.sessionState().newHadoopConf()
        self._files = self._path(self.root).getFileSystem(settings)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), settings)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def publish(self, folder: str, tables: dict[str, DataFrame], parent: str | None = None) -> str:
        """Writes ``tables`` as a snapshot, an update of ``parent`` if given; returns its version. It is not live yet."""
        if parent is not None and parent not in self.published():
            raise SwitchError(f"{parent} is not published")
        version = snapshots.write_snapshot(tables, f"{self.root}/{folder}", parent)
        state = self.state()
        self._put(state, "publish", folder, state.live, state.standby)
        return version

    def state(self) -> State:
        """The newest entry of the log."""
        log = self._path(f"{self.root}/{_LOG}")
        numbers = [int(x.getPath().getName().split(".")[0]) for x in self._files.listStatus(log) if not x.getPath().getName().startswith("_")] if self._files.exists(log) else []
        if not numbers:
            return State()
        row = self.history().filter(F.col("number") == max(numbers)).first()
        return State(row["number"], row["live"], row["standby"])

    def history(self) -> DataFrame:
        """(number, action, folder, live, standby) of everything that was done."""
        return self.spark.read.schema(_STATE).json(f"{self.root}/{_LOG}")

    def prepare(self, folder: str) -> None:
        """``folder`` becomes the standby. It must be published, and built on what is live."""
        state = self.state()
        if state.live == folder:
            raise SwitchError(f"{folder} is live already")
        if state.standby not in (None, folder):
            raise SwitchError(f"another standby is there: {state.standby}")
        if folder not in self.published():
            raise SwitchError(f"{folder} is not published")
        if state.live is not None and self.parent_of(folder) not in (state.live, None):
            raise SwitchError(f"{folder} was built on {self.parent_of(folder)}, not on {state.live}")
        self._put(state, "prepare", folder, state.live, folder)

    def flip(self) -> None:
        """The standby becomes live, and the live one the standby."""
        state = self.state()
        if state.standby is None:
            raise SwitchError("no standby to flip to")
        self._put(state, "flip", state.standby, state.standby, state.live)

    def finish(self) -> None:
        """Lets the standby go."""
        state = self.state()
        self._put(state, "finish", state.standby, state.live, None)

    def undo(self) -> None:
        """What was live before the last flip or undo becomes live again; what is live becomes the standby."""
        state = self.state()
        before = self.history().filter((F.col("live") != F.lit(state.live)) & (F.col("action").isin("flip", "undo"))).orderBy(F.desc("number")).first()
        if before is None or before["live"] not in self.published():
            raise SwitchError("nothing to go back to")
        self._put(state, "undo", before["live"], before["live"], state.live)

    def published(self) -> list[str]:
        """Finished snapshots in the folder; one without a manifest is unfinished."""
        root = self._path(self.root)
        if not self._files.exists(root):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(root) if x.isDirectory() and x.getPath().getName() != _LOG]
        return sorted(n for n in names if self._files.exists(self._path(f"{self.root}/{n}/manifest/_SUCCESS")))

    def parent_of(self, folder: str) -> str | None:
        return self.spark.read.parquet(f"{self.root}/{folder}/manifest").first()["parent"]

    def lineage(self, folder: str) -> list[str]:
        """From the base to ``folder``."""
        out = [folder]
        while (parent := self.parent_of(out[0])) is not None:
            out.insert(0, parent)
        return out

    def table(self, name: str, folder: str | None = None) -> DataFrame:
        """A table at a version, the live one unless given; a query that has begun keeps the version it read."""
        folder = folder or self.state().live
        if folder is None:
            raise SwitchError("nothing is live")
        return snapshots.snapshot_table(self.spark, [f"{self.root}/{f}" for f in self.lineage(folder)], name)

    def prune(self, keep: int = 2) -> list[str]:
        """Deletes snapshots that are not live, standby, among the ``keep`` last published ones, or a base of one of
        these; unfinished ones too. Returns what was deleted. No snapshot should be in the making meanwhile."""
        state, there = self.state(), self.published()
        last = [r["folder"] for r in self.history().filter("action = 'publish'").orderBy(F.desc("number")).collect() if r["folder"] in there][:keep]
        held = {f for wanted in {state.live, state.standby, *last} - {None} for f in self.lineage(wanted)}
        every = [x.getPath().getName() for x in self._files.listStatus(self._path(self.root)) if x.isDirectory() and x.getPath().getName() != _LOG]
        gone = sorted(f for f in every if f not in held)
        for folder in gone:
            self._files.delete(self._path(f"{self.root}/{folder}"), True)
        if gone:
            self._put(state, "prune", ",".join(gone), state.live, state.standby)
        return gone

    def _put(self, state: State, action: str, folder: str | None, live: str | None, standby: str | None) -> None:
        number = state.number + 1
        line = json.dumps({"number": number, "action": action, "folder": folder, "live": live, "standby": standby}) + "\n"
        self._files.mkdirs(self._path(f"{self.root}/{_LOG}"))
        temporary, final = self._path(f"{self.root}/{_LOG}/_{uuid.uuid4().hex}"), self._path(f"{self.root}/{_LOG}/{number:012d}.json")
        out = self._files.create(temporary, False)
        try:
            out.write(bytearray(line.encode()))
        finally:
            out.close()
        try:
            self._context.rename(temporary, final, self._no_options)
        except Exception as e:
            self._files.delete(temporary, False)
            raise SwitchError(f"another writer was ahead: {final} exists") from e
