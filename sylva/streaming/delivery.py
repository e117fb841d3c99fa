"""Parts delivered to a sink in walk order, with progress and cancellation."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.errors import Cancelled
from sylva.operators.documents import entries_of_document, part_documents
from sylva.operators.parts import checked, with_node_ids
from sylva.operators.staging import staged


@dataclass(frozen=True)
class Part:
    number: int
    document: str

    def entries(self) -> list[dict]:
        return list(entries_of_document(self.document))

    def __len__(self) -> int:
        return len(self.entries())


class Progress(Protocol):
    """Told, from the driver and as parts are handed out, of the root and every directory before what it holds, of every
    entry with the size of a file (0 for others), and of what was skipped."""

    def entered(self, directory: str) -> None: ...

    def recorded(self, path: str, kind: str, size: int) -> None: ...

    def skipped(self, path: str, reason: str) -> None: ...


@contextmanager
def cancellable(spark: SparkSession, cancel: threading.Event | None) -> Iterator[Callable[[], None]]:
    """Jobs started within are interrupted once ``cancel`` is set, and end in Cancelled. Gives a function that looks at it."""
    tag, done, context = f"sylva-{uuid.uuid4().hex}", threading.Event(), spark.sparkContext

    def look() -> None:
        if cancel is not None and cancel.is_set():
            raise Cancelled("the caller asked to stop")

    def watch() -> None:
        while not done.wait(0.05):
            if cancel.is_set():
                context.cancelJobsWithTag(tag)

    look()
    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True) if cancel is not None else None
    if watcher:
        watcher.start()
    try:
        yield look
    except Cancelled:
        raise
    except Exception as error:
        if cancel is not None and cancel.is_set() and "cancel" in str(error).lower():
            raise Cancelled("the caller asked to stop") from error
        raise
    finally:
        done.set()
        context.removeJobTag(tag)
        if watcher:
            watcher.join()


def deliver(parted: DataFrame, sink: Callable[[Part], None], skips: DataFrame | None = None, progress: Progress | None = None, cancel: threading.Event | None = None) -> int:
    """Calls ``sink`` with each part in order; returns their number.

    The driver holds one partition of parts at a time. An error of the sink ends it and comes out unchanged. ``cancel``
    interrupts the jobs that make the parts, is looked at before each entry that is told of and before each part, and
    raises Cancelled; parts handed out until then stay valid."""
    with cancellable(parted.sparkSession, cancel) as look:
        documents = staged(part_documents(with_node_ids(checked(staged(parted, "deliver-rows")))), "deliver").orderBy("part_no")
        if progress is not None:
            progress.entered("")
            for row in skips.orderBy(F.split("path", "/")).toLocalIterator() if skips is not None else ():
                look()
                progress.skipped(row.path, row.reason)
        n = 0
        for row in documents.toLocalIterator():
            look()
            part = Part(row.part_no, row.document)
            for e in part.entries() if progress is not None else ():
                look()
                progress.recorded(e["path"], e["kind"], e.get("size") or 0)
                if e["kind"] == "directory":
                    progress.entered(e["path"])
            sink(part)
            n += 1
        return n
