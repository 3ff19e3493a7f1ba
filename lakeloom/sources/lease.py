"""One run at a time per context, others queue.

A lease is a numbered file, created whole or not at all: whoever creates number
n + 1 holds the context. It is free again when it is released, or when its
holder has not renewed it for ``seconds`` (the driver was lost). A holder renews
from a thread of its own, so a long batch keeps its lease.

The number is a fencing token. A holder that stalled past its lease and lives on
is not the latest any more; it checks before it writes intents, data and
commits, and every manifest row carries the token it was written under. Drivers'
clocks must agree to well within ``seconds``.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import SparkSession

from lakeloom.sources import fs


class LeaseBusy(RuntimeError):
    """Another run held the context all the time this one was ready to wait."""


class Fenced(RuntimeError):
    """This run's lease has passed to another run."""


class Lease:
    """``with Lease(spark, state_dir, ctx) as lease: ... lease.check()``."""

    def __init__(self, spark: SparkSession, state_dir: str, ctx: str, seconds: float = 600.0, wait: float = 7200.0, poll: float = 0.5):
        self.spark, self.seconds, self.wait, self.poll = spark, seconds, wait, poll
        safe = "".join(c if c.isalnum() or c in "-_" else f"%{ord(c):x}" for c in ctx)
        self.folder, self.owner = f"{state_dir.rstrip('/')}/lease/{safe}", uuid.uuid4().hex
        self.token, self._done = 0, threading.Event()

    def _latest(self) -> int:
        return max((int(n.split(".")[0]) for n in fs.list_names(self.spark, self.folder) if n.endswith(".held")), default=0)

    def _path(self, token: int, kind: str) -> str:
        return f"{self.folder}/{token:012d}.{kind}"

    def _free(self, token: int) -> bool:
        if token == 0 or fs.exists(self.spark, self._path(token, "released")):
            return True
        note = fs.read_text(self.spark, self._path(token, "renewed")) or fs.read_text(self.spark, self._path(token, "held"))
        return note is not None and json.loads(note)["until"] <= time.time()

    def _note(self) -> str:
        return json.dumps({"owner": self.owner, "until": time.time() + self.seconds})

    def __enter__(self) -> Lease:
        end = time.time() + self.wait
        while True:
            last = self._latest()
            if self._free(last) and fs.write_once(self.spark, self._path(last + 1, "held"), self._note()):
                self.token = last + 1
                break
            if time.time() >= end:
                raise LeaseBusy(f"{self.folder} is held by another run (token {last})")
            time.sleep(self.poll)
        for n in fs.list_names(self.spark, self.folder):  # earlier tokens' files
            if int(n.split(".")[0]) < self.token - 1:
                fs.delete(self.spark, f"{self.folder}/{n}", recursive=False)
        if self.seconds > 0:
            threading.Thread(target=self._renew, daemon=True).start()
        return self

    def _renew(self) -> None:
        while not self._done.wait(self.seconds / 3):
            fs.write_text(self.spark, self._path(self.token, "renewed"), self._note())

    def check(self) -> None:
        """Raise if another run has taken the context since."""
        last = self._latest()
        if last != self.token:
            raise Fenced(f"token {self.token} of {self.folder} has been followed by {last}")

    def __exit__(self, *_) -> None:
        self._done.set()
        if self._latest() == self.token:
            fs.write_once(self.spark, self._path(self.token, "released"), self.owner)
