"""A deadline for each row: the work on a document runs in a child process of the worker, which is killed when its time is up.

A document that hangs a converter, or takes the process down with it, then costs its own row (a Timeout or Render error), not its task. The child is
forked once and serves row after row; only after it was killed, or has died, is another one forked. It ends with its worker.
"""

from __future__ import annotations

import multiprocessing
import os
import resource
import signal
from collections.abc import Callable
from multiprocessing.connection import Connection
from typing import Any

from docloom.operators.base import ConversionError

SECONDS = 120.0


class Guarded:
    """`work` under a deadline, and under a bound of the child's memory if one is given."""

    def __init__(self, work: Callable[[bytes], Any], seconds: float = SECONDS, memory_bytes: int | None = None):
        self.work, self.seconds, self.memory = work, seconds, memory_bytes
        self.pid, self.pipe, self.owner = 0, None, 0

    def __getstate__(self) -> dict:
        return {"work": self.work, "seconds": self.seconds, "memory": self.memory, "pid": 0, "pipe": None, "owner": 0}

    def _serve(self, pipe: Connection) -> None:
        signal.signal(signal.SIGTERM, signal.SIG_DFL)
        if self.memory:
            with open("/proc/self/statm") as f:  # what the worker has mapped already comes on top
                mapped = int(f.read().split()[0]) * resource.getpagesize()
            resource.setrlimit(resource.RLIMIT_AS, (mapped + self.memory, mapped + self.memory))
        while True:
            try:
                content = pipe.recv_bytes()
            except EOFError:
                return
            try:
                answer = True, self.work(content)
            except ConversionError as e:
                answer = False, (e.kind, str(e))
            except MemoryError:
                answer = False, ("Resource", f"over {self.memory} bytes of memory")
            except Exception as e:
                answer = False, (None, str(e) or type(e).__name__)
            pipe.send(answer)

    def _start(self) -> None:
        ours, theirs = multiprocessing.Pipe()
        pid = os.fork()
        if pid == 0:
            try:
                ours.close()
                self._serve(theirs)
            finally:
                os._exit(0)
        theirs.close()
        self.pid, self.pipe, self.owner = pid, ours, os.getpid()

    def _end(self) -> None:
        self.pipe.close()
        try:
            os.kill(self.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        os.waitpid(self.pid, 0)
        self.pid, self.pipe = 0, None

    def __call__(self, content: bytes):
        if self.pipe is None or self.owner != os.getpid():
            self._start()
        try:
            self.pipe.send_bytes(content)
            if not self.pipe.poll(self.seconds):
                self._end()
                raise ConversionError("Timeout", f"over {self.seconds:g} s")
            done, value = self.pipe.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError) as e:
            self._end()
            raise ConversionError("Render", "the process that worked on it has died") from e
        if done:
            return value
        kind, message = value
        raise ConversionError(kind, message) if kind else RuntimeError(message)

    def close(self) -> None:
        if self.pipe is not None and self.owner == os.getpid():
            self._end()

    def __del__(self):
        self.close()
