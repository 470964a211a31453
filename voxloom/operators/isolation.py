"""Model calls in a process of their own, so that a model that crashes or hangs costs one row.

A Spark task whose Python worker dies fails, and after a few attempts so does the
job.  Here the worker forks a child that loads the model and makes the calls; if the
child dies or takes too long, the worker notes that as the row's error, starts
another child and goes on.
"""

from __future__ import annotations

import ctypes
import multiprocessing
import os
import signal
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

WORKER_LOST = "worker_lost"
TIMED_OUT = "timed_out"

Run = Callable[[list[Any]], list[Any]]

_PR_SET_PDEATHSIG = 1  # fixed value of the operating system


@dataclass(frozen=True)
class Isolation:
    """Make model calls in a child process.

    ``seconds`` is how long one row may take (a list of rows: as many times that);
    ``None`` sets no limit.  ``load_seconds`` limits the loading of the model.
    """

    seconds: float | None = None
    load_seconds: float | None = None


def _text(exc: BaseException) -> str:
    return str(exc) or type(exc).__name__


def _serve(pipe: Any, load: Callable[[], Run]) -> None:
    """The child: load, then answer lists of rows until the pipe closes."""
    try:  # a worker that is killed takes its child with it
        ctypes.CDLL(None).prctl(_PR_SET_PDEATHSIG, signal.SIGKILL)
    except (OSError, AttributeError):
        pass
    try:
        run = load()
    except BaseException as exc:
        pipe.send(_text(exc))
        return
    pipe.send(None)
    while True:
        try:
            values = pipe.recv()
        except EOFError:
            return
        # Plain values only: a class may not be the same object in a worker that is used again.
        pipe.send([(_text(r), None) if isinstance(r, Exception) else (None, r) for r in run(values)])


def _fork(pipe: Any, other: Any, load: Callable[[], Run]) -> int:
    pid = os.fork()
    if pid:
        return pid
    status = 1
    try:
        other.close()
        _serve(pipe, load)
        status = 0
    finally:  # never back into the worker's own code
        os._exit(status)


class Isolated:
    """Runs lists of rows in a child process; a row that costs a child gets its reason as an exception."""

    def __init__(self, load: Callable[[], Run], how: Isolation):
        self.load, self.how = load, how
        self.pid: int | None = None
        self.pipe: Any = None

    def _answer(self, seconds: float | None) -> Any:
        if not self.pipe.poll(seconds):
            raise TimeoutError(TIMED_OUT)
        try:
            return self.pipe.recv()
        except (EOFError, ConnectionResetError):
            raise ChildProcessError(WORKER_LOST) from None

    def _start(self) -> None:
        mine, theirs = multiprocessing.Pipe()
        self.pid, self.pipe = _fork(theirs, mine, self.load), mine
        theirs.close()
        try:
            failed = self._answer(self.how.load_seconds)
        except (TimeoutError, ChildProcessError) as exc:
            self.close()
            raise RuntimeError(f"the model cannot be loaded: {exc}") from None
        if failed is not None:
            self.close()
            raise RuntimeError(failed)

    def _call(self, values: list[Any]) -> list[Any]:
        if self.pid is None:
            self._start()
        limit = None if self.how.seconds is None else self.how.seconds * len(values)
        try:
            try:
                self.pipe.send(values)
            except (BrokenPipeError, ConnectionResetError):
                raise ChildProcessError(WORKER_LOST) from None
            return [made if text is None else RuntimeError(text) for text, made in self._answer(limit)]
        except (TimeoutError, ChildProcessError):
            self.close()
            raise

    def __call__(self, values: list[Any]) -> list[Any]:
        """One result per row.  A list that costs its child is run again row by row."""
        try:
            return self._call(values)
        except (TimeoutError, ChildProcessError) as exc:
            if len(values) == 1:
                return [exc]
            return [self([v])[0] for v in values]

    def close(self) -> None:
        if self.pid is None:
            return
        pid, self.pid = self.pid, None
        self.pipe.close()
        try:
            os.kill(pid, signal.SIGKILL)
            os.waitpid(pid, 0)
        except (ProcessLookupError, ChildProcessError):
            pass
