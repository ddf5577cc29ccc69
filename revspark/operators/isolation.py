"""User code in a child process of the worker: what hangs, ends the process or takes too much memory costs one call."""

from __future__ import annotations

import contextlib
import multiprocessing
import os
import pickle
import resource
import signal
from collections.abc import Callable


def _serve(fn: Callable, ours, theirs, memory_mb: int | None) -> None:
    ours.close()  # so that the end of the worker ends this process, too
    os.setsid()  # what the user's code starts is ended with it
    if memory_mb is not None:
        with open("/proc/self/statm") as f:
            now = int(f.read().split()[0]) * os.sysconf("SC_PAGE_SIZE")
        most = now + memory_mb * 2**20
        resource.setrlimit(resource.RLIMIT_AS, (most, most))
    while True:
        try:
            args = pickle.loads(theirs.recv_bytes())
        except EOFError:
            os._exit(0)
        try:
            answer = pickle.dumps((fn(*args), None))
        except BaseException as e:  # noqa: BLE001 - also SystemExit: whatever the user's code raises is its answer
            answer = pickle.dumps((None, f"{type(e).__name__}: {e}"))
        theirs.send_bytes(answer)


class Child:
    """Calls ``fn`` in a forked process, which is kept for further calls and replaced once a call has failed hard.

    ``call`` gives (answer, None) or (None, reason). seconds: how long a call may take. memory_mb: what the process may
    allocate beyond what the worker held when it was forked (Linux).
    """

    def __init__(self, fn: Callable, seconds: float | None = None, memory_mb: int | None = None):
        self.fn, self.seconds, self.memory_mb = fn, seconds, memory_mb
        self.process = self.pipe = None

    def call(self, *args):
        if self.process is None:
            self._start()
        try:
            self.pipe.send_bytes(pickle.dumps(args))
            if not self.pipe.poll(self.seconds):
                self.close()
                return None, f"TimeoutError: no answer within {self.seconds} s"
            return pickle.loads(self.pipe.recv_bytes())
        except (EOFError, OSError):
            self.process.join(5)
            code = self.process.exitcode
            self.close()
            return None, f"ChildProcessError: process ended with code {code}"

    def _start(self) -> None:
        ways = multiprocessing.get_context("fork")
        self.pipe, theirs = ways.Pipe()
        self.process = ways.Process(target=_serve, args=(self.fn, self.pipe, theirs, self.memory_mb), daemon=True)
        self.process.start()
        theirs.close()

    def close(self) -> None:
        if self.process is None:
            return
        self.pipe.close()
        with contextlib.suppress(ProcessLookupError, PermissionError):
            os.killpg(self.process.pid, signal.SIGKILL)
        self.process.kill()
        self.process.join()
        self.process = self.pipe = None
