"""Calls of injected clients from within tasks: several at once, each with a deadline."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

#: Fixed value: seconds that a provider has for an answer.
DEADLINE = 30.0
AT_ONCE = 4


def answers(client: Callable[[str], str | None], prompts: list[str], seconds: float = DEADLINE, at_once: int = AT_ONCE) -> list[str | None]:
    """The client's answers in order; None for one that fails or takes longer than its deadline.

    At most `at_once` calls that are within their deadlines run at a time. One past it is left to itself in a
    daemon thread, whose answer nobody reads, and gives its place to the next, so n prompts take n / at_once deadlines at most.
    """
    out: list[str | None] = [None] * len(prompts)
    changed = threading.Condition()
    running: dict[int, float] = {}

    def call(i: int) -> None:
        try:
            got = client(prompts[i])
        except BaseException:  # whatever an injected client fails with, there is no answer
            got = None
        with changed:
            if i in running:  # else it is too late
                del running[i]
                out[i] = got
                changed.notify_all()

    at = 0
    with changed:
        while at < len(prompts) or running:
            now = time.monotonic()
            for i in [i for i, end in running.items() if end <= now]:
                del running[i]
            while at < len(prompts) and len(running) < at_once:
                running[at] = now + seconds
                threading.Thread(target=call, args=(at,), daemon=True).start()
                at += 1
            if running:
                changed.wait(max(0.0, min(running.values()) - time.monotonic()))
    return out
