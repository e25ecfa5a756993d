"""Providers of structured proposals: a protocol, retries with what was wrong, and bounded batches on the driver.

A provider is any object with a name and generate(request) -> dict; none is built in, and none is called by an operator.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol


class Provider(Protocol):
    name: str

    def generate(self, request: dict[str, Any]) -> dict[str, Any]: ...


@dataclass
class Outcome:
    """Answers and failures by task id."""

    answers: dict[str, dict] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)


def leaked(answer: Any, protected: Sequence[str]) -> str | None:
    """The first protected value, of three characters at least, that an answer repeats anywhere."""
    if isinstance(answer, dict):
        return next((x for v in answer.values() if (x := leaked(v, protected))), None)
    if isinstance(answer, list):
        return next((x for v in answer if (x := leaked(v, protected))), None)
    return next((p for p in protected if len(p) >= 3 and isinstance(answer, str) and p.lower() in answer.lower()), None)


def answered(provider: Provider, request: dict[str, Any], check: Callable[[dict], str | None], retries: int = 2, pause: float = 0.0) -> dict[str, Any]:
    """An answer that check finds nothing wrong with; each retry tells what was wrong before."""
    wrong = None
    for attempt in range(retries + 1):
        try:
            answer = provider.generate(request if wrong is None else {**request, "correction": wrong})
            wrong = check(answer)
            if wrong is None:
                return answer
        except OSError as e:
            wrong = type(e).__name__
        if attempt < retries and pause:
            time.sleep(pause * 2**attempt)
    raise ValueError(wrong)


def run_batch(tasks: Sequence[dict[str, Any]], provider: Provider, check: Callable[[dict], str | None], workers: int = 4, retries: int = 2, pause: float = 0.0, most_errors: int | None = None, cache: dict[str, dict] | None = None) -> Outcome:
    """Answers to tasks (id, request, protected), in their order; a cache by task id saves calls.

    Answers that repeat protected values fail. Without most_errors the first failure ends the batch; with it, that many do.
    """
    if workers < 1 or retries < 0 or pause < 0:
        raise ValueError("workers, retries and pause must be sound")
    out, known = Outcome(), cache if cache is not None else {}

    def one(task: dict[str, Any]) -> dict[str, Any]:
        def sound(answer: dict) -> str | None:
            value = leaked(answer, task.get("protected", ()))
            return "a protected value is repeated" if value else check(answer)

        return known[task["id"]] if task["id"] in known else answered(provider, task["request"], sound, retries, pause)

    with ThreadPoolExecutor(workers) as pool:
        started = [(t["id"], pool.submit(one, t)) for t in tasks]
        for task_id, future in started:
            try:
                out.answers[task_id] = known[task_id] = future.result()
            except ValueError as e:
                out.failures[task_id] = str(e)
                if most_errors is None or len(out.failures) >= most_errors:
                    for _, f in started:
                        f.cancel()
                    raise ValueError(f"the batch failed at {task_id}: {e}") from e
    return out
