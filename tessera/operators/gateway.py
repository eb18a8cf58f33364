"""Calls of models and tools from the driver: roles, retries, a breaker, a table of tools."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..streaming.stateful import breaker


class Gateway:
    """Models by role: complete() asks the role's model, else the default one, some times each, and gives None where all
    fail or shed: callers then take their deterministic way. Failures in a row open a breaker for that model."""

    def __init__(self, models: dict[str, Callable[[list[dict]], str]], attempts: int = 2, clock: Callable[[], float] = time.time, wait: Callable[[float], None] = time.sleep):
        self._models, self._attempts, self._clock, self._wait = models, attempts, clock, wait
        self._state = {name: ("closed", 0, 0.0, 0) for name in models}
        self.errors: dict[str, int] = {name: 0 for name in models}

    def _tell(self, name: str, ok: bool) -> bool:
        """Record an outcome; False if the breaker sheds the call."""
        phases, self._state[name] = breaker([(self._clock(), ok)], self._state[name])
        return phases[0] != "shed"

    def _open(self, name: str) -> bool:
        phases, _ = breaker([(self._clock(), True)], self._state[name])
        return phases[0] == "shed"

    def complete(self, messages: list[dict], role: str = "default") -> str | None:
        for name in dict.fromkeys((role, "default")):
            for attempt in range(self._attempts if name in self._models else 0):
                if self._open(name):
                    break
                try:
                    answer = self._models[name](messages)
                except Exception:
                    answer = None
                if isinstance(answer, str):
                    self._tell(name, True)
                    return answer
                self.errors[name] += 1
                self._tell(name, False)
                self._wait(0.1 * 2**attempt)
        return None

    def complete_json(self, messages: list[dict], role: str = "default") -> dict | list | None:
        """The answer as JSON, with or without a code fence; None if it isn't any."""
        answer = self.complete(messages, role)
        try:
            return json.loads((answer or "").strip().removeprefix("```json").removeprefix("```").removesuffix("```"))
        except ValueError:
            return None


class Tools:
    """Named functions of arguments to DataFrames, as a tool server would offer them: their list with descriptions, and calls
    whose rows come back as JSON, `most` at a time."""

    def __init__(self):
        self._tools: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], str]] = {}

    def add(self, name: str, function: Callable[..., DataFrame], *arguments: str) -> None:
        self._tools[name] = (function, arguments, (function.__doc__ or "").strip().split("\n")[0])

    def listed(self) -> list[dict]:
        return [{"name": n, "arguments": list(a), "description": d} for n, (_, a, d) in sorted(self._tools.items())]

    def call(self, name: str, most: int = 100, **arguments) -> dict:
        """{"rows": ...} or {"error": ...}: a tool that is unknown, or given other arguments, is an answer too."""
        if name not in self._tools:
            return {"error": f"unknown tool {name}"}
        function, known, _ = self._tools[name]
        if set(arguments) - set(known):
            return {"error": f"unknown arguments {sorted(set(arguments) - set(known))}"}
        rows = function(**arguments).limit(most + 1).collect()
        return {"rows": [json.loads(json.dumps(r.asDict(recursive=True), default=str)) for r in rows[:most]], "more": len(rows) > most}
