"""Script errors with the place marked, and name suggestions."""

from __future__ import annotations

import difflib


class ScriptError(ValueError):
    """A script that does not parse or does not fit its input."""

    def __init__(self, message: str, script: str = "", at: int | None = None) -> None:
        self.reason, self.at = message, at
        if at is not None and script:
            start = script.rfind("\n", 0, at) + 1
            end = script.find("\n", at)
            line = script[start : end if end >= 0 else len(script)]
            message = f"{message}\n  {line}\n  {' ' * (at - start)}^"
        super().__init__(message)


def suggestion(name: str, known: list[str]) -> str:
    near = difflib.get_close_matches(name, known, 1, 0.6)
    return f"; did you mean '{near[0]}'?" if near else ""
