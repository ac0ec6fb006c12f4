"""A trace of calls, one JSON line each; ``spark.read.json`` reads it back."""

from __future__ import annotations

import functools
import json
import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path
from typing import Any


class Trace:
    """Appends to a file of the driver; safe for several threads."""

    def __init__(self, path: str) -> None:
        self._path, self._lock = Path(path), threading.Lock()

    def log(self, event: str, **fields: Any) -> None:
        line = json.dumps({"time": datetime.now(timezone.utc).isoformat(), "event": event, **fields}, default=str, ensure_ascii=False)
        with self._lock, self._path.open("a", encoding="utf-8") as file:
            file.write(line + "\n")

    def traced(self, call: Callable) -> Callable:
        """``call`` with a line for each use: its name, arguments, milliseconds, and result or error."""

        @functools.wraps(call)
        def run(*args: Any, **kwargs: Any) -> Any:
            began = time.monotonic()
            outcome: dict[str, Any] = {}
            try:
                result = call(*args, **kwargs)
                outcome["result"] = result
                return result
            except Exception as error:
                outcome["error"] = str(error)
                raise
            finally:
                self.log("call", method=call.__name__, params={"args": args, **kwargs}, duration_ms=round((time.monotonic() - began) * 1000, 3), **outcome)

        return run
