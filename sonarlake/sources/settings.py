"""Options with defaults, and a plugin's parameter as stored state."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path


@dataclass(frozen=True)
class Options:
    """What a run may be told; a missing file or key leaves the default."""

    folder: str = "."
    output: str = "report.html"
    seconds: float = 5.0
    rate: int = 44_100
    silence: float = 100.0
    tokens: int = 100

    @classmethod
    def read(cls, path: str) -> Options:
        file = Path(path)
        given = json.loads(file.read_text()) if file.exists() else {}
        return cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__})


@dataclass(frozen=True)
class Gain:
    """A level between 0 and 1, kept as tagged JSON."""

    level: float = 0.5

    def save(self) -> bytes:
        return json.dumps({"tag": "gain", **asdict(self)}).encode()

    @classmethod
    def load(cls, raw: bytes) -> Gain:
        """The stored level, or the default if the state is another's."""
        try:
            state = json.loads(raw)
        except ValueError:
            return cls()
        if not isinstance(state, dict) or state.get("tag") != "gain":
            return cls()
        return cls(min(1.0, max(0.0, float(state.get("level", 0.5)))))


def timed(model: Callable[[str], str]) -> Callable[[str], tuple[str, float]]:
    """A model that also says how many seconds it took."""

    def run(prompt: str) -> tuple[str, float]:
        began = time.perf_counter()
        return model(prompt), time.perf_counter() - began

    return run
