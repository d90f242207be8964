"""What a model is to the operators: a factory, called once a task, of an object with one method. Deterministic ones for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import numpy as np


class Engine(Protocol):
    """Speech to text: segments (text, start_ms, end_ms, words) of a clip, words being (text, start_ms, end_ms)."""

    def transcribe(self, samples: np.ndarray, rate: int) -> list[tuple[str, int, int, list[tuple[str, int, int]]]]: ...


class Diarizer(Protocol):
    """The speaker of a clip; None if it cannot tell."""

    def identify(self, samples: np.ndarray, rate: int) -> int | None: ...


class Denoiser(Protocol):
    """Samples without noise, as many as came in."""

    def denoise(self, samples: np.ndarray, rate: int) -> np.ndarray: ...


class Embedder(Protocol):
    """Vectors of ``dim`` numbers: of passages to be found, and of queries."""

    dim: int

    def passages(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...


class Canned:
    """Gives its results in order, one a call, then none; counts its calls."""

    def __init__(self, results: Iterable[list[tuple]]):
        self.results, self.calls = list(results), 0

    def transcribe(self, samples: np.ndarray, rate: int) -> list[tuple]:
        self.calls += 1
        return self.results[self.calls - 1] if self.calls <= len(self.results) else []


class Measured:
    """Says how long a clip is, so that a result does not depend on which task a clip falls to."""

    def transcribe(self, samples: np.ndarray, rate: int) -> list[tuple]:
        ms = len(samples) * 1000 // rate
        return [(f" {ms} ms", 0, ms, [(" " + str(ms), 0, ms // 2), (" ms", ms // 2, ms)])] if ms else []


class OneSpeaker:
    """Takes all clips for the same speaker."""

    def identify(self, samples: np.ndarray, rate: int) -> int | None:
        return 0


class Unchanged:
    """Leaves samples as they are; counts them."""

    def __init__(self) -> None:
        self.samples = self.calls = 0

    def denoise(self, samples: np.ndarray, rate: int) -> np.ndarray:
        self.samples, self.calls = self.samples + len(samples), self.calls + 1
        return samples


Factory = Callable[[], Engine]
