"""Settings of a run and their bounds."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Lower and upper bound of each number, None where there is none.
BOUNDS = {
    "gpu_layers": (-1, None),
    "timeout_seconds": (1, 600),
    "max_output_tokens": (256, 5000),
    "dimensions": (384, 384),
}


@dataclass(frozen=True)
class Settings:
    """Checked when made: numbers out of their bounds are named, all at once."""

    gpu_layers: int = -1
    timeout_seconds: float = 180
    max_output_tokens: int = 3000
    dimensions: int = 384
    embedding_model: str = ""
    reranker_model: str = ""

    def __post_init__(self) -> None:
        wrong = [n for n, (low, high) in BOUNDS.items() if getattr(self, n) < low or (high is not None and getattr(self, n) > high)]
        if wrong:
            raise ValueError(f"out of bounds: {', '.join(wrong)}")


def settings(values: Mapping[str, str]) -> Settings:
    """Settings from texts (an environment, a configuration); other names are left alone, bad numbers are errors."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    return Settings(**{n: kinds[n](v) for n, v in values.items() if n in kinds})
