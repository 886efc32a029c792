"""Engine settings, with defaults that environment variables of the same upper-case name, or a file of them, override."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConf:
    similarity_threshold: float = 0.75
    min_segment_seconds: float = 30.0
    max_segment_seconds: float = 1200.0
    smoothing_window: int = 3
    max_words: int = 50
    pause_seconds: float = 1.0
    excerpt_chars: int = 500
    verify_batch: int = 10
    top_k: int = 10
    max_depth: int = 10
    attempts: int = 3

    @classmethod
    def from_env(cls, env=os.environ) -> EngineConf:
        kinds = {"int": int, "float": float}
        return cls(**{f.name: kinds[f.type](env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env})

    @classmethod
    def from_file(cls, path: str, env=os.environ) -> EngineConf:
        """Lines NAME=value; what the environment has counts more, other names, blank lines and # comments nothing."""
        with open(path, encoding="utf-8") as f:
            lines = [line.strip() for line in f]
        told = dict(line.split("=", 1) for line in lines if "=" in line and not line.startswith("#"))
        return cls.from_env({k.strip().upper(): v.strip().strip("'\"") for k, v in told.items()} | dict(env))
