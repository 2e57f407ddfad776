"""Settings of a run, from ANNOT_* environment variables, checked when made."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_tokens: int = 256
    chunk_overlap: float = 0.15
    min_chunk_chars: int = 40
    dedup_threshold: float = 0.8
    minhash_permutations: int = 128
    backend: str = "rule"
    prompt_version: str = "v1"
    psi_alert: float = 0.25
    psi_warn: float = 0.10
    chi2_alpha: float = 0.05
    seed: int = 20261008
    batch_dir: str = "batches"
    runs_dir: str = "runs"
    cache_dir: str = "api_cache"

    def __post_init__(self) -> None:
        rules = {
            "chunk_tokens": self.chunk_tokens >= 16,
            "chunk_overlap": 0 <= self.chunk_overlap < 0.9,
            "min_chunk_chars": self.min_chunk_chars >= 1,
            "dedup_threshold": 0 < self.dedup_threshold < 1,
            "minhash_permutations": self.minhash_permutations >= 32,
            "backend": self.backend in ("rule", "gemini"),
            "psi_alert": self.psi_alert > 0,
            "psi_warn": 0 < self.psi_warn <= self.psi_alert,
            "chi2_alpha": 0 < self.chi2_alpha < 1,
        }
        if bad := [f"{k}={getattr(self, k)!r}" for k, ok in rules.items() if not ok]:
            raise ValueError("settings out of range: " + ", ".join(bad))

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {f.name: env[key] for f in fields(cls) if (key := f"ANNOT_{f.name.upper()}") in env}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        try:
            return cls(**{k: kinds[k](v) for k, v in given.items()})
        except ValueError as e:
            raise ValueError(f"settings from the environment: {e}") from e
