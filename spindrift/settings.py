"""Settings of the pipeline with their defaults; an environment variable SPINDRIFT_NAME or an argument overrides one."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    stt_provider: str = "openai"
    stt_model: str = "gpt-4o-mini-transcribe"
    local_stt_model: str = "small"
    llm_cheap_model: str = "gpt-5-mini"
    llm_strong_model: str = "gpt-5"
    hook_threshold: int = 3
    overlap_ngram: int = 6
    overlap_max: float = 0.15
    overlap_max_shared: int = 12
    tts_provider: str = "edge"
    tts_model: str = "gpt-4o-mini-tts"
    ai_video: str = "none"
    ai_shot_seconds: float = 5.0
    ai_shots_per_clip: int = 2
    ai_shot_width: int = 576
    ai_shot_height: int = 1024
    ai_shot_fps: int = 24
    footage: str = "none"
    footage_max_seconds: float = 8.0
    max_budget_usd: float = 1.0
    max_clips: int = 3
    remove_silence: bool = True
    trim_head_sec: float = 0.0
    trim_tail_sec: float = 0.0
    speedup: float = 1.0
    sample_rate: int = 16_000

    @classmethod
    def read(cls, environ: dict[str, str] | None = None, **given) -> Settings:
        environ = dict(os.environ) if environ is None else environ
        for f in fields(cls):
            raw = environ.get(f"SPINDRIFT_{f.name.upper()}")
            if raw is not None and f.name not in given:
                kind = type(f.default)
                given[f.name] = raw.strip().lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return cls(**given)

    def speech_model(self) -> tuple[str, str]:
        """Provider and model that speech is billed by."""
        return ("openai", self.tts_model) if self.tts_provider == "openai" else ("edge", "edge-tts")
