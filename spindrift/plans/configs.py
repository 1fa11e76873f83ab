"""What the results of the first two stages depend on: the configurations whose hashes say whether a result may be reused."""

from __future__ import annotations

from ..settings import Settings

#: Language, chunk length in seconds and conversion of transcripts, fixed values.
LANGUAGE, CHUNK_SECONDS, CONVERSION = "zh", 600, "s2twp"


def download(settings: Settings, video_id: str) -> dict:
    """Of the audio: the recording and how it is cut and sped up."""
    return {"video_id": video_id} | {name: getattr(settings, name) for name in ("sample_rate", "remove_silence", "trim_head_sec", "trim_tail_sec", "speedup")}


def transcribe(settings: Settings, video_id: str, audio_hash: str | None) -> dict:
    """Of the transcript: the service, the language, the chunks, and the hash of what made the audio (None before it is made)."""
    model = settings.local_stt_model if settings.stt_provider == "local" else settings.stt_model
    return {"video_id": video_id, "stt_provider": settings.stt_provider, "stt_model": model, "language": LANGUAGE, "chunk_seconds": CHUNK_SECONDS, "opencc": CONVERSION, "s1_config_hash": audio_hash}
