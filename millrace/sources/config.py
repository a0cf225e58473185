"""Settings as a value that is passed on; nothing is read when modules are imported."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

MODES = ("offline", "api")
ON_ERROR = ("fail", "fallback")


@dataclass(frozen=True)
class Settings:
    """``mode`` says where vectors come from; the URLs and models are those of the HTTP providers."""

    mode: str = "offline"
    api_key: str | None = None
    on_error: str = "fail"
    embedding_url: str = ""
    embedding_model: str = ""
    chat_url: str = ""
    chat_model: str = ""

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if self.on_error not in ON_ERROR:
            raise ValueError(f"on_error must be one of {', '.join(ON_ERROR)}")

    @classmethod
    def from_environment(cls, names: Mapping[str, str] | None = None) -> Settings:
        """Settings from environment variables; ``names`` says which holds which field."""
        usual = {field: f"MILLRACE_{field.upper()}" for field in cls.__dataclass_fields__}
        found = {field: os.environ[name] for field, name in (names or usual).items() if name in os.environ}
        return cls(**found)

    def key(self) -> str:
        if not self.api_key:
            raise ValueError("an API key is needed")
        return self.api_key
