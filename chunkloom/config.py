"""Settings: defaults, overridden by a .env file, overridden by the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    #: Names and defaults.
    chunk_size: int = 512
    chunk_overlap: int = 50
    top_k: int = 4
    max_upload_size: int = 10_485_760
    upload_dir: str = "./data/uploads"
    vector_store_dir: str = "./data/chroma"

    @classmethod
    def load(cls, env_file: Mapping[str, str | None] | None = None, environment: Mapping[str, str] | None = None, prefix: str = "") -> Settings:
        """Names are matched whatever their case; empty values of the file count as absent; no key is required."""
        merged = merge_settings(env_file or {}, os.environ if environment is None else environment, prefix)
        known = {f.name: type(f.default) for f in fields(cls)}
        return replace(cls(), **{k: known[k](v) for k, v in merged.items() if k in known})


def merge_settings(env_file: Mapping[str, str | None], environment: Mapping[str, str], prefix: str = "") -> dict[str, str]:
    """Names with the prefix, without it and in lower case; the environment wins over non-empty file values."""
    out: dict[str, str] = {}
    for source in (env_file, environment):
        for name, value in source.items():
            if value and name.lower().startswith(prefix.lower()):
                out[name[len(prefix) :].lower()] = value
    return out
