"""Index configuration, read from TOML; each missing key has its default."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from ..errors import ConfigError
from ..functions.analysis import STOP_WORDS, Analyzer


@dataclass(frozen=True)
class Config:
    #: Bytes of a document file after which another one is begun.
    segment_size: int = 52_428_800
    #: Buffered documents are written beyond so many characters, or seconds.
    documents_buffer_size: int = 1_048_576
    documents_save_after_seconds: int = 5
    #: merge() rewrites batches of which at least this share is deleted.
    merge_deleted_ratio: float = 0.3
    #: Accepted for compatibility; Parquet batches need no such policy.
    metadata_save_after_operations: int = 100_000
    metadata_save_after_seconds: int = 10
    index_buffer_size: int = 1_048_576
    index_save_after_operations: int = 100_000
    index_save_after_seconds: int = 5
    #: A given list replaces the default one.
    stop_words: frozenset[str] = STOP_WORDS
    #: Whether words are stemmed.
    stem: bool = True

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        if path is None:
            return cls()
        try:
            with open(path, "rb") as file:
                given = tomllib.load(file)
        except (OSError, tomllib.TOMLDecodeError) as error:
            raise ConfigError(f"{path}: {error}") from error
        kinds = {"merge_deleted_ratio": (int, float), "stop_words": list, "stem": bool}
        known = {f.name for f in fields(cls)}
        values = {}
        for key, value in given.items():
            if key not in known:
                continue
            if not isinstance(value, kinds.get(key, int)) or isinstance(value, bool) != (key == "stem"):
                raise ConfigError(f"{path}: {key} has the wrong type")
            values[key] = frozenset(map(str, value)) if key == "stop_words" else value
        return cls(**values)

    def analyzer(self) -> Analyzer:
        return Analyzer(self.stop_words, self.stem)
