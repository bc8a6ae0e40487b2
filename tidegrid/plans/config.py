"""Codec settings: built-in defaults, then the user's file, then arguments."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class CodecConfig:
    """Settings of the codec. ``cached`` persists decoded signals; the rest describes chunks."""

    algorithm: str = "zlib"
    chunk_duration: float = 1.0
    chunk_order: str = "F"
    comp_level: int = -1
    do_time_diff: bool = True
    do_spatial_diff: bool = False
    check_after_compress: bool = True
    check_after_decompress: bool = True
    cached: bool = False
    sample_rate: float | None = None
    n_channels: int | None = None
    dtype: str | None = None

    def __post_init__(self):
        if self.algorithm != "zlib":
            raise ValueError(f"unknown algorithm {self.algorithm!r}; only zlib is known")
        if self.chunk_order not in ("C", "F"):
            raise ValueError("chunk_order is C or F")
        if not -1 <= self.comp_level <= 9:
            raise ValueError("comp_level is between -1 and 9")

    @staticmethod
    def path() -> Path:
        """The user's file; the environment variable TIDEGRID_CONFIG names another."""
        return Path(os.environ.get("TIDEGRID_CONFIG", Path.home() / ".tidegrid.json"))

    @classmethod
    def stored(cls) -> dict:
        return json.loads(cls.path().read_text()) if cls.path().exists() else {}

    @classmethod
    def resolve(cls, **given) -> CodecConfig:
        """Arguments that aren't None override the user's file, which overrides the defaults."""
        known = {f.name for f in fields(cls)}
        given = {k: v for k, v in given.items() if v is not None}
        if unknown := given.keys() - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(cls(), **{k: v for k, v in cls.stored().items() if k in known and v is not None} | given)

    @classmethod
    def store(cls, **given) -> None:
        """Make the given settings the user's defaults; others of the file stay."""
        merged = cls.stored() | {k: v for k, v in given.items() if v is not None}
        cls.resolve(**merged)  # rejects what is not valid
        cls.path().write_text(json.dumps(merged, indent=2, sort_keys=True))

    def to_dict(self) -> dict:
        return asdict(self)
