"""Configuration: frozen records and the guards that read them."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass, field
from pathlib import Path


class SettingsError(ValueError):
    """A setting is missing or out of range."""


class WriteRefused(RuntimeError):
    """A write gate is closed."""


@dataclass(frozen=True)
class Profile:
    """How a document class is cut: sizes in tokens, and the unit that is never crossed."""

    target: int
    overlap: int
    most: int | None = None
    unit: str = "whole"
    least: int = 0

    @property
    def ceiling(self) -> int:
        return self.most if self.most is not None else self.target + self.overlap


# Sizes of the chunk profiles.
PROFILES = {
    "reference": Profile(512, 64),
    "transcript": Profile(384, 48, unit="turn"),
    "approved_example": Profile(256, 0, 512, unit="heading"),
    "glossary": Profile(512, 0, 768, unit="heading"),
    "pronunciation": Profile(256, 0, unit="blank"),
}
SAFE_TARGET, HARD_MAX = 1024, 2048


@dataclass(frozen=True)
class Retrieval:
    # Fan-in, fusion and policy constants.
    dense_k: int = 24
    lexical_k: int = 24
    rrf_k: int = 60
    final_k: int = 5
    per_document: int = 3
    neighbors: int = 1
    token_budget: int = 2048
    similarity_floor: float | None = None
    excluded_types: tuple[str, ...] = ("negative_pattern",)
    demoted_types: tuple[str, ...] = ("evaluation_case",)
    most_query_chars: int = 2000
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class Settings:
    root: Path = Path("corpus")
    collections: tuple[str, ...] = ("chunks", "feedback")
    dimension: int = 768
    tokenizer: str = "surrogate_v1"
    embedding_model: str = "external"
    writes_enabled: bool = False
    write_switch: str = "LOOMTEXT_ALLOW_WRITES"
    disk_floor_gb: float = 20.0
    retrieval: Retrieval = field(default_factory=Retrieval)

    def __post_init__(self) -> None:
        if self.dimension <= 0:
            raise SettingsError("the dimension must be positive")
        if self.retrieval.rrf_k <= 0:
            raise SettingsError("rrf_k must be positive")
        if not self.collections:
            raise SettingsError("no collection is allowed")


REQUIRED = ("root", "collections", "dimension")


def load(values: dict) -> Settings:
    """Settings from a mapping; missing or unknown keys are errors."""
    if missing := [k for k in REQUIRED if k not in values]:
        raise SettingsError(f"missing settings: {', '.join(missing)}")
    known = Settings.__dataclass_fields__
    if unknown := [k for k in values if k not in known]:
        raise SettingsError(f"unknown settings: {', '.join(unknown)}")
    made = dict(values, root=Path(values["root"]), collections=tuple(values["collections"]))
    if isinstance(made.get("retrieval"), dict):
        made["retrieval"] = Retrieval(**made["retrieval"])
    return Settings(**made)


def inside(root: Path, path: Path) -> Path:
    """The resolved path, which must lie under ``root``."""
    full, base = (root / path).resolve(), root.resolve()
    if full != base and base not in full.parents:
        raise SettingsError(f"{path} is outside {root}")
    return full


def allowed_collection(settings: Settings, name: str) -> str:
    if name not in settings.collections:
        raise SettingsError(f"collection {name!r} is not allowed")
    return name


def check_write(settings: Settings, confirm: bool = True, free_gb: float | None = None) -> None:
    """Writes need a confirmation, the setting or the environment switch, and free disk above the floor."""
    if not confirm:
        raise WriteRefused("CONFIRMATION_REQUIRED")
    if not (settings.writes_enabled or os.environ.get(settings.write_switch) == "1"):
        raise WriteRefused("WRITES_DISABLED")
    free = shutil.disk_usage("/").free / 1e9 if free_gb is None else free_gb
    if free < settings.disk_floor_gb:
        raise WriteRefused("DISK_FLOOR")
