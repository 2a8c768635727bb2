"""Optional configuration file of a project: ``.quarry/config.json``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from codequarry.sources.files import MAX_FILE_SIZE, ScanOptions

DEBOUNCE_MS = 500


@dataclass
class Config:
    languages: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    watchDebounceMs: int = 0  # noqa: N815  the file's own names
    maxFileSize: int = 0  # noqa: N815

    @property
    def debounce_ms(self) -> int:
        return self.watchDebounceMs if self.watchDebounceMs > 0 else DEBOUNCE_MS

    def options(self) -> ScanOptions:
        return ScanOptions(self.include, self.exclude, self.languages, self.maxFileSize if self.maxFileSize > 0 else MAX_FILE_SIZE)


def load(root: str) -> Config:
    """The project's configuration; a missing or malformed file gives the defaults, a value of the wrong type its own default."""
    try:
        raw = json.loads((Path(root) / ".quarry/config.json").read_text())
    except (OSError, ValueError):
        return Config()
    out = Config()
    for f in fields(Config):
        value = raw.get(f.name) if isinstance(raw, dict) else None
        if isinstance(value, type(getattr(out, f.name))) and not isinstance(value, bool):
            setattr(out, f.name, value)
    return out
