"""Reports beside an index: architecture.md, summary.md, status.json."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path

from codequarry.operators.store import Store
from codequarry.plans import api


def _replace(path: Path, text: str) -> None:
    """Write beside the target, then rename: a reader sees the old text or the new one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    temp = path.with_name(f".{path.name}.{os.getpid()}")
    temp.write_text(text)
    os.replace(temp, path)


def write_all(store: Store, folder: str) -> None:
    _replace(Path(folder) / "architecture.md", api.get_architecture(store))
    _replace(Path(folder) / "summary.md", api.get_summary(store))
    write_status(store, folder)


def write_status(store: Store, folder: str) -> None:
    status = api.get_status(store) | {"written": datetime.now(UTC).isoformat(timespec="seconds")}
    _replace(Path(folder) / "status.json", json.dumps(status, indent=2, default=str))


def read(folder: str, name: str) -> str | None:
    path = Path(folder) / name
    return path.read_text() if path.is_file() else None
