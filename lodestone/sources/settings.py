"""Paths of an installation, kept as JSON; keys that aren't known are left out."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass
class Settings:
    crawl_data: str = "data/crawl"
    index: str = "data/index"
    models: str = "data/models"
    logs: str = "data/logs"

    @classmethod
    def load(cls, path: str) -> Settings:
        if not Path(path).exists():
            return cls()
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(Path(path).read_text()).items() if k in known})

    def save(self, path: str) -> None:
        """Written beside the file and moved over it."""
        draft = Path(f"{path}.tmp")
        draft.write_text(json.dumps(asdict(self), indent=2))
        os.replace(draft, path)

    def set(self, key: str, value: str) -> None:
        if key not in {f.name for f in fields(self)}:
            raise KeyError(key)
        setattr(self, key, value)
