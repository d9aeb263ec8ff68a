"""Settings and the state marker, as TOML files of a repository."""

from __future__ import annotations

import os
import tempfile
import tomllib
from dataclasses import dataclass, field

PLACES = ("spanforge.toml", ".spanforge/config.toml")
MARKER = "spanforge-state.toml"


@dataclass
class Config:
    provider: str = "voyage"
    model: str = "voyage-context-3"
    dimensions: int = 256
    base_url: str = ""
    api_key_env: str = ""
    ext_overrides: dict[str, str] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    max_reindex_cost: float = 5.0


def load(root: str) -> Config:
    """The first settings file there is over the defaults; unknown keys are ignored."""
    out = Config()
    for place in PLACES:
        path = os.path.join(root, place)
        if os.path.exists(path):
            with open(path, "rb") as f:
                given = tomllib.load(f)
            e = given.get("embedding", {})
            for name, key in (("provider", "provider"), ("model", "model"), ("dimensions", "dimensions"), ("base_url", "baseurl"), ("api_key_env", "apikeyenv")):
                setattr(out, name, e.get(key, getattr(out, name)))
            for name, key in (("ext_overrides", "extOverrides"), ("exclude", "exclude"), ("max_reindex_cost", "maxReindexCost")):
                setattr(out, name, given.get(key, getattr(out, name)))
            break
    return out


def read_marker(root: str) -> dict | None:
    path = os.path.join(root, MARKER)
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        return tomllib.load(f)


def write_marker(root: str, commit: str, files: int, chunks: int) -> None:
    """Written last, in one rename."""
    fd, temp = tempfile.mkstemp(dir=root, prefix=".marker")
    with os.fdopen(fd, "w") as f:
        f.write(f'commit = "{commit}"\nfile_count = {files}\nchunk_count = {chunks}\n')
    os.replace(temp, os.path.join(root, MARKER))
