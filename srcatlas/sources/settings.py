"""Settings of an installation and of a repository."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

#: Name of a repository's settings file, and of the section in it, unless told otherwise.
REPO_FILE, REPO_SECTION = ".index.yaml", "index"


@dataclass
class Settings:
    embedding_provider: str = "voyage"
    embedding_model: str = "voyage-4-large"
    log_level: str = "info"
    query_ttl_minutes: int = 10


@dataclass
class RepoSettings:
    name: str = ""
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    default_branch: str = ""
    modules: dict = field(default_factory=dict)


def _yaml(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def load_settings(path: str) -> Settings:
    """Defaults overlaid by the file; a missing file gives the defaults."""
    s = Settings()
    if os.path.exists(path):
        x = _yaml(path)
        s.embedding_provider = x.get("embedding", {}).get("provider", s.embedding_provider)
        s.embedding_model = x.get("embedding", {}).get("model", s.embedding_model)
        s.log_level = x.get("logging", {}).get("level", s.log_level)
        s.query_ttl_minutes = x.get("cache", {}).get("query_ttl_minutes", s.query_ttl_minutes)
    return s


def load_repo_settings(root: str, name: str = REPO_FILE, section: str = REPO_SECTION) -> RepoSettings:
    """Settings under a section of a repository's file; a missing file is an error."""
    x = _yaml(os.path.join(root, name)).get(section, {})
    return RepoSettings(x.get("name", ""), x.get("include", []), x.get("exclude", []), x.get("default_branch", ""), x.get("modules", {}))


def write_repo_settings(root: str, name: str, includes: list[str], file: str = REPO_FILE, section: str = REPO_SECTION) -> bool:
    """Write a first settings file; False where there is one already."""
    path = os.path.join(root, file)
    if os.path.exists(path):
        return False
    with open(path, "w") as f:
        f.write(f"{section}:\n  name: {name}\n  include:\n" + "".join(f'    - "{g}"\n' for g in includes) + "  exclude: []\n")
    return True
