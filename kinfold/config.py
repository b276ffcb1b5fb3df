"""Settings in layers: defaults, environment, a JSON file, then arguments."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from .operators.embed import WEIGHTS
from .sources.files import EXCLUDE, INCLUDE, STYLE_EXTENSIONS

FILE = "kinfold.json"


@dataclass(frozen=True)
class Config:
    root: str = "."
    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = EXCLUDE
    style_extensions: tuple[str, ...] = STYLE_EXTENSIONS
    compare: tuple[str, ...] = ()
    ignore_names: tuple[str, ...] = ()
    ignore_usages: tuple[str, ...] = ()
    disabled_labels: tuple[str, ...] = ()
    threshold: float = 0.85
    high_threshold: float = 0.9
    max_threshold: float = 1.0
    limit: int | None = None
    min_path_distance: int = 0
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    model: str = "mock"
    model_path: str = ""
    model_repo: str = ""
    auto_download_model: bool = False
    progress: bool = True
    remote: dict = field(default_factory=dict)
    language: str = "en"
    allow_ignores: bool = True
    relative_paths: bool = False
    out: str = ""
    cache: str = ""


#: Lists that layers add to; others replace.
ADDED = {"exclude", "compare", "ignore_names", "ignore_usages", "disabled_labels"}
#: Mappings that layers merge by key.
MERGED = {"weights", "remote"}


def read_file(path: str) -> dict:
    """The settings in a JSON file; none if it is missing, an error if it isn't valid or has unknown names."""
    if not Path(path).exists():
        return {}
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is not valid JSON: {e}") from None
    unknown = set(found) - {f.name for f in dataclasses.fields(Config)}
    if unknown:
        raise ValueError(f"{path} has unknown settings: {sorted(unknown)}")
    return {k: v for k, v in found.items() if v is not None}


def from_environment(env: dict | None = None) -> dict:
    env = os.environ if env is None else env
    out: dict = {}
    for name, key in (("MODEL", "model"), ("MODEL_PATH", "model_path"), ("MODEL_REPO", "model_repo")):
        if env.get(name):
            out[key] = env[name]
    for name, key in (("AUTO_DOWNLOAD_MODEL", "auto_download_model"), ("PROGRESS", "progress")):
        if env.get(name):
            out[key] = env[name].strip().lower() in ("1", "true", "yes", "on")
    remote = {k: env[n] for n, k in (("API_URL", "url"), ("API_KEY", "key"), ("API_MODEL", "model")) if env.get(n)}
    if env.get("API_TIMEOUT"):
        remote["timeout"] = float(env["API_TIMEOUT"])
    return out | ({"remote": remote} if remote else {})


def layered(*layers: dict) -> Config:
    values: dict = {f.name: getattr(Config(), f.name) for f in dataclasses.fields(Config)}
    for layer in layers:
        for k, v in layer.items():
            if v is None:
                continue
            if k in ADDED:
                v = tuple(dict.fromkeys([*values[k], *v]))
            elif k in MERGED:
                v = {**values[k], **v}
            elif isinstance(v, list):
                v = tuple(v)
            values[k] = v
    return Config(**values)


def load(root: str = ".", arguments: dict | None = None, path: str | None = None, env: dict | None = None) -> Config:
    return layered(from_environment(env), read_file(path or os.path.join(root, FILE)), {"root": root}, arguments or {})


def save(config: Config, path: str) -> None:
    """Writes what differs from the defaults, without empty values, by a file beside it that takes its place."""
    base = Config()
    own = {f.name: getattr(config, f.name) for f in dataclasses.fields(Config) if getattr(config, f.name) != getattr(base, f.name)}
    for k in ADDED & set(own):
        own[k] = [v for v in own[k] if v not in getattr(base, k)]
    write_text(path, json.dumps({k: v for k, v in own.items() if v not in (None, "", [], {})}, indent=2))


def write_text(path: str, text: str) -> None:
    beside = f"{path}.{os.getpid()}"
    try:
        Path(beside).write_text(text, encoding="utf-8")
        os.replace(beside, path)
    finally:
        Path(beside).unlink(missing_ok=True)
