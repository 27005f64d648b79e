"""Configuration: model instances, parallel renders and the recognition time limit."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

# Defaults of the configuration file.
FILE_NAME = "ollama.json"
DEFAULT_URL = "http://localhost:11434"
DEFAULT_MODEL = "qwen2.5vl:7b"
DEFAULT_TIMEOUT = 600


class ConfigError(ValueError):
    """The configuration file cannot be used."""


@dataclass(frozen=True)
class Instance:
    url: str = DEFAULT_URL
    model: str = DEFAULT_MODEL


@dataclass(frozen=True)
class Config:
    instances: tuple[Instance, ...] = (Instance(),)
    render_workers: int = field(default_factory=lambda: os.cpu_count() or 1)
    timeout: int = DEFAULT_TIMEOUT


def parse_config(data: object) -> Config:
    """Check a parsed file: known instances, positive numbers; workers are capped at the number of cores."""
    if not isinstance(data, dict):
        raise ConfigError("the configuration is not an object")
    listed = data.get("instances")
    if not isinstance(listed, list) or not listed:
        raise ConfigError("'instances' must be a non-empty list")
    instances = []
    for entry in listed:
        if not isinstance(entry, dict) or not isinstance(entry.get("url"), str) or not entry["url"]:
            raise ConfigError("each instance needs a 'url'")
        instances.append(Instance(entry["url"], entry.get("model", DEFAULT_MODEL)))
    cores = os.cpu_count() or 1
    numbers = {}
    for key, default in (("max_render_workers", cores), ("ocr_timeout", DEFAULT_TIMEOUT)):
        value = data.get(key)
        try:
            numbers[key] = default if value is None else int(value)
        except (TypeError, ValueError) as error:
            raise ConfigError(f"'{key}' must be a positive integer") from error
        if numbers[key] < 1:
            raise ConfigError(f"'{key}' must be a positive integer")
    return Config(tuple(instances), min(numbers["max_render_workers"], cores), numbers["ocr_timeout"])


def load_config(*folders: Path) -> Config:
    """The first configuration file found in the folders, else the defaults."""
    for folder in folders:
        path = Path(folder) / FILE_NAME
        if path.is_file():
            try:
                return parse_config(json.loads(path.read_text(encoding="utf-8")))
            except json.JSONDecodeError as error:
                raise ConfigError(f"{path}: {error}") from error
    return Config()


def parse_page_spec(spec: str) -> set[int]:
    """Page numbers of a list like ``3,5,7-9``; ValueError if any part is empty, not a number, below 1 or descending."""
    pages: set[int] = set()
    for part in spec.split(","):
        low, dash, high = (x.strip() for x in part.strip().partition("-"))
        if not low.isdecimal() or dash and not high.isdecimal():
            raise ValueError(f"not a page or range: {part.strip()!r}")
        first, last = int(low), int(high or low)
        if first < 1 or last < first:
            raise ValueError(f"not a page or range: {part.strip()!r}")
        pages.update(range(first, last + 1))
    return pages
