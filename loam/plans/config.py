"""Configuration: dataclasses with complete defaults; unknown keys are errors."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from typing import Any

from loam.operators.chunking import Config as Chunking
from loam.operators.enrich import Taxonomy, TagField, Thresholds
from loam.operators.retrieval import Classify, Gate, Route

MODES = {True: "on", False: "off", "on": "on", "off": "off", "shadow": "shadow"}


@dataclasses.dataclass(frozen=True)
class Retrieval:
    top_k: int = 30
    include_quarantined: bool = False
    expand_neighbours: bool = False
    expand_below_self_contained: float = 0.5
    expand_max_tokens: int = 1200
    route: Route = Route()
    classify: Classify = Classify()
    gate: Gate = Gate()


@dataclasses.dataclass(frozen=True)
class Config:
    store: str = "collections"
    embedder: str = "hash:256"
    metric: str = "cosine"
    chunking: Chunking = Chunking()
    enrich: Thresholds = Thresholds()
    taxonomy: Taxonomy = Taxonomy()
    retrieve: Retrieval = Retrieval()


def build(kind: type, values: dict[str, Any] | None, where: str = "config") -> Any:
    """A dataclass from a dictionary, nested ones too."""
    values = dict(values or {})
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(values) - set(fields):
        raise ValueError(f"unknown keys in {where}: {sorted(unknown)}")
    out = {}
    for name, value in values.items():
        default = fields[name].default
        if name in ("mode", "screen_paragraphs"):
            if value not in MODES:
                raise ValueError(f"{where}.{name} is on, shadow or off")
            value = MODES[value]
        elif kind is Taxonomy and name == "fields":
            value = tuple(TagField(f["name"], tuple(f["options"]), bool(f.get("route", False))) for f in value)
        elif dataclasses.is_dataclass(default):
            value = build(type(default), value, f"{where}.{name}")
        out[name] = value
    return kind(**out)


def load(path: str | None) -> Config:
    """A YAML or JSON file; YAML needs the optional package."""
    if path is None:
        return Config()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return build(Config, json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs the optional package pyyaml; JSON does not") from e
    return build(Config, yaml.safe_load(text))


_ASSIGNMENT = re.compile(r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", re.A)
_QUOTED_VALUE = re.compile(r"'([^']*)'|\"((?:[^\"\\]|\\.)*)\"")
# What a backslash and a letter mean inside double quotes.
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def parse_env(text: str) -> dict[str, str]:
    """``NAME=value`` lines; quotes are taken off, escapes read inside double ones, comments behind values dropped. A bad line is an error."""
    out = {}
    for number, line in enumerate(text.removeprefix("\ufeff").splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        found = _ASSIGNMENT.match(line)
        if not found:
            raise ValueError(f"line {number} is no NAME=value")
        name, value = found.groups()
        if quoted := _QUOTED_VALUE.match(value):
            single, double = quoted.groups()
            value = single if double is None else re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[0]), double)
        else:
            value = re.sub(r"(?:^|\s+)#.*$", "", value).strip()
        out[name] = value
    return out


def load_env(path: str = ".env", override: bool = False) -> list[str]:
    """Set variables of a file that are not set yet, or all of them; empty values are left out. The names that were set."""
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8") as f:
        found = {n: v for n, v in parse_env(f.read()).items() if v and (override or not os.environ.get(n))}
    os.environ.update(found)
    return list(found)
