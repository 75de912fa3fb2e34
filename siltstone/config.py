"""Configuration of a compaction: frozen dataclasses, validated when they are made from a mapping."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

DEPRECATED = {"": {"mergeTiers"}, "preprocessing": {"headMiddleTail"}}


class ConfigError(ValueError):
    """What is wrong with a configuration, with its path."""


def _known(value, names: set[str], path: str) -> dict:
    if not isinstance(value, Mapping):
        raise ConfigError(f"{path or 'config'}: an object is expected")
    if unknown := set(value) - names - DEPRECATED.get(path, set()):
        raise ConfigError(f"{path or 'config'}: unknown keys {sorted(unknown)}")
    return dict(value)


def _number(value, path: str, low: float, high: float = math.inf, *, whole: bool = False, above: bool = False, below: bool = False):
    sound = isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) and (not whole or value == int(value))
    if not sound or value < low or value > high or (above and value == low) or (below and value == high):
        raise ConfigError(f"{path}: out of range")
    return int(value) if whole else float(value)


def _flag(value, path: str) -> bool:
    if not isinstance(value, bool):
        raise ConfigError(f"{path}: true or false is expected")
    return value


def _name(value, path: str, empty: bool = False) -> str:
    if not isinstance(value, str) or not (value or empty):
        raise ConfigError(f"{path}: a string is expected")
    return value


@dataclass(frozen=True)
class Model:
    provider: str
    model: str
    max_concurrent: int = 1
    cooldown_hours: float = 1.0

    @property
    def key(self) -> str:
        return f"{self.provider}/{self.model}"


@dataclass(frozen=True)
class Tier:
    name: str
    models: tuple[Model, ...]


@dataclass(frozen=True)
class Preprocessing:
    dedup: bool = True
    purge_errors: bool = True
    skeleton: bool = False
    skeleton_depth: int = 2
    log_mode: str = "balanced"
    log_lines: int = 200


@dataclass(frozen=True)
class RunRecord:
    enabled: bool = False
    max_entries: int = 200
    snapshot_chars: int = 0
    path: str = ""


@dataclass(frozen=True)
class Config:
    tiers: tuple[Tier, ...]
    chunk_ratio: float = 0.8
    chunk_overlap_ratio: float = 0.1
    merge_max_context_tokens: int = 128_000
    fallback_to_session_model: bool = True
    chunk_prompt_suffix: str = ""
    merge_prompt_suffix: str = ""
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    run_record: RunRecord = field(default_factory=RunRecord)
    deprecated: tuple[str, ...] = ()


def _tiers(value) -> tuple[Tier, ...]:
    if not isinstance(value, list) or not value:
        raise ConfigError("tiers: one at least is needed")
    out, names, keys = [], set(), set()
    for i, t in enumerate(value):
        t = _known(t, {"name", "models"}, f"tiers[{i}]")
        name = _name(t.get("name"), f"tiers[{i}].name")
        if name in names:
            raise ConfigError(f"tiers: name {name} occurs twice")
        names.add(name)
        models = []
        if not isinstance(t.get("models"), list) or not t["models"]:
            raise ConfigError(f"tiers[{i}].models: one at least is needed")
        for j, m in enumerate(t["models"]):
            at = f"tiers[{i}].models[{j}]"
            m = _known(m, {"provider", "model", "maxConcurrent", "cooldownHours"}, at)
            made = Model(_name(m.get("provider"), at), _name(m.get("model"), at), _number(m.get("maxConcurrent", 1), at, 1, whole=True), _number(m.get("cooldownHours", 1), at, 0, above=True))
            if made.key in keys:
                raise ConfigError(f"tiers: route {made.key} occurs twice")
            keys.add(made.key)
            models.append(made)
        out.append(Tier(name, tuple(models)))
    return tuple(out)


def load(value: Mapping) -> Config:
    """A configuration from its mapping; ConfigError tells the first thing that is wrong."""
    names = {"tiers", "chunkRatio", "chunkOverlapRatio", "mergeMaxContextTokens", "fallbackToSessionModel", "chunkPromptSuffix", "mergePromptSuffix", "preprocessing", "runRecord"}
    v = _known(value, names, "")
    p = _known(v.get("preprocessing", {}), {"dedup", "purgeErrors", "astSkeleton", "logCondense"}, "preprocessing")
    a = _known(p.get("astSkeleton", {}), {"enabled", "maxDepth"}, "preprocessing.astSkeleton")
    log = _known(p.get("logCondense", {}), {"mode", "maxLines"}, "preprocessing.logCondense")
    r = _known(v.get("runRecord", {}), {"enabled", "maxEntries", "snapshotChars", "path"}, "runRecord")
    if log.get("mode", "balanced") not in ("balanced", "head", "tail"):
        raise ConfigError("preprocessing.logCondense.mode: balanced, head or tail")
    old = tuple(sorted((set(v) & DEPRECATED[""]) | {f"preprocessing.{k}" for k in set(p) & DEPRECATED["preprocessing"]}))
    return Config(
        _tiers(v.get("tiers")),
        _number(v.get("chunkRatio", 0.8), "chunkRatio", 0, 1, above=True),
        _number(v.get("chunkOverlapRatio", 0.1), "chunkOverlapRatio", 0, 1, below=True),
        _number(v.get("mergeMaxContextTokens", 128_000), "mergeMaxContextTokens", 1, whole=True),
        _flag(v.get("fallbackToSessionModel", True), "fallbackToSessionModel"),
        _name(v.get("chunkPromptSuffix", ""), "chunkPromptSuffix", True),
        _name(v.get("mergePromptSuffix", ""), "mergePromptSuffix", True),
        Preprocessing(_flag(p.get("dedup", True), "preprocessing.dedup"), _flag(p.get("purgeErrors", True), "preprocessing.purgeErrors"), _flag(a.get("enabled", False), "preprocessing.astSkeleton.enabled"), _number(a.get("maxDepth", 2), "preprocessing.astSkeleton.maxDepth", 0, whole=True), log.get("mode", "balanced"), _number(log.get("maxLines", 200), "preprocessing.logCondense.maxLines", 0, whole=True)),
        RunRecord(_flag(r.get("enabled", False), "runRecord.enabled"), _number(r.get("maxEntries", 200), "runRecord.maxEntries", 1, whole=True), _number(r.get("snapshotChars", 0), "runRecord.snapshotChars", 0, whole=True), _name(r.get("path", ""), "runRecord.path", True)),
        old,
    )


class Conflict(RuntimeError):
    """Somebody else has written the configuration since it was read."""


def revision(value: Mapping) -> str:
    """What tells one version of a configuration from another: 32-bit FNV-1a of its JSON over UTF-16 code units, in base 36."""
    h = 2166136261
    raw = json.dumps(value, sort_keys=True, ensure_ascii=False).encode("utf-16-be", "surrogatepass")
    for k in range(0, len(raw), 2):
        h = ((h ^ (raw[k] << 8 | raw[k + 1])) * 16777619) & 0xFFFFFFFF
    digits = ""
    while h or not digits:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    return digits


def save(path: str, value: Mapping, expected: str | None) -> str:
    """Validate a configuration and write it over the one at ``path`` if that is still of the expected revision (None: there is none yet); returns the new revision.

    ConfigError if it is unsound, Conflict if the revision differs; in both cases the file stays as it is. It is replaced in one step.
    """
    load(value)
    found = read(path) if os.path.exists(path) else None
    if (None if found is None else revision(found)) != expected:
        raise Conflict(path)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.tmp", path)
    return revision(value)


def read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def reload(path: str, current: Config) -> tuple[Config, str | None]:
    """(configuration, error): the one at ``path``, or the current one and what is wrong if that cannot be used."""
    try:
        return load(read(path)), None
    except (ConfigError, OSError, ValueError) as e:
        return current, str(e)


def log_path(explicit: str = "", home: str = "") -> str:
    """Where the run log is: the explicit path, else under ``home``/storages, else under the user's own folder."""
    return explicit or os.path.join(home or os.path.join(os.path.expanduser("~"), ".siltstone"), "storages", "runs")
