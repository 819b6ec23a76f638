"""Settings of detectors and engine, and their file and environment sources."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class DetectorConfig:
    """Scores and context settings of the pattern detectors."""

    window: int = 10
    ssn_dashed: float = 0.99
    phone: float = 0.95
    email: float = 0.99
    mrn: float = 0.99
    card_dashed: float = 0.99
    ipv4: float = 0.95
    ipv6: float = 0.95
    passport: float = 0.99
    ssn_base: float = 0.40
    dob_base: float = 0.50
    card_base: float = 0.50
    ssn_threshold: float = 0.70
    dob_threshold: float = 0.70
    card_threshold: float = 0.70


@dataclass(frozen=True)
class EngineConfig:
    """The whole engine: detectors, entity model, chunking.

    Model id, device and aggregation of subwords are for the provider of an entity model, which
    gets the configuration if its loader takes an argument."""

    detectors: DetectorConfig = field(default_factory=DetectorConfig)
    model_threshold: float = 0.90
    chunk_size: int = 1500
    enable_patterns: bool = True
    label_adapter: Mapping[str, str] | None = None
    model_id: str = ""
    device: str = "cpu"
    aggregation: str = "simple"


@dataclass(frozen=True)
class ServiceConfig:
    upstream_url: str = ""
    disabled_entities: tuple[str, ...] = ()


def load_service_config(path: str) -> ServiceConfig:
    """A TOML file; missing keys and a file that cannot be read give the defaults."""
    try:
        with open(path, "rb") as f:
            found = tomllib.load(f)
        return ServiceConfig(str(found.get("upstream_url", "")), tuple(map(str, found.get("disabled_entities", ()))))
    except (OSError, tomllib.TOMLDecodeError, TypeError):
        return ServiceConfig()


def model_environment(names: tuple[str, str] = ("MODEL_PATH", "TOKENIZER_PATH"), env: Mapping[str, str] = os.environ) -> tuple[str, str]:
    """Paths from two variables; both must be set and exist, or nothing starts."""
    paths = []
    for name in names:
        if not (path := env.get(name)):
            raise RuntimeError(f"{name} is not set")
        if not os.path.exists(path):
            raise RuntimeError(f"{name} names a missing path")
        paths.append(path)
    return paths[0], paths[1]
