"""Configuration: defaults, then a TOML file, then environment variables; validated once."""

from __future__ import annotations

import ipaddress
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from tidelog.errors import ConfigError

PREFIX = "TIDELOG"


@dataclass(frozen=True)
class Storage:
    data_dir: str = "./data"
    memtable_size_mb: int = 4

    def validate(self) -> None:
        if not 1 <= self.memtable_size_mb <= 1024:
            raise ConfigError(f"memtable_size_mb must be from 1 to 1024, not {self.memtable_size_mb}")
        probe = Path(self.data_dir) / ".write_test"
        try:
            probe.parent.mkdir(parents=True, exist_ok=True)
            probe.write_bytes(b"")
            probe.unlink()
        except OSError as e:
            raise ConfigError(f"data_dir {self.data_dir} is not writable: {e}") from e


@dataclass(frozen=True)
class Server:
    host: str = "127.0.0.1"
    port: int = 21524

    def validate(self) -> None:
        try:
            ipaddress.ip_address(self.host)
        except ValueError as e:
            raise ConfigError(f"host must be an IP address, not {self.host!r}") from e
        if not 1 <= self.port <= 65535:
            raise ConfigError(f"port must be from 1 to 65535, not {self.port}")


@dataclass(frozen=True)
class Config:
    storage: Storage = field(default_factory=Storage)
    server: Server = field(default_factory=Server)

    def validate(self) -> None:
        self.storage.validate()
        self.server.validate()


def find_file(environ: Mapping[str, str], folder: Path) -> Path | None:
    """The path that the variable names, which must exist, however the variable is set; else config.toml in ``folder``, if there."""
    if (named := environ.get(f"{PREFIX}_CONFIG")) is not None:
        if not named or not Path(named).exists():
            raise ConfigError(f"no configuration file {named!r}")
        return Path(named)
    return path if (path := folder / "config.toml").is_file() else None


def typed(name: str, value: object, kind: type) -> object:
    try:
        if kind is int and not isinstance(value, bool | float):
            return int(value)
        if kind is str and isinstance(value, str):
            return value
    except (TypeError, ValueError):
        pass
    raise ConfigError(f"{name} must be of type {kind.__name__}, not {value!r}")


def load(environ: Mapping[str, str] | None = None, folder: str | Path = ".") -> Config:
    """Read, override and validate. TIDELOG__STORAGE__DATA_DIR overrides data_dir of [storage]."""
    environ = os.environ if environ is None else environ
    given: dict = {}
    if path := find_file(environ, Path(folder)):
        try:
            given = tomllib.loads(path.read_text())
        except (OSError, ValueError) as e:
            raise ConfigError(f"can't read {path}: {e}") from e
    config = Config()
    for part in fields(Config):
        section = getattr(config, part.name)
        table = given.get(part.name, {})
        if not isinstance(table, dict):
            raise ConfigError(f"[{part.name}] must be a table")
        for f in fields(section):
            value = environ.get(f"{PREFIX}__{part.name.upper()}__{f.name.upper()}", table.get(f.name))
            if value is not None:
                section = replace(section, **{f.name: typed(f"{part.name}.{f.name}", value, type(f.default))})
        config = replace(config, **{part.name: section})
    config.validate()
    return config


_config: Config | None = None


def init(environ: Mapping[str, str] | None = None, folder: str | Path = ".") -> Config:
    """Load the process's configuration once; later calls return the first."""
    global _config
    if _config is None:
        _config = load(environ, folder)
    return _config


def current() -> Config:
    if _config is None:
        raise RuntimeError("the configuration is not initialised")
    return _config
