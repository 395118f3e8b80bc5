"""Configuration: a TOML file of sections, read once and then fixed."""

from __future__ import annotations

import logging
import os
import tomllib
from logging.handlers import RotatingFileHandler
from pathlib import Path

from vellum.operators.providers import ChatProvider

_MISSING = object()


class ConfigError(Exception):
    """A configuration file that can't be read."""


class Config:
    """Values by section and key. A key without value and default raises KeyError; None as default counts as none."""

    def __init__(self, path: str | os.PathLike = "config.toml", values: dict | None = None):
        self.path = Path(path)
        if values is None:
            if not self.path.exists():
                raise FileNotFoundError(f"no configuration file {self.path}")
            try:
                values = tomllib.loads(self.path.read_text(encoding="utf-8"))
            except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
                raise ConfigError(f"{self.path}: {e}") from e
        self._values = values

    def get(self, section: str, key: str | None = None, default: object = None) -> object:
        """A section as a dict, or one of its values."""
        found = self._values.get(section, _MISSING)
        if key is not None and found is not _MISSING:
            found = found.get(key, _MISSING)
        if found is not _MISSING:
            return found
        if default is None:
            raise KeyError(f"{section}.{key}" if key else section)
        return default

    def optional(self, section: str, key: str) -> object | None:
        """A value, or None."""
        return self._values.get(section, {}).get(key)

    def resolve(self, name: str) -> Path:
        """A path, a relative one beside the configuration file."""
        return Path(name) if os.path.isabs(name) else self.path.parent / name

    def ambiguous(self) -> list[str]:
        """Abbreviations never taken for conflicts."""
        return list(self._values.get("ambiguity", {}).get("ambiguous_aws", []))

    def openai_integration(self, key: str) -> object:
        return self.get("OpenAI_integration", key)

    def validate_paths(self, source: str | None = None, output: str | None = None) -> None:
        """Input and both dictionaries must exist; the output folder is made. ``source`` and ``output`` stand in for the configured ones; URIs are left alone."""
        for key, name in (("paths.input_path", source or self.resolve(self.get("paths", "input_path"))), *((f"data.{k}", self.resolve(self.get("data", k))) for k in ("machine_solution_path", "user_solution_path"))):
            if "://" not in str(name) and not Path(name).exists():
                raise FileNotFoundError(f"{key}: {name}")
        target = str(output or self.resolve(self.get("paths", "output_path")))
        if "://" not in target:
            Path(target).mkdir(parents=True, exist_ok=True)

    def recap(self) -> list[tuple[str, str, str]]:
        """Section, key and value of every setting, in the file's order."""
        return [(s, k, str(v)) for s, values in self._values.items() if isinstance(values, dict) for k, v in values.items() if not isinstance(v, dict)]


def missing_keys(config: Config, environment: dict[str, str] | None = None) -> list[str]:
    """Warnings about credentials that the configured language model would need."""
    environment = os.environ if environment is None else environment
    wanted = ChatProvider.VARIABLES.get(str(config.optional("language_model_integration", "provider")).lower(), ())
    return [f"{name} is not set; offline answers are used" for name in wanted if not environment.get(name)]


def setup_logging(folder: str = "logs", level: int = logging.INFO) -> logging.Logger:
    """A logger of warnings to the console, and of everything from ``level`` on to files of 10 MB, five kept."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    logger = logging.getLogger("vellum")
    logger.setLevel(level)
    if not logger.handlers:
        console = logging.StreamHandler()
        console.setLevel(logging.WARNING)
        file = RotatingFileHandler(Path(folder) / "vellum.log", maxBytes=10_000_000, backupCount=5, encoding="utf-8")
        for handler in (console, file):
            handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
            logger.addHandler(handler)
    return logger
