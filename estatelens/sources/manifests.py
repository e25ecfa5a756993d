"""Connectors as manifests: what they can do, what they need, and whether it is there."""

from __future__ import annotations

import importlib.util
import tomllib
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

#: What every connector can do, and the only permission there is.
NEEDED, PERMISSION = ("probe", "discover_catalog"), "read"


class Connector(Protocol):
    """A source's catalog and samples; profiles and overlaps come from any DataFrame."""

    def probe(self) -> dict: ...

    def discover_catalog(self, namespace: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]: ...

    def sample_rows(self, namespace: str, name: str, limit: int) -> DataFrame: ...


@dataclass(frozen=True)
class Manifest:
    name: str
    version: str
    source_type: str
    capabilities: tuple[str, ...]
    dependencies: tuple[str, ...] = ()
    permissions: tuple[str, ...] = (PERMISSION,)
    dialect: str | None = None
    contract_version: int = 1
    references: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.contract_version != 1 or not self.name.strip() or not self.version.strip():
            raise ValueError("the manifest's contract or name is not supported")
        if set(NEEDED) - set(self.capabilities):
            raise ValueError(f"a connector can {', '.join(NEEDED)}")
        if set(self.permissions) - {PERMISSION}:
            raise ValueError("connectors read only")

    def check(self) -> dict[str, bool]:
        """Whether each package that it needs can be imported."""
        return {d: importlib.util.find_spec(d) is not None for d in self.dependencies}


def read_manifest(text: str) -> Manifest:
    """A manifest from TOML with a [connector] table."""
    own = tomllib.loads(text).get("connector")
    if not isinstance(own, dict) or set(own) - set(Manifest.__dataclass_fields__):
        raise ValueError("a manifest has a [connector] table of known keys")
    return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})


BUILT_IN = {
    "files": Manifest("files", "1", "files", (*NEEDED, "sample_rows", "profile_object", "probe_relationships"), ("pyspark",)),
    "sqlite": Manifest("sqlite", "1", "database", (*NEEDED, "sample_rows", "profile_object", "probe_relationships"), ("sqlite3",), dialect="sqlite"),
    "sqlserver": Manifest("sqlserver", "1", "database", (*NEEDED, "sample_rows", "profile_object", "probe_relationships"), ("pyspark",), dialect="tsql"),
}


def manifest(name: str) -> Manifest:
    if name not in BUILT_IN:
        raise ValueError(f"connector_not_found: {name}")
    return BUILT_IN[name]
