"""Settings, their defaults and their environment variables (read on the driver only)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


def prefix_list(raw: str) -> list[str]:
    """Comma-separated path prefixes: blanks dropped, surrounding white space and slashes stripped."""
    return [p.strip().strip("/") for p in raw.split(",") if p.strip()]


@dataclass(frozen=True)
class Settings:
    repo_path: str
    data_dir: str = ".srcatlas"
    embedding_model: str = "hashed-ngrams"
    embedding_batch_size: int = 32
    embedding_dim: int = 768
    chunk_small_threshold: int = 100
    chunk_medium_threshold: int = 300
    chunk_target_lines_medium: int = 125
    chunk_target_lines_large: int = 100
    chunk_overlap_lines: int = 20
    search_top_k: int = 5
    search_response_format: str = "concise"
    search_snippet_lines_concise: int = 15
    search_snippet_lines_detailed: int = 50
    preferred_module_prefix: str = ""
    exclude_module_prefixes: str = ""
    include_module_prefixes: str = ""
    reindex_dirty: bool = True
    exemplar_module: str = ""
    mandatory_fan_in_threshold: float = 0.02
    mandatory_contract_min_ratio: float = 0.005
    mandatory_max_base_files: int = 15
    mandatory_max_contract_files: int = 12
    mandatory_supertype_depth: int = 2
    mandatory_include_exemplar_deps: bool = True
    mandatory_max_lines_per_file: int = 100
    mandatory_max_method_lines: int = 40
    architecture_include_exemplar_default: bool = False
    reindex_on_tool_call: bool = True
    #: False: the context index covers the whole tree, whatever the scope prefixes say.
    scope_context: bool = False

    @classmethod
    def from_env(cls, prefix: str = "SRCATLAS_", env: dict[str, str] | None = None, **given) -> Settings:
        """Fields from variables PREFIX + NAME; arguments win."""
        env = os.environ if env is None else env
        kinds = {"int": int, "float": float, "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"), "str": str}
        found = {f.name: kinds[f.type](env[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in env}
        return cls(**found | given)

    @property
    def exclude_prefixes(self) -> list[str]:
        return prefix_list(self.exclude_module_prefixes)

    @property
    def include_prefixes(self) -> list[str]:
        return prefix_list(self.include_module_prefixes)

    @property
    def data_path(self) -> Path:
        return Path(self.repo_path) / self.data_dir

    @property
    def store_path(self) -> Path:
        return self.data_path / "store"

    @property
    def context_path(self) -> Path:
        return self.data_path / "mandatory.json"
