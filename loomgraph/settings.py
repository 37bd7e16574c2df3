"""Settings, with the defaults that results depend on; environment variables override them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 100
    min_chunk_size: int = 80
    embedding_dimension: int = 1536
    top_k_chunks: int = 5
    max_hops: int = 2
    max_paths: int = 20
    max_facts: int = 30
    fan_out: int = 50
    rrf_k: int = 60
    vector_weight: float = 0.5
    graph_weight: float = 0.3
    entity_weight: float = 0.2


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    """Settings of this process; LOOMGRAPH_CHUNK_SIZE and the like override single ones."""
    found = {}
    for f in fields(Settings):
        value = os.environ.get(f"LOOMGRAPH_{f.name.upper()}")
        if value is not None:
            found[f.name] = type(f.default)(value)
    return Settings(**found)
