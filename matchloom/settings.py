"""Settings with defaults, each overridable by an environment variable MATCHLOOM_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from matchloom.operators.rerank import Penalties
from matchloom.operators.sampling import Negatives


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 64
    semantic_blend: float = 0.25
    hard_tag_filter: bool = True
    negative_ratio: float = 5.0
    negative_conflict: float = 0.5
    negative_near_miss: float = 0.33
    negative_stratified: bool = True
    neighbours: int = 20
    attribute_penalty: float = 0.7
    language_penalty: float = 0.3
    no_match_penalty: float = 0.02
    untagged_penalty: float = 0.3
    secondary_penalty: float = 0.4
    broad_threshold: int = 4
    test_share: float = 0.2
    seed: int = 42
    trees: int = 30
    folds: int = 3
    top_n: int = 5

    @classmethod
    def from_env(cls, env=os.environ) -> Settings:
        """Values from the environment; ``0``, ``false`` and blank are false for switches."""
        found = {}
        for f in fields(cls):
            raw = env.get(f"MATCHLOOM_{f.name.upper()}")
            if raw is None:
                continue
            kind = type(f.default)
            found[f.name] = raw.strip().lower() not in ("0", "false", "") if kind is bool else kind(raw)
        return cls(**found)

    @property
    def penalties(self) -> Penalties:
        return Penalties(attribute=self.attribute_penalty, language=self.language_penalty, no_match=self.no_match_penalty, untagged=self.untagged_penalty, secondary=self.secondary_penalty, breadth=self.broad_threshold)

    @property
    def negatives(self) -> Negatives:
        return Negatives(self.negative_ratio, self.negative_conflict, self.negative_near_miss, self.negative_stratified, self.neighbours)
