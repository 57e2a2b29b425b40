"""Settings of the linkage pipeline, and the part of them that a model is bound to."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Config:
    name_topk: int = 2
    addr_topk: int = 4
    num_topk: int = 2
    max_df: int = 500
    max_pairs_per_key: int = 50_000
    k_key: int = 40
    k_bm25: int = 5
    k_bm25_empty: int = 40
    k_dense: int = 15
    k_dense_script: int = 50
    fuzzy_gate: int = 24
    rounds: int = 20
    depth: int = 4
    tau: float = 0.3
    gamma: float = 0.85
    miss: float = 0.1
    housenum_bonus: float = 0.05
    housenum_near: int = 5
    train_countries: tuple[str, ...] = ()

    #: Settings that change features; a model is used only with those it was trained with.
    CONTRACT = ("name_topk", "addr_topk", "num_topk", "max_df", "max_pairs_per_key", "k_key", "k_bm25", "k_bm25_empty", "k_dense", "k_dense_script", "fuzzy_gate", "housenum_bonus", "housenum_near")

    def contract(self, features: list[str]) -> str:
        own = asdict(self)
        return json.dumps({"settings": {k: own[k] for k in self.CONTRACT}, "features": features}, sort_keys=True)


def enforce(expected: str, config: Config, features: list[str]) -> Config:
    """The config with the contract's settings; an error where the features differ."""
    want = json.loads(expected)
    if want["features"] != features:
        raise ValueError("the model was trained on other features")
    return Config(**{**asdict(config), **want["settings"]})
