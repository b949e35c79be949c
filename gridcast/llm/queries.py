"""Imports every module that registers a query, so that the registry is complete."""

from __future__ import annotations

from gridcast.llm import (  # noqa: F401
    bpe,
    exact_dedup,
    importance,
    language_id,
    mixing,
    prefix_trie,
    quality,
    recompression,
    secret_scan,
    simhash,
    suffix_dedup,
    token_counts,
    topk_search,
)
from gridcast.llm.registry import RUNS, SQL

__all__ = ["RUNS", "SQL"]
