"""Folders that operators use, and free column names."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..shared import cut, shared_dir, written

__all__ = ["cut", "free_name", "shared_dir", "tokenizer_dir", "written"]


def tokenizer_dir() -> str:
    """The default of the `tokenizers` parameter: the folder of the public tokenizers."""
    return os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
