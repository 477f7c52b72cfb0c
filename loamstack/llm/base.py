"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstack.operators.folds import FAN_IN, list_parts, or_fold

__all__ = ["FAN_IN", "list_parts", "or_fold", "token_set"]


def token_set(toks: str | Column, *scope: Column) -> Column:
    """Sorted distinct 64-bit hashes of the tokens, each hashed with ``scope``.

    Null tokens in the list are ignored; a null list gives null.
    """
    toks = F.col(toks) if isinstance(toks, str) else toks
    return F.sort_array(F.array_distinct(F.transform(
        F.filter(toks, lambda t: t.isNotNull()), lambda t: F.xxhash64(*scope, t))))
