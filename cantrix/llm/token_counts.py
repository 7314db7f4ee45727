"""Token counts by the whole-token shortcut.

Offline, ``Bpe.prove`` finds which vocabulary strings are one pre-token that encodes alone as one
token. A batch is cut into pre-tokens by numpy; those that are such a string count one, and the
merges run only for the distinct rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .arrow import add_columns
from .bpe import shared


def token_counts(docs: DataFrame, limit: int = 512, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows and null keys keep their rows.
    A special string inside a text is its special token. An empty table gives no rows.
    """

    def of():
        bpe = shared(vocabulary)

        def count(t):
            n = bpe.count(t)
            return {"n_bytes": np.diff(t.offsets), "n_tokens": n, "over_limit": n > limit}

        return count

    return add_columns(docs, text, [key], "n_bytes bigint, n_tokens bigint, over_limit boolean", of)
