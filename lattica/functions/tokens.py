"""Token counts by a tokenizer instead of words, for the budget of passages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenizer_counts(path: str) -> Callable[[Column], Column]:
    """What ``segmentation.passages`` takes as ``counts``: tokens of each sentence by the tokenizer file at ``path``.

    A file ``.model`` is read by sentencepiece, any other by tokenizers; special tokens are not added. The file must be where every
    executor can read it. A task loads it once.
    """
    held: dict[str, Callable[[str], int]] = {}

    def count() -> Callable[[str], int]:
        if path not in held:
            if path.endswith(".model"):
                from sentencepiece import SentencePieceProcessor

                model = SentencePieceProcessor(model_file=path)
                held[path] = lambda s: len(model.encode(s))
            else:
                from tokenizers import Tokenizer

                model = Tokenizer.from_file(path)
                held[path] = lambda s: len(model.encode(s, add_special_tokens=False).ids)
        return held[path]

    @F.pandas_udf("array<int>")
    def counts(sentences: pd.Series) -> pd.Series:
        n = count()
        return sentences.map(lambda row: [n(s) for s in row])

    return counts
