"""Token counts: batch encoding in Arrow functions that return lengths only.

Arrow batches are joined and cut into batches of about equal bytes, whose texts go through the tokenizer of the tokenizers library in
runs of about equal length. Each text is cut at white space, which the normaliser and pre-tokenizer of word-level files never join across, so that a long
text is many short strings and a string that occurs again in a batch or an earlier one is encoded once.
Special strings inside a text count as the library counts them by default. Defined results: null and empty
texts have 0 bytes and 0 tokens; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.textbatch import Dictionary, balanced, per_row, raw, text_column, words_of

BATCH_BYTES = 4 << 20
RUN_BYTES = 1 << 17  #: what the library gets at once, about


def runs(strings: list[str], n: int) -> Iterator[list[str]]:
    """The strings in runs of about n characters; a longer one is a run of its own."""
    at = np.cumsum([0, *map(len, strings)])
    a = 0
    while a < len(strings):
        b = max(a + 1, int(np.searchsorted(at, at[a] + n, "right")) - 1)
        yield strings[a:b]
        a = b


@functools.lru_cache(maxsize=4)
def word_lengths(path: str) -> Dictionary:
    """Remembered token counts of words, one table for each process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for part in runs(words, RUN_BYTES):
            out += [[len(e)] for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    return Dictionary(encode)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document. ``path``: a tokenizers file that drops white space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_lengths(path)
        for part in balanced(batches, batch_bytes):
            column = text_column(part)
            words, counts = words_of(column)
            lengths, at, _ = table.look_up(words)
            n_tokens = per_row(np.add, lengths[at].astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(raw(column)[1])), pa.array(n_tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
