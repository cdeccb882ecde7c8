"""Token counts of whole texts under a public tokenizer.

Arrow batches are cut into runs of about equal bytes; a long text is first cut where the tokenizer's own splitting into
words must cut as well, so no batch is larger than a run and the lengths of the pieces add up to the length of the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import annotate, read

TOKENIZER = "byte_bpe_50k.json"
#: UTF-8 bytes handed to the tokenizer at once, and the characters from which a text is cut.
RUN_BYTES, LONG_CHARS = 1 << 19, 1 << 16
#: A byte-level BPE that splits words as in GPT-2 always starts a word at a space between two non-spaces.
SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.no_truncation()
    made.no_padding()
    return made


def pieces(text: str, limit: int = LONG_CHARS) -> Iterator[str]:
    """Cut a text into pieces of at least ``limit`` characters, at safe boundaries only; a stretch without one stays whole."""
    at = 0
    while len(text) - at > limit:
        cut = SAFE.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def lengths(texts: list[str | None], name: str = TOKENIZER) -> np.ndarray:
    """Token counts; a null has none."""
    out = np.zeros(len(texts), np.int64)
    run: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if run:
            np.add.at(out, owners, [len(e) for e in _tokenizer(name).encode_batch_fast(run, add_special_tokens=False)])
        run.clear()
        owners.clear()
        size = 0

    for k, text in enumerate(texts):
        for piece in pieces(text or ""):
            run.append(piece)
            owners.append(k)
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= RUN_BYTES:
                flush()
    flush()
    return out


def count_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, limit: int = 512) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids stay; other columns are not read."""

    def step(column: pa.Array) -> list[pa.Array]:
        return [pa.array(lengths(column.to_pylist(), tokenizer))]

    slim = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return annotate(slim, text, step, "n_tokens long", [id, "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > limit)


def op4(spark, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
