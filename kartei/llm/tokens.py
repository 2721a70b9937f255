"""Token counts by a public tokenizer, as an Arrow function."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

#: Where the vocabulary files lie; a parameter everywhere. The driver sends the file to all executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How such vocabularies split text before merging (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """The tokenizer of a rank file, loaded once in a worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _LOADED[path]


def token_counts(documents: DataFrame, doc_id: str, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, *keep, digest, tokens) of all rows with an id and a text; the texts stay where they are."""

    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            digests = pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())
            tokens = pa.array([len(encode(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], digests, tokens], names=["doc_id", *keep, "digest", "tokens"])

    rows = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
    kinds = dict(documents.dtypes)
    return rows.mapInArrow(work, ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in keep), "digest binary", "tokens long"]))
