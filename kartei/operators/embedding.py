"""Embedders, encoding of distinct texts, and the composite vectors of files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kartei.functions import scoring, vectors as V


class Embedder(Protocol):
    """Turns a column of texts into unit vectors; blank texts give zero vectors."""

    name: str
    scale: float
    dimensions: int

    def encode(self, texts: DataFrame) -> DataFrame:
        """(text) to (text, vec array<double>)."""


@dataclass(frozen=True)
class MarkerEmbedder:
    """One dimension per keyword, 1 if the text holds it, at unit length. Stays in the JVM."""

    keywords: tuple[str, ...]
    scale: float = 0.5
    name: str = "marker"

    @property
    def dimensions(self) -> int:
        return len(self.keywords)

    def as_column(self, text: Column) -> Column:
        low = F.lower(text)
        return V.normalised(F.array(*(F.when(F.contains(low, F.lit(k)), 1.0).otherwise(0.0) for k in self.keywords)))

    def encode(self, texts: DataFrame) -> DataFrame:
        return texts.select("text", self.as_column(F.col("text")).alias("vec"))


_WORD = re.compile(r"[^\W_]+")


def _token_direction(token: str, dimensions: int) -> np.ndarray:
    import xxhash

    signs = np.frombuffer(b"".join(xxhash.xxh64_digest(f"{k}:{token}") for k in range(-(-dimensions // 64))), np.uint8)
    return np.unpackbits(signs)[:dimensions].astype(np.float32) * 2 - 1


@dataclass(frozen=True)
class HashedEmbedder:
    """Sums a random direction per word, damped by the word's count; needs no model file.

    Longer words count more: short ones are mostly grammar. The scale was measured on documents with known topics:
    texts of one topic and language are at 0.27 on average, texts of different topics at 0.17, so that clusters begin at
    0.65 * scale = 0.22."""

    dimensions: int = 128
    scale: float = 0.34
    name: str = "hashed"

    def vectors(self, texts: list[str], memory: dict[str, np.ndarray] | None = None) -> np.ndarray:
        memory = {} if memory is None else memory
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k, text in enumerate(texts):
            words, counts = np.unique(_WORD.findall((text or "").lower()), return_counts=True)
            for word, n in zip(words.tolist(), counts.tolist()):
                if word not in memory and len(memory) < 50_000:
                    memory[word] = _token_direction(word, self.dimensions)
                direction = memory.get(word)
                out[k] += (1 + np.log(n)) * min(len(word), 8) ** 1.5 * (_token_direction(word, self.dimensions) if direction is None else direction)
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)

    def encode(self, texts: DataFrame) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memory: dict[str, np.ndarray] = {}
            for batch in batches:
                x = self.vectors(batch.column(0).to_pylist(), memory).astype(np.float64)
                offsets = pa.array((np.arange(len(x) + 1) * self.dimensions).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["text", "vec"])

        return texts.select("text").mapInArrow(work, "text string, vec array<double>")


def zeros(dimensions: int) -> Column:
    return F.array_repeat(F.lit(0.0), dimensions)


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"[\s\p{Z}]+", ""), F.lit("")) == ""


def encode_distinct(rows: DataFrame, columns: dict[str, str], embedder: Embedder, known: DataFrame | None = None) -> DataFrame:
    """rows with a vector column for each text column: every distinct text is embedded once.

    known: an earlier dictionary (text, vec); texts it holds with the right length aren't embedded again.
    A text that many rows share is joined by its value; adaptive execution splits such keys.
    """
    wanted = None
    for text in columns:
        part = rows.where(~is_blank(F.col(text))).select(F.make_valid_utf8(F.col(text)).alias("text"))
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = wanted.distinct()
    if known is not None:
        fresh = known.where(F.size("vec") == embedder.dimensions).select("text", "vec")
        dictionary = embedder.encode(wanted.join(fresh, "text", "left_anti")).unionByName(fresh.join(wanted, "text", "left_semi"))
    else:
        dictionary = embedder.encode(wanted)
    dictionary = dictionary.select("text", V.finite(F.col("vec")).alias("vec"))
    out = rows
    for text, vec in columns.items():
        entry = dictionary.select(F.col("text").alias("_text"), F.col("vec").alias(vec))
        out = out.join(entry, F.make_valid_utf8(F.col(text)) == F.col("_text"), "left").drop("_text").withColumn(vec, F.coalesce(vec, zeros(embedder.dimensions)))
    return out


def composite(text_vec: Column, name_vec: Column, kind_vec: Column, mix: Column, void: Column) -> Column:
    """The three channels side by side, each scaled by the root of its share, at unit length; zero where ``void``."""
    channels = ((text_vec, "text"), (name_vec, "name"), (kind_vec, "kind"))
    joined = V.let(mix, lambda m: F.concat(*(V.scaled(v, F.sqrt(m[c])) for v, c in channels)))
    whole = F.size(text_vec) + F.size(name_vec) + F.size(kind_vec)
    return F.when(void, F.array_repeat(F.lit(0.0), whole)).otherwise(V.normalised(joined))


def name_phrases(files: DataFrame, tokens: str = "tokens", least_files: int = 5, share: float = 0.7) -> DataFrame:
    """files (folder, pos, tokens array) with name_phrase: in folders of at least ``least_files`` files, words
    that ``share`` of their names hold are left out."""
    counts = files.groupBy("folder").agg(F.count(F.lit(1)).alias("_n"))
    seen = files.select("folder", "pos", F.explode(F.array_distinct(tokens)).alias("_token")).groupBy("folder", "_token").agg(F.count(F.lit(1)).alias("_with"))
    common = seen.join(counts, "folder").where((F.col("_n") >= least_files) & (F.col("_with") >= share * F.col("_n"))).groupBy("folder").agg(F.collect_set("_token").alias("_common"))
    kept = F.array_join(F.filter(tokens, lambda t: ~F.coalesce(F.array_contains("_common", t), F.lit(False))), " ")
    return files.join(common, "folder", "left").withColumn("name_phrase", kept).drop("_common")


def embedded_texts(files: DataFrame, embedder: Embedder, known: DataFrame) -> DataFrame:
    """(text, vec) of all texts that file_vectors needs: those of ``known`` as they are, the others embedded now."""
    from kartei.functions.kinds import phrase_of

    texts = files.select(F.explode(F.array("text", "name_phrase", phrase_of(F.col("kind")))).alias("text"))
    wanted = texts.where(~is_blank(F.col("text"))).select(F.make_valid_utf8("text").alias("text")).distinct()
    fit = known.where(F.size("vec") == embedder.dimensions).select("text", "vec")
    return embedder.encode(wanted.join(fit, "text", "left_anti")).select("text", F.col("vec").cast("array<double>").alias("vec")).unionByName(fit.join(wanted, "text", "left_semi"))


def file_vectors(files: DataFrame, embedder: Embedder, known: DataFrame | None = None, thin: float = 0.45, rich: float = 0.75, min_text: int = 120) -> DataFrame:
    """(folder, pos, vec, topical) of files (folder, pos, text, name_phrase, kind, textual, size)."""
    from kartei.functions.kinds import phrase_of

    ready = files.select("folder", "pos", "text", "name_phrase", "kind", "textual", "size", phrase_of(F.col("kind")).alias("kind_phrase"))
    encoded = encode_distinct(ready, {"text": "_t", "name_phrase": "_n", "kind_phrase": "_k"}, embedder, known)
    void = (F.col("kind") == "junk") | (F.col("size") == 0)
    mix = scoring.channel_mix(F.col("text"), F.col("name_phrase"), F.col("textual"), thin, rich, min_text)
    topical = ~void & (~is_blank(F.col("text")) | ~is_blank(F.col("name_phrase")))
    return encoded.select("folder", "pos", composite(F.col("_t"), F.col("_n"), F.col("_k"), mix, F.coalesce(void, F.lit(False))).alias("vec"), F.coalesce(topical, F.lit(False)).alias("topical"))
