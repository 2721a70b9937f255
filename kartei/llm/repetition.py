"""Problem 8: repetition inside one document.

Method: line sequence labelling. A text is cut into units (lines and sentences, at most
``UNIT_WORDS`` words each); a linear-chain conditional random field over features of each unit
labels it content or repeated boilerplate by Viterbi decoding; the share of words in content
units decides whether a document is kept, and which ones are held to be repetitive. The shares of repeated five-word
sequences, counted exactly over the whole text, confirm the latter.

The field is trained here: from a bounded sample of clean documents (``TRAIN_TEXTS``, the only
bounded part) into which repeats are planted, so that the labels are known. All documents are
then labelled where they lie; nothing is shuffled.

Defined results: null and wordless texts have 0 words, share 0 and content share 1; texts with
fewer than five words have no sequences and share 0; repeated rows give one row each time they
have another text, once otherwise; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sampling import sample_texts
from .words import rolling, window_mask

TOKEN = re.compile(r"[^\W_]+|[\n.!?…。！？]")
BREAKS = frozenset("\n.!?…。！？")
UNIT_WORDS = 20
GRAM = 5
#: The field is fitted on at most so many texts.
TRAIN_TEXTS = 300
FEATURES = 6
SCHEMA = "doc_id long, n_words int, sequences int, distinct_sequences int, units int, repeated_units int, content_share double"


@dataclass
class Units:
    """Texts of a batch: word ids, where texts end, where units end, and counts by text."""

    flat: np.ndarray
    ends: np.ndarray
    unit_ends: np.ndarray
    unit_text: np.ndarray


def cut(texts: list[str | None]) -> Units:
    """Words of all texts as one array, cut into units."""
    ids: dict[str, int] = {}
    flat: list[int] = []
    ends, marks, unit_text = [0], [], []
    for k, text in enumerate(texts):
        tokens = TOKEN.findall(text.lower()) if text else []
        begin = len(flat)
        for token in tokens:
            if token in BREAKS:
                if len(flat) > begin:
                    marks.append(len(flat))
                    unit_text.append(k)
                    begin = len(flat)
            else:
                flat.append(ids.setdefault(token, len(ids)))
                if len(flat) - begin >= UNIT_WORDS:
                    marks.append(len(flat))
                    unit_text.append(k)
                    begin = len(flat)
        if len(flat) > begin:
            marks.append(len(flat))
            unit_text.append(k)
        ends.append(len(flat))
    return Units(*(np.array(x, np.int64) for x in (flat, ends, marks, unit_text)))


def repeats(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each key, whether the same key came earlier in the same text."""
    if not len(keys):
        return np.zeros(0, bool)
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(mixed, kind="stable")
    same = np.concatenate([[False], mixed[order][1:] == mixed[order][:-1]])
    out = np.empty(len(keys), bool)
    out[order] = same
    return out


def describe(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by unit, sequences by text, distinct sequences by text."""
    n_texts, total, n_units = len(u.ends) - 1, len(u.flat), len(u.unit_ends)
    text_of = np.repeat(np.arange(n_texts), np.diff(u.ends))
    sequences = np.maximum(0, np.diff(u.ends) - GRAM + 1)
    inside = np.nonzero(window_mask(u.ends, GRAM))[0]
    again = inside[repeats(rolling(u.flat, GRAM)[inside], text_of[inside])] if len(inside) else inside
    distinct = sequences - np.bincount(text_of[again], minlength=n_texts)
    x = np.zeros((n_units, FEATURES))
    if not n_units:
        return x, sequences, distinct
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + GRAM, -1)
    covered = np.cumsum(edge)[:total] > 0
    starts = np.concatenate([[0], u.unit_ends[:-1]])
    length = u.unit_ends - starts
    old_word = repeats(u.flat, text_of)
    # A unit's key: its words in order, by a positional sum.
    position = np.arange(total) - np.repeat(starts, length)
    weight = (position.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    term = (u.flat.astype(np.uint64) + np.uint64(1)) * (weight ^ (weight >> np.uint64(29)))
    key = np.add.reduceat(term ^ (term >> np.uint64(31)), starts)
    x[:, 0] = 1
    x[:, 1] = np.add.reduceat(covered.astype(float), starts) / length
    x[:, 2] = repeats(key, u.unit_text)
    x[:, 3] = np.add.reduceat(old_word.astype(float), starts) / length
    x[:, 4] = length < GRAM
    x[:, 5] = x[:, 1] > 0.2
    return x, sequences, distinct


class ChainField:
    """A linear-chain conditional random field with two labels: 0 content, 1 repeated."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None) -> None:
        self.weights = np.zeros((2, FEATURES)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    @staticmethod
    def _pad(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ragged rows as (texts, longest, ...) and the mask of what is real."""
        mask = np.arange(counts.max())[None, :] < counts[:, None]
        out = np.zeros((*mask.shape, *x.shape[1:]), x.dtype)
        out[mask] = x
        return out, mask

    def fit(self, x: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> ChainField:
        """Maximum likelihood by gradient steps (Adam) on forward-backward expectations."""
        xs, mask = self._pad(x, counts)
        ys, _ = self._pad(labels, counts)
        theta = np.concatenate([self.weights.ravel(), self.moves.ravel()])
        first, second, n = np.zeros_like(theta), np.zeros_like(theta), len(counts)
        one_hot = np.stack([(ys == k) & mask for k in (0, 1)], 2).astype(float)
        pair_mask = mask[:, 1:]
        seen = np.concatenate([np.einsum("ntk,ntf->kf", one_hot, xs).ravel(), np.einsum("nti,ntj->ij", one_hot[:, :-1], one_hot[:, 1:]).ravel()])
        for step in range(1, rounds + 1):
            w, m = theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES :].reshape(2, 2)
            emit = xs @ w.T
            alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
            alpha[:, 0] = emit[:, 0]
            for t in range(1, emit.shape[1]):
                new = np.logaddexp(alpha[:, t - 1, 0, None] + m[0], alpha[:, t - 1, 1, None] + m[1]) + emit[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            for t in range(emit.shape[1] - 2, -1, -1):
                ahead = emit[:, t + 1] + beta[:, t + 1]
                new = np.logaddexp(m[:, 0] + ahead[:, 0, None], m[:, 1] + ahead[:, 1, None])
                beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            single = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            double = np.exp(alpha[:, :-1, :, None] + m + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]) * pair_mask[:, :, None, None]
            expected = np.concatenate([np.einsum("ntk,ntf->kf", single, xs).ravel(), double.sum((0, 1)).ravel()])
            g = (seen - expected) / n - ridge * theta
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves = theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES :].reshape(2, 2)
        return self

    def decode(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Viterbi labels of all units; texts of like length are decoded together."""
        out = np.zeros(len(x), np.int8)
        emit = x @ self.weights.T
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        order = np.argsort(counts, kind="stable")
        order = order[counts[order] > 0]
        at = 0
        while at < len(order):
            shortest = counts[order[at]]
            until = at + int(np.searchsorted(counts[order[at:]], 2 * shortest, side="right"))
            group = order[at:until]
            at = until
            n, t_max = counts[group], int(counts[group].max())
            index = np.minimum(starts[group][:, None] + np.arange(t_max), (starts[group] + n - 1)[:, None])
            e = emit[index]
            score, back = e[:, 0], np.zeros((len(group), t_max, 2), np.int8)
            last = np.zeros(len(group), np.int8)
            for t in range(1, t_max):
                via0, via1 = score[:, 0, None] + self.moves[0], score[:, 1, None] + self.moves[1]
                back[:, t] = via1 > via0
                live = t < n
                score = np.where(live[:, None], np.maximum(via0, via1) + e[:, t], score)
            last = (score[:, 1] > score[:, 0]).astype(np.int8)
            rows = np.arange(len(group))
            for t in range(t_max - 1, -1, -1):
                live = t < n
                out[starts[group][live] + t] = last[live]
                last = np.where(live, back[rows, t, last], last)
        return out


def planted(texts: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and unit counts of clean texts with repeats planted at known places."""
    rng = np.random.default_rng(seed)
    docs: list[str] = []
    marks: list[np.ndarray] = []
    for text in texts:
        parts = [p for p in re.split(r"(?<=[.!?…。！？\n])", text) if p.strip()]
        units = [(p, 0) for p in parts]
        for _ in range(int(rng.integers(0, 3))):
            kind = rng.integers(0, 3)
            at = int(rng.integers(0, len(parts)))
            if kind == 0:  # a block of lines again, later
                block = [(p, 1) for p in parts[at : at + int(rng.integers(1, 4))]] * int(rng.integers(1, 5))
            elif kind == 1:  # a line again with one other word
                words = parts[at].split()
                words[int(rng.integers(0, len(words)))] = f"x{int(rng.integers(0, 10**6))}"
                block = [(" ".join(words) + ".", 1)]
            else:  # a phrase that loops
                words = parts[at].split()[: int(rng.integers(5, 12))]
                block = [(" ".join(words) + ".", 1)] * int(rng.integers(3, 12))
            if kind == 2:
                block[0] = (block[0][0], 1)
            after = int(rng.integers(0, 2)) * (len(units) - at - 1) + at + 1
            units[max(at + 1, after) : max(at + 1, after)] = block
        u = cut([p for p, _ in units])  # each part on its own, to know how many units it gives
        per_part = np.bincount(u.unit_text, minlength=len(units))
        docs.append("\n".join(p for p, _ in units))
        marks.append(np.repeat([m for _, m in units], per_part))
    u = cut(docs)
    counts = np.bincount(u.unit_text, minlength=len(docs))
    keep = np.array([len(m) == c and c > 0 for m, c in zip(marks, counts)])
    x, _, _ = describe(u)
    rows = keep[u.unit_text]
    return x[rows], np.concatenate([m for m, k in zip(marks, keep) if k] or [np.zeros(0, int)]), counts[keep]


def train(documents: DataFrame, text: str = "text", texts: int = TRAIN_TEXTS) -> ChainField:
    """Fit the field on at most ``texts`` clean texts, chosen by hash (the same at every run)."""
    rows = sample_texts(documents.where(F.length(text).between(200, 4000)), texts, text)
    u = cut(rows)
    _, sequences, distinct = describe(u)
    clean = [t for t, a, b in zip(rows, sequences, distinct) if a == b and a > 0]
    if len(clean) < 5:  # too little to learn from: the share of repeated sequences alone decides
        weights = np.zeros((2, FEATURES))
        weights[1, :2] = -2.0, 8.0
        return ChainField(weights)
    return ChainField().fit(*planted(clean))


def label_units(documents: DataFrame, field: ChainField, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: exact sequence counts and the labels' summary."""
    weights, moves = field.weights, field.moves

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = ChainField(weights, moves)
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                u = cut(part.column(1).to_pylist())
                n = part.num_rows
                x, sequences, distinct = describe(u)
                counts = np.bincount(u.unit_text, minlength=n)
                labels = chain.decode(x, counts)
                length = np.diff(np.concatenate([[0], u.unit_ends]))
                words = np.diff(u.ends)
                content = np.bincount(u.unit_text, weights=length * (labels == 0), minlength=n)
                share = np.where(words > 0, content / np.maximum(words, 1), 1.0)
                numbers = (words, sequences, distinct, counts, np.bincount(u.unit_text, weights=labels, minlength=n))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v.astype(np.int32)) for v in numbers), pa.array(share)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, SCHEMA).withColumn("repeated_share", F.when(F.col("sequences") > 0, 1 - F.col("distinct_sequences") / F.col("sequences")).otherwise(0.0))


def repetition(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_content: float = 0.7) -> DataFrame:
    """label_units with a trained field; ``keep`` says whether enough of the document is content."""
    return label_units(documents, train(documents, text), doc_id, text).withColumn("keep", F.col("content_share") >= least_content)


def repetitive(labelled: DataFrame, least_words: int = 50, tenths: int = 3) -> DataFrame:
    """Documents whose share of repeated sequences is at least tenths/10.

    The field chooses them: those of whose words it labels at least half that share as repeated. The exact count follows on
    what it chose, as units are labelled whole and sequences are counted by the word."""
    chosen = labelled.where((F.col("n_words") >= least_words) & (F.col("content_share") <= 1 - tenths / 20))
    return chosen.where(10 * (F.col("sequences") - F.col("distinct_sequences")) >= tenths * F.col("sequences"))
