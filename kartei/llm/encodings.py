"""Problem 4: text that was decoded with the wrong character encoding, wholly or in a passage.

Method: a smoothed character trigram model is trained on clean records, by distributed counts
over all of them. For every word with characters beyond ASCII that the model finds improbable,
every chain (encode with the wrong encoding, decode with the right one) is tried and scored by the
model; words are scored jointly by the best run of words under one chain, and the likeliest chain
is accepted beyond a margin. Restoring is repeated on its own result, which undoes double damage
and several damaged passages. The margin is validated on all clean texts beyond ASCII.

A replacement character (U+FFFD) is the trace of a failed decoding: such records are found,
though what it replaced can't be restored.

The model is trained twice: first on records without a replacement character and without words
whose bytes under a wrong encoding are valid UTF-8 of common characters, then on all records in which
the first model finds no damage.

Defined results: null and empty texts are not damaged; repeated rows count once; a record with
several texts is found if one of them is; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kartei.plans.lineage import discard, materialise

#: Encodings that texts may have been written in.
RIGHT = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp852", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "cp1253", "iso8859-7", "cp737", "cp932", "euc_jp", "mac_roman", "cp850", "cp437", "utf-16-le", "utf-16-be")
#: Encodings that they may have been read with.
WRONG = ("cp1252", "latin-1", "cp437", "cp850", "cp852", "mac_roman", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac_cyrillic", "cp1253", "iso8859-7", "cp1254", "cp1257", "utf-16-le", "utf-16-be", "gbk", "cp932", "big5", "cp949")
#: One-byte encodings that UTF-8 may have been read with twice.
TWICE = ("cp1252", "latin-1", "cp1250", "cp437", "mac_roman", "cp850", "cp1251")
CHAINS = [(w, r) for w in WRONG for r in RIGHT if w != r] + [(f"{w}, {w}", "utf-8, utf-8") for w in TWICE]
#: What a chain costs before it gains, until the chains of the collection at hand have been counted.
COST = [2.0 if "utf-8" in r else 6.0 for _, r in CHAINS]
#: Weight of a chain that was never seen, in records.
NEVER = 0.05
REPLACED = "�"
#: The model is sent to all executors: of more trigrams than this, those below a least count are left out.
MODEL_GRAMS = 300_000
#: Clean texts that a margin is validated on, at least.
LEAST_VALIDATED = 20
#: Steps of a range that a quantile is looked for in, at once.
STEPS = 1024
#: Log-probability by character from which on a word is taken as it is.
FAMILIAR = -3.2
#: A context is half trusted if it makes up this share of all characters, and was seen so often at least.
TRUST, LEAST_TRUST = 2e-5, 50
#: Texts that a character must be in to count as common.
COMMON = 5
#: Records whose best chain gains less under the first model train the second one.
FIRST_MARGIN = 7.0
#: A run of words must gain more than this by a chain, at least.
LEAST_MARGIN = 4.5
STRAY = 0.005
_BIT = 21
_MASK = (1 << _BIT) - 1
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPLIT = re.compile(r"[ \t\r\n\f\v]+")


def recode(word: str, wrong: str, right: str) -> str | None:
    """The word's bytes under ``wrong`` read as ``right``; None if either step fails."""
    try:
        return encode(word, wrong).decode(right)
    except (UnicodeError, LookupError):
        return None


def encode(word: str, wrong: str) -> bytes:
    """As the codec does; bytes that a one-byte code page leaves undefined stand for themselves."""
    try:
        return word.encode(wrong)
    except UnicodeEncodeError:
        if not wrong.startswith("cp125"):
            raise
        return b"".join(c.encode("latin-1") if 0x80 <= ord(c) <= 0x9F else c.encode(wrong) for c in word)


def read_as(raw: bytes, right: str, wide: bool) -> str | None:
    """Bytes as ``right``; a longer passage from a two-byte encoding may begin or end inside a character."""
    try:
        return raw.decode(right)
    except UnicodeError:
        if len(raw) < 8 or not wide:
            return None
        other = raw.decode(right, "ignore")
        return other if len(other) >= 0.9 * len(raw.decode(right, "replace")) else None


def odd_words(text: str) -> list[str]:
    """Words with characters beyond ASCII, without ASCII punctuation around."""
    return [w.strip(_STRIP) for w in _SPLIT.split(text) if not w.isascii()]


_UTF8_CODES = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp1251", "koi8-r", "cp866", "cp850", "cp1253", "iso8859-7")


class Suspicion:
    """Tells words whose bytes under some one-byte encoding are valid UTF-8 of common characters."""

    def __init__(self, common: frozenset[str]) -> None:
        self.common, self.known = common, {}

    def word(self, word: str) -> bool:
        known = self.known.get(word)
        if known is None:
            known = any((r := recode(word, code, "utf-8")) is not None and len(r) < len(word) and self.common.issuperset(r) for code in _UTF8_CODES)
            if len(self.known) < 300_000:
                self.known[word] = known
        return known

    def clean(self, text: str) -> bool:
        return REPLACED not in text and not any(map(self.word, odd_words(text)))


def char_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(char, n): the number of texts that hold each character."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter(c for t in batch.column(0).to_pylist() if t for c in set(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(ord, n)), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["char", "n"])

    return texts.select(text).mapInArrow(count, "char int, n long").groupBy("char").agg(F.sum("n").alias("n"))


def gram_keys(texts: list[str]) -> np.ndarray:
    """Trigrams of all words with a mark at either end, as numbers; digits are one character."""
    joined = "\x02\x02" + _SPLIT.sub("\x03\x02\x02", "\n".join(texts)) + "\x03"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c[(c >= 48) & (c <= 57)] = 48
    keys = (c[:-2] << (2 * _BIT)) | (c[1:-1] << _BIT) | c[2:]
    return keys[(c[2:] != 2)]


def gram_counts(texts: DataFrame, judge: Callable[[], Callable[[str], bool]], text: str = "text") -> DataFrame:
    """(gram, n) over all texts that the function made by ``judge`` calls clean."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_clean = judge()
        for batch in batches:
            good = [t for t in batch.column(0).to_pylist() if t and is_clean(t)]
            keys, n = np.unique(gram_keys(good), return_counts=True) if good else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["gram", "n"])

    return texts.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class CharModel:
    """Trigrams interpolated with bigrams and single characters.

    A context seen n times is trusted by n / (n + K), K in proportion to all characters: what only a
    few damaged records hold stays improbable although it was counted.
    """

    three: dict[int, float] = field(default_factory=dict)
    two: dict[int, float] = field(default_factory=dict)
    one: dict[int, float] = field(default_factory=dict)
    doubt_three: dict[int, float] = field(default_factory=dict)
    doubt_two: dict[int, float] = field(default_factory=dict)
    unseen: float = -16.0
    remembered: dict[str, float] = field(default_factory=dict)
    chars: set[str] = field(default_factory=set)

    @staticmethod
    def of(grams: np.ndarray, counts: np.ndarray) -> CharModel:
        total = max(counts.sum(), 1)
        k3 = max(LEAST_TRUST, TRUST * total)
        k2 = 5 * k3
        lasts, at_last = np.unique(grams & _MASK, return_inverse=True)
        p_one = np.bincount(at_last, weights=counts) / total
        pairs, at_pair = np.unique(grams & ((1 << 2 * _BIT) - 1), return_inverse=True)
        n_pair = np.bincount(at_pair, weights=counts)
        firsts, at_first = np.unique(pairs >> _BIT, return_inverse=True)
        n_first = np.bincount(at_first, weights=n_pair)
        trust_two = n_first / (n_first + k2)
        p_two = trust_two[at_first] * n_pair / n_first[at_first] + (1 - trust_two[at_first]) * p_one[np.searchsorted(lasts, pairs & _MASK)]
        contexts, at_context = np.unique(grams >> _BIT, return_inverse=True)
        n_context = np.bincount(at_context, weights=counts)
        trust_three = 0.95 * n_context / (n_context + k3)
        p_three = trust_three[at_context] * counts / n_context[at_context] + (1 - trust_three[at_context]) * p_two[at_pair]
        to = lambda k, p: dict(zip(k.tolist(), np.log(p).tolist()))
        return CharModel(to(grams, p_three), to(pairs, p_two), to(lasts, p_one), to(contexts, 1 - trust_three), to(firsts, 1 - trust_two), float(np.log(0.1 / total)))

    def score(self, word: str) -> float:
        """Log-probability of a word between blanks."""
        s = self.remembered.get(word)
        if s is None:
            s = 0.0
            a = b = 2
            three, two, one, doubt_three, doubt_two = self.three, self.two, self.one, self.doubt_three, self.doubt_two
            for ch in word + "\x03":
                c = ord(ch)
                if 48 <= c <= 57:
                    c = 48
                elif c in (32, 10, 9, 13):
                    c = 3
                p = three.get((a << 42) | (b << 21) | c)
                if p is None:
                    p = two.get((b << 21) | c)
                    if p is None:
                        p = one.get(c, self.unseen) + doubt_two.get(b, 0.0)
                    p += doubt_three.get((a << 21) | b, 0.0)
                s += p
                a, b = (2, 2) if c == 3 else (b, c)
            if len(self.remembered) < 400_000 and len(word) < 40:
                self.remembered[word] = s
        return s

    def knows(self, text: str) -> bool:
        if not self.chars:
            self.chars.update(map(chr, self.one), " \n\t0123456789")
        return self.chars.issuperset(text)


class Repairer:
    """Finds and restores wrongly decoded runs of words."""

    def __init__(self, model: CharModel, margin: float, cost: list[float] = COST) -> None:
        self.model, self.margin, self.cost = model, margin, cost
        self.gains: dict[str, dict[int, tuple[float, str]] | None] = {}

    def options(self, word: str) -> dict[int, tuple[float, str]] | None:
        """By chain, how much likelier the word gets, and what it becomes; None: it is familiar."""
        if word in self.gains:
            return self.gains[word]
        before = self.model.score(word)
        out: dict[int, tuple[float, str]] | None = None
        if before < FAMILIAR * (len(word) + 1) and REPLACED not in word:
            out, results = {}, {}
            encoded: dict[str, bytes | None] = {}
            decoded: dict[tuple[bytes, str, bool], str | None] = {}
            for k, (wrong, right) in enumerate(CHAINS):
                if "," in wrong:
                    once = recode(word, wrong.split(",")[0], "utf-8")
                    other = recode(once, wrong.split(",")[0], "utf-8") if once else None
                    if other and other != once and self.model.knows(other):
                        out[k] = (self.model.score(other) - before, other)
                    continue
                if wrong not in encoded:
                    try:
                        encoded[wrong] = encode(word, wrong)
                    except UnicodeError:
                        encoded[wrong] = None
                raw = encoded[wrong]
                if raw is None:
                    continue
                # Several encodings give the same bytes for a word.
                key = raw, right, wrong[:5] == "utf-1"
                if key not in decoded:
                    decoded[key] = read_as(*key)
                other = decoded[key]
                if other is None:
                    continue
                if other == word:
                    out[k] = (0.0, word)  # the chain leaves it as it is
                if other == word or not other:
                    continue
                if other not in results:
                    results[other] = self.model.score(other) - before if self.model.knows(other) else None
                if results[other] is not None:
                    out[k] = (results[other], other)
        if len(self.gains) < 200_000 and len(word) < 40:
            self.gains[word] = out
        return out

    def best(self, text: str) -> tuple[float, int, int, int, list[str]]:
        """(gain, chain, first, last, words): the run of odd words that gains most under one chain."""
        words = odd_words(text)
        options = [self.options(w) for w in words]
        best = (0.0, -1, 0, 0)
        tried = {k for o in options if o for k, (g, _) in o.items() if g > 0}
        for k in tried:
            run, begin = -self.cost[k], 0
            for i, o in enumerate(options):
                # Familiar words inside a damaged run speak against it, as do words the chain can't read.
                g = -2.0 if o is None else o[k][0] if k in o else -6.0
                if run <= -self.cost[k]:
                    run, begin = -self.cost[k], i
                run += g
                if run > best[0] + 1e-9:
                    best = (run, k, begin, i)
        return (*best, words)

    def repair(self, text: str | None) -> tuple[bool, bool, float, str, str]:
        """(damaged, restored wholly, largest gain, chains, text after restoring).

        Every round makes the text likelier by the margin or more. A text that comes back as it was before ends the rounds,
        and then it is not restored."""
        if not text:
            return False, False, 0.0, "", text or ""
        lossy, top, chains, seen_texts = REPLACED in text, 0.0, [], set()
        while text not in seen_texts:
            seen_texts.add(text)
            gain, k, first, last, words = self.best(text)
            if gain < self.margin:
                top = max(top, gain)
                break
            top = max(top, gain)
            chains.append(">".join(CHAINS[k]))
            out, seen = [], -1
            for piece in re.split(r"([ \t\r\n\f\v]+)", text):
                if piece and not piece.isascii():
                    seen += 1
                    o = self.options(words[seen]) if first <= seen <= last else None
                    if o and k in o and words[seen]:
                        piece = piece.replace(words[seen], o[k][1], 1)
                out.append(piece)
            text = "".join(out)
        else:
            lossy = True
        damaged = lossy or bool(chains)
        return damaged, damaged and not lossy, top, ",".join(chains), text


def lower_quantile(values: DataFrame, share: float) -> float:
    """The value of column gain at the place floor(share * (n - 1)) of their order, exactly: by counts of ever narrower steps."""
    n, low, high = values.agg(F.count("gain"), F.min("gain"), F.max("gain")).first()
    place = int((n - 1) * share)
    while low < high:
        step = F.least(F.floor((F.col("gain") - low) / ((high - low) / STEPS)), F.lit(STEPS - 1))
        counts = values.where(F.col("gain").between(low, high)).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("gain").alias("low"), F.max("gain").alias("high"))
        for r in sorted(counts.collect(), key=lambda r: r.step):  # STEPS rows at most
            if place < r.n:
                low, high = r.low, r.high
                break
            place -= r.n
    return low


def validated_margin(gains: DataFrame) -> float:
    """The smallest margin that at most a share of STRAY of the clean texts' gains reaches, so that the few
    damaged ones that the first model let pass don't raise it."""
    if gains.limit(LEAST_VALIDATED).count() < LEAST_VALIDATED:
        return 4.0
    return max(LEAST_MARGIN, lower_quantile(gains, 1 - STRAY) + 0.5)


def least_count(counts: DataFrame, most: int = MODEL_GRAMS) -> int:
    """The smallest count from which on there are at most ``most`` grams, from the numbers of grams by the logarithm of their counts."""
    # Steps of a factor of 2 ** (1/8) in the count; below 12 every count is a step of its own.
    step = F.when(F.col("n") < 12, F.col("n")).otherwise(F.floor(F.log2(F.col("n").cast("double")) * 8))
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("grams"), F.min("n").alias("least")).orderBy(F.desc("least")).collect()
    held, least = 0, None
    for r in steps:  # some 500 rows at most
        held += r.grams
        if held > most:
            break
        least = r.least
    return least if least is not None else (steps[0].least if steps else 1)


def fit(rows: DataFrame, judge: Callable[[], Callable[[str], bool]]) -> CharModel:
    counts = materialise(gram_counts(rows, judge))
    kept = counts.where(F.col("n") >= least_count(counts)).orderBy("gram").toArrow()
    discard(counts)
    if not kept.num_rows:
        return CharModel()
    return CharModel.of(np.asarray(kept.column("gram").combine_chunks()), np.asarray(kept.column("n").combine_chunks()).astype(float))


def train(rows: DataFrame) -> tuple[CharModel, float, list[float], DataFrame]:
    """The model of all clean texts (of columns id, text), the margin validated on them, the chains' costs, and rows with what
    the best chain gains under that model."""
    sc = rows.sparkSession.sparkContext
    common = {chr(r.char) for r in char_counts(rows).where(F.col("n") >= COMMON).select("char").collect()}  # no more than Unicode has
    frozen = frozenset(common - {REPLACED})
    first = sc.broadcast(fit(rows, lambda: Suspicion(frozen).clean))

    def best_of(repairer: Repairer, batch: pa.RecordBatch) -> tuple[list, list]:
        best = [(0.0, -1) if t.isascii() else repairer.best(t)[:2] for t in batch.column(1).to_pylist()]
        return [b[0] for b in best], [b[1] for b in best]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(first.value, FIRST_MARGIN)
        for batch in batches:
            gain, chain = best_of(repairer, batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gain, pa.float64()), pa.array(chain, pa.int32())], names=["id", "text", "gain", "chain"])

    judged = materialise(rows.select("id", "text").mapInArrow(judge, "id long, text string, gain double, chain int"))
    passed = (F.col("gain") < FIRST_MARGIN) & ~F.col("text").contains(REPLACED)
    model = fit(judged.where(passed).select("text"), lambda: bool)
    # How often each chain was seen says what it costs from now on.
    seen = {r.chain: r.n for r in judged.where(F.col("gain") >= FIRST_MARGIN).groupBy("chain").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(seen.values()) + NEVER * len(CHAINS)
    cost = [-float(np.log((seen.get(k, 0) + NEVER) / whole)) for k in range(len(CHAINS))] if seen else COST
    second = sc.broadcast((model, cost))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, costs = second.value
        repairer = Repairer(own, float("inf"), costs)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(best_of(repairer, batch)[0], pa.float64())], names=["id", "text", "clean", "gain"])

    scored = materialise(judged.select("id", "text", passed.alias("clean")).mapInArrow(score, "id long, text string, clean boolean, gain double"))
    discard(judged)
    # Equal texts count once.
    gains = materialise(scored.where(F.col("clean") & F.col("text").rlike(r"[^\x00-\x7f]")).groupBy(F.xxhash64("text").alias("h")).agg(F.min("gain").alias("gain")))
    margin = validated_margin(gains)
    discard(gains)
    return model, margin, cost, scored


def garbled(texts: DataFrame, doc_id: str = "file_id", text: str = "text") -> DataFrame:
    """(id, damaged, restorable, gain, chains, restored) of every record's text."""
    rows = materialise(texts.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).distinct())
    model, margin, cost, scored = train(rows)
    discard(rows)
    shared = rows.sparkSession.sparkContext.broadcast((model, margin, cost))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(*shared.value)
        for batch in batches:
            # The gain is what the first round of repairing would find.
            known = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            out = [repairer.repair(t) if g >= repairer.margin or REPLACED in t else (False, False, g, "", t) for t, g in known]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.bool_(), pa.bool_(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "damaged", "restorable", "gain", "chains", "restored"])

    return scored.select("id", "text", "gain").mapInArrow(work, "id long, damaged boolean, restorable boolean, gain double, chains string, restored string")
