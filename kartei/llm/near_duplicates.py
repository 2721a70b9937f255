"""Problem 2: near-duplicate texts with small edits, insertions or another order.

Method: LSH forest. Each text's set of word sequences is reduced to ``TREES`` signatures of
``DEPTH`` minhashes. Every tree sorts the texts by their signature; texts with a long common prefix
stand next to each other. A region of equal prefix of ``LEAST_DEPTH`` is taken whole while it has
at most ``REGION`` texts; a larger one (shared footers and the like) is split by the next minhash,
again and again, so depth adapts to how crowded a region is. The shuffle goes as deep as the largest regions need.
Candidates are checked exactly, by the intersection of the sequence sets.

Regions of more than ``FAMILY`` texts at full depth are families: texts of one template. The sequences that nearly all of a
sample of them have are its core C. A text x with 2|x & C| - |C| >= least * (2|x| - 2|x & C| + |C|) is central, and any two
central texts are similar enough by that alone (their intersection is at least |x & C| + |y & C| - |C|, and the ratio of sums lies
between the ratios). So a family's links are known without forming its pairs, and it is told as membership. Its texts meet all
other texts as any text does; a region that is too large for one task is dealt into blocks of its family, each with all the others.

Texts with the same words are one class; only its representative (the smallest id) is searched for.

At the defaults a pair with similarity 0.5 is missed by all trees with a chance of 0.75**32 (1e-4) in regions that are not crowded;
where a footer crowds them and depth grows, more (0.5 ** depth instead of 0.25 for a tree). Families are exact.

Defined results: null, empty and short texts (fewer than ``least_words`` words) take no part;
repeated rows count once; an id with several texts takes part with each of them, never with itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kartei.plans.lineage import discard, materialise

from .components import components
from .words import hash_word, rolling, scramble, words_of

TREES, DEPTH, LEAST_DEPTH, REGION = 32, 6, 2, 48
#: Texts of a region from which on the next minhash joins the key of the shuffle, and at full depth texts of a block.
HEAVY = 5000
#: Texts of a full-depth region that make a family, how many of them show its core, and in what share of those.
FAMILY, SHOWN, CORE = 200, 64, 0.9
#: Classes of equal texts up to this size are written out pair by pair; larger ones as pairs with their representative.
COPIES = 100
_FACTORS = scramble(np.arange(1, TREES * DEPTH + 1)) | np.uint64(1)
_SHIFTS = scramble(np.arange(1, TREES * DEPTH + 1) + 1_000_003)


def _shingle_rows(batches: Iterator[pa.RecordBatch], size: int, least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, digests, arrays = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if len(words) < max(least_words, size):
                continue
            # Word ids must agree between texts: a hash of each word.
            ids.append(doc)
            digests.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            h = np.fromiter((hash_word(w) for w in words), np.int64, len(words))
            arrays.append(np.unique((rolling(h, size) >> np.uint64(32)).astype(np.uint32).view(np.int32)))
        offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        flat = pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "digest", "shingles"])


def _signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minhashes (sets, TREES * DEPTH) as int32 of non-empty sets that lie one after another."""
    x = scramble(flat.view(np.uint32))
    out = np.empty((len(starts), len(_FACTORS)), np.int32)
    for k, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS)):
        out[:, k] = np.minimum.reduceat((x * factor + shift) >> np.uint64(32), starts).astype(np.uint32).view(np.int32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            sets = part.column("shingles")
            flat, ends = np.asarray(sets.flatten()), np.asarray(sets.value_lengths()).astype(np.int64)
            s = _signatures(flat, np.cumsum(ends) - ends)
            offsets = pa.array((np.arange(len(s) + 1) * s.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("id"), sets, pa.ListArray.from_arrays(offsets, pa.array(s.ravel()))], names=["id", "shingles", "sig"])


def _pairs_of(ids: np.ndarray, family: np.ndarray, keys: np.ndarray, depth: int, dealt: np.ndarray, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one region, sorted by its keys from ``depth`` on; none inside a family (0 is none).

    A family counts as one text when it is asked how crowded a region is. Rows that are ``dealt`` stand in one block only; pairs
    of the others are formed in the ``first`` block."""
    n = len(ids)
    if n < 2:
        return
    lone = family == 0
    crowd = int(lone.sum())
    groups = len(np.unique(family[~lone])) if crowd < n else 0
    if groups == 1 and crowd == 0:
        return
    if groups == 0 and n <= REGION:
        i, j = np.triu_indices(n, 1)
        keep = first | dealt[i] | dealt[j]
        yield ids[i[keep]], ids[j[keep]]
    elif crowd + groups <= REGION or depth == keys.shape[1]:
        # Texts of no family meet all; families meet one another where they agree in all minhashes.
        single, others = np.flatnonzero(lone), np.flatnonzero(~lone)
        for at, a in enumerate(single.tolist()):
            for rest in (single[at + 1 :], others):
                met = ids[rest if first else rest[dealt[rest] | dealt[a]]]
                yield np.repeat(ids[a : a + 1], len(met)), met
        if groups > 1:
            yield from _between_families(ids[others], family[others], keys[others], depth, dealt[others], first)
    else:
        cuts = np.concatenate([[0], np.nonzero(keys[1:, depth] != keys[:-1, depth])[0] + 1, [n]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield from _pairs_of(ids[a:b], family[a:b], keys[a:b], depth + 1, dealt[a:b], first)


def _between_families(ids: np.ndarray, family: np.ndarray, keys: np.ndarray, depth: int, dealt: np.ndarray, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(ids) < 2 or (family == family[0]).all():
        return
    if depth < keys.shape[1] and len(ids) > REGION:
        cuts = np.concatenate([[0], np.nonzero(keys[1:, depth] != keys[:-1, depth])[0] + 1, [len(ids)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield from _between_families(ids[a:b], family[a:b], keys[a:b], depth + 1, dealt[a:b], first)
        return
    order = np.argsort(family, kind="stable")
    ids, family, dealt = ids[order], family[order], dealt[order]
    behind = np.searchsorted(family, family, side="right")
    for a in range(int(np.searchsorted(family, family[-1]))):
        rest = np.arange(behind[a], len(ids))
        met = ids[rest if first else rest[dealt[rest] | dealt[a]]]
        yield np.repeat(ids[a : a + 1], len(met)), met


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (tree, prefix, ahead, block, further minhashes): the candidate pairs of all regions."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def regions(group: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, family, dealt, keys = rows[:, 0], rows[:, 1], rows[:, 2] > 0, rows[:, 3:]
        cuts = np.concatenate([[0], np.nonzero((group[1:] != group[:-1]).any(1))[0] + 1, [len(ids)]])
        size = np.diff(cuts)
        twos = cuts[:-1][size == 2]
        twos = twos[(family[twos] != family[twos + 1]) | (family[twos] == 0)]
        got, waiting = [(ids[twos], ids[twos + 1])], len(twos)
        for a, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist()):
            part = slice(a, a + n)
            for pair in _pairs_of(ids[part], family[part], keys[part], 0, dealt[part], group[a, 3] == 0):
                got.append(pair)
                waiting += len(pair[0])
                if waiting > 500_000:
                    yield pack(got)
                    got, waiting = [], 0
        if waiting:
            yield pack(got)

    def pack(got: list) -> pa.RecordBatch:
        x, y = (np.concatenate([p[k] for p in got]) for k in (0, 1))
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("tree", "prefix", "ahead", "block")], 1)
        rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("id", "family", "dealt", *(f"h{k}" for k in range(LEAST_DEPTH, DEPTH)))], 1)
        new = np.nonzero((group[1:] != group[:-1]).any(1))[0]
        last = int(new[-1]) + 1 if len(new) else 0
        if not last and (not held or (held[-1][0][-1] == group[0]).all()):
            held.append((group, rows))  # a region over several batches is put together once
            continue
        whole = [*held, (group[:last], rows[:last])]
        yield from regions(*(np.concatenate([x[k] for x in whole]) for k in (0, 1)))
        held = [(group[last:], rows[last:])]
    if held:
        yield from regions(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))


def shingle_sets(texts: DataFrame, doc_id: str, text: str, size: int, least_words: int) -> DataFrame:
    rows = texts.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda batches: _shingle_rows(batches, size, least_words), "id long, digest binary, shingles array<int>")


def tree_rows(signed: DataFrame) -> DataFrame:
    """(id, tree, prefix, h2, ...): a row for each tree."""
    return signed.select("id", F.posexplode(F.array(*(F.slice("sig", t * DEPTH + 1, DEPTH) for t in range(TREES)))).alias("tree", "s")).select(
        "id", "tree", (F.shiftleft(F.col("s")[0].cast("long"), 32) + (F.col("s")[1].cast("long") + 2**31)).alias("prefix"), *(F.col("s")[k].alias(f"h{k}") for k in range(LEAST_DEPTH, DEPTH))
    )


def _crowded(rows: DataFrame, keys: list[str], least: int) -> DataFrame | None:
    """Keys with more than ``least`` rows, None without any; at most TREES * n / least, so they are broadcast where that is few."""
    found = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > least))
    count = found.count()
    if not count:
        discard(found)
        return None
    return F.broadcast(found) if count <= 100_000 else found


def families(signed: DataFrame, wide: DataFrame | None, least: float) -> DataFrame | None:
    """(id, family) of the central texts of crowded full-depth regions, None without any. signed: (id, shingles, sig); wide:
    (tree, prefix, texts) of prefixes with more than FAMILY texts."""
    if wide is None:
        return None
    trees = tree_rows(signed.select("id", "sig"))
    deep = [f"h{k}" for k in range(LEAST_DEPTH, DEPTH)]
    full = trees.join(wide.drop("texts"), ["tree", "prefix"], "left_semi").select("id", F.xxhash64("tree", "prefix", *deep).alias("region"))
    crowded = _crowded(full, ["region"], FAMILY)
    if crowded is None:
        return None
    inside = materialise(full.join(crowded, "region"))
    shown = inside.where(F.pmod(F.xxhash64("id"), F.col("texts")) < SHOWN).join(signed.select("id", "shingles"), "id")
    seen = shown.groupBy("region").agg(F.count(F.lit(1)).alias("shown"))
    common = shown.select("region", F.explode("shingles").alias("g")).groupBy("region", "g").agg(F.count(F.lit(1)).alias("n")).join(seen, "region").where(F.col("n") >= CORE * F.col("shown"))
    cores = common.groupBy("region").agg(F.sort_array(F.collect_list("g")).alias("core")).withColumn("family", F.xxhash64("core"))
    # Several trees show the same core: one family.
    cores = materialise(cores.where(F.col("family") != 0))
    distinct = cores.groupBy("family").agg(F.first("core").alias("core"))
    asked = inside.join(cores.select("region", "family"), "region").select("id", "family").distinct()
    tried = asked.join(signed.select("id", "shingles"), "id").join(distinct, "family")
    held, size, core = F.size(F.array_intersect("shingles", "core")), F.size("shingles"), F.size("core")
    central = materialise(tried.where(2 * held - core >= least * (2 * size - 2 * held + core)).select("id", "family"))
    largest = central.groupBy("family").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    return materialise(central.join(largest, "family").groupBy("id").agg(F.max(F.struct("texts", "family")).alias("x")).select("id", "x.family"))


def candidates(signed: DataFrame, known: DataFrame | None, wide: DataFrame | None) -> DataFrame:
    """Distinct pairs of ids that share a region of some tree and no family. signed: (id, sig); known: (id, family); wide: as in families."""
    n = signed.count()
    trees = tree_rows(signed)
    trees = trees.join(known, "id", "left").withColumn("family", F.coalesce("family", F.lit(0))) if known is not None else trees.withColumn("family", F.lit(0).cast("long"))
    least = max(HEAVY, TREES * n // 100_000)
    keyed = trees.withColumns({"ahead": F.lit(0).cast("long"), "block": F.lit(0), "dealt": F.lit(False)})
    done = None
    for k in range(LEAST_DEPTH, DEPTH + 1):
        if k == LEAST_DEPTH and least >= FAMILY:
            known_wide = None if wide is None else wide.where(F.col("texts") > least).withColumn("ahead", F.lit(0).cast("long"))
            heavy = known_wide if known_wide is not None and known_wide.limit(1).count() else None
        else:
            heavy = _crowded(keyed, ["tree", "prefix", "ahead"], least)
        if heavy is None:
            break
        # A region of little else than families is dealt into blocks of its largest one, the others stand in each; and so is
        # any at full depth. The rest goes one minhash deeper.
        marked = keyed.join(heavy, ["tree", "prefix", "ahead"], "left")
        kinds = marked.where("texts is not null").groupBy("tree", "prefix", "ahead", "family").agg(F.count(F.lit(1)).alias("m"))
        main = kinds.groupBy("tree", "prefix", "ahead").agg(F.max(F.struct((F.col("family") != 0).alias("is"), "m", "family")).alias("main"), F.sum(F.when(F.col("family") == 0, F.col("m")).otherwise(1)).alias("crowd"))
        main = main.where(F.col("main.is") & ((F.col("crowd") <= REGION) | F.lit(k == DEPTH)) & (F.col("main.m") > least))
        marked = marked.join(F.broadcast(main), ["tree", "prefix", "ahead"], "left")
        blocks = F.ceil(F.col("main.m") / least).cast("int")
        deal = F.coalesce(F.col("family") == F.col("main.family"), F.lit(False))
        where = F.when(deal, F.array(F.pmod(F.xxhash64("id"), blocks).cast("int"))).when(F.col("main").isNotNull(), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("block"))
        keyed = marked.withColumns({"dealt": F.col("dealt") | deal, "block": F.explode(where)})
        if k < DEPTH:
            deeper = F.col("texts").isNotNull() & F.col("main").isNull()
            keyed = keyed.withColumn("ahead", F.when(deeper, F.xxhash64("ahead", f"h{k}")).otherwise(F.col("ahead")))
        # What has been dealt doesn't count as crowded again.
        settled = keyed.where("main is not null").drop("texts", "main", "crowd")
        done = settled if done is None else done.unionByName(settled)
        keyed = keyed.where("main is null").drop("texts", "main", "crowd")
    if done is not None:
        keyed = keyed.unionByName(done)
    order = ["tree", "prefix", "ahead", "block", *(f"h{k}" for k in range(LEAST_DEPTH, DEPTH))]
    placed = keyed.select(*order, "id", "family", "dealt").repartition("tree", "prefix", "ahead", "block").sortWithinPartitions(*order, "id")
    return placed.mapInArrow(_neighbours, "a long, b long").distinct()


def similar_texts(texts: DataFrame, doc_id: str, text: str, size: int = 5, least: float = 0.8, least_words: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, members, families): links (a, b, shared, size_a, size_b, similarity) between representatives of
    different texts with a similarity of at least ``least`` that are in no common family; members (id, rep) of all classes
    of equal texts; families (id, family) of representatives that are all linked to one another."""
    sets = materialise(shingle_sets(texts, doc_id, text, size, least_words))
    heads = sets.groupBy("digest").agg(F.min("id").alias("rep"))
    members = materialise(sets.select("id", "digest").distinct().join(heads, "digest").select("id", "rep"))
    signed = materialise(sets.join(heads.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"]).mapInArrow(_sign, "id long, shingles array<int>, sig array<int>"))
    discard(sets)
    # An id that stands for several texts takes part pair by pair.
    several = signed.groupBy("id").count().where("count > 1").select("id")
    wide = _crowded(tree_rows(signed.select("id", "sig")), ["tree", "prefix"], FAMILY)
    known = families(signed, wide, least)
    if known is not None:
        known = materialise(known.join(several, "id", "left_anti"))
    pairs = candidates(signed.select("id", "sig"), known, wide)
    left = signed.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = signed.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    checked = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"), F.size("sa").alias("size_a"), F.size("sb").alias("size_b"))
    similarity = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    found = checked.withColumn("similarity", similarity).where(F.col("similarity") >= least)
    return found, members, known if known is not None else texts.sparkSession.createDataFrame([], "id long, family long")


def family_pairs(known: DataFrame) -> DataFrame:
    """(a, b) of all texts of each family, in blocks: as many rows as there are links, spread over block pairs."""
    sized = known.join(known.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / HEAVY).cast("int").alias("blocks")), "family")
    placed = sized.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = lambda name: placed.select("family", F.col("id").alias(name), F.col("own").alias(f"{name}_own"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return cell("a").join(cell("b"), ["family", "low", "high"]).where("a < b").select("a", "b")


def similar_pairs(links: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """Links written out for all ids, those of families included: (id_a, id_b), id_a < id_b.

    Classes of more than ``COPIES`` equal texts stay folded: each member is paired with the
    representative, and links of the class are links of the representative.
    """
    # An id may stand for several texts, so a class is told by its representative and size.
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    sized = materialise(members.join(size, "rep"))
    shown = sized.where((F.col("copies") <= COPIES) | (F.col("id") == F.col("rep"))).select("id", "rep")
    links = links.select("a", "b").unionByName(family_pairs(known))
    across = links.join(shown.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(shown.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    several = sized.where((F.col("copies") > 1) & (F.col("copies") <= COPIES))
    equal = several.select("rep", F.col("id").alias("x")).join(several.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    folded = sized.where((F.col("copies") > COPIES) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y"))
    every = across.unionByName(equal).unionByName(folded).where("x != y")
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def duplicate_classes(links: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """(id, class_id, copies, links): one row per id that has a copy or a near-duplicate.

    class_id is the smallest id of all texts connected by links; links counts the different texts linked. A family is connected
    through its smallest id, and each of its texts is linked to all others, so its pairs are counted but never formed.
    """
    links = materialise(links.select("a", "b"))
    size = known.groupBy("family").agg(F.min("id").alias("head"), (F.count(F.lit(1)) - 1).alias("links"))
    inside = known.join(size, "family")
    joined = components(links.unionByName(inside.select(F.col("head").alias("a"), F.col("id").alias("b")).where("a != b")))
    ends = links.select(F.col("a").alias("rep"), F.lit(1).cast("long").alias("links")).unionByName(links.select(F.col("b").alias("rep"), F.lit(1).cast("long").alias("links")))
    degree = ends.unionByName(inside.select(F.col("id").alias("rep"), "links")).groupBy("rep").agg(F.sum("links").alias("links"))
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    rows = members.join(size, "rep").join(degree, "rep", "left").join(joined.withColumnRenamed("vertex", "rep"), "rep", "left")
    return (
        rows.where((F.col("copies") > 1) | F.col("links").isNotNull())
        .groupBy("id")
        .agg(F.min(F.coalesce("label", "rep")).alias("class_id"), F.max("copies").alias("copies"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
    )
