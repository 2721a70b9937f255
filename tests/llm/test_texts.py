import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kartei.llm import encodings as E, leaks as L, near_duplicates as N, repetition as R
from kartei.llm.mixture import mixture, pfair, quotas
from kartei.llm.term_weights import characteristic, term_weights
from kartei.llm.words import rolling, window_mask, words_of

LONG = "word " * 30_000


def sentence(rng, n, size=900):
    return " ".join(f"{'bcdfgklmnprst'[rng.randrange(13)]}{'aeiou'[rng.randrange(5)]}{rng.randrange(size)}" for _ in range(n))


# --- words ---


def test_windows():
    ends = np.array([0, 3, 3, 5])
    assert window_mask(ends, 2).tolist() == [True, True, False, True] and window_mask(ends, 9).tolist() == [] and not len(rolling(np.zeros(2, np.int64), 3))
    assert words_of("Ça_va, 3-4²!") == ["ça", "va", "3", "4²"] and words_of(None) == words_of("") == []


# --- problem 2 ---


def shingles(text, n=3):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def edited(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        k = rng.randrange(len(w))
        w[k : k + 1] = [[], ["new", w[k]], ["other"]][rng.randrange(3)]
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    footer = " " + sentence(rng, 25)
    base = [sentence(rng, rng.randrange(25, 120)) for _ in range(60)]
    texts = base + [edited(rng, rng.choice(base), s) for s in (0.02, 0.05, 0.1, 0.15) for _ in range(40)] + [sentence(rng, 40) + footer for _ in range(150)] + [base[0]] * 3 + [base[0].upper() + "!"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "too short"), (0, texts[0]), (None, texts[0]), (903, LONG), (904, LONG)]
    df = spark.createDataFrame(rows, "file_id long, text string").withColumn("id", F.lit(1)).withColumn("rep", F.lit("x"))
    found = N.similar_texts(df, "file_id", "text", size=3, least=0.5, least_words=20)
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(*found).collect()}
    sets = [shingles(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5} | {(903, 904)}
    assert got == want
    classes = {r.id: r for r in N.duplicate_classes(*found).collect()}
    assert set(classes) == {i for p in want for i in p} and classes[904].class_id == 903 and classes[0].copies == 5


def test_large_classes_stay_folded(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 3)
    rng = random.Random(0)
    a = sentence(rng, 40)
    df = spark.createDataFrame([(i, a) for i in range(6)] + [(9, a + " end")], "file_id long, text string")
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(*N.similar_texts(df, "file_id", "text", 3, 0.5)).collect()}
    assert got == {(0, i) for i in range(1, 6)} | {(0, 9)}


def test_crowded_regions_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "REGION", 4)
    monkeypatch.setattr(N, "HEAVY", 3)
    rng = random.Random(5)
    a = sentence(rng, 60)
    texts = [a + f" tail{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    assert N.similar_pairs(*N.similar_texts(df, "file_id", "text", 3, 0.5)).count() == 30 * 29 // 2


def test_families_lose_nothing(spark, monkeypatch):
    """Two templates with numbers, texts near one of them, and others, with regions that are dealt into blocks."""
    for name, value in (("REGION", 16), ("HEAVY", 20), ("FAMILY", 18), ("SHOWN", 10)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(8)
    one, two = sentence(rng, 30).rstrip("."), sentence(rng, 45).rstrip(".")
    texts = [f"{one} number {k} ends" for k in range(80)] + [f"{two} {k} and so on" for k in range(50)]
    texts += [edited(rng, rng.choice(texts[:130]), 0.1) for _ in range(30)] + [sentence(rng, 40) for _ in range(20)] + texts[:2]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    found = N.similar_texts(df, "file_id", "text", 3, 0.5)
    sets = [shingles(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(*found).collect()}
    assert found[2].count() > 100 and got <= want and len(got) >= 0.995 * len(want)  # crowded regions go deeper
    classes = {r.id: r for r in N.duplicate_classes(*found).collect()}
    assert set(classes) == {i for p in got for i in p} and {classes[k].class_id for k in range(80)} == {0} and classes[40].links >= 79 - 2


def test_a_large_family_is_no_square(spark):
    df = spark.range(20_000).select(F.col("id").alias("file_id"), F.concat(F.lit(" ".join(f"word{k}" for k in range(30))), F.lit(" number "), F.col("id"), F.lit(" of many that are alike")).alias("text"))
    rows = N.duplicate_classes(*N.similar_texts(df, "file_id", "text", 3, 0.5)).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.min("links").alias("least"))
    assert [(r.class_id, r.n, r.least) for r in rows.collect()] == [(0, 20_000, 19_999)]


def test_no_texts(spark):
    df = spark.createDataFrame([], "file_id long, text string")
    assert N.similar_pairs(*N.similar_texts(df, "file_id", "text")).count() == 0


# --- problem 3 ---


def test_term_weights(spark):
    rows = [(1, "Oak", 2), (1, " oak ", 1), (1, "elm", 3), (2, "oak", 1), (2, "oak", 1), (2, None, 4), (2, "ash", 0), (2, "ash", -1), (2, "ash", None), (None, "ash", 1), (3, "  ", 5)]
    df = spark.createDataFrame(rows, "file_id long, term string, n int").withColumn("total", F.lit("x")).withColumn("df", F.lit(9)).withColumn("record", F.lit(7))
    out = {(r.record, r.term): r for r in term_weights(df).collect()}
    assert set(out) == {(1, "oak"), (1, "elm"), (2, "oak")}
    r = out[1, "oak"]
    assert (r.n, r.total, r.df, r.records) == (3, 6, 2, 2) and r.score == pytest.approx(0.5 * (np.log(3 / 3) + 1))
    assert characteristic(term_weights(df), least_df=1).count() == 2
    assert term_weights(spark.createDataFrame([], "file_id long, term string, n int")).count() == 0


# --- problem 4 ---

CLEAN = ["Le déjeuner à l’école est très agréable même en février où les élèves préfèrent le thé", "Большой корабль вышел в открытое море рано утром и вернулся только вечером", "Zażółć gęślą jaźń przez żółty kościół gdzie wszędzie śpiewają", "Η θάλασσα ήταν ήρεμη και το πλοίο έφυγε πολύ νωρίς το πρωί", "plain english words about the quiet harbour and every ship that left it", "Größe über für schöne Straßen und große Häuser während der Übung"]


def corpus(n=1500):
    rng = random.Random(8)
    out = []
    for k in range(n):
        words = CLEAN[k % len(CLEAN)].split()
        out.append(" ".join(rng.choice(words) for _ in range(25)))
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


CASES = [("utf-8", "latin-1"), ("utf-8", "cp437"), ("cp1251", "koi8-r"), ("cp1250", "cp1252"), ("cp1253", "latin-1"), ("utf-8", "utf-16-le"), ("utf-8", "mac_roman")]


def test_damage_is_found_and_restored(spark, texts):
    rng = random.Random(1)
    rows, damaged = [], {}
    for i, t in enumerate(texts):
        if i % 25 == 0 and not t.isascii():
            right, wrong = CASES[(i // 25) % len(CASES)]
            w = t.split(" ")
            a = rng.randrange(5)
            b = a + 12
            while right == "utf-8" and wrong == "utf-16-le" and len(" ".join(w[a:b]).encode()) % 2:
                b -= 1
            passage = " ".join(w[a:b])
            try:
                bad = passage.encode(right).decode(wrong)
            except UnicodeError:
                bad = passage
            if bad != passage and sum(c > "\x7f" for c in passage) >= 3:
                damaged[i] = t
                t = " ".join([*w[:a], bad, *w[b:]])
        rows.append((i, t))
    rows += [(9000, None), (9001, ""), (9002, "caf� au lait"), (9003, LONG), (0, rows[0][1]), (None, "DÃ©jÃ"), (9004, "© ® ™ «note» ¶")]
    df = spark.createDataFrame(rows, "file_id long, text string").withColumn("id", F.lit("x")).withColumn("gain", F.lit(1))
    out = {r.id: r for r in E.garbled(df).collect()}
    found = {i for i, r in out.items() if r.damaged}
    assert len(damaged) > 20 and len(found & set(damaged)) >= 0.9 * len(damaged)
    assert len(found - set(damaged) - {9002}) <= 3 and 9002 in found and not out[9002].restorable and 9003 not in found
    exact = sum(out[i].restored == t for i, t in damaged.items() if i in found)
    assert exact >= 0.75 * len(damaged)


def test_double_damage(texts):
    model = E.CharModel.of(*np.unique(E.gram_keys(texts), return_counts=True))
    t = "très agréable même en février"
    bad = t.encode().decode("latin-1").encode().decode("latin-1")
    assert E.Repairer(model, 4.0).repair(bad)[4] == t and E.Repairer(model, 4.0).repair(t) == (False, False, 0.0, "", t)


def test_margin_counts_all_clean_texts(spark, texts, monkeypatch):
    """Every text passes as clean here, damaged ones, too, so that what a few gain tells whether all were counted."""
    monkeypatch.setattr(E, "FIRST_MARGIN", 1e9)
    rows = []
    for i, t in enumerate(texts):
        right, wrong = CASES[i // 61 % len(CASES)]
        try:
            rows.append((i, t.encode(right).decode(wrong) if i % 61 == 0 else t))
        except UnicodeError:
            rows.append((i, t))
    rows += [(5000 + i, t) for i, t in rows[:300]]  # equal texts count once
    model, margin, cost = E.train(spark.createDataFrame(rows, "id long, text string"))[:3]
    repairer = E.Repairer(model, float("inf"), cost)
    gains = [repairer.best(t)[0] for t in sorted({t for _, t in rows if not t.isascii()})]
    assert margin == pytest.approx(max(E.LEAST_MARGIN, np.quantile(gains, 1 - E.STRAY, method="lower") + 0.5)) and margin > E.LEAST_MARGIN


@pytest.mark.parametrize("values", [[3.5], [0.0] * 50 + [1.0], [-1e-9, 0.0, 1e-9, 1e6], np.random.default_rng(1).exponential(2, 2500).tolist()])
def test_quantile_is_exact(spark, values):
    table = spark.createDataFrame([(v,) for v in values], "gain double")
    for share in (0.0, 0.5, 0.995, 1.0):
        assert E.lower_quantile(table, share) == np.quantile(values, share, method="lower")


def test_empty_table(spark):
    assert E.garbled(spark.createDataFrame([], "file_id long, text string")).count() == 0


# --- problem 6 ---


def slow_tiles(a, b, least):
    """Greedy string tiling as it is defined, by trying everything."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return tiles
        n, i, j = best
        tiles.append((i, j, n))
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(2, 4))
def test_tiles_equal_the_definition(a, b, least):
    got = L.tile(np.array(a, np.int64), np.array(b, np.int64), least)
    want = slow_tiles(a, b, least)
    assert sum(n for *_, n in got) == sum(n for *_, n in want) and [n for *_, n in got][:1] == [n for *_, n in want][:1]


def test_tiling_of_loops_is_no_square():
    a, b = np.tile(np.arange(4), 20_000), np.tile(np.arange(4), 15_000)
    assert sum(n for *_, n in L.tile(a, b, 8)) == 60_000


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    items = [sentence(rng, 40, 30) for _ in range(30)]
    docs = []
    for k in range(120):
        t = sentence(rng, 80)
        if k % 3 == 0:
            w, a, n = words_of(rng.choice(items)), rng.randrange(20), rng.choice([10, 11, 12, 13, 20])
            t += ".\n" + ", ".join(x.upper() for x in w[a : a + n]) + " " + sentence(rng, 10)
        docs.append(t)
    halves = [words_of(items[0])[i : i + 10] for i in range(0, 40, 10)]
    docs.append(" zz ".join(" ".join(h) for h in (halves[2], halves[0], halves[3], halves[1])))
    rows = list(enumerate(docs)) + [(500, None), (501, ""), (502, LONG), (0, docs[0]), (None, items[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("longest", F.lit(0))
    tests = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, "few words"), (0, items[0])], "item_id long, text string")
    for bits in (L.FILTER_BITS, 1 << 10):  # a full table lets all pass; the join is exact
        monkeypatch.setattr(L, "FILTER_BITS", bits)
        tiles = L.leaked_passages(df, tests)
        got = {(r.doc_id, r.item_id) for r in tiles.where("longest >= 12").collect()}
        run = lambda t: {tuple(words_of(t)[i : i + 12]) for i in range(len(words_of(t)) - 11)}
        assert got == {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if run(t) & run(x)}
        assert (120, 0) in {(r.doc_id, r.item_id) for r in L.leaks(tiles).collect()} - got
    assert L.leaked_passages(df.limit(0), tests).count() == 0 and L.leaked_passages(df, tests.limit(0)).count() == 0


# --- problem 7 ---


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=9))
def test_pfair_stays_within_a_block(counts):
    order = pfair(counts)
    share = np.array(counts) / sum(counts)
    given_ = np.cumsum(order[:, None] == np.arange(len(counts)), axis=0)
    assert np.abs(given_ - share * np.arange(1, len(order) + 1)[:, None]).max() < 1 and np.bincount(order).tolist() == counts


@pytest.mark.parametrize("period", [10, 37, 1000])
def test_periods_lose_and_shift_nothing(spark, period):
    rng = random.Random(5)
    rows = [(s, sentence(rng, 8)) for s, n in (("a", 300), ("b", 130), ("c", 21)) for _ in range(n)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    goals = spark.createDataFrame([("a", 0.7, 1), ("b", 0.27, 1), ("c", 0.03, 1)], "source string, weight double, max_repeats int")
    mixed, report = mixture(df, goals, slots=200, period=period)
    out, got = {r.source: r for r in report.collect()}, sorted((r.slot, r.start, r.source, r.tokens) for r in mixed.collect())
    whole = mixture(df, goals, slots=200, period=10**6)[0]
    assert sorted((s, b, t) for _, b, s, t in got) == sorted((r.source, r.start, r.tokens) for r in whole.collect())
    block, most, run, used = sum(r[3] for r in got) / 200, max(r[3] for r in got), 0, Counter()
    for _, _, source, tokens in got:
        run += tokens
        used[source] += tokens
        assert all(abs(used[s] - out[s].share * run) < 2 * block + 2 * most for s in "abc")


def test_quotas():
    w, c = np.array([0.5, 0.3, 0.2]), np.array([100.0, 0.0, 1000.0])
    assert quotas(w, c, None) == pytest.approx([100, 0, 40]) and quotas(w, c, 600) == pytest.approx([100, 0, 500]) and not quotas(w, c * 0, None).any()


def test_mixture(spark):
    rng = random.Random(7)
    rows, i = [], 0
    for source, n in (("big", 300), ("small", 12), ("other", 200), ("untold", 20)):
        for _ in range(n):
            rows.append((i, sentence(rng, 30), source))
            i += 1
    rows += [(i, rows[0][1], "other"), (i + 1, None, "big"), (i + 2, "", "big"), (i + 3, "x y", None), (i + 4, rows[305][1], " SMALL "), (None, "lost", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("x")).withColumn("slot", F.lit(1))
    goals = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("other", 0.25, 1), ("gone", 0.05, 2), (None, 0.1, 1), ("bad", -1.0, 1)], "source string, weight double, max_repeats int")
    mixed, report = mixture(df, goals, slots=50)
    rows = mixed.collect()
    uses = Counter((r.source, r.doc_id) for r in rows)
    limit = {"big": 1, "small": 3, "other": 1}
    assert all(n <= limit[s] for (s, _), n in uses.items()) and (i not in {d for _, d in uses})
    out = {r.source: r for r in report.collect()}
    assert out["gone"].share == 0 and out["small"].most_repeats == 3 and sum(r.share for r in out.values()) == pytest.approx(1)
    total = sum(r.tokens for r in rows)
    for s, w in (("big", 0.5), ("small", 0.2), ("other", 0.25)):
        assert out[s].share == pytest.approx(w / 0.95, abs=max(r.tokens for r in rows) / total * 2) and out[s].used_tokens == sum(r.tokens for r in rows if r.source == s)
    given_ = Counter()
    for slot in sorted({r.slot for r in rows}):
        for r in rows:
            if r.slot == slot:
                given_[r.source] += r.tokens
        whole = sum(given_.values())
        block = max(total / 50, max(r.tokens for r in rows))
        assert all(abs(given_[s] - out[s].share * whole) < 3 * block for s in limit)


def test_one_long_text_drops_no_source(spark):
    rng = random.Random(3)
    sizes = {"big": 200, "mid": 40, "small": 12, "tiny": 6}
    rows = [(s, sentence(rng, 10)) for s, n in sizes.items() for _ in range(n)] + [("big", sentence(rng, 1500))]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    goals = spark.createDataFrame([("big", 0.8, 1), ("mid", 0.16, 1), ("small", 0.025, 1), ("tiny", 0.015, 1)], "source string, weight double, max_repeats int")
    mixed, report = mixture(df, goals, slots=50)
    out = {r.source: r for r in report.collect()}
    assert all(r.used_tokens > 0 for r in out.values()) and out["mid"].share == pytest.approx(0.16, abs=0.08)
    assert {r.source for r in mixed.select("source").distinct().collect()} == set(sizes)
    # Fewer slots than sources: those without a slot of their own come behind the last.
    assert all(r.used_tokens > 0 for r in mixture(df, goals, slots=3)[1].collect())


def test_empty_mixture(spark):
    docs, goals = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string"), spark.createDataFrame([("s", 1.0, None)], "source string, weight double, max_repeats int")
    assert mixture(docs.limit(0), goals)[0].count() == 0 and mixture(docs, goals.limit(0))[1].count() == 0
    assert mixture(docs, goals)[1].first().share == 1.0


# --- problem 8 ---


def counts(text):
    w = words_of(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return len(w), len(grams), len(set(grams))


def test_repetition(spark):
    rng = random.Random(9)
    lines = lambda n: [sentence(rng, 12).capitalize() + "." for _ in range(n)]
    texts, spam = [], set()
    for k in range(200):
        body = lines(12)
        if k % 5 == 0:
            spam.add(k)
            body = [lambda: body + body[2:5] * 6, lambda: body[:3] + [body[0]] * 15, lambda: body + [" ".join(["again and again and"] * 40)]][(k // 5) % 3]()
        texts.append("\n".join(body) if k % 2 else " ".join(body))
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "one"), (903, LONG), (0, texts[0]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("units", F.lit("x")).withColumn("n_words", F.lit(0))
    out = {r.doc_id: r for r in R.repetition(df).collect()}
    for i, t in [*enumerate(texts), (903, LONG), (901, ""), (902, "one")]:
        assert (out[i].n_words, out[i].sequences, out[i].distinct_sequences) == counts(t)
    assert out[900].n_words == 0 and out[900].content_share == 1.0
    found = {r.doc_id for r in R.repetitive(R.repetition(df)).collect()}
    assert found == {i for i, t in [*enumerate(texts), (903, LONG)] if counts(t)[0] >= 50 and 10 * (counts(t)[1] - counts(t)[2]) >= 3 * counts(t)[1]}
    assert all(out[k].keep for k in range(200) if k not in spam) and sum(not out[k].keep for k in spam) >= 0.9 * len(spam)


def test_field_labels_planted_repeats():
    rng = random.Random(4)
    texts = [" ".join(sentence(rng, 10).capitalize() + "." for _ in range(15)) for _ in range(120)]
    field = R.ChainField().fit(*R.planted(texts[:80]))
    x, labels, n = R.planted(texts[80:], seed=99)
    assert (field.decode(x, n) == labels).mean() >= 0.97


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = R.ChainField(rng.standard_normal((2, R.FEATURES)), rng.standard_normal((2, 2)))
    n = np.array([1, 4, 0, 6, 3])
    x = rng.standard_normal((n.sum(), R.FEATURES))
    got, at = field.decode(x, n), 0
    for k in n.tolist():
        e = x[at : at + k] @ field.weights.T
        score = lambda p: sum(e[i, v] for i, v in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        paths = [[int(b) for b in f"{m:0{k}b}"] for m in range(2**k)] if k else [[]]
        assert got[at : at + k].tolist() == max(paths, key=score)
        at += k


def test_cut_units():
    u = R.cut(["One two. Three\nfour", None, "x " * 50])
    assert u.ends.tolist() == [0, 4, 4, 54] and np.diff(np.concatenate([[0], u.unit_ends])).tolist() == [2, 1, 1, 20, 20, 10]
