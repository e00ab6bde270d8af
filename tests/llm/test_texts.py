"""Token counts, classifiers, similarity join, language model and pipeline."""

import math
import random
import zlib
from collections import Counter

import helpers as H
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from heatloom.llm import attention_lm, nb_toxicity, pairwise_quality, partenum, prefix_tokens, queries
from heatloom.llm.components import connected_components


@pytest.fixture(scope="module")
def counter():
    return prefix_tokens.PrefixCounter(queries.tokenizer_bytes())


PARTS = st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "\t", "é", "日", "▁", "<s>", "aaa", "x", "　", "!!", "0x", "😀", "'s", "   ", "\x00"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, max_size=20).map("".join))
def test_prefix_counts_equal_the_library(counter, text):
    table = counter.table(text)
    assert counter.count(text) == len(counter.sp.encode(text)) == table[-1]
    for i in range(len(text) + 1):
        assert table[i] == len(counter.sp.encode(text[:i]))


def test_token_counts_of_awkward_rows(spark, counter):
    rows = H.awkward()
    got = prefix_tokens.token_counts(H.frame(spark, rows, extra=True), queries.tokenizer_bytes(), limit=100).collect()
    want = [(i, len((t or "").encode()), len(counter.sp.encode(t or "")), len(counter.sp.encode(t or "")) > 100) for i, t, _ in rows]
    H.same_rows([tuple(r) for r in got], want)
    assert prefix_tokens.token_counts(H.frame(spark, []), queries.tokenizer_bytes()).count() == 0


def test_truncation_keeps_the_longest_prefix(spark, counter):
    rows = [r for r in H.awkward() if r[0] is not None and r[0] != 63]
    out = prefix_tokens.truncate_to_budget(H.frame(spark, rows), queries.tokenizer_bytes(), 7).collect()
    whole = {i: t or "" for i, t, _ in rows}
    for r in out:
        t = whole[r.doc_id]
        fits = [i for i in range(len(t) + 1) if len(counter.sp.encode(t[:i])) <= 7]
        assert r.text == t[: max(fits)] and r.n_tokens == len(counter.sp.encode(r.text))


def labelled(n=240, seed=2):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("ra", "to", "vi", "we", "zu", "pe")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        toxic, good = int(i % 5 == 0), int(i % 4 != 1)
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["grimfoul", "vilefoul"]))
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 8 == 1 else [x + "$$$" for x in w]
        rows.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, good, toxic))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32((("" if i is None else str(i))).encode()) % 5 == 0


@pytest.mark.parametrize("fit, score, column, threshold", [
    (pairwise_quality.fit_quality, pairwise_quality.quality_scores, "quality", 0.3),
    (nb_toxicity.fit_toxicity, nb_toxicity.toxicity_scores, "toxic", 0.5),
])
def test_classifiers(spark, fit, score, column, threshold):
    rows, labels = labelled()
    odd = labels + [(3, 1 - labels[3][1], 1 - labels[3][2]), (None, 1, 1), (999, None, None), (10_000, 0, 1)]
    docs = H.frame(spark, rows + [(1000, None, "s"), (1001, "", "s"), (None, "x y", None)], extra=True)
    model = fit(docs, spark.createDataFrame(odd, LABELS))
    got = score(docs, model).collect()
    assert len(got) == len(rows) + 3
    truth = {x[0]: dict(quality=x[1], toxic=x[2])[column] for x in labels}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 20 and np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == held(r.doc_id) for r in got)
    # held-out labels are never read
    flipped = [(i, *((1 - q, 1 - t) if held(i) else (q, t))) for i, q, t in labels]
    again = score(docs, fit(docs, spark.createDataFrame(flipped, LABELS))).collect()
    a, b = ({r.doc_id: r.score for r in x} for x in (got, again))
    b_without = score(docs, fit(docs, spark.createDataFrame(labels, LABELS))).collect()
    c = {r.doc_id: r.score for r in b_without}
    assert all(abs(b[k] - c[k]) < 1e-9 for k in c)
    # nothing to learn from
    assert fit(docs, spark.createDataFrame([], LABELS)) is None
    assert score(H.frame(spark, []), None).count() == 0
    assert len({r.score for r in score(docs, None).collect()}) == 1 and len(a) == len(c)


def test_filters_keep_columns(spark):
    rows, labels = labelled()
    docs, lab = H.frame(spark, rows, extra=True), spark.createDataFrame(labels, LABELS)
    kept = nb_toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(ids & toxic) <= 2 and len(ids) >= 0.97 * (len(rows) - len(toxic))
    good = pairwise_quality.keep_good(docs, lab)
    bad = {i for i, q, _ in labels if not q}
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert good.columns == docs.columns and len(ids & bad) <= 3 and len(ids) >= 0.97 * (len(rows) - len(bad))


def test_similar_classes_of_awkward_rows(spark):
    rows = H.awkward() + [(7, "other text under a known id", "s")] * 2 + [(70, "one two three four five six seven eight nine ten", "s"),
                                                                         (71, "one two three four five six seven eight nine ten eleven", "s")]
    got = partenum.similar_classes(H.frame(spark, rows, extra=True)).collect()
    # rows of one id are separate sets
    H.same_rows([tuple(r) for r in got], H.similar_classes([(i, t) for i, t, _ in rows]))
    assert partenum.similar_classes(H.frame(spark, [])).count() == 0
    got = partenum.similar_classes(H.frame(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("seed, small_run", [(1, 12), (2, 2), (3, 3)])
def test_no_link_is_lost(spark, monkeypatch, seed, small_run):
    """Many sets around the threshold that share a passage, and runs that count as large."""
    monkeypatch.setattr(partenum, "SMALL_RUN", small_run)
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 12, 40, 90, 150]))]
        if group % 2:
            base = base[: len(base) // 3] + passage + base[len(base) // 3 :]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.3:
                t = t + [rng.choice(vocab) for _ in range(len(t) // 6)]
            rows.append((len(rows), " ".join(t)))
    docs = H.frame(spark, [(i, t, "s") for i, t in rows])
    got = partenum.similar_classes(docs).collect()
    H.same_rows([tuple(r) for r in got], H.similar_classes(rows))


def test_copies_that_only_the_middle_links(spark, monkeypatch):
    """Copies changed at different places, similar to their text and hardly to each other; runs in several blocks."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(110)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.choice([0, 2, 3, 4, 5])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(partenum, "RUN_BLOCK", 8)
    original = partenum.large_runs
    monkeypatch.setattr(partenum, "large_runs", lambda *a: original(*a, block=8))
    for hubs in (True, False):
        if not hubs:
            monkeypatch.setattr(partenum, "hub_links", lambda m, *a: spark.createDataFrame([], "a binary, b binary"))
        got = partenum.similar_classes(H.frame(spark, [(i, t, "s") for i, t in rows])).collect()
        H.same_rows([tuple(r) for r in got], H.similar_classes(rows))


def test_signatures_share_for_every_allowed_difference():
    rng = np.random.default_rng(4)
    for n in [1, 4, 5, 9, 10, 33, 120, 700]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            change = int(rng.integers(0, n // 4 + 1))
            drop = rng.permutation(len(a))[:change]
            b = np.unique(np.concatenate([np.delete(a, drop), rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
                continue
            owner, sig = partenum.signatures([a, b], 80, 100)
            assert set(sig[owner == 0]) & set(sig[owner == 1])
            apart = len(a) + len(b) - 2 * both
            assert partenum.sketch_distance(partenum.sketch_of(a), partenum.sketch_of(b)) <= apart <= partenum.most_apart(len(a), len(b), 80, 100)


def test_keep_one_per_class(spark):
    rows = [r for r in H.awkward() if r[0] is not None]
    docs = H.frame(spark, rows + rows[:3], extra=True)
    kept = partenum.keep_one_per_class(docs)
    classes = H.similar_classes([(i, t) for i, t, _ in rows])
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in classes})


def test_one_row_per_class_whatever_the_ids(spark):
    """Different texts under one id, copies without an id, repeated rows."""
    a, b, c = ("one two three four five six seven eight nine ten", "red green blue white black brown pink grey gold teal", "north south east west up down left right in out")
    rows = [(1, a, "s"), (1, b, "s"), (2, a, "s"), (2, b, "s"), (None, b, "s"), (None, c, "s"), (None, c, "t"), (5, "", "s"), (5, "", "s"), (None, None, "s"), (None, "", "s"),
            (7, a + " eleven", "s"), (8, c + " again", "s"), (8, c + " again", "s")]
    kept = partenum.keep_one_per_class(H.frame(spark, rows, extra=True))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert got == sorted([(False, 1, a), (False, 1, b), (False, 8, c + " again"), (False, 5, ""), (True, 0, ""), (True, 0, "")])
    lone = partenum.keep_one_per_class(H.frame(spark, [(None, c, "s")] * 3))
    assert [(r.doc_id, r.text) for r in lone.collect()] == [(None, c)]


@pytest.mark.parametrize("fit, score, keep", [
    (pairwise_quality.fit_quality, pairwise_quality.quality_scores, pairwise_quality.keep_good),
    (nb_toxicity.fit_toxicity, nb_toxicity.toxicity_scores, nb_toxicity.drop_toxic),
])
def test_ids_of_any_type(spark, fit, score, keep):
    """Text ids in documents or labels alone or in both give what numbers give; long words and texts pass."""
    rows, labels = labelled(160)
    rows = rows + [(700, "w" * 100_000, "s"), H.awkward()[63]]
    docs, lab = H.frame(spark, rows), spark.createDataFrame(labels, LABELS)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    named_lab = lab.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    for d, l in ((named, named_lab), (docs.withColumn("doc_id", F.col("doc_id").cast("string")), lab)):
        got = score(d, fit(d, l))
        assert got.count() == len(rows) and got.where("score between 0 and 1").count() == len(rows)
        assert keep(d, l).columns == docs.columns


def plain_grams(text):
    t = " " + "".join(" " if 9 <= ord(ch) <= 13 else ch for ch in text.lower()) + " "
    return {t[i : i + n] for n in nb_toxicity.GRAMS for i in range(len(t) - n + 1)}


def plain_hash(gram):
    h, power, wide = 0, 1, (1 << 64) - 1
    for ch in gram:
        h = (h + (ord(ch) + 1) * power) & wide
        power = power * nb_toxicity.STEP & wide
    return ((h ^ (h >> 29)) * nb_toxicity.MIX & wide) >> (64 - nb_toxicity.BITS)


def test_toxicity_equals_a_plain_version(spark):
    """Ratios by counting sets of n-grams, and scores by adding up their weights."""
    rows, labels = labelled(200)
    docs, lab = H.frame(spark, rows), spark.createDataFrame(labels, LABELS)
    for selected, least in ((None, 1), (50, 2)):
        model = nb_toxicity.fit_toxicity(docs, lab, selected=selected, least_docs=least)
        toxic = {i: t for i, _, t in labels if not held(i)}
        sets = {i: {plain_hash(g) for g in plain_grams(t)} for i, t, _ in rows}
        count = [Counter(f for i, t in toxic.items() if t == c for f in sets[i]) for c in (0, 1)]
        size = [sum(t == c for t in toxic.values()) for c in (0, 1)]
        ratio = {f: math.log((count[1][f] + 1) / (size[1] + 2)) - math.log((count[0][f] + 1) / (size[0] + 2)) for f in {*count[0], *count[1]} if count[0][f] + count[1][f] >= least}
        telling = sorted(ratio, key=lambda f: (-abs(ratio[f]) * math.sqrt(count[1][f] / size[1] + count[0][f] / size[0]), f))
        chosen = {int(f) for f in np.flatnonzero(model["select"] >= 0)}
        if selected is None:
            assert chosen == set(ratio)
        else:
            least_telling = abs(ratio[telling[selected - 1]]) * math.sqrt(count[1][telling[selected - 1]] / size[1] + count[0][telling[selected - 1]] / size[0])
            assert len(chosen) == selected and all(abs(ratio[f]) * math.sqrt(count[1][f] / size[1] + count[0][f] / size[0]) >= least_telling - 1e-9 for f in chosen)
        weight = {f: model["weight"][model["select"][f]] for f in chosen}
        for i, text, _ in rows[:60]:
            z = sum(weight[f] for f in sets[i] if f in weight) + model["bias"]
            assert nb_toxicity.score_texts([text], model)[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9, abs=1e-12)


def test_preference_pairs_equal_a_plain_version():
    """Weights by plain gradient descent on the same pairs, and the cut by sorting."""
    rng = np.random.default_rng(2)
    y = (rng.random(60) < 0.6).astype(int)
    x = rng.normal(size=(60, 3)) + y[:, None] * np.array([0.8, -0.4, 0.0])
    w = pairwise_quality.fit_pairs(x, y, rivals=3, decay=0.05)
    good, bad = [i for i in range(60) if y[i]], [i for i in range(60) if not y[i]]
    draw = np.random.default_rng(17)
    one = [(g, bad[k]) for g, k in zip(np.repeat(good, 3), draw.integers(0, len(bad), len(good) * 3))]
    two = [(good[k], b) for b, k in zip(np.repeat(bad, 3), draw.integers(0, len(good), len(bad) * 3))]
    plain = [0.0] * 3
    for _ in range(4000):
        grad = [0.05 * v for v in plain]
        for i, j in one + two:
            d = [float(a - b) for a, b in zip(x[i], x[j])]
            p = 1 / (1 + math.exp(sum(a * b for a, b in zip(d, plain))))
            grad = [g - p * v / len(one + two) for g, v in zip(grad, d)]
        if max(map(abs, grad)) < 1e-7:
            break
        plain = [v - 0.5 * g for v, g in zip(plain, grad)]
    assert np.allclose(w, plain, atol=1e-4)
    s, weight = rng.normal(size=30), rng.uniform(0.5, 2, 30)
    for share in (0.1, 0.37, 0.9):
        cut = pairwise_quality.quantile_cut(s, weight, share)
        below = weight[s < cut].sum() / weight.sum()
        assert below >= share - 1e-9 and weight[s < cut][:].sum() - weight[np.argmax(np.where(s < cut, s, -9))] <= share * weight.sum() + 1e-9


def test_components_of_long_paths(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    u = H.Union(range(400))
    for a, b in links:
        u.join(a, b)
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    want = {x: u.find(x) for p in links if p[0] != p[1] for x in p}
    assert {r.node: r.root for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def tokenizer():
    return queries.tokenizer_bytes()


def test_language_scores(spark):
    rows = H.awkward()
    got = attention_lm.language_scores(H.frame(spark, rows, extra=True), tokenizer(), steps=20).collect()
    count, n = Counter(), 0
    out = lambda i: zlib.crc32((("" if i is None else str(i))).encode()) % 10 == 0
    tokens = [[w.encode() for w in H.words(t)] + [None] for _, t, _ in rows]
    for (i, _, _), w in zip(rows, tokens):
        if not out(i):
            count.update(w)
            n += len(w)
    each = math.log10(n + 0.1 * (len(count) + 1))
    want = [(i, out(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10(count[x] + 0.1) - each for x in w), 6))
            for (i, _, _), w in zip(rows, tokens)]
    H.same_rows([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert attention_lm.language_scores(H.frame(spark, []), tokenizer(), steps=5).count() == 0


@pytest.fixture(scope="module")
def small_model():
    texts = [t for _, t, _ in H.awkward() if t][:40]
    return attention_lm.fit_language_model(texts, tokenizer(), steps=30)[0]


def slow_score(t, ids):
    """Log probability of one text, position by position, with the windows of a text that starts at the stream's start."""
    w, skip = attention_lm.WINDOW, attention_lm.OVERLAP
    slot = t["slot"][ids]
    x = [t["start"], *slot[:-1]]
    total = 0.0
    for i in range(len(ids)):
        lo = max(0, (i // (w - skip)) * (w - skip) - skip)
        q = t["q"][x[i]].astype(float)
        a = np.array([math.exp(q @ t["k"][x[j]]) * t["rel"][i - j, 0] for j in range(lo, i + 1)])
        v = sum(a[j - lo] * t["v"][x[j]][:-1].astype(float) for j in range(lo, i + 1)) / a.sum()
        z = np.maximum(v + t["x"][x[i]], 0)
        c, p = t["classes"], t["place"]
        top = z @ t["wc"] + t["bc"]
        cls = slot[i] // p
        total += top[cls] - np.log(np.exp(top).sum())
        if cls < c:
            inner = z @ t["wi"][cls] + t["bi"][cls]
            total += inner[slot[i] % p] - np.log(np.exp(inner).sum())
        else:
            total += t["other"][ids[i]]
    return total


def test_windows_score_each_id_once(small_model):
    table = attention_lm.Subwords(tokenizer())
    texts = ["", "w1 w2", H.awkward()[63][1][:2000]]
    for text in texts:
        ids, doc, _, _ = attention_lm.streamed(table, [text], table.ids)
        assert attention_lm.score_stream(small_model, ids, doc, 1)[0] == pytest.approx(slow_score(small_model, ids), rel=1e-4)


def test_model_is_a_distribution(small_model):
    """All continuations of a prefix have probability one together."""
    t = small_model
    n = len(t["slot"])
    prefix = [int(np.flatnonzero(t["slot"] == 5)[0]), int(np.flatnonzero(t["slot"] == 40)[0])]
    total = 0.0
    base = attention_lm.score_stream(t, np.array(prefix), np.zeros(2, int), 1)[0]
    ids = np.tile(np.array(prefix + [0]), (n, 1))
    ids[:, 2] = np.arange(n)
    lp = attention_lm.score_stream(t, ids.ravel(), np.repeat(np.arange(n), 3), n)
    # texts start at other places of the windows, so contexts differ by rounding only: a text of 3 ids always sees itself
    total = np.exp(lp - base).sum()
    assert total == pytest.approx(1.0, rel=1e-3)


def test_gradients():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 50, 3000).astype(float)
    vocab = attention_lm.vocabulary(counts, 2999)
    shares = np.full(vocab["classes"] * vocab["place"] + 1, 1.0)
    m = {k: v.astype(np.float64) for k, v in attention_lm.new_model(vocab, shares).items()}
    x, y = rng.integers(0, vocab["start"], (2, attention_lm.WINDOW)), rng.integers(0, vocab["start"], (2, attention_lm.WINDOW))
    doc, use = np.repeat([[0], [1]], attention_lm.WINDOW, 1), np.ones((2, attention_lm.WINDOW), bool)
    doc[0, 20:] = 5
    _, g = attention_lm.gradients(m, vocab, x, y, doc, use)
    for name in m:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        step = 1e-4
        up, down = ({k: v.copy() for k, v in m.items()} for _ in range(2))
        up[name][at] += step
        down[name][at] -= step
        slope = (attention_lm.gradients(up, vocab, x, y, doc, use)[0] - attention_lm.gradients(down, vocab, x, y, doc, use)[0]) / (2 * step)
        assert g[name][at] == pytest.approx(slope, rel=2e-2, abs=1e-4), name


def test_model_learns(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["kalo mine", "suzu pewe", "tora vika"]) for _ in range(80))
    docs = H.frame(spark, [(i, text(), "s") for i in range(60)])
    got = attention_lm.language_scores(docs, tokenizer(), steps=250).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_model_learns_from_rows_outside_the_sample(spark):
    """One language in the sample, another in all other training rows: the model knows both."""
    rng = random.Random(8)
    text = lambda pairs: " ".join(rng.choice(pairs) for _ in range(60))
    other = ["zebra quilt", "jumbo fjord", "vexing hymn"]
    ids = spark.range(300).where(attention_lm.fold("id", 10) != 0).orderBy(F.xxhash64("id"), "id").limit(10)
    first = {r["id"] for r in ids.collect()}
    rows = [(i, text(["kalo mine", "suzu pewe", "tora vika"] if i in first else other), "s") for i in range(300)]
    got = attention_lm.language_scores(H.frame(spark, rows), tokenizer(), sample_docs=10, steps=100).where("held_out").agg(F.sum("score")).first()[0]
    table = attention_lm.Subwords(tokenizer())
    held, seen = ([t for i, t, _ in rows if (zlib.crc32(str(i).encode()) % 10 == 0) == out] for out in (True, False))
    counts = np.bincount(attention_lm.streamed(table, seen, table.ids)[0], minlength=table.ids + 1) + 0.1
    alone = np.log10(counts / counts.sum())[attention_lm.streamed(table, held, table.ids)[0]].sum()
    assert got > 0.7 * alone  # negative: the exact shares of single ids are far worse


def test_id_counts_cover_all_training_rows(spark):
    rows = H.awkward()
    table = attention_lm.Subwords(tokenizer())
    head = attention_lm.frequent_words(["w1 w2"])
    tokens = attention_lm.tokenised(H.frame(spark, rows), tokenizer(), table.ids + 1, 10, 4)
    got = attention_lm.counted(attention_lm.tail_rows(tokens, table.ids + 1, head, 16), head).where("kind = 3").collect()
    texts = [t or "" for i, t, _ in rows if zlib.crc32((("" if i is None else str(i))).encode()) % 10]
    ids = attention_lm.streamed(table, texts, table.ids)[0]
    assert {r.word: r.n for r in got} == {i: n for i, n in enumerate(np.bincount(ids)) if n}


def test_rounds_count_every_target_once():
    rng = np.random.default_rng(9)
    vocab = attention_lm.vocabulary(rng.integers(0, 50, 3000).astype(float), 2999)
    m = attention_lm.new_model(vocab, np.full(vocab["start"], 1 / vocab["start"]))
    streams = [np.concatenate([np.append(vocab["start"], rng.integers(0, vocab["start"], k)) for k in sizes]) for sizes in ((1, 5000, 3), (700,))]
    n, after = attention_lm.local_steps(m, vocab, iter(streams), 0.01)
    before = np.concatenate([v.ravel() for v in m.values()])
    assert n == 5704 and after.shape == before.shape
    assert np.isfinite(after).all() and 0 < np.abs(after - before).max() < 0.05  # a step moves a parameter by about the rate


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled(200)
    rows = rows + [(500 + i, t, s) for i, t, s in rows[:30]] + [(900, None, None), (901, "", "s0"), (902, "kara loto", "s1")]
    H.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    lab = spark.read.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept[name], docs = docs, spark.read.parquet(str(tmp_path / name))
    ids = lambda d: [r.doc_id for r in d.select("doc_id").collect()]
    whole = {i: t for i, t, _ in rows}
    got = nb_toxicity.toxicity_scores(kept["toxicity"], nb_toxicity.fit_toxicity(kept["toxicity"], lab)).where("predicted = 0")
    assert sorted(ids(got)) == sorted(ids(kept["quality"]))
    got = pairwise_quality.quality_scores(kept["quality"], pairwise_quality.fit_quality(kept["quality"], lab)).where("predicted = 1")
    assert sorted(ids(got)) == sorted(ids(kept["near_duplicates"]))
    classes = H.similar_classes([(i, whole[i]) for i in ids(kept["near_duplicates"])])
    assert sorted(ids(kept["mixing"])) == sorted({c for _, _, c in classes})
    sizes = {i: len(H.words(whole[i])) for i in ids(kept["mixing"])}
    taken = Counter()
    for r in kept["packing"].collect():
        taken[r.doc_id] += len(H.words(r.text))
    assert all(n <= 2 * sizes[i] for i, n in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=10)
    assert docs.count() == kept["packing"].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
