"""Rotation, packing and mixing against their SQL, and their awkward cases."""

import os

import helpers as H
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatloom.llm import budget_mix, chat_rotation, length_buckets, queries
from heatloom.llm.common import word_count
from heatloom.operators.groups import GroupProfile


def compare(got, want):
    from check import compare as c

    assert c(got, want) == ""


@pytest.mark.parametrize("name", ["op1_itq_dedup", "op4_perspective_rotation", "op6_length_buckets", "op10_budget_mix"])
def test_query_equals_sql(spark, name):
    if not os.path.isdir(H.SF):
        pytest.skip("no test tables")
    compare(queries.QUERIES[name](spark, H.SF).toPandas(), H.sf_duck(queries.ORACLES[name]))


def mix(df):
    m = budget_mix.mix_sources(df)
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                    F.col("mix_target").alias("target"), F.col("mix_taken").cast("long").alias("taken"))


def test_mix_awkward_rows(spark):
    rows = H.awkward() + [(3, "again and again", "s3")] * 4
    got = mix(H.frame(spark, rows, extra=True)).toPandas()
    compare(got, H.duck(queries.MIX_SQL, documents=H.pandas_docs(rows)))
    assert (got.taken <= 2 * got["size"]).all()
    again = mix(H.frame(spark, rows[::-1])).toPandas()
    compare(got, again)


def test_mix_rows_hold_what_is_taken(spark):
    rows = [r for r in H.awkward() if r[0] is not None]
    m = budget_mix.mix_sources(H.frame(spark, rows))
    out = budget_mix.repeat_taken(m).toPandas()
    assert list(out.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    n = out.assign(n=[len(H.words(t)) for t in out.text]).groupby("doc_id").n.sum()
    taken = m.toPandas().set_index("doc_id").mix_taken
    assert n.to_dict() == taken[taken > 0].to_dict()
    whole = {i: t for i, t, _ in rows}
    assert all(whole[i].startswith(t) for i, t in zip(out.doc_id, out.text))
    assert (out.n_chars == out.text.str.len()).all()


def test_mix_empty_and_wordless(spark):
    assert mix(H.frame(spark, [])).count() == 0
    assert [r.taken for r in mix(H.frame(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def best_padding(lengths, buckets):
    """Least padding by trying every set of bounds."""
    from itertools import combinations

    kinds = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(kinds)) + 1):
        for cut in combinations(kinds[:-1], k - 1):
            ends = [*cut, kinds[-1]]
            cost = sum(min(e for e in ends if e >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_bounds_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 40, 60)
    kinds, counts = np.unique(lengths, return_counts=True)
    ends = length_buckets.best_bounds(kinds, counts, 3)
    got = sum(min(e for e in ends if e >= x) - x for x in lengths)
    assert got == best_padding(lengths.tolist(), 3)


def test_packing_places_every_row_once(spark):
    rows = H.awkward() + [(5, "a b c", "s")] * 7
    got = length_buckets.pack_documents(H.frame(spark, rows, extra=True), word_count(F.col("text")), 4, 100).toPandas()
    assert len(got) == len(rows)
    assert not got.duplicated(["pad_to", "batch", "slot"]).any()
    assert (got.n_tokens <= got.pad_to).all()
    per = got.groupby(["pad_to", "batch"]).slot.agg(["count", "max"])
    assert (per["count"] == per["max"] + 1).all()
    assert all(n * max(p, 1) <= 100 or n == 1 for (p, _), n in per["count"].items())
    assert length_buckets.pack_documents(H.frame(spark, []), word_count(F.col("text"))).count() == 0


def test_long_lengths_are_rounded_up(spark):
    n = [0, 1, 4095, 4096, 4097, 8191, 8193, 10**9 + 1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(length_buckets.rounded_length(F.col("n"))).collect()]
    assert got[:4] == n[:4] and all(a <= b < a * (1 + 1 / 2048) + 1 for a, b in zip(n, got))


TURNS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi\nall"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (1, 3, "cy", "Grüße 日"),
         (1, None, None, "who?"), (2, 0, "system", "alone"), (None, 5, "ann", "lost"), (3, 1500, "ann", "late"), (3, 2, "bob", "early"),
         (4, 1, "ann", "x"), (4, 1, "ann", "x")]


def rotated(spark, turns, **how):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("z"))
    return chat_rotation.rotate_perspectives(df, **how)


def comparable(views):
    spans = F.zip_with("mask_starts", "mask_ends", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string")))
    return views.select("conv_id", "speaker", "part", "n_messages", "n_own", "text", F.array_join(spans, ",").alias("spans")).toPandas()


def turns_frame(turns):
    return pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})


def hot_turns():
    """A conversation without turn numbers, a message repeated 1,100 times, one long dialogue, rows without conversation."""
    return (
        TURNS + [(5, None, ("ann", "bob", None)[i % 3], f"line {i}") for i in range(1300)] + [(6, 7, "ann", "again")] * 1100
        + [(6, 9, "bob", "end")] + [(7, 3 * i, ("ann", "bob")[i % 2], f"turn {i}") for i in range(1200)] + [(None, 2, "bob", "found")])


@pytest.mark.parametrize("limits", [{}, {"direct_rows": 300}, {"direct_rows": 300, "broadcast_groups": 1}])
def test_rotation_of_hot_conversations(spark, limits):
    """No part grows with turns that are missing or repeated, and long conversations ordered in ranges come out alike."""
    turns = hot_turns()
    got = comparable(rotated(spark, turns, profile=GroupProfile(8, 1300, **limits)))
    assert got.n_messages.max() == chat_rotation.PART_TURNS
    assert got[(got.conv_id == 6) & (got.speaker == "bob")].sort_values("part").n_messages.tolist() == [512, 512, 77]
    compare(got, H.duck(queries.ROTATE_SQL, conversations=turns_frame(turns)))


def test_rotation_awkward_turns(spark):
    got = comparable(rotated(spark, TURNS))
    compare(got, H.duck(queries.ROTATE_SQL, conversations=turns_frame(TURNS)))


def test_rotation_masks_cover_own_words(spark):
    for r in rotated(spark, TURNS).collect():
        own = [r.text[a:b] for a, b in zip(r.mask_starts, r.mask_ends)]
        said = sorted((x[3] or "") + "\n" for x in TURNS if x[0] == r.conv_id and x[2] == r.speaker)
        assert sorted(own) == said and len(own) == r.n_own
        assert r.text.count("<|assistant|>") == r.n_own
    assert rotated(spark, []).count() == 0


def test_native_plans_have_no_python(spark):
    docs = H.frame(spark, H.awkward())
    frames = [budget_mix.mix_sources(docs), length_buckets.pack_documents(docs, word_count(F.col("text"))), rotated(spark, TURNS)]
    for df in frames:
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan
