"""Word counts move in packed rows: a worker never holds a Python object for each text and group."""

import math
from collections import Counter

import helpers as H
import pytest
from pyspark.sql import functions as F

from heatloom.llm import attention_lm, queries
from heatloom.llm.common import batches_of


@pytest.fixture(scope="module")
def tokens(spark):
    """1,500 rows, of them 300 copies in upper case far from their texts, one text of 9,000 distinct words; row 7 mod 10 is held out."""
    texts = [" ".join([f"t{i}", f"t{i}", f"u{i % 40}", "kalo", f"v{i % 3}"]) for i in range(1199)] + [" ".join(f"y{i}" for i in range(9000))]
    texts += [t.upper() for t in texts[:300]]
    table = attention_lm.Subwords(queries.tokenizer_bytes())
    with batches_of(spark, 200):
        cut = attention_lm.tokenised(H.frame(spark, [(i, t, "s") for i, t in enumerate(texts)]).coalesce(1), queries.tokenizer_bytes(), table.ids + 1, 10, 4)
        cut = cut.withColumn("round", F.when(F.col("doc_id") % 10 == 7, -1).otherwise(0)).localCheckpoint()
    return [t.lower().split() for t in texts], cut, table.ids + 1


def test_rows_hold_many_texts(spark, tokens):
    words, cut, n_ids = tokens
    head = attention_lm.frequent_words(["kalo"])
    with batches_of(spark, attention_lm.TOKEN_ROWS):
        got = attention_lm.tail_rows(cut, n_ids, head, 16).toPandas()
    assert len(got) < len(words)  # one row for each text and group would be above 5,000
    assert max(map(len, got["words"])) // 8 < attention_lm.ROW_WORDS + 9000 // 16 + 200


def test_counts_equal_plain_ones(spark, tokens):
    """Copies of a text in different batches count in training, and their sums come once."""
    words, cut, n_ids = tokens
    head = attention_lm.frequent_words(["kalo"])
    with batches_of(spark, attention_lm.TOKEN_ROWS):
        got = attention_lm.counted(attention_lm.tail_rows(cut, n_ids, head, 16), head).toPandas()
    train = Counter(w for i, ws in enumerate(words) if i % 10 != 7 for w in ws)
    n_train = sum(i % 10 != 7 for i in range(len(words)))
    last = got[got["kind"] == 2]
    assert (last["s"].sum(), last["n"].sum()) == (len(train) + 1, sum(train.values()) + n_train)  # and the end
    assert sorted(got[got["kind"] == 1]["n"]) == sorted([train["kalo"], n_train])
    sums = got[got["kind"] == 0]
    sums = sums.groupby("key")[["s", "n"]].sum()
    assert len(sums) == 1200
    for i in (0, 7, 8, 299, 300, 307, 1199):
        s, n = sums.loc[attention_lm.text_key(" ".join(words[i]))]
        tail = [w for w in words[i] if w != "kalo"]
        assert n == sum(train[w] > 0 for w in tail)
        assert s == pytest.approx(sum(math.log10(train[w] + 0.1) for w in tail), abs=1e-9)
