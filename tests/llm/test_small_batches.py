"""The language model gets few rows at a time: large batches of tokens stand beside the heap of an executor."""

import os

import helpers as H
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from heatloom.llm import attention_lm, queries
from heatloom.llm.common import SLICE_ROWS, batches_of

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_are_bounded(spark, monkeypatch, tmp_path):
    """In every step, the last one too, whatever the session's setting, which stays as it was."""
    before, step, plain = spark.conf.get(SETTING), [], DataFrame.mapInArrow

    def recorded(self, run, *args, **more):
        name = f"{run.__qualname__.split('.')[0]}-{len(step)}"
        step.append(name)
        folder = str(tmp_path)

        def seen(batches):
            def noted():
                for b in batches:
                    open(os.path.join(folder, f"{name}={b.num_rows}"), "w").close()
                    yield b
            return run(noted())

        return plain(self, seen, *args, **more)

    monkeypatch.setattr(DataFrame, "mapInArrow", recorded)
    rows = [(i, f"kalo mine {i % 7}", "s") for i in range(6000)]
    got = attention_lm.language_scores(H.frame(spark, rows).coalesce(1), queries.tokenizer_bytes(), steps=5, rounds=2)
    assert got.count() == len(rows) and got.where("score < 0 and n_tokens = 4").count() == len(rows)
    sizes = {}
    for f in os.listdir(tmp_path):
        name, n = f.split("=")
        name = name.split("-")[0]
        sizes[name] = max(sizes.get(name, 0), int(n))
    assert {"tokenised", "tail_rows", "train_on_all", "language_scores"} <= set(sizes)
    assert all(n <= (attention_lm.TOKEN_ROWS if k in ("tail_rows", "counted") else SLICE_ROWS) for k, n in sizes.items()), sizes
    assert spark.conf.get(SETTING) == before


@pytest.mark.parametrize("own, rows", [("100", "100"), ("0", "512"), ("9000", "512")])
def test_a_smaller_setting_stays(spark, own, rows):
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, own)
    try:
        with pytest.raises(ValueError), batches_of(spark, 512):
            assert spark.conf.get(SETTING) == rows
            raise ValueError
        assert spark.conf.get(SETTING) == own
    finally:
        spark.conf.set(SETTING, before)
