"""How often the solutions behind a front are worked out."""

import numpy as np
from pyspark.sql import functions as F

from heatloom.operators import pareto as P


def counted_solutions(spark, n=400):
    """(solutions whose rows are counted when they are made, the counter)."""
    seen, values = spark.sparkContext.accumulator(0), np.random.default_rng(8).random((n, 5)).tolist()
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "solution_id long, f1 double, f2 double, f3 double, f4 double, f5 double")

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return rows.mapInPandas(count, rows.schema), seen, np.array(values)


def test_a_report_works_solutions_out_twice(spark):
    rows, seen, values = counted_solutions(spark)
    front = P.pareto_front(rows)
    table = P.pareto_table(front).collect()
    assert P.reference_direction_select(front).count() > 0
    assert {r["solution_id"] for r in table} == set(np.flatnonzero(~P.dominated_by(values, values)).tolist())
    assert sum(r["is_balanced"] for r in table) == 1 and seen.value <= 2 * len(values)


def test_a_union_of_fronts_works_solutions_out_twice(spark):
    rows, seen, values = counted_solutions(spark)
    parts = [P.pareto_front(rows.where(F.col("solution_id") % 2 == i)) for i in range(2)]
    got = {r["solution_id"] for r in P.union_seeds(parts, [1, 2]).collect()}
    assert got == set(np.flatnonzero(~P.dominated_by(values, values)).tolist())
    assert seen.value <= 2 * len(parts) * len(values)
