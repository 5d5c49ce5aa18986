from collections import defaultdict

import pytest

from tessera.operators import ordering as R


@pytest.mark.parametrize(("total", "own"), [(0, 10), (1, 10), (6, 10), (40, 10), (60, 1)])
def test_pools_are_filled_or_candidates_run_out(spark, total, own):
    items = spark.range(100).withColumnRenamed("id", "item_id")
    docs = spark.range(total).withColumnRenamed("id", "doc_id")
    rule = "doc_id % 10 <> item_id % 10" if own == 10 else "doc_id % 20 = 7"  # 3 of 60 in the last case
    got = defaultdict(list)
    for r in R.filled_pools(items, docs, "item_id", "doc_id", rule, 5, 3, width=2).collect():
        got[r.item_id].append(r.doc_id)
    for i in range(100):
        right = {d for d in range(total) if (d % 10 != i % 10 if own == 10 else d % 20 == 7)}
        assert len(got[i]) == len(set(got[i])) == min(5, len(right)) and set(got[i]) <= right
