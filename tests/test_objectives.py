import math

import pytest

from tessera.functions import objectives as O
from tessera.plans import catalogue


def test_topk_forward_kl_by_hand(spark):
    rows = [(1, 0, -2000.0, -1.0), (1, 0, -2000.0, -3.0), (1, 1, math.log(0.75), -1.0), (1, 1, math.log(0.25), -2.0), (2, 0, -1.0, None), (2, 1, 0.0, -4.0)]
    got = {r["sample"]: r for r in O.topk_forward_kl(spark.createDataFrame(rows, "sample long, spot long, teacher double, student double"), "sample", "spot").collect()}
    one = got[1]
    assert (one.loss, one.entropy) == (pytest.approx((2 + 1.25) / 2), pytest.approx((math.log(2) - 0.75 * math.log(0.75) - 0.25 * math.log(0.25)) / 2))
    assert (one.min_mass, one.max_mass, one.n_positions) == (0.0, pytest.approx(1.0), 2)
    assert (got[2].loss, got[2].n_positions) == (4.0, 2)  # a place without student scores has no loss


@pytest.mark.parametrize("name", ["topk_forward_kl"])
def test_tokens_are_dealt_out_once(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("HashAggregate(") == 2
