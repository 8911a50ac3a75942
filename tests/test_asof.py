"""As-of joins that cut long series and crowded dates over partitions."""

import datetime as dt
import random

import pytest

from tremora.operators import asof

DAY = dt.date(2020, 1, 1)


@pytest.mark.parametrize("keyed", [False, True])
def test_asof_matches_brute_force_across_partitions(frame, keyed):
    rng = random.Random(3)
    left = [(rng.choice("ab") if keyed else "a", i, DAY + dt.timedelta(rng.choice([50, rng.randrange(120)]))) for i in range(300)]
    right = [(rng.choice("ab") if keyed else "a", DAY + dt.timedelta(d), d) for d in sorted(rng.sample(range(10, 110), 30))]
    l, r = frame(left, "k string, id int, date date"), frame(right, "k string, date date, v int")
    keys = ("k",) if keyed else ()
    if not keyed:
        l, r = l.drop("k"), r.drop("k")
    for strict in (False, True):
        got = {x.id: x.m.v if x.m else None for x in asof.backward(l, r, keys, strict, 20).collect()}
        for k, i, d in left:
            fits = [(rd, v) for rk, rd, v in right if rk == k and (rd < d or rd == d and not strict)]
            want = max(fits)[1] if fits and (d - max(fits)[0]).days <= 20 else None
            assert got[i] == want
    got = {x.id: x.m.v if x.m else None for x in asof.nearest(l, r, keys).collect()}
    for k, i, d in left:
        fits = [(abs((rd - d).days), rd < d, v) for rk, rd, v in right if rk == k]
        assert got[i] == min(fits)[2]


def test_one_date_is_cut_over_partitions(spark, frame):
    left = frame([(i, DAY) for i in range(400)], "id int, date date")
    right = frame([(DAY - dt.timedelta(1), 7)], "date date, v int")
    out = asof.backward(left, right)
    assert {x.m.v for x in out.collect()} == {7} and out.count() == 400
