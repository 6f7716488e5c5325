import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cotejo.llm import mixing as M
from cotejo.llm.queries import op9_pfair


def brute_period(w):
    """Earliest deadline first, slot by slot."""
    total, done, out = sum(w), [0] * len(w), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // w[i]), i) for i in range(len(w)) if done[i] < w[i] and done[i] * total // w[i] <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("w", [[1], [3, 1], [50, 30, 15, 5], [7, 7, 7], [97, 1, 1, 1], [13, 11, 29, 47]])
def test_schedule_is_edf_and_stays_within_one_block(spark, w):
    got = [r.source for r in M.period_schedule(spark, w).orderBy("slot").collect()]
    assert got == brute_period(w)
    total, done = sum(w), Counter()
    for t, s in enumerate(got, 1):
        done[s] += 1
        assert all(abs(done[i] - t * x / total) < 1 for i, x in enumerate(w))


def test_weights_are_positive_and_sum_up():
    for shares in ({"a": 1}, {"a": 5, "b": 1, None: 1e-9}, {str(i): i + 1 for i in range(150)}, {"a": 1e12, **{str(i): 1 for i in range(20)}}):
        w = M.rounded_weights(shares)
        assert sum(w.values()) == max(1000, 10 * len(shares)) and min(w.values()) >= 1


def test_every_row_once_in_edf_order(spark):
    rnd = random.Random(1)
    counts = {"a": 130, "b": 40, None: 33, "": 5}
    rows = [(rnd.randrange(60), k) for k, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").withColumns({"slot": F.lit(1), "weight": F.lit(2), "position": F.lit(3), "count": F.lit(0)})
    weights = {"a": 5, "b": 3, None: 2, "": 1}
    out = M.mix_sources(df, ["doc_id"], "source", weights, block_rows=4).orderBy("position").collect()
    assert [r.position for r in out] == list(range(len(rows)))
    assert Counter(r.source for r in out) == counts
    names = sorted(weights, key=lambda k: (k is not None, str(k)))
    plan = brute_period([weights[k] for k in names])
    seen = Counter()
    end = None
    left = {k: -(-n // 4) for k, n in counts.items()}
    expected = []
    for t in range(11 * 40):
        k = names[plan[t % 11]]
        if seen[k] < left[k]:
            expected.append((t, k, seen[k]))
        elif end is None:
            end = t
        seen[k] += 1
    blocks = list(dict.fromkeys((r.slot, r.source, r.block) for r in out))
    assert blocks == expected
    assert all(r.within_target == (r.slot < end) for r in out)
    assert all(r.release <= r.slot < r.deadline for r in out)


def test_prefix_shares_on_the_test_data(spark):
    rows = op9_pfair(spark, "/root/testdata/sf0.01").orderBy("position").collect()
    assert len(rows) == 1000 and [r.position for r in rows] == list(range(1000))
    total = sum({r.source: r.weight for r in rows}.values())
    blocks, done = list(dict.fromkeys((r.slot, r.source, r.weight) for r in rows if r.within_target)), Counter()
    for t, (slot, source, _) in enumerate(blocks, 1):
        assert slot == t - 1
        done[source] += 1
        assert abs(done[source] - t * dict((s, w) for _, s, w in blocks)[source] / total) < 1


def test_errors_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, source string")
    with pytest.raises(Exception, match="no weight"):
        M.mix_sources(df, ["doc_id"], "source", {"y": 1}).collect()
    assert M.target_weights(df.limit(0), "source", 0.5) == {}
    assert M.mix_sources(df.limit(0), ["doc_id"], "source", {}).count() == 0
    assert M.mix_sources(df.limit(0), ["doc_id"], "source", {"x": 3}).count() == 0
