"""A rate that all workers share."""

import time

import pytest
from pyspark import TaskContext

from quern.operators import inference


def test_shares():
    assert inference.allotted([5, 5, 5], 9.7) == [3, 3, 3]
    assert inference.allotted([1, 9, 0], 8) == [1, 7, 0]
    assert inference.allotted([9, 9], 1) == [1, 0]
    assert inference.allotted([2, 2], 50) == [2, 2] and inference.allotted([], 5) == [] and inference.allotted([0], 5) == [0]


def slow_and_fast():
    slow = TaskContext.get().partitionId() == 0

    def ask(prompt):
        now = time.time()
        time.sleep(0.45 if slow else 0.002)
        return f"{now} {slow}", 1, 1

    return ask


def test_a_slow_worker_leaves_its_rate_to_others(spark):
    rate = 20.0
    df = spark.range(240).selectExpr("cast(id as string) as id", "'p' as prompt")
    rows = inference.asked(df, slow_and_fast, per_minute=rate * 60 / 0.9, workers=3).collect()
    assert len(rows) == 240 and all(r.error is None for r in rows)
    said = sorted((float(r.text.split()[0]), r.text.endswith("True")) for r in rows)
    begin, fast = said[0][0], [t for t, slow in said if not slow]
    # while the fast ones have prompts, nine tenths of the rate are kept from the second beat on, less one beat that is dealt but not yet used
    end, second = max(fast), begin + 1.5
    assert end - second > 2
    assert sum(second < t <= end for t, _ in said) >= 0.9 * rate * (end - second) - rate
    # and it is never exceeded but for the beat under way
    for k, (t, _) in enumerate(said):
        assert k + 1 <= rate * (t - begin) + 2 * rate * 1.2 + 1
    assert sum(slow for _, slow in said) == 80


def flaky():
    tried = {}

    def ask(prompt):
        tried[prompt] = tried.get(prompt, 0) + 1
        if prompt == "bad" or tried[prompt] < 2:
            raise OSError("again")
        return prompt, None, None

    return ask


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_prompts_and_failures(spark, n):
    df = spark.range(n).selectExpr("cast(id as string) as id", "if(id = 3, 'bad', concat('p', id)) as prompt")
    got = {r.id: (r.text, r.error) for r in inference.asked(df, flaky, per_minute=6000, workers=3, tries=2, every=0.1).collect()}
    assert got == {str(k): (None, "OSError: again") if k == 3 else (f"p{k}", None) for k in range(n)}
