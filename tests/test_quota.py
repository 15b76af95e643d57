"""Leave-one-domain-out medians against statistics.median."""

import math
import random
import statistics

import pytest

from shotweave.operators.sample import synthetic_quota


def quotas(spark, classes, domains=None):
    """classes: (intent, domain, train rows)."""
    rows = [(i, d, "train") for i, d, n in classes for _ in range(n)] + [("x", "val only", "val")]
    df = spark.createDataFrame(rows, "intent string, domain string, split string")
    return {r.val_domain: r.quota for r in synthetic_quota(df, domains=domains).collect()}


def plain(classes, domains):
    ins = [c for c in classes if c[0] != "oos"]
    return {d: math.floor(statistics.median([n for _, e, n in ins if e != d] or [n for _, _, n in classes])) for d in domains}


@pytest.mark.parametrize("seed", range(4))
def test_quota_equals_median(spark, seed):
    rng = random.Random(seed)
    top = (2, 3, 9, 40)[seed]
    classes = [(f"c{i}", f"d{rng.randrange(4)}", rng.randint(1, top)) for i in range(rng.choice((9, 24)))] + [("oos", "oos", 7)]
    assert quotas(spark, classes) == plain(classes, {d for _, d, _ in classes if d != "oos"})


def test_quota_of_one_domain_and_of_named_ones(spark):
    one = [("a", "d", 2), ("b", "d", 5), ("oos", "oos", 30)]
    assert quotas(spark, one) == {"d": 5}  # nothing is left without d: the median of all classes
    two = [*one, ("c", "e", 8)]
    assert quotas(spark, two, ["e", "absent"]) == {"e": 3, "absent": 5}
    assert quotas(spark, []) == {}


def test_quota_query_samples_the_corpus_once(spark):
    from shotweave.plans.q_augment import q_aug13q
    out = q_aug13q(spark, "/root/testdata/sf0.001")
    assert not any("/corpus-" in f for f in out.inputFiles())
