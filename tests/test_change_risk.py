"""Change-risk features against a count by hand."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_relations import store
from tidemark.operators import delivery


@pytest.mark.parametrize("seed", [1, 2])
def test_earlier_authors_by_hand(spark, seed):
    """Ten paths that many touch, others that few touch, equal moments, and a commit without author, which counts for nobody."""
    rng = random.Random(seed)
    start = datetime(2025, 12, 20)
    commits = [{"rev": f"c{k}", "date": (start + timedelta(hours=rng.randrange(400))).isoformat(sep=" "), "author": f"a{rng.randrange(9)} <m>"} for k in range(80)]
    pool = [f"hot{k}" for k in range(10)] * 3 + [f"lib/f{k}" for k in range(40)]
    changes = [(c["rev"], p, "modified", None, 1, 0) for c in commits for p in sorted(set(rng.sample(pool, rng.randint(1, 6))))]
    fs = store(spark, commits, changes)
    unknown = {"c7", "c30"}
    fs = fs.replacing(commits=fs.table("commits").withColumn("canonical_author", F.when(~F.col("rev").isin(*unknown), F.col("canonical_author"))))
    by = {c["rev"]: (c["date"], None if c["rev"] in unknown else c["author"]) for c in commits}
    want = {}
    for rev, (at, who) in by.items():
        mine = {p for r, p, *_ in changes if r == rev}
        earlier = [(r, by[r][1]) for r, p, *_ in changes if p in mine and by[r][0] < at]
        exp = sum(1 for d, a in by.values() if a is not None and a == who and d < at)
        want[rev] = (len({a for _, a in earlier if a is not None}), len(earlier), exp)
    got = {r["rev"]: (r["ndev"], r["nuc"], r["exp"]) for r in delivery.kamei_features(fs).collect()}
    assert got == want
