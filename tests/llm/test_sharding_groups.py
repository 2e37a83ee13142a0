"""Groups of equal texts stay in one shard wherever shards' sizes allow it."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import hilbert
from tests.conftest import SF
from tests.llm.test_operators import docs


@pytest.mark.parametrize("seed", range(6))
def test_ends_cut_as_few_groups_as_any_choice(seed):
    rng = np.random.default_rng(seed)
    n, total = 6, int(rng.integers(20, 60))
    least, more = divmod(total, n)
    cut = set(rng.choice(total, total // 2, replace=False).tolist())
    cost = lambda large: sum(e in cut for e in np.cumsum([least + (s in large) for s in range(n)])[:-1])
    got = hilbert.ends(total, n, cut)
    sizes = np.diff([0, *got])
    assert got[-1] == total and sizes.max() - sizes.min() <= 1
    assert sum(e in cut for e in got[:-1]) == min(cost(set(c)) for c in itertools.combinations(range(n), more))
    assert set(got[:-1]) <= set(hilbert.candidates(total, n))


def test_equal_texts_share_a_shard(spark):
    """Groups over several sources; ends that would cut them are moved. A group larger than a shard is cut into as few parts as may be."""
    rows = [(i, f"text {i // 3}", f"source {i % 5}") for i in range(2 * 24 * 5 + 11)]
    got = hilbert.shard(docs(spark, rows), 24).collect()
    shards, text = defaultdict(set), {i: t for i, t, _ in rows}
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1 and sorted(count) == list(range(24))
    assert sum(len(s) > 1 for s in shards.values()) < 16  # 23 ends among groups of three, without a choice
    large = [(i, "one text", f"s{i % 3}") for i in range(60)] + [(100 + i, f"t{i}", "s0") for i in range(180)]
    got = hilbert.shard(docs(spark, large), 24).collect()
    assert len({r.shard for r in got if r.doc_id < 60}) in (6, 7)


def test_torn_groups_of_the_given_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    shards = defaultdict(set)
    text = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    for r in hilbert.shard(table, 24).collect():
        shards[text[r.doc_id]].add(r.shard)
    torn = sum(len(s) > 1 for s in shards.values())
    assert torn <= 3


def test_many_groups_are_joined_by_shuffling(spark):
    rows = spark.createDataFrame([(i, 8, i % 7, i) for i in range(100)], "doc_id long, size long, text_hash long, cell long")
    for most in (0, 100):
        assert {(r.text_hash, r.cell) for r in hilbert.as_groups(rows, most).collect()} == {(k, k) for k in range(7)}
