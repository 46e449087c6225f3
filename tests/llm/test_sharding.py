"""Sharding: links kept, even counts, and a search over all divisions of small inputs."""

import functools
import itertools

import pytest

from tidewatch.llm import sharding

ROWS = "doc_id long, group string"


def placed(spark, groups, shards, ids=None):
    rows = spark.createDataFrame(list(zip(ids or range(len(groups)), groups)), ROWS)
    out = sharding.assigned(rows, shards)
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.group or "") for r in got) == sorted((i is None, i or 0, g or "") for i, g in zip(ids or range(len(groups)), groups))
    counts = [sum(r.shard == s for r in got) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(groups)
    return got, sharding.cut_links(out).first()


def least_cut(sizes, room):
    """The least number of cut links, by trying every division of every group over the shards."""

    @functools.cache
    def best(at, left):
        if at == len(sizes):
            return 0
        n, out = sizes[at], 10**9
        for take in itertools.product(*[range(min(n, r) + 1) for r in left]):
            if sum(take) == n:
                cut = (n * n - sum(t * t for t in take)) // 2
                out = min(out, cut + best(at + 1, tuple(sorted(r - t for r, t in zip(left, take)))))
        return out

    return best(0, tuple(sorted(room)))


def test_every_text_twice_keeps_its_links(spark):
    got, cut = placed(spark, [f"g{i // 2}" for i in range(800)], 8)
    assert (cut.links, cut.cut, cut.cut_groups, cut.groups) == (400, 0, 0, 400)
    # odd quotas leave one place in each shard: four pairs have to be cut
    got, cut = placed(spark, [f"g{i // 2}" for i in range(808)], 8)
    assert (cut.links, cut.cut) == (404, 4)


def test_one_text_of_250_sits_in_three_shards(spark):
    got, cut = placed(spark, ["hot"] * 250 + [f"s{i}" for i in range(550)], 8)
    assert len({r.shard for r in got if r.group == "hot"}) == 3
    assert cut.cut == 100 * 100 + 2 * 100 * 50


@pytest.mark.parametrize("sizes", [(4, 4, 4), (5, 2, 2, 2, 1), (3, 3, 2, 2, 1, 1), (7, 5)])
def test_cut_links_equal_the_least_possible(spark, sizes):
    got, cut = placed(spark, [f"g{i}" for i, n in enumerate(sizes) for _ in range(n)], 4)
    assert cut.cut == least_cut(sizes, (3, 3, 3, 3))


def test_nulls_repeats_and_few_rows(spark):
    placed(spark, [None] * 9 + ["a"] * 3, 4, [None] * 6 + [7] * 6)
    placed(spark, ["a"] * 5, 8)
    placed(spark, ["a"], 8)
    placed(spark, ["a"] * 17, 8, [1] * 17)
    got, cut = placed(spark, [None, None], 8)
    assert (cut.links, cut.cut, cut.groups) == (0, 0, 0)


def test_docs_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, "x" if i < 3 else None, i, "h") for i in range(6)], "doc_id long, text string, shard int, hub string")
    rows = sharding.sharded(docs, 2).collect()
    assert sorted(r.doc_id for r in rows) == list(range(6))
    assert len({r.shard for r in rows if r.doc_id < 3}) == 1 == len({r.shard for r in rows if r.doc_id >= 3})
    assert sharding.sharded(docs.limit(0), 2).count() == 0
