"""Mixing sources to target weights."""

import numpy as np
import pytest

from dossierflow.llm.mixing import cut_to_rest, mix_sources, plan_mixes, shuffled_shards, split_tree


def test_splitting_tree_is_exact():
    counts = np.array([100, 37, 0, 5])
    m = split_tree(counts, 7, np.random.default_rng(1))
    assert m.shape == (7, 4) and (m.sum(axis=0) == counts).all() and (m >= 0).all()
    sizes = m.sum(axis=1)
    assert sizes.max() - sizes.min() <= 3
    assert split_tree(np.array([0, 0]), 3, np.random.default_rng(1)).sum() == 0


def test_plan_uses_every_block_evenly():
    blocks = {"a": [(i, 10, 100) for i in range(10)], "b": [(i, 1, 50) for i in range(4)]}
    plan = plan_mixes([("m", "a", 0.5, 2), ("m", "b", 0.5, 3), ("m", "none", 0.1, 1)], blocks, 4, 3)
    quota = {s: q for _, s, _, _, _, _, q in plan.shares}
    assert quota == {"a": 600.0, "b": 600.0, "none": 0.0}
    drawn = [(s, b, d) for _, s, b, d, *_ in plan.picks]
    assert len(drawn) == len(set(drawn)) and sum(s == "b" for s, *_ in drawn) == 12 and max(d for s, _, d in drawn if s == "b") == 3


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, draw int")


def test_shares_and_caps(spark):
    rows = [(i, "some words here " * (1 + i % 5), "Big_Source" if i % 2 else "big-source ", 0) for i in range(400)] + [(1000 + i, "small text", "small", 0) for i in range(20)] + [(2000, None, "small", 0), (2001, "", "small", 0), (2002, "x", None, 0), (2003, "x", "other", 0)]
    targets = spark.createDataFrame([("m", "big-source", 0.7, 2), ("m", "small", 0.3, 4), ("m", "missing", 0.1, 9), ("n", "small", 1.0, 1), ("n", "big-source", None, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mix = mix_sources(docs(spark, rows), targets, shards=4)
    shares = {(r.mix_name, r.source): r for r in mix.shares().collect()}
    assert shares["m", "small"].actual_share == pytest.approx(0.3, abs=0.02) and shares["m", "big-source"].actual_share == pytest.approx(0.7, abs=0.02)
    assert shares["m", "missing"].actual_share == 0.0 and shares["n", "small"].actual_share == 1.0
    chosen = mix.documents().collect()
    assert max(r.repeats for r in chosen if r.source == "small" and r.mix_name == "m") == 4
    assert max(r.repeats for r in chosen if r.source == "big-source") <= 2
    assert not {2000, 2001, 2002, 2003} & {r.doc_id for r in chosen}
    again = mix_sources(docs(spark, rows).repartition(3), targets, shards=4)
    key = lambda d: sorted((r.mix_name, r.shard, r.doc_id, r.draw) for r in d.draws.collect())
    assert key(mix) == key(again)


def test_partial_blocks_are_cut_by_sub_blocks(spark):
    rows = [("m", s, b, i, 1 + i % 7, 3, 0, 500 + 100 * b) for s in "xy" for b in (1, 2) for i in range(1000)]
    drawn = spark.createDataFrame(rows, "mix_name string, source string, block int, doc_id long, n_tokens long, draw int, shard int, rest long")
    kept = cut_to_rest(drawn, 5, block_rows=50).groupBy("source", "block").sum("n_tokens").collect()
    assert len(kept) == 4 and all(0 <= 500 + 100 * r["block"] - r["sum(n_tokens)"] < 7 for r in kept)
    assert cut_to_rest(drawn.limit(0), 5).collect() == []


def test_shards_are_in_random_order_over_many_tasks(spark):
    rows = [("m", i % 2, (i * 7919) % 10007, "s", i, 1, 1) for i in range(2000)]
    draws = spark.createDataFrame(rows, "mix_name string, shard int, slot long, source string, doc_id long, draw int, n_tokens long")
    out = shuffled_shards(draws)
    got = [(r.shard, r.slot) for r in out.collect()]
    assert len(got) == 2000 and got == sorted(got)


def test_empty(spark):
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mix = mix_sources(docs(spark, []), targets)
    assert mix.documents().collect() == [] and [r.actual_share for r in mix.shares().collect()] == [0.0]
    assert mix_sources(docs(spark, [(1, "a", "a", 0)]), targets.limit(0)).documents().collect() == []
