"""Mixing sources to target weights of the total size in tokens.

Shares are exact up to one document per source: the total is the largest for
which no source needs more than its cap of repeats (or a smaller one asked
for). A source's documents form blocks in a random permutation; all blocks are
used floor(quota / size) times, and blocks in permuted order once more until
the rest of the quota is met, the last one up to a document.

The blocks drawn are dealt to output shards by a splitting tree: at each node
the counts by source of one half are a multivariate hypergeometric draw from
those of the whole, so every shard gets an exact quota of each source's blocks.
Blocks are disjoint, and each shard is shuffled on its own. The driver only
holds counts by source and block, whose number is a parameter. The block that
meets a quota's rest is cut on the executors: into sub-blocks of about
BLOCK_ROWS rows each, of which whole ones are taken as long as they fit, so
that only one sub-block is put in order, whatever the size of the source.

Edge cases: targets whose source has no documents are reported with share 0
and their weight goes to the others in proportion; documents of sources
without target, with null source or without tokens are not used; spellings
of a source that differ in case, spaces, `_` and `-` are one; a cap below 1
or null excludes the source; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.llm.tokens import DEFAULT_RANKS, with_token_counts
from dossierflow.session import materialise

#: Rows per block aimed at, and the most blocks of all sources together (but for the few that every shard needs).
BLOCK_ROWS, MAX_BLOCKS = 2_000, 65_536
#: Drawn blocks up to which their table is broadcast.
MAX_BROADCAST = 500_000

PICK_SCHEMA = "mix_name string, source string, block int, draw int, shard int, partial boolean, rest long"
SHARE_SCHEMA = "mix_name string, source string, target_share double, max_repeats int, n_docs long, available_tokens long, quota_tokens double"


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[_\-\s]+", "-")


@dataclass(frozen=True)
class MixPlan:
    """Which blocks are drawn how often into which shard, and what was planned for each target."""

    picks: list[tuple]
    shares: list[tuple]


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """counts by source -> matrix (shard, source) of exact quotas, by recursive hypergeometric splits."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    if total == 0:
        return np.zeros((shards, len(counts)), dtype=np.int64)
    half = rng.multivariate_hypergeometric(counts, total * left // shards, method="marginals")
    return np.vstack([split_tree(half, left, rng), split_tree(counts - half, shards - left, rng)])


def plan_mixes(targets: list[tuple], blocks: dict[str, list[tuple[int, int, int]]], shards: int, seed: int, total_tokens: float | None = None) -> MixPlan:
    """targets: (mix, source, share, cap); blocks: source -> [(block, docs, tokens)]."""
    picks, shares = [], []
    for k, mix in enumerate(sorted({t[0] for t in targets})):
        own = sorted((s, float(w), int(r)) for m, s, w, r in targets if m == mix)
        size = {s: sum(b[2] for b in blocks.get(s, [])) for s, _, _ in own}
        live = [(s, w, r) for s, w, r in own if size[s] > 0 and w > 0 and r > 0]
        weight = sum(w for _, w, _ in live)
        total = min((r * size[s] * weight / w for s, w, r in live), default=0.0)
        if total_tokens is not None:
            total = min(total, total_tokens)
        units: dict[str, list[tuple[int, int, bool, int]]] = {}
        for s, w, r in own:
            quota = total * w / weight if any(x[0] == s for x in live) else 0.0
            shares.append((mix, s, w, r, sum(b[1] for b in blocks.get(s, [])), size[s], quota))
            if not quota:
                continue
            rng = np.random.default_rng([seed, k, *map(ord, s)])
            order = rng.permutation(len(blocks[s]))
            full = min(r, int(quota / size[s] + 1e-9))
            drawn = [(blocks[s][i][0], d, False, 0) for d in range(1, full + 1) for i in order]
            rest = int(quota - full * size[s] + 1e-6) if full < r else 0
            for i in order:
                if rest <= 0:
                    break
                block, _, tokens = blocks[s][i]
                drawn.append((block, full + 1, tokens > rest, rest))
                rest -= tokens
            units[s] = drawn
        names = sorted(units)
        if not names:
            continue
        rng = np.random.default_rng([seed, k])
        quotas = split_tree(np.array([len(units[s]) for s in names], dtype=np.int64), shards, rng)
        for j, s in enumerate(names):
            order = rng.permutation(len(units[s]))
            at = 0
            for shard in range(shards):
                for i in order[at : at + quotas[shard, j]]:
                    block, draw, partial, rest = units[s][i]
                    picks.append((mix, s, int(block), draw, shard, partial, int(rest)))
                at += quotas[shard, j]
    return MixPlan(picks, shares)


DRAWN = ("mix_name", "source", "doc_id", "n_tokens", "draw", "shard")


def cut_to_rest(drawn: DataFrame, seed: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of partly drawn blocks in a random order up to the tokens of their `rest`.

    A block is divided by a hash into sub-blocks of about block_rows rows; the
    order goes by sub-block first. Running sums over sub-blocks tell which are
    taken whole and which one is cut; only that one is sorted.
    """
    key = ["mix_name", "source", "block"]
    sizes = drawn.groupBy(*key).agg(F.count("*").alias("n"))
    number = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows))
    split = drawn.join(sizes, key).withColumn("sub", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.lit("sub")), number))
    sums = split.groupBy(*key, "sub").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*key).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = split.join(sums.withColumn("before", before), [*key, "sub"]).where("before < rest")
    whole = placed.where("before + t <= rest")
    inner = Window.partitionBy(*key, "sub").orderBy(F.xxhash64(F.lit(seed), "doc_id", F.lit("cut")), "doc_id")
    last = placed.where("before + t > rest").withColumn("upto", F.sum("n_tokens").over(inner)).where("before + upto <= rest").drop("upto")
    return whole.unionByName(last)


@dataclass
class Mixture:
    draws: DataFrame
    plan: DataFrame

    def documents(self) -> DataFrame:
        """mix_name, source, doc_id, n_tokens, repeats of the chosen documents."""
        return self.draws.groupBy("mix_name", "source", "doc_id").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("repeats"))

    def shares(self) -> DataFrame:
        """What each target asked for and what was reached."""
        used = self.draws.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("used_docs"), F.max("draw").alias("most_repeats"))
        joined = self.plan.join(used, ["mix_name", "source"], "left").na.fill({"used_tokens": 0, "used_docs": 0, "most_repeats": 0})
        whole = F.sum("used_tokens").over(Window.partitionBy("mix_name"))
        return joined.withColumn("actual_share", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(F.lit(0.0)))


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 17, shards: int = 16, total_tokens: float | None = None, ranks: str = DEFAULT_RANKS) -> Mixture:
    """Combines documents (doc_id, text, source) by targets (mix_name, source, target_share, max_repeats)."""
    spark = documents.sparkSession
    wanted = targets.select("mix_name", source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("mix_name is not null and source is not null and target_share is not null and max_repeats is not null")
    wanted = wanted.groupBy("mix_name", "source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r"))
    # the targets are a stated table of mixes
    rows = wanted.collect()
    names = sorted({r["source"] for r in rows})
    keyed = documents.select("doc_id", "text", source_key(F.col("source")).alias("source")).where(F.col("source").isin(names) if names else F.lit(False))
    sized = materialise(with_token_counts(keyed, "doc_id", "text", "source", ranks).where("n_tokens > 0"))
    counts = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.count("*").alias("n")).collect()}
    most = max(8 * shards, MAX_BLOCKS // max(1, len(counts)))
    n_blocks = {s: int(min(most, max(8 * shards, -(-n // BLOCK_ROWS)))) for s, n in counts.items()}
    number = F.lit(1)
    for s, n in n_blocks.items():
        number = F.when(F.col("source") == s, n).otherwise(number)
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.lit("block"))
    blocked = sized.withColumn("block", F.pmod(key, number).cast("int"))
    blocks: dict[str, list[tuple[int, int, int]]] = {}
    for r in blocked.groupBy("source", "block").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).orderBy("source", "block").collect():
        blocks.setdefault(r["source"], []).append((r["block"], r["n"], r["t"]))
    made = plan_mixes([(r["mix_name"], r["source"], r["w"], r["r"]) for r in rows], blocks, shards, seed, total_tokens)
    picks = spark.createDataFrame(made.picks, PICK_SCHEMA)
    # at most MAX_BLOCKS blocks, for each repeat of each mix; counted all the same
    drawn = blocked.join(F.broadcast(picks) if len(made.picks) <= MAX_BROADCAST else picks, ["source", "block"])
    kept = drawn.where("not partial").select(*DRAWN).unionByName(cut_to_rest(drawn.where("partial"), seed).select(*DRAWN))
    slot = F.xxhash64(F.lit(seed), "doc_id", "draw", "shard")
    return Mixture(kept.select("mix_name", "shard", slot.alias("slot"), "source", "doc_id", "draw", "n_tokens"), spark.createDataFrame(made.shares, SHARE_SCHEMA))


def shuffled_shards(draws: DataFrame) -> DataFrame:
    """The draws in the random order of their slots within each shard, range by range."""
    order = ["mix_name", "shard", "slot", "doc_id"]
    return draws.repartitionByRange(*order).sortWithinPartitions(*order)
