"""What stays the same through all rounds of a model: values, their supporters, pair counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truthloom.functions.text import char_weights, number_of
from truthloom.operators import skew
from truthloom.operators.dependence import both_directions
from truthloom.operators.sets import SET, distinct_sets, pair_counts, set_key, set_members, units_with_sets
from truthloom.operators.skew import hot_keys, spread_join
from truthloom.plans import packed
from truthloom.plans.workspace import Workspace
from truthloom.schema import CLAIM, FACT, ITEM, as_claims, dedupe_claims

BLOCK = ["block_id"]
#: Facts, or members of sets, that one task of a round takes, and groups of items that facts are numbered in.
PLACED_ROWS = 200_000
GROUPS_PER_TASK = 16
#: Claims that one task makes facts of.
DEALT_CLAIMS = 1_000_000


@dataclass
class Placed:
    """Facts dealt by item once for all rounds, so that rounds move scores of sets and never facts.

    ``facts``  item_hash, group_id, block, object, property, value, SET, at   bucketed by ``group_id``, a hash of the item
    ``sets``   group_id, block, SET, at   bucketed by block and SET: the sets of each group, numbered from 1
    """

    facts: DataFrame
    sets: DataFrame
    tasks: int

    def scored(self, set_scores: DataFrame) -> DataFrame:
        """Facts with the score of their set; facts of blocks without scores are left out.

        The scores go to the groups that hold their sets, one array per group in the order of the sets'
        numbers: the only rows shuffled are distinct sets of groups.
        """
        scores = set_scores.select(*BLOCK, *SET, "score")
        wanted = self.sets.join(scores, [*BLOCK, *SET], "left").select("group_id", "at", "score")
        # as many partitions as buckets: else Spark deals the facts anew
        wanted = wanted.repartition(self.tasks, "group_id").groupBy("group_id").agg(
            F.array_sort(F.collect_list(F.struct("at", "score"))).alias("known")
        )
        arrays = wanted.select("group_id", F.col("known.score").alias("known"))
        joined = self.facts.join(arrays.hint("shuffle_hash"), "group_id").withColumn("score", F.get("known", F.col("at") - 1))
        return joined.drop("known", "at").where(F.col("score").isNotNull())


@dataclass
class ClaimBase:
    """Claims prepared once for an iterative model.

    ``facts``      object, property, value, SET   one row per claimed value; SET = its supporters
    ``members``    SET, source                    the sources of each distinct supporter set
    ``items``      object, property, SET          one row per item; SET = all its claimants
    ``claimants``  SET, source                    the sources of each distinct claimant set

    A round works on facts and on distinct supporter sets.  The claims themselves are not
    read again.  ``blocks`` (block_id, property) runs the model separately for each block of
    properties in the same job; a property may be in several blocks.
    """

    claims: DataFrame
    work: Workspace
    blocks: DataFrame | None = None
    shared: dict = field(default_factory=dict)
    _placed: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, claims: DataFrame | ClaimBase, blocks: DataFrame | None = None, deduped: bool = False) -> ClaimBase:
        if isinstance(claims, ClaimBase):
            return claims if blocks is None else claims.with_blocks(blocks)
        ready = claims.select(*CLAIM) if deduped else dedupe_claims(as_claims(claims))
        return cls(ready, Workspace(claims.sparkSession), blocks)

    def with_blocks(self, blocks: DataFrame) -> ClaimBase:
        """The same prepared tables, resolved in other blocks."""
        return ClaimBase(self.claims, self.work, blocks, self.shared)

    def _once(self, name: str, make: Callable):
        if name not in self.shared:
            self.shared[name] = make()
        return self.shared[name]

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self._once(name, lambda: self.work.keep(make(), name))

    def _hot(self, name: str, sizes: Callable[[], DataFrame], keys: list[str], size: str, total: int) -> DataFrame | None:
        def find():
            found = hot_keys(sizes, keys, size, total)
            return None if found is None else self.work.keep(found, f"hot-{name}")

        return self._once(f"hot-{name}", find)

    @property
    def source_names(self) -> list[str] | None:
        """The sources in order; ``None`` if there are none or more than fit the masks."""
        def make() -> list[str] | None:
            rows = self.claims.select("source").distinct().limit(packed.MOST_SOURCES + 1).collect()
            return sorted((row.source for row in rows), key=str.encode) if 0 < len(rows) <= packed.MOST_SOURCES else None

        return self._once("source-names", make)

    @property
    def sources(self) -> DataFrame | None:
        """``source, number`` in the order of the names; ``None`` if there are more than fit the masks."""
        def make() -> DataFrame | None:
            if self.source_names is None:
                return None
            pairs = F.array(*[F.struct(F.lit(name).alias("source"), F.lit(at).alias("number")) for at, name in enumerate(self.source_names)])
            return self.work.spark.range(0, 1, 1, 1).select(F.inline(pairs))

        return self._once("sources", make)

    @property
    def n_sources(self) -> int:
        return len(self.source_names)

    @property
    def dealing(self) -> tuple[int, int]:
        """Numbers of groups of items and of the tasks that these are dealt to, with few sources."""
        def count() -> tuple[int, int]:
            rows = self.claims.count()
            cores = self.work.spark.sparkContext.defaultParallelism
            tasks = cores * max(1, -(-rows // (cores * DEALT_CLAIMS)))  # no last wave that leaves cores idle
            return max(4 * tasks, -(-rows // packed.GROUP_CLAIMS)), tasks

        return self._once("dealing", count)

    @property
    def masked_facts(self) -> DataFrame:
        """Facts; with few sources also the numbers of their supporters as bit masks, and a ``group_id`` they are dealt by.

        With few sources no item has many claims.  Claims are then shuffled once, by a hash of their item;
        facts, items and packed groups are made where the claims are.
        """
        def make() -> DataFrame:
            if self.sources is None:
                return self.work.keep(units_with_sets(self.claims, FACT, "source"), "facts")
            n_groups, tasks = self.dealing
            dealt = self.claims.select(packed.group_of(n_groups).alias("group_id"), *CLAIM).repartition(tasks, "group_id")
            masks = packed.mask_columns(F.col("number"), self.n_sources)
            made = dealt.join(F.broadcast(self.sources), "source").groupBy("group_id", *FACT).agg(*set_key("source"), *masks)
            return self.work.keep_bucketed(made, "facts", tasks, "group_id", dealt=True)

        return self._once("facts", make)

    @property
    def facts(self) -> DataFrame:
        return self.masked_facts.select(*FACT, *SET)

    def packed(self, rule: packed.Rule = packed.Rule()) -> packed.Packed | None:
        """Facts in packed groups for rounds by ``rule``; ``None`` if they are few, or the sources many, or an item is hot."""
        if self.size.facts < packed.PACKED_FACTS or self.sources is None or self.hot_items is not None:
            return None
        n_sources, blocks, n_blocks = self.n_sources, None, 1
        if self.blocks is not None:
            n_blocks = self.blocks.select(*BLOCK).distinct().count()
        if n_blocks * n_sources * n_sources > packed.MOST_PAIRS:
            return None
        if self.blocks is not None:
            ids = self.blocks.select(*BLOCK).distinct().withColumn("block", F.row_number().over(W.orderBy(*BLOCK)) - 1)
            blocks = self.work.keep(self.blocks.select(*BLOCK, "property").distinct().join(ids, BLOCK).coalesce(1), "numbered-blocks")
        named = self._once("sources-array", lambda: F.array(*[F.lit(name) for name in self.source_names]))
        return packed.Packed(self.packed_groups(rule.numeric), named, n_sources, blocks, rule=rule)

    def packed_groups(self, numbered: bool = False) -> DataFrame:
        """With ``numbered`` the values as numbers too."""
        def make() -> DataFrame:
            dealt = self.masked_facts.drop(*SET)
            if numbered:
                dealt = dealt.withColumn("x", number_of(F.col("value")))
            return dealt.groupBy("group_id").applyInArrow(packed.pack_group, packed.NUMBERED if numbered else packed.PACKED)

        return self._table("packed-numbers" if numbered else "packed", make)

    @property
    def size(self) -> Row:
        """Numbers of facts and claims and the greatest supporter set, in one small job."""
        return self._once("size", lambda: self.facts.agg(
            F.count(F.lit(1)).alias("facts"),
            F.coalesce(F.sum("set_size"), F.lit(0)).alias("claims"),
            F.coalesce(F.max("set_size"), F.lit(0)).alias("biggest_set"),
        ).first())

    @property
    def sets(self) -> DataFrame:
        """Distinct supporter sets with the number of facts that have them."""
        return self._table("sets", lambda: distinct_sets(self.facts, FACT))

    @property
    def n_members(self) -> int:
        return self._once("n_members", lambda: self.sets.agg(F.sum("set_size")).first()[0] or 0)

    @property
    def members(self) -> DataFrame:
        """The members of every set lie in one bucket, so pairs of them and sums over them need no shuffle."""
        def make() -> DataFrame:
            found = set_members(self.claims, self.sets, FACT, "source", self.hot_facts)
            return self.work.keep_bucketed(found, "members", self.tasks(self.n_members), *SET)

        return self._once("members", make)

    def tasks(self, rows: int) -> int:
        """Buckets for so many rows: work for all cores, and no more rows than a task may take."""
        return max(self.work.spark.sparkContext.defaultParallelism, -(-rows // PLACED_ROWS))

    @property
    def items(self) -> DataFrame:
        """The sets of an item's values are disjoint, so their XOR sums add up to the item's."""
        dealt = [c for c in ("group_id",) if c in self.masked_facts.columns]
        return self._table("items", lambda: self.masked_facts.groupBy(*dealt, *ITEM).agg(
            F.bit_xor("set_hi").alias("set_hi"),
            F.bit_xor("set_lo").alias("set_lo"),
            F.sum("set_size").alias("set_size"),
            F.count(F.lit(1)).alias("n_values"),
        ).drop(*dealt))

    @property
    def biggest_item(self) -> int:
        return self._once("biggest-item", lambda: self.items.agg(F.max("n_values")).first()[0] or 0)

    @property
    def item_sets(self) -> DataFrame:
        """Distinct claimant sets with the number of items that have them."""
        return self._table("item-sets", lambda: distinct_sets(self.items, ITEM))

    @property
    def claimants(self) -> DataFrame:
        hot = self._hot("item-claims", lambda: self.items, ITEM, "set_size", self.size.claims)
        return self._table("claimants", lambda: set_members(self.claims, self.item_sets, ITEM, "source", hot))

    @property
    def hot_facts(self) -> DataFrame | None:
        return self._hot("facts", lambda: self.facts, FACT, "set_size", self.size.claims)

    @property
    def hot_items(self) -> DataFrame | None:
        # an item has no more values than there are sources
        if skew.SHARE is None and self.sources is not None and self.n_sources <= skew.FLOOR:
            return None
        return self._hot("items", lambda: self.items, ITEM, "n_values", self.size.facts)

    @property
    def hot_fact_sets(self) -> DataFrame | None:
        """Sets shared by very many facts, such as the set of one very busy source."""
        return self._hot("fact-sets", lambda: self.sets, SET, "n", self.size.facts)

    @property
    def hot_member_sets(self) -> DataFrame | None:
        return self._hot("member-sets", lambda: self.sets, SET, "set_size", self.n_members)

    @property
    def hot_sources(self) -> DataFrame | None:
        def sizes():
            return self.members.groupBy("source").agg(F.count(F.lit(1)).alias("n_sets"))

        return self._hot("sources", sizes, ["source"], "n_sets", self.n_members)

    def votes_per_value(self) -> DataFrame:
        return self.facts.select(*FACT, F.col("set_size").alias("votes"))

    def in_blocks(self, rows: DataFrame) -> DataFrame:
        """Rows with a ``property`` once per block that contains it."""
        if self.blocks is None:
            return rows.withColumn("block_id", F.lit(0))
        return rows.join(self.blocks, "property")

    @cached_property
    def block_sets(self) -> DataFrame:
        """``block, SET, n_facts`` of the supporter sets that occur in a block."""
        if self.blocks is None:
            return self.sets.select(F.lit(0).alias("block_id"), *SET, F.col("n").alias("n_facts"))
        counted = self.in_blocks(self.facts).groupBy(*BLOCK, *SET).agg(F.count(F.lit(1)).alias("n_facts"))
        return self.work.keep(counted, "block-sets")

    @property
    def spelled_facts(self) -> DataFrame:
        """Facts with the character weights of their value, worked out once for all rounds."""
        return self._table("spelled", lambda: self.facts.withColumn("weights", char_weights(F.col("value"))))

    def block_members(self) -> DataFrame:
        """``block, SET, source`` for the supporter sets of each block."""
        if self.blocks is None:
            return self.members.withColumn("block_id", F.lit(0))
        return self.member_values(self.block_sets.select(*BLOCK, *SET))

    def member_values(self, per_set: DataFrame) -> DataFrame:
        """``per_set`` (block, SET, ...) once per member of the set."""
        return spread_join(self.members, per_set, SET, self.hot_member_sets, SET, F.col("source"))

    def _pairs(self, weights: DataFrame) -> DataFrame:
        return pair_counts(self.members, weights, "source", BLOCK, self.hot_member_sets, self.size.biggest_set)

    def same_pairs(self) -> DataFrame:
        """Values claimed by both sources, per block and pair of sources."""
        return self._pairs(self.block_sets.select(*BLOCK, *SET, F.col("n_facts").alias("n")))

    def common_pairs(self) -> DataFrame:
        """Items claimed by both sources, per block and pair of sources."""
        if self.blocks is None:
            weights = self.item_sets.select(F.lit(0).alias("block_id"), *SET, "n")
        else:
            weights = self.in_blocks(self.items).groupBy(*BLOCK, *SET).agg(F.count(F.lit(1)).alias("n"))
        hot = self._hot("claimant-sets", lambda: self.item_sets, SET, "set_size", self.size.claims)
        return pair_counts(self.claimants, weights, "source", BLOCK, hot)

    def true_pairs(self, per_set: DataFrame) -> DataFrame:
        """True values claimed by both sources; ``per_set`` has ``block, SET, n_true``."""
        weights = per_set.where(F.col("n_true") > 0).select(*BLOCK, *SET, F.col("n_true").alias("n"))
        return self._pairs(weights).withColumnsRenamed({"m1": "s1", "m2": "s2", "n": "n_true"})

    @cached_property
    def pairs(self) -> DataFrame:
        """``block, s1, s2, n_common, n_same`` for s1 < s2 that share an item."""
        same = self.same_pairs().withColumnRenamed("n", "n_same")
        common = self.common_pairs().withColumnRenamed("n", "n_common")
        joined = common.join(same, [*BLOCK, "m1", "m2"], "left").fillna(0, ["n_same"])
        return self.work.keep(joined.withColumnsRenamed({"m1": "s1", "m2": "s2"}), "pairs")

    @cached_property
    def hot_pairs(self) -> DataFrame | None:
        """Ordered pairs of sources that meet in very many sets; none while no pair can."""
        if self.sets.count() <= skew.FLOOR:
            return None
        met = self._pairs(self.block_sets.select(*BLOCK, *SET, F.lit(1).alias("n")))
        met = met.groupBy(F.col("m1").alias("s1"), F.col("m2").alias("s2")).agg(F.sum("n").alias("n"))
        sizes = self.work.keep(both_directions(met), "meetings")
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        found = hot_keys(lambda: sizes, ["s1", "s2"], "n", total)
        return None if found is None else self.work.keep(found, "hot-pairs")

    @cached_property
    def hub_sources(self) -> DataFrame | None:
        """Sources that share items with very many others; ``None`` while no source can."""
        total = 2 * self.pairs.count()
        if total <= skew.FLOOR:
            return None
        met = both_directions(self.pairs.select(*BLOCK, "s1", "s2")).groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
        found = hot_keys(lambda: met, ["s1"], "n", total)
        return None if found is None else self.work.keep(found, "hub-sources")

    def initial_trust(self, trust: float) -> DataFrame:
        """Every source of every block starts with the same trust."""
        seen = self.block_members().select(*BLOCK, "source").distinct()
        start = seen.withColumn("trust", F.lit(float(trust))).withColumn("old_trust", F.lit(float(trust)))
        return self.work.keep(start, "trust-0")

    def placed(self, spelled: bool = False) -> Placed | None:
        """Facts of every block dealt by item; ``None`` if some item has more facts than a task may take."""
        if self.hot_items is not None:
            return None
        if spelled not in self._placed:
            self._placed[spelled] = self._place(self.in_blocks(self.spelled_facts if spelled else self.facts))
        return self._placed[spelled]

    def _place(self, facts: DataFrame) -> Placed:
        rows = self.size.facts if self.blocks is None else self.block_sets.agg(F.sum("n_facts")).first()[0] or 0
        tasks = self.tasks(rows)
        group = F.pmod(F.xxhash64(*ITEM), F.lit(tasks * GROUPS_PER_TASK)).cast("int")
        number = F.dense_rank().over(W.partitionBy("group_id").orderBy(*BLOCK, *SET))
        # sorts by item compare this number first, and texts only where it is equal
        numbered = facts.withColumns({"group_id": group, "item_hash": F.xxhash64(*BLOCK, *ITEM)}).withColumn("at", number)
        dealt = self.work.keep_bucketed(numbered, "placed-facts", tasks, "group_id")
        sets = dealt.groupBy("group_id", *BLOCK, *SET).agg(F.min("at").alias("at"))
        return Placed(dealt, self.work.keep_bucketed(sets, "placed-sets", tasks, *BLOCK, *SET), tasks)

    def scored_facts(self, set_scores: DataFrame, spelled: bool = False) -> DataFrame:
        """Facts of every block with the score of their supporter set.

        With a ``group_id``, by which the rows are dealt, unless an item is hot: then facts are joined
        with the scores by set.
        """
        placed = self.placed(spelled)
        if placed is not None:
            return placed.scored(set_scores)
        scores = set_scores.select(*BLOCK, *SET, "score")
        facts = self.spelled_facts if spelled else self.facts
        return spread_join(self.in_blocks(facts), scores, [*BLOCK, *SET], self.hot_fact_sets, SET, F.struct(*FACT))
