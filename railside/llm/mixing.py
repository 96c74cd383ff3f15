"""Mixing sources to target weights over a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a seeded hash of its rows. A source's target fixes its quota of
blocks: every block ``full`` times, and once more the blocks that fit, in permuted order, into what
is left; what is left of that is filled from a block that did not fit, by sub-blocks and at last by
single documents. A token for each copy that is taken, and for nothing else, stands at the root of a
binary tree over the output shards: the root's numbers by source are the quotas. A node sends a
uniformly drawn half of its tokens to the left, so that the numbers by source on the left follow the
multivariate hypergeometric law of the node's quotas; leaves are output shards. The draw is by a
histogram of the tokens' hashes, so no task holds a node. Rows of a shard are ordered by a seeded
hash. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railside.llm.cluster import cut, missing, small_side

#: A word: a run of anything but space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Blocks of a source, and parts of a block that is cut further; a power of two.
FANOUT_BITS = 8
#: How often a block that did not fit is cut before single documents are taken.
LEVELS = 3
#: Bits of a token's hash that name its bin in a node of the tree.
BIN_BITS = 12


def word_count(text: Column) -> Column:
    return missing(F.regexp_count(text, F.lit(WORD)), 0).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> with source_no and target.

    Targets share ``share`` times all sizes by weight; none exceeds ``most`` times its source's size,
    and what is cut off is shared by weight among the others: target = min(cap, level * weight) with
    one level for all. The windows are in one task, with a row of a few dozen bytes for each source: a
    million sources are well within it.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.select("*", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).alias("source_no"))
    ranked = ranked.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")).alias("w"), (F.lit(most) * F.col("source_size")).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "source_no")
    ranked = ranked.select("*", (F.lit(share) * F.sum("source_size").over(everything)).alias("all"), missing(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), 0.0).alias("capped"), F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    level = (F.col("all") - F.col("capped")) / F.col("rest")
    free = ranked.select("*", level.alias("level"), (level * F.col("w") <= F.col("cap")).alias("fits"))
    shared = F.min(F.when(F.col("fits"), F.struct(F.col("capped"), F.col("level")))).over(everything)["level"]
    return free.select("source", "source_size", "source_no", F.when(F.col("fits"), F.least(F.col("cap"), shared * F.col("w"))).otherwise(F.col("cap")).alias("target"))


def _first_fit(parts: DataFrame, room: DataFrame, seed: int) -> DataFrame:
    """source_no, part, words; source_no, room -> source_no, took (array of parts), room, cut.

    Parts are met in permuted order; each that fits is taken. ``cut`` is the smallest that did not
    fit: its words, then the part. A source has at most as many parts as one level of cutting gives.
    """
    lists = parts.groupBy("source_no").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), F.col("source_no"), F.col("part")).alias("h"), F.col("part"), F.col("words")))).alias("ps"))
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("took"), F.lit(None).cast("struct<words:bigint,part:bigint>").alias("cut"))

    def step(acc: Column, p: Column) -> Column:
        fits = p["words"] <= acc["room"]
        return F.struct(
            F.when(fits, acc["room"] - p["words"]).otherwise(acc["room"]).alias("room"),
            F.when(fits, F.concat(acc["took"], F.array(p["part"]))).otherwise(acc["took"]).alias("took"),
            F.when(fits, acc["cut"]).otherwise(F.least(acc["cut"], F.struct(p["words"].alias("words"), p["part"].alias("part")))).alias("cut"),
        )

    return lists.join(room, "source_no").select("source_no", F.aggregate("ps", start, step).alias("a")).select("source_no", "a.took", "a.room", "a.cut")


def _part(level: int) -> Column:
    """The first bits of a row's key: its block (level 0), or a part of a block."""
    return F.shiftrightunsigned("key", 64 - FANOUT_BITS * (level + 1)) if level < LEVELS else F.col("key")


class Mix:
    """Targets, quotas and the splitting tree of one mix, to be applied to its rows.

    The tables that it keeps have a few hundred rows for each source at most.
    """

    def __init__(self, docs: DataFrame, shards: int = 8, seed: int = 11, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.seed, self.columns = seed, (id_col, text_col, source_col)
        self.rows = rows = cut(self._keyed(docs).select("id", "source", "size", "key"))
        targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        some = F.col("source_size") > 0
        full = F.when(some, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(F.lit(0))
        targets = targets.withColumn("full", full.cast("int"))
        self.targets = small_side(cut(targets.withColumn("room", F.when(some, F.col("target") - F.col("full") * F.col("source_size")).otherwise(F.lit(0.0)))))
        known = self._sourced(rows)
        self.chosen = self._quotas(known)
        self.places = self._tree(known, shards)

    def _keyed(self, docs: DataFrame) -> DataFrame:
        id_, text, source = (F.col(c) for c in self.columns)
        size = word_count(text)
        key = F.xxhash64(F.lit(self.seed), id_, size, F.when(id_.isNull(), F.xxhash64(text)))
        return docs.select(id_.alias("id"), source.cast("string").alias("source"), size.alias("size"), key.alias("key"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))

    def _sourced(self, rows: DataFrame) -> DataFrame:
        known = self.targets.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "full")
        return rows.join(known, rows["source"].eqNullSafe(F.col("_source"))).drop("_source").withColumn("block", _part(0))

    def _quotas(self, known: DataFrame) -> list[DataFrame]:
        """By level, the parts that are taken once more: source_no, part."""
        inside, room, chosen = known, self.targets.select("source_no", "room"), []
        for level in range(LEVELS + 1):
            cells = inside.select("source_no", _part(level).alias("part"), "size").groupBy("source_no", "part").agg(F.sum("size").alias("words"))
            fit = _first_fit(cells, room, self.seed + level)
            if level == LEVELS:  # one document more if that comes nearer to the target
                nearer = F.col("cut").isNotNull() & (F.col("cut.words") - F.col("room") < F.col("room"))
                fit = fit.withColumn("took", F.when(nearer, F.concat("took", F.array("cut.part"))).otherwise(F.col("took")))
            fit = cut(fit)
            chosen.append(small_side(cut(fit.select("source_no", F.explode("took").alias("part")))))
            if level < LEVELS:
                cuts = small_side(cut(fit.where("cut is not null").select("source_no", F.col("cut.part").alias("part"))))
                inside = inside.withColumn("part", _part(level)).join(cuts, ["source_no", "part"], "left_semi").drop("part")
                room = fit.select("source_no", "room")
        return chosen

    def _tokens(self, known: DataFrame) -> DataFrame:
        """source_no, level, part, copy: one for each copy of a block, or part of a block, that is taken."""
        blocks = known.groupBy("source_no", F.col("block").alias("part")).agg(F.max("full").alias("full"))
        once = self.chosen[0].withColumn("more", F.lit(1))
        copies = F.col("full") + missing(F.col("more"), 0)
        blocks = blocks.join(once, ["source_no", "part"], "left").where(copies > 0)
        tokens = blocks.select("source_no", F.lit(0).alias("level"), "part", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
        for level, parts in enumerate(self.chosen[1:], 1):
            tokens = tokens.union(parts.select("source_no", F.lit(level), "part", F.lit(0)))
        return cut(tokens)

    def _tree(self, known: DataFrame, shards: int) -> DataFrame:
        """source_no, level, part, places: the output shard of each copy, from draws without replacement."""
        name = ["source_no", "level", "part", "copy"]
        tokens = self._tokens(known).select(*name, F.lit(0).alias("node"), F.lit(shards).alias("leaves"), F.lit(0).alias("shard"))
        for depth in range((shards - 1).bit_length()):
            tokens = tokens.withColumn("draw", F.xxhash64(F.lit(self.seed + 100 + depth), *name)).withColumn("bin", F.shiftrightunsigned("draw", 64 - BIN_BITS))
            bins = tokens.groupBy("node", "bin").agg(F.count("*").alias("n"), F.max("leaves").alias("leaves"))
            node, half = Window.partitionBy("node"), F.ceil(F.col("leaves") / 2)
            before = missing(F.sum("n").over(node.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), 0)
            quota = F.round(F.sum("n").over(node) * half / F.col("leaves")).cast("long")
            bins = small_side(cut(bins.select("node", "bin", (quota - before).alias("room"))))
            rank = F.row_number().over(Window.partitionBy("node", "bin").orderBy("draw", *name))
            left, half = F.col("rank") <= F.col("room"), half.cast("int")
            tokens = tokens.join(bins, ["node", "bin"]).withColumn("rank", rank)
            tokens = tokens.select(
                *name,
                (F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node"),
                F.when(left, half).otherwise(F.col("leaves") - half).alias("leaves"),
                (F.col("shard") + F.when(left, 0).otherwise(half)).alias("shard"),
            )
        listed = F.sort_array(F.collect_list(F.struct("copy", "shard")))
        return cut(tokens.groupBy("source_no", "level", "part").agg(F.transform(listed, lambda x: x["shard"]).alias("places")))

    def apply(self, rows: DataFrame) -> DataFrame:
        """Keyed rows with source_size, target, places (the shard of each copy taken) and taken."""
        out, none = self._sourced(rows), F.array().cast("array<int>")
        for level in range(LEVELS + 1):
            own = self.places.where(F.col("level") == level).select("source_no", "part", F.col("places").alias(f"places{level}"))
            out = out.withColumn("part", _part(level)).join(small_side(own), ["source_no", "part"], "left")
        out = out.withColumn("places", F.concat(*[missing(F.col(f"places{level}"), none) for level in range(LEVELS + 1)]))
        return out.withColumn("taken", (F.size("places") * F.col("size")).cast("long"))

    def plan(self) -> DataFrame:
        return self.apply(self.rows)

    def mixture(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs``, each as often as the mix takes it, with mix_shard and mix_order."""
        out = self.apply(self._keyed(docs)).select("doc", "key", F.posexplode("places").alias("copy", "mix_shard"))
        order = F.xxhash64(F.lit(self.seed + 1), "key", "copy", "mix_shard")
        names = [c for c in docs.columns if c.lower() not in ("mix_shard", "mix_order")]
        return out.select(*[F.col("doc")[c].alias(c) for c in names], "mix_shard", order.alias("mix_order"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document row: id, size, source_size, target, taken, mix_shards.

    ``size`` counts words (null text: 0). ``mix_shards`` names the output shard of each copy that the
    mix takes, and ``taken`` is their number times ``size``; no row is taken more than ``most`` times.
    A null source is one source, last in order. A source without words has target 0, and its rows are
    not taken. Rows that repeat id and size are taken or left together. Empty input gives no rows;
    other columns are ignored.
    """
    plan = Mix(docs, id_col=id_col, **options).plan()
    return plan.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.col("places").alias("mix_shards"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows of ``docs`` with mix_shard and mix_order (a shard's local shuffle); see mix_plan."""
    return Mix(docs, **options).mixture(docs)


def write_mixture(docs: DataFrame, path: str, **options) -> None:
    """Write the mix as Parquet: range-partitioned by shard and local order, so that a hot shard splits."""
    mixed = mixture(docs, **options)
    mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)
