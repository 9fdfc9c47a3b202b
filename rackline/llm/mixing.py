"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times on average,
at most twice.  The whole part is certain.  The fraction is a probability, and the
probabilities are rounded to 0 or 1 against each other: of two documents one becomes
certain, and the words that this adds or takes away go to, or come from, the other.
So a source's words stay what they were, but for the last document left over.

A task rounds a bucket of some dozens of documents of about one size, the largest first,
and leaves one undecided.  The undecided of some dozens of buckets meet in a bucket of the
next level, and so on: a reduction tree per source, whose depth grows with the logarithm
of the largest source.  Large documents so decide early and against each other, and what
is left over at the end is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackline.llm.storage import Workspace
from rackline.llm.text import word_count

_ITEM = "struct<size:double,key:bigint,chance:double,luck:double>"

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
BUCKET = 64
_NEAR = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``sizes`` (source, source_size) with the words that each source should give.

    All sizes times ``share`` are dealt by weight; a source stops at ``limit`` times its
    size, and what is left over is dealt again among the others.  With r = limit * size /
    weight, the sources that stop are those of the smallest r, so running sums over the
    sources in that order find them.  The windows here run over one row per source.

    Sources without words get 0.  An empty table gives no rows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place + 1)
    capped = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), weight.alias("weight"))
    capped = capped.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    # Words for each unit of weight, if all sources before this one stop at their limit.
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    leveled = capped.withColumn("level", level).withColumn("stops", F.col("cap") <= level * F.col("weight"))
    # The first source that doesn't stop fixes the level of all after it.
    first = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", first * F.col("weight")))
    return leveled.select("source", "source_size", target.alias("target"))


def _uniform(seed: int, *key) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    bits = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), *key), F.lit(11))
    return bits.cast("double") / F.lit(float(2**53))


def _fold(items: Column) -> Column:
    """Round the chances of an array of (size, key, chance, luck) against each other.

    Gives (done: array of (key, copy), rest: the undecided one, or null).
    """
    empty = F.struct(
        F.array().cast("array<struct<key:bigint,copy:boolean>>").alias("done"),
        F.lit(None).cast(_ITEM).alias("rest"),
    )

    def decided(item: Column, copy) -> Column:
        return F.struct(item.key.alias("key"), copy.alias("copy"))

    def with_chance(item: Column, chance: Column) -> Column:
        return F.struct(
            item.size.alias("size"), item.key.alias("key"), chance.alias("chance"), item.luck.alias("luck")
        )

    def step(state: Column, item: Column) -> Column:
        a = state.rest
        # Words that may move from one to the other until a chance is 0 or 1.
        up = F.least((1 - a.chance) * a.size, item.chance * item.size)
        down = F.least(a.chance * a.size, (1 - item.chance) * item.size)
        words = F.when(item.luck * (up + down) < down, up).otherwise(-down)
        new_a = a.chance + words / a.size
        new_b = item.chance - words / item.size
        a_done = (new_a <= _NEAR) | (new_a >= 1 - _NEAR)
        b_done = (new_b <= _NEAR) | (new_b >= 1 - _NEAR)
        moved = F.struct(new_a.alias("a"), new_b.alias("b"), a_done.alias("a_done"), b_done.alias("b_done"))

        def settle(m: Column) -> Column:
            none = F.lit(None).cast(_ITEM)
            out = F.when(m.a_done & m.b_done, F.array(decided(a, m.a > 0.5), decided(item, m.b > 0.5))).when(
                m.a_done, F.array(decided(a, m.a > 0.5))
            ).otherwise(F.array(decided(item, m.b > 0.5)))
            rest = F.when(m.a_done & m.b_done, none).when(m.a_done, with_chance(item, m.b)).otherwise(
                with_chance(a, m.a)
            )
            return F.struct(F.concat(state.done, out).alias("done"), rest.alias("rest"))

        both = F.element_at(F.transform(F.array(moved), settle), 1)
        return F.when(a.isNull(), F.struct(state.done.alias("done"), item.alias("rest"))).otherwise(both)

    return F.aggregate(items, empty, step)


def pivotal_round(items: DataFrame, seed: int, work: Workspace, bucket: int = BUCKET) -> DataFrame:
    """(key, copy) for items (source, key, size, chance) with 0 < chance < 1 and size > 0.

    ``key`` is a distinct long.  The level of a bucket, its members and every draw
    depend on keys, sizes and seed alone, so reruns agree.

    As long as a source has more undecided items than a bucket holds, those of one power
    of two in size are dealt to buckets of about ``bucket``; then the rest of each source
    meets in one, the largest first.
    """
    rest, done, level = items.select("source", "key", "size", "chance"), None, 0
    while True:
        sized = rest.withColumn("band", F.floor(F.log2("size")))
        counts = work.save(sized.groupBy("source", "band").agg(F.count("*").alias("n")), f"counts{level}")
        largest = counts.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if not largest:
            return items.select("key", F.lit(True).alias("copy")).limit(0) if done is None else done
        last = largest <= max(bucket, counts.select("band").distinct().count())
        if last:
            dealt = sized.select("*", F.lit(0).alias("bucket")).withColumn("band", F.lit(0))
        else:
            counts = counts.select(F.col("source").alias("__source"), F.col("band").alias("__band"), "n")
            same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("band") == F.col("__band"))
            number = F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.ceil(F.col("n") / F.lit(bucket)))
            dealt = sized.join(counts, same).withColumn("bucket", number)
        item = F.struct(
            F.col("size").cast("double").alias("size"),
            "key",
            F.col("chance").cast("double").alias("chance"),
            _uniform(seed + 2 + level, "key").alias("luck"),
        )
        folded = dealt.select("source", "band", "bucket", item.alias("item")).groupBy("source", "band", "bucket")
        folded = folded.agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = folded.select("source", _fold(F.col("items")).alias("folded"))
        folded = work.save(
            folded.select("source", F.col("folded.done").alias("done"), F.col("folded.rest").alias("rest")),
            f"level{level}",
        )
        decided = folded.select(F.explode("done").alias("d")).select("d.key", "d.copy")
        done = decided if done is None else done.unionByName(decided)
        rest = folded.where("rest IS NOT NULL").select("source", "rest.key", "rest.size", "rest.chance")
        if last:
            drawn = (_uniform(seed + 2 + level, "key", F.lit("last")) < F.col("chance")).alias("copy")
            return done.unionByName(rest.select("key", drawn))
        level += 1


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies times size).

    Size is the number of words; null and empty texts have none, are taken 0 times, and
    change nothing.  A null source is a source of its own.  Rows that repeat a doc_id are
    separate documents that share one draw; documents without a doc_id are told apart by
    their size only.  Extra columns stay; those with the names of results are replaced.
    An empty table gives no rows.  Nothing is sampled: every row of ``docs`` is returned,
    with the number of copies that the mix takes.
    """
    return mix_sized(docs.withColumn("size", word_count(F.col("text"))), **options)


def mix_sized(
    docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """``mix`` for documents (doc_id, source, and others) whose words are counted in size."""
    work = Workspace(docs.sparkSession, "mix")
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    sizes = work.save(docs.select("doc_id", "source", "size"), "sizes")
    targets = source_targets(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit
    )
    times = F.least(F.lit(float(limit)), F.col("target") / F.col("source_size"))
    wanted = work.save(
        targets.select(
            F.col("source").alias("__source"),
            "source_size",
            "target",
            F.when(F.col("source_size") > 0, times).otherwise(F.lit(0.0)).alias("__times"),
        ),
        "targets",
    )
    same_source = F.col("source").eqNullSafe(F.col("__source"))

    # One item for each document and size; repeated rows share a draw, so their words count together.
    items = sizes.where("size > 0").groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    items = items.select(
        "source",
        F.xxhash64("source", "doc_id", "size").alias("key"),
        (F.col("size") * F.col("n")).alias("size"),
    )
    fraction = F.col("__times") - F.floor("__times")
    items = items.join(wanted, same_source).select("source", "key", "size", fraction.alias("chance"))
    drawn = work.save(items.where((F.col("chance") > _NEAR) & (F.col("chance") < 1 - _NEAR)), "items")
    picked = pivotal_round(drawn, seed, work).where("copy")
    picked = picked.select(F.col("key").alias("__key"), F.lit(1).alias("__copy")).distinct()

    rows = docs.select(*kept, "size").join(wanted, same_source)
    # The same join at every size: rows are dealt by document, however few are picked.
    rows = rows.join(picked.hint("merge"), F.xxhash64("source", "doc_id", "size") == F.col("__key"), "left")
    # A chance within rounding of 1 is certain, and was not drawn.
    whole = F.floor(F.col("__times") + _NEAR)
    copies = F.when(F.col("size") > 0, whole + F.coalesce("__copy", F.lit(0))).otherwise(0).cast("long")
    return rows.select(
        *kept, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
