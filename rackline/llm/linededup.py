"""Line deduplication: repeated runs of lines by a suffix array over line numbers.

Lines are numbered in the order of their content hashes.  Prefix doubling turns the
ranks of runs of k lines into those of 2k lines: the ranks of positions p and p + k,
taken together, are sorted and numbered anew.  After the last round the ranks order all
suffixes by as many lines as the longest shortest-sufficient run needs, and equal ranks
are the LCP intervals of that depth.  A run of any length within is found by two ranks
of the next smaller power of two that overlap.

Only lines that occur twice take part, in stretches of such lines with enough words:
no other line lies in a repeated run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackline.llm.storage import Workspace
from rackline.llm.text import let, word_count

MIN_WORDS = 40
_BLANK = r"^[\x20\x09-\x0D]*$"


def _document() -> list:
    """A document is its id and text; rows that repeat both are the same one."""
    return [F.col("doc_id"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("uid")]


def _numbered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, uid, q (number among lines with words), k1, k2 (content), w (words)."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~F.rlike(x, F.lit(_BLANK)))
    rows = docs.where("text IS NOT NULL").select(*_document(), F.posexplode(lines).alias("q", "line"))
    return rows.select(
        "doc_id", "uid", "q", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"), word_count(F.col("line")).alias("w")
    )


def _ranked(keys: DataFrame) -> DataFrame:
    """``keys`` (distinct columns) with ``rank``, longs in their order."""
    return keys.orderBy(*keys.columns).withColumn("rank", F.monotonically_increasing_id())


def repeated_runs(docs: DataFrame, work: Workspace, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, start, length) of all later copies of runs with ``min_words`` words or more.

    Of every such run the first copy, by doc_id (null first), text hash and line, stays
    out.  Runs are reported by their shortest pieces that have enough words, counted from
    either end; these cover the maximal runs.  Pieces overlap.
    """
    lines = work.save(_numbered_lines(docs).distinct(), "lines")
    # Counts are written before they are joined back: the planner can split a hot line's join then.
    again = lines.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2")
    inside = lines.join(work.save(again, "again"), ["k1", "k2"])

    by_line = Window.partitionBy("uid").orderBy("q")
    stretch = inside.withColumn("seg", F.col("q") - F.row_number().over(by_line))
    by_stretch = Window.partitionBy("uid", "seg").orderBy("q")
    whole = Window.partitionBy("uid", "seg")
    ends = F.sum("w").over(by_stretch)
    stretch = stretch.select("*", ends.alias("end"), F.sum("w").over(whole).alias("total"))
    stretch = stretch.where(F.col("total") >= min_words).withColumn("begin", F.col("end") - F.col("w"))
    ahead = Window.partitionBy("uid", "seg").orderBy("begin").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("uid", "seg").orderBy("end").rangeBetween(-(min_words - 1), 0)
    stretch = stretch.select(
        "doc_id",
        "uid",
        "q",
        "k1",
        "k2",
        F.when(F.col("begin") + min_words <= F.col("total"), F.count("*").over(ahead)).alias("ahead"),
        F.when(F.col("end") >= min_words, F.count("*").over(back)).alias("back"),
    )
    stretch = work.save(stretch, "stretch")
    work.drop("lines")

    pieces = stretch.select("doc_id", "uid", F.col("q").alias("start"), F.col("ahead").alias("length"))
    turned = stretch.select("doc_id", "uid", (F.col("q") - F.col("back") + 1).alias("start"), F.col("back").alias("length"))
    pieces = pieces.unionByName(turned).where("length IS NOT NULL").distinct()
    longest = stretch.agg(F.greatest(F.max("ahead"), F.max("back"))).first()[0] or 1

    names = work.save(_ranked(stretch.select("k1", "k2").distinct()), "names0")
    level = work.save(stretch.join(names, ["k1", "k2"]).select("uid", "q", "rank"), "rank0")
    levels, k = [level.withColumn("k", F.lit(0))], 0
    while 2 ** (k + 1) <= longest:
        after = level.select("uid", (F.col("q") - 2**k).alias("q"), F.col("rank").alias("next"))
        pairs = work.save(level.join(after, ["uid", "q"]), f"pairs{k + 1}")
        # A pair that occurs once is in no repeated run, nor is any longer run from there.
        names = pairs.groupBy("rank", "next").count().where("count > 1").select("rank", "next")
        names = names.orderBy("rank", "next").withColumn("new", F.monotonically_increasing_id())
        k += 1
        names = work.save(names, f"names{k}")
        level = work.save(pairs.join(names, ["rank", "next"]).select("uid", "q", F.col("new").alias("rank")), f"rank{k}")
        work.drop(f"pairs{k}")
        levels.append(level.withColumn("k", F.lit(k)))
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.unionByName(more)

    power = F.floor(F.log2("length") + 1e-9).cast("int")
    pieces = pieces.withColumn("k", power)
    pieces = pieces.withColumn("q", F.col("start")).join(ranks, ["uid", "q", "k"]).withColumnRenamed("rank", "left").drop("q")
    tail = (F.col("start") + F.col("length") - F.call_function("shiftleft", F.lit(1), F.col("k"))).cast("int")
    pieces = pieces.withColumn("q", tail).join(ranks, ["uid", "q", "k"]).withColumnRenamed("rank", "right").drop("q", "k")
    pieces = work.save(pieces, "pieces")
    place = F.struct("doc_id", "uid", "start")
    groups = pieces.groupBy("length", "left", "right").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    groups = work.save(groups.where("n > 1").drop("n"), "groups")
    later = pieces.join(groups, ["length", "left", "right"]).where(place != F.col("first"))
    return later.select("uid", "start", "length")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut out of ``text``.

    Lines end at line feeds and are compared whole.  Blank lines are skipped over when
    runs are compared, and stay.  Adds ``n_lines`` (lines with words) and ``n_removed``;
    extra columns stay, those of these names are replaced.  Rows that repeat doc_id and
    text are one document and are cut alike.  Null and empty texts stay as they are; an
    empty table gives no rows; no row is dropped.
    """
    work = Workspace(docs.sparkSession, "lines")
    runs = repeated_runs(docs, work, min_words)
    spans = runs.groupBy("uid").agg(F.collect_list(F.struct("start", "length")).alias("__spans"))
    spans = work.save(spans.select(F.col("uid").alias("__uid"), "__spans"), "spans")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*kept, _document()[1].alias("__id"))
    # The same join at every size: texts are dealt by document, however few spans there are.
    rows = rows.join(spans.hint("merge"), F.col("__id") == F.col("__uid"), "left")
    edited = let(F.split("text", "\n", -1), lambda lines: _edited(lines, F.col("__spans")))
    rows = rows.select(*kept, edited.alias("__edit"))
    text = F.when(F.col("__edit.n_removed") > 0, F.col("__edit.text")).otherwise(F.col("text")).alias("text")
    counts = (F.coalesce(F.col(f"__edit.{n}"), F.lit(0)).cast("long").alias(n) for n in ("n_lines", "n_removed"))
    return rows.select(*(text if c == "text" else F.col(c) for c in kept), *counts)


def _edited(lines: Column, spans: Column) -> Column:
    """Struct of n_lines, n_removed and text, for the lines of a text and its spans to cut."""
    numbered = F.transform(lines, lambda x, i: F.when(~F.rlike(x, F.lit(_BLANK)), i))
    covered = F.flatten(F.transform(spans, lambda s: F.sequence(s.start, s.start + s.length - 1)))
    cut = F.coalesce(F.array_distinct(covered), F.array().cast("array<bigint>"))

    def without(numbers: Column, cut: Column) -> Column:
        gone = F.transform(cut, lambda q: F.get(numbers, q.cast("int")))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
        return F.struct(
            F.size(numbers).alias("n_lines"),
            F.size(cut).alias("n_removed"),
            F.when(F.size(cut) > 0, left).alias("text"),
        )

    return let(F.array_compact(numbered), lambda numbers: let(cut, lambda gone: without(numbers, gone)))
