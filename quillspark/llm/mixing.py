"""Mixing sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import WORD, stash

#: The weights of the sources by code point order of their names, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many passes over itself.
PASSES = 3
#: Words of a block.
BLOCK = 1024
#: Slot k has the point (k * STEP mod 2^31) / 2^31; STEP is 2^31 over the golden ratio, made odd.
STEP, PERIOD = 1_327_217_885, 2**31
#: Slots of a run that is ranked by itself, strips of each source's shuffle, and strips of the unit interval.
RUN, STRIPS, BANDS = 4096, 4096, 4096
#: Rows of a table that a task writes at least, if there are more tasks than cores.
WRITTEN = 1 << 18


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the text) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, weight and target of each source: the filling that meets every cap.

    Filling rises with the weights until it has given out all sizes; a source whose cap, PASSES times its size,
    is below its share stands at the cap. With sources by cap per weight, the full ones come first, so two
    running sums find the level. The window is over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    per = per.withColumn("weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("long"))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("full", F.coalesce(F.sum(F.lit(PASSES) * F.col("source_size")).over(before), F.lit(0)))
    per = per.withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("total", F.sum("source_size").over(every))
    level = (F.col("total") - F.col("full")).cast("double") / F.col("rest")
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(order))
    # Up to the first source below its cap the sums hold full ones only; its level is that of all that follow.
    first = F.min(F.when(F.col("level") * F.col("weight") < PASSES * F.col("source_size"), F.struct("place", "level"))).over(every)
    per = per.withColumn("first", first)
    target = F.when(F.col("place") >= F.col("first")["place"], F.col("first")["level"] * F.col("weight")).otherwise((PASSES * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def schedule(quota: DataFrame, n_slots: int) -> DataFrame:
    """slot, sid, rank: which source each slot of the mix draws its next block from. *quota* has sid, source, words, need.

    Slot k's golden-ratio point, in integers so that it is the same everywhere, falls into the source whose
    part of the cumulative targets holds it. Bands of the unit interval turn that range search into an
    equi-join. Ranks come from counts of each run of RUN slots and places within the run, never from one
    task that sees all slots of a source. Each source gets the slots that its quota needs: points beyond them
    are idle, and the few that the points leave out follow at the end.
    """
    spark = quota.sparkSession
    by = Window.orderBy(F.col("source").asc_nulls_last())
    cut = quota.withColumn("hi", F.sum("words").over(by)).withColumn("lo", F.col("hi") - F.col("words")).withColumn("all", F.sum("words").over(Window.partitionBy())).withColumn("of", F.count("*").over(Window.partitionBy()))
    point = lambda c: F.floor(F.col(c) / F.col("all") * PERIOD).cast("long")
    inside = cut.where("words > 0").select("source", "sid", point("lo").alias("lo"), point("hi").alias("hi"))
    width = PERIOD // BANDS
    bands = inside.where("hi > lo").withColumn("band", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") % PERIOD * STEP % PERIOD).alias("point")).withColumn("band", F.floor(F.col("point") / width))
    put = slots.join(bands, "band").where("lo <= point and point < hi").select("slot", "sid", F.floor(F.col("slot") / RUN).alias("run"))
    runs = put.groupBy("sid", "run").agg(F.count("*").alias("n"))
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = put.withColumn("at", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1)
    ranked = placed.join(runs, ["sid", "run"]).select("slot", "sid", (F.col("before") + F.col("at")).alias("rank"))
    need = cut.select("sid", "need", "of")
    have = runs.groupBy("sid").agg(F.sum("n").alias("have"))
    late = need.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("need > have").select("sid", "of", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"))
    late = late.select((F.lit(n_slots) + F.col("rank") * F.col("of") + F.col("sid")).alias("slot"), "sid", "rank")
    return ranked.join(need, "sid").where("rank < need").select("slot", "sid", "rank").unionByName(late)


def shuffled(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with its place in its source's shuffled stream of words: sid, doc_id, size, start.

    The shuffle is by a hash of the id. Strips of hash space are summed and their sums run up, then each strip
    is run up by itself, so no task sees a whole source.
    """
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["name"])).select("sid", "doc_id", "size", spread.alias("h")).withColumn("strip", (F.col("h") / (2**60 // STRIPS)).cast("long"))
    strips = rows.groupBy("sid", "strip").agg(F.sum("size").alias("n"))
    strips = strips.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = Window.partitionBy("sid", "strip").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(strips, ["sid", "strip"]).select("sid", "doc_id", "size", (F.col("before") + F.col("at")).alias("start"))


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """*df*, which has about so many rows, in no more parts than are worth a file; these grow with the rows.

    Where nothing joins small partitions of a shuffle, each would be a task that writes a few rows, and each file has processes forked from the
    executor to set its mode, which show the executor's memory again.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // WRITTEN)))


def dealt(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, documents in their source's shuffled stream, what each slot draws): see stream() and mix()."""
    sized = stash(sizes(docs), "mix-sizes")
    per = targets(sized).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("words", F.floor(F.col("target") + 1e-6).cast("long")).withColumn("need", F.ceil(F.col("words") / block))
    per = stash(per, "mix-sources")
    words = per.agg(F.sum("words")).first()[0] or 0
    places = stash(in_few(shuffled(sized, per.select(F.col("source").alias("name"), "sid")), sized.count()), "mix-places")
    slots = schedule(per.select("source", "sid", "words", "need"), -(-words // block))
    # A source's stream comes again and again, and rank r draws words r * block and on of it; the last rank ends with the target.
    turns = places.where("size > 0").join(per.select("sid", "source_size", "words"), "sid").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
    turns = turns.withColumn("lo", F.col("turn") * F.col("source_size") + F.col("start")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words"))).where("lo < hi")
    ranks = F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))
    pieces = turns.withColumn("rank", F.explode(ranks)).select(
        "sid", "rank", "doc_id", "size", "start", "turn",
        (F.greatest(F.col("lo"), F.col("rank") * block) - F.col("lo")).alias("first"),
        (F.least(F.col("hi"), (F.col("rank") + 1) * block) - F.col("lo")).alias("upto"),
    )
    return per, places, slots.join(pieces, ["sid", "rank"])


def stream(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix in the order in which it is drawn: slot, source, rank, turn, start, doc_id, first, upto.

    A slot has *block* words of one source, the last of a source fewer: words first to upto (not included) of each
    document, by *start*, its place in the source's stream, in turn after turn. The rows come in no order of their own; sort by slot, turn, start.
    """
    per, _, pieces = dealt(docs, block)
    return pieces.join(per.select("sid", "source"), "sid").select("slot", "source", "rank", "turn", "start", "doc_id", "first", "upto")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of *docs*: doc_id, source, size, source_size, target, taken (words, repeats counted), first_slot and n_draws.

    What is taken is what the slots of the schedule draw: first_slot is the first one that draws on the row (null:
    none does), n_draws how many times one does. Slots of a source are as many as its target fills, the last one in part. Hence a
    source gives its target's whole words, and no row over PASSES times its
    size. Null and empty texts have size 0 and give 0; a null source is one more, listed last; a null id is
    shuffled as an empty one; ties of the shuffle go by id, then size; repeated rows are rows of their own, a very long
    text is drawn in many slots; reruns agree. Empty tables give empty results. Sources are a table of a row each, which
    one task orders; no task sees all rows or slots of a source.
    """
    per, places, pieces = dealt(docs, block)
    # start tells rows apart but for those of no words, which take none.
    sums = pieces.groupBy("sid", "start").agg(F.sum(F.col("upto") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_draws"))
    filled = places.where("size > 0").join(sums, ["sid", "start"], "left").select("sid", "doc_id", "size", "taken", "first_slot", "n_draws")
    none = F.lit(None).cast("long")
    out = filled.unionByName(places.where("size = 0").select("sid", "doc_id", "size", none.alias("taken"), none.alias("first_slot"), none.alias("n_draws")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = in_few(out.join(per.select("sid", "source", "source_size", "target"), "sid"), places.count())
    return out.select("doc_id", "source", "size", "source_size", "target", zero("taken"), "first_slot", zero("n_draws"))
