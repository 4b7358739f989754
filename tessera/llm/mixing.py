"""Mixing sources to target weights by Pareto order sampling.

A document's size is its number of words. Sources, in code point order with null last, weigh 5, 2, 1 and so on again;
they share all words by weight, none above ``cap`` times its own words, the excess going to the others by weight.
A source with target t and s words takes each document ``floor(t / s)`` times for certain. What is left is a sample of
fixed size without repeats. The odds of a document's inclusion probability p are c times (mean size / its size) to the
power ``lean``, since a long document uses up more of the words; sizes count by class, eighths of powers of two, and c
is such that the expected words are what is left. The ranking value is the odds of a random number over the odds of p;
the sample is the n documents of least value, n the sum of all p, or as many of them as fit into the words left.

A gap stays open in one way only: passes go on in the same order, over documents that are not longer than it, ``FILLS``
passes over those not taken yet, then ``REFILLS`` over all, up to the cap. So of each source a pass is two numbers: the
words left before it, and the ranking value up to which it takes. They are found from sums over slices of the values,
and in the one slice where the words run out. The documents are then decided on where they lie: no text is moved.

The random number is a digest of the seed, the id and the text, so reruns agree in whatever order the rows come. Rows
alike in id and text are taken alike, all or none of them in a pass. Null texts have size 0; a source without words has
target 0 and takes nothing. An empty table gives no rows. Only functions of the JVM are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, scratch, small, spool, uniform

WEIGHTS = (5, 2, 1)
FILLS, REFILLS = 3, 2
#: Size classes for each doubling; steps of the bisection for c; documents for each slice of ranking values, slices.
CLASSES, STEPS, PER_SLICE, MOST_SLICES = 8, 60, 1_000, 1 << 16


def words_in(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, cap: int, weights: tuple[int, ...]) -> DataFrame:
    """Per source (a row each): source, source_size, target. Rounds of sums over this table give the shares."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    sources = spool(sources.withColumn("weight", weight.cast("long")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wanted, per_weight = share * total, 0.0
    full = F.lit(False)
    while True:
        got = sources.agg(F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if not got.open:
            break
        per_weight = (wanted - cap * (got.full or 0)) / got.open
        above = F.col("weight") * F.lit(per_weight) >= cap * F.col("source_size")
        if sources.filter(above & ~full).isEmpty():
            break
        full = full | above
    target = F.when(full, (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(per_weight))
    return sources.select("source", "source_size", "n_docs", target.alias("target"))


def odds(p: Column) -> Column:
    return p / (1 - p)


def leaning(size: Column, mean: Column, lean: float) -> Column:
    """What the odds of a document are multiplied by, for its size class."""
    middle = F.pow(F.lit(2.0), (F.floor(F.log2(size.cast("double")) * CLASSES) + 0.5) / CLASSES)
    return F.pow(mean / middle, F.lit(lean))


def plan_of(sizes: DataFrame, share: float, cap: int, weights: tuple[int, ...], lean: float) -> DataFrame:
    """Per source: source, source_size, target, mean, whole copies, words left, documents to sample."""
    per = spool(targets(sizes, share, cap, weights))
    s, t = F.col("source_size"), F.col("target")
    whole = F.when(s > 0, F.least(F.lit(float(cap)), F.floor(t / s + 1e-12))).otherwise(0).cast("long")
    left = F.when(s > 0, F.greatest(F.lit(0.0), t - whole * s)).otherwise(0.0)
    per = per.select("source", "source_size", "target", (s / F.greatest(F.col("n_docs"), F.lit(1))).alias("mean"), whole.alias("whole"), left.alias("left"))
    classes = sizes.filter("size > 0").groupBy(F.col("source").alias("__source"), F.floor(F.log2(F.col("size").cast("double")) * CLASSES).alias("class"))
    classes = classes.agg(F.sum("size").alias("words"), F.count("*").alias("n")).groupBy("__source")
    # A row for each size class of the source, some hundreds at most.
    classes = classes.agg(F.collect_list(F.struct(F.pow(F.lit(2.0), (F.col("class") + 0.5) / CLASSES).alias("middle"), "words", "n")).alias("classes"))
    per = per.join(classes, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    leant = F.transform("classes", lambda k: F.struct(F.pow(F.col("mean") / k["middle"], F.lit(lean)).alias("w"), k["words"].alias("words"), k["n"].alias("n")))
    per = per.withColumn("classes", leant)

    def total(c: Column, of: str) -> Column:
        return F.aggregate("classes", F.lit(0.0), lambda x, k: x + k[of] * (c * k["w"] / (1 + c * k["w"])))

    def step(x: Column, _: Column) -> Column:
        half = (x["low"] + x["high"]) / 2
        above = total(F.pow(F.lit(2.0), half), "words") > F.col("left")
        return F.struct(F.when(above, x["low"]).otherwise(half).alias("low"), F.when(above, half).otherwise(x["high"]).alias("high"))

    c = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(-60.0).alias("low"), F.lit(60.0).alias("high")), step, lambda x: F.pow(F.lit(2.0), x["low"]))
    per = per.withColumn("c", c)
    sampled = F.when(F.col("left") > 0, F.coalesce(F.round(total(F.col("c"), "n")), F.lit(0.0))).otherwise(0.0)
    return per.withColumn("sampled", sampled.cast("long")).drop("classes", "c")


def ranked(df: DataFrame, per: DataFrame, lean: float) -> DataFrame:
    """df (source, size, u) with the columns of its source, and rank: the ranking value as a place in (0, 1), spread about evenly."""
    out = df.join(per.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    value = odds(F.col("u")) / leaning(F.greatest(F.col("size"), F.lit(1)), F.greatest(F.col("mean"), F.lit(1e-9)), lean)
    return out.withColumn("rank", value / (1 + value))


def taken(passes: Column, cap: int) -> Column:
    """How often the passes take a document."""

    def step(n: Column, p: Column) -> Column:
        may = F.when(p["again"], F.col("whole") + n < cap).otherwise(n == 0)
        goes = (F.col("size") > 0) & (F.col("size") <= p["left"]) & ((F.col("rank") < p["below"]) | (F.col("rank") <= p["last"]))
        return n + F.when(may & goes, 1).otherwise(0)

    return F.aggregate(passes, F.lit(0), step)


def closing(rows: DataFrame, slices: int) -> DataFrame:
    """Per source where a pass over rows (source, size, rank, left, most) ends: below, last, used.

    It takes all rows in order of rank while the words fit into left and the rows into most (null: any number).
    """
    over = lambda words, n: (F.col(words) > F.col("left")) | F.coalesce(F.col(n) > F.col("most"), F.lit(False))
    rows = rows.withColumn("slice", F.floor(F.col("rank") * slices).cast("int"))
    cells = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("left").alias("left"), F.first("most").alias("most"))
    window = Window.partitionBy("source").orderBy("slice")
    cells = cells.withColumns({"upto": F.sum("words").over(window), "number": F.sum("n").over(window)})
    end = F.when(over("upto", "number"), F.struct("slice", (F.col("upto") - F.col("words")).alias("words"), (F.col("number") - F.col("n")).alias("n")))
    ends = spool(cells.groupBy("source").agg(F.min(end).alias("end"), F.sum("words").alias("all")))
    at = small(ends.filter("end is not null").select(F.col("source").alias("__source"), "end"))
    within = rows.join(at, F.col("source").eqNullSafe(F.col("__source")) & (F.col("slice") == F.col("end.slice")))
    # Peers of equal rank come in together.
    window = Window.partitionBy("source").orderBy("rank")
    within = within.withColumns({"upto": F.col("end.words") + F.sum("size").over(window), "number": F.col("end.n") + F.count("*").over(window)})
    within = within.filter(~over("upto", "number")).groupBy(F.col("source").alias("__source")).agg(F.max("rank").alias("last"), F.max("upto").alias("used"))
    out = ends.join(within, F.col("source").eqNullSafe(F.col("__source")), "left")
    below = F.when(F.col("end").isNull(), 2.0).otherwise(F.col("end.slice") / slices)
    return out.select("source", below.alias("below"), F.coalesce("last", F.lit(-1.0)).alias("last"), F.when(F.col("end").isNull(), F.col("all")).otherwise(F.coalesce("used", "end.words")).alias("used"))


def decided(sizes: DataFrame, share: float, cap: int, weights: tuple[int, ...], lean: float) -> DataFrame:
    """Per source its plan and passes, from sizes (a spooled table of source, size, u)."""
    per = spool(plan_of(sizes, share, cap, weights, lean))
    slices = 1 << max(0, min(MOST_SLICES, sizes.count() // PER_SLICE).bit_length() - 1)
    per = spool(per.withColumns({"passes": F.array().cast("array<struct<left:double,below:double,last:double,again:boolean>>"), "open": F.col("left")}))
    for k in range(1 + FILLS + REFILLS):
        again = k > FILLS
        rows = ranked(sizes, small(per), lean)
        done = taken(F.col("passes"), cap)
        rows = rows.filter(((F.col("whole") + done < cap) if again else (done == 0)) & (F.col("size") > 0) & (F.col("size") <= F.col("open")))
        rows = rows.select("source", "size", "rank", F.col("open").alias("left"), (F.lit(None).cast("long") if k else F.col("sampled")).alias("most"))
        ends = small(spool(closing(rows, slices).withColumnRenamed("source", "__source")))
        per = per.join(ends, F.col("source").eqNullSafe(F.col("__source")), "left")
        one = F.struct(F.col("open").alias("left"), F.coalesce("below", F.lit(-1.0)).alias("below"), F.coalesce("last", F.lit(-1.0)).alias("last"), F.lit(again).alias("again"))
        per = spool(per.select("source", "source_size", "target", "mean", "whole", "left", "sampled", F.concat("passes", F.array(one)).alias("passes"), (F.col("open") - F.coalesce("used", F.lit(0))).alias("open")))
    return per


def random_number(seed: str, doc_id: Column, text: Column) -> Column:
    return uniform(seed, F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text))


def counted(sizes: DataFrame, per: DataFrame, lean: float, cap: int) -> DataFrame:
    """sizes with the columns of its source and copies."""
    return ranked(sizes, per, lean).withColumn("copies", (F.col("whole") + taken(F.col("passes"), cap)).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, cap: int = 3, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", lean: float = 0.25) -> DataFrame:
    """Per row of docs: its id, size, source_size, target, taken (words, with repeats) and copies."""
    t = F.col(text)
    with scratch() as held:
        sizes = spool(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), words_in(t).alias("size"), random_number(seed, F.col(doc_id), t).alias("u")))
        out = counted(sizes, small(decided(sizes, share, cap, weights, lean)), lean, cap)
        return held.keep(out.select(F.col("id").alias(doc_id), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, cap: int = 3, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", lean: float = 0.25) -> DataFrame:
    """The rows of the mix: each of docs as often as it is taken, with its columns."""
    t = F.col(text)
    slim = [F.col(source).alias("source"), words_in(t).alias("size"), random_number(seed, F.col(doc_id), t).alias("u")]
    with scratch() as held:
        per = decided(spool(docs.select(*slim)), share, cap, weights, lean)
        rows = counted(docs.select(F.struct(*docs.columns).alias("row"), *slim), small(per), lean, cap)
        return held.keep(rows.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*"))
