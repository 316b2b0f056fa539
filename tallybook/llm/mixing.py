"""Sources mixed to target weights: thresholds on a hash of each row, found by histograms.

Every row has a place, 60 bits of a hash. A source that is to give k whole passes and a
rest takes the rows below a threshold once more. The threshold is found digit by digit:
words are summed by source and the first 12 bits, a running sum over at most 4,096
buckets a source finds the bucket in which the rest is reached, and only the rows of that
bucket are counted by the next 12 bits. Larger targets hold the rows of smaller ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import written

DIGIT_BITS, DIGITS = 12, 5
SPACES = r"[\x20\x09-\x0D]+"
COPIES_A_ROW = 100_000
#: Parts into which a source's rows are dealt where they meet its threshold.
DEALS = 64


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, line feed, vertical tab, form feed and return."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(body == "", 0).otherwise(F.char_length(body) - F.char_length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long")


def place_of(id_col: Column, text: Column) -> Column:
    """60 bits of a digest of id and text: equal rows share it, all others are spread evenly."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """src, source_size, target, passes and rest for each source (src, source_size).

    Sources in the order of ``src`` weigh ``weights`` in turn and share all words. None gets
    more than ``most`` times its own; the excess goes to the others by weight until none is
    above. In the order of most * size / weight the full sources come first, so running
    sums over one row a source find them: a source is full if what the ones before it leave
    would give it more than it may take.
    """
    everything, in_order = Window.partitionBy(), Window.orderBy("src")
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "src")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("src", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("most"))
    rows = rows.withColumn("left", F.sum("source_size").over(everything) - (F.sum("most").over(by_room) - F.col("most")))
    rows = rows.withColumn("shares", F.sum("weight").over(everything) - (F.sum("weight").over(by_room) - F.col("weight")))
    rows = rows.withColumn("full", F.col("left").cast("double") * F.col("weight") / F.col("shares") > F.col("most"))
    left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything)
    shares = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(left.cast("double") * F.col("weight") / shares)
    rows = rows.select("src", "source_size", target.alias("target"))
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    return rows.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))


def prefix(digits: int) -> Column:
    return F.shiftright("place", DIGIT_BITS * (DIGITS - digits))


def boundary(sums: DataFrame) -> DataFrame:
    """src, bucket, below and rest: the bucket in which a source's rest is reached, and the words below it.

    ``sums`` has src, below, rest, bucket and words: ``below`` the words below all buckets given,
    ``words`` those of the bucket.
    """
    upto = F.col("below") + F.sum("words").over(Window.partitionBy("src").orderBy("bucket"))
    sums = sums.select("src", "rest", "bucket", (upto - F.col("words")).alias("below"), upto.alias("upto"))
    first = sums.where("upto >= rest").groupBy("src").agg(F.min(F.struct("bucket", "below", "rest")).alias("b"))
    return first.select("src", "b.*")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size (words), source_size, target (words of its source in the mix) and taken (words the mix takes of the row).

    Rows are taken whole, each ``passes`` times and those below the threshold once more, so
    a source misses its target by half the words of one row at most. Null is a source of its
    own, the last one; null texts have no words and are taken as such. Equal rows share a place: where
    the threshold falls among them, their number decides how many are taken once more.
    Rows of equal ids are separate rows. No rows give no rows; further columns are not read.
    """
    text, own = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    src = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(">"))
    rows = written(docs.select(own.alias("doc_id"), src.alias("src"), word_count(text).alias("size"), place_of(own, text).alias("place")), "places")
    plan = written(source_targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), weights, most), "targets")

    words = F.sum("size").alias("words")
    sums = rows.groupBy("src", prefix(1).alias("bucket")).agg(words)
    edge = written(boundary(sums.join(plan.select("src", F.lit(0).cast("long").alias("below"), "rest"), "src")), "edge")
    near = written(rows.withColumn("bucket", prefix(1)).join(edge.select("src", "bucket"), ["src", "bucket"]).drop("bucket"), "near")
    for digits in range(2, DIGITS + 1):
        inside = near.withColumn("bucket", prefix(digits - 1)).join(edge, ["src", "bucket"])
        edge = boundary(inside.groupBy("src", "below", "rest", prefix(digits).alias("bucket")).agg(words))
    edge = written(edge.withColumnRenamed("bucket", "edge"), "threshold")

    limits = plan.select("src", "source_size", "target", "passes").join(edge.select("src", "edge"), "src")
    limits = limits.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    dealt = rows.withColumn("deal", F.pmod("place", F.lit(DEALS)).cast("int"))
    whole = dealt.join(limits, ["src", "deal"]).where("place <> edge")
    whole = whole.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + (F.col("place") < F.col("edge")).cast("long"))).alias("taken"))
    return whole.unionByName(at_edge(near, plan, edge))


def at_edge(near: DataFrame, plan: DataFrame, edge: DataFrame) -> DataFrame:
    """The rows whose place is the threshold itself: equal ones are counted, and of n the first m are taken once more."""
    classes = near.join(edge, (near["src"] == edge["src"]) & (near["place"] == edge["edge"])).drop(edge["src"])
    classes = classes.groupBy("src", "below", "rest", "doc_id", "size").agg(F.count("*").alias("n"))
    upto = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("src").orderBy(F.col("doc_id").asc_nulls_last(), "size"))
    wanted = F.col("rest") - F.col("below") - (upto - F.col("n") * F.col("size"))
    m = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.floor(wanted / F.col("size") + 0.5)))).otherwise(0)
    classes = classes.withColumn("m", m).join(plan.select("src", "source_size", "target", "passes"), "src")
    copies = classes.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES_A_ROW}"))))
    first, last = F.col("lot") * COPIES_A_ROW + 1, F.least(F.col("n"), (F.col("lot") + 1) * COPIES_A_ROW)
    copies = copies.withColumn("nth", F.explode(F.sequence(first, last)))
    return copies.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + (F.col("nth") <= F.col("m")).cast("long"))).alias("taken"))
