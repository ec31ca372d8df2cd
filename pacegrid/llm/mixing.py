"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source has a target in words.  Document rates are the least change, in
relative entropy, from one copy each that meets the target: a document of
``size`` words gets ``min(MOST, exp(lambda * size / scale))`` copies, with one
dual variable lambda per source and MOST copies at most.  Lambda is found by
Newton steps on the convex dual, inside a bracket that each step narrows.  All
steps run on the histogram (source, size, cell), not on documents, and sums are
decimals, so the order of addition cannot change a result.

Rates become whole copies chain by chain.  Documents of a source are dealt by hash
to chains of about ``CHAINED`` documents, whatever their sizes, so that no source
is one group.  A chain goes from large sizes to small: each size class takes the
number of copies that brings the running total of words nearest to the running
target.  Up to ``EXACT`` words a class is one size, so a chain ends within half
of its smallest document; above, a class is 1/32 of an octave wide, which bounds a chain's
array, and its copies count with the class's mean size.  Within a class of a
chain the copies go to documents in hash order.

Sources may be many: their order, the water filling and the Newton steps are
aggregations over the table of sources, without a window over all of it.

Defined results: a null text has size 0; the null source is a source, last in
order; empty documents and sources of size 0 get target and taken 0; rows with
one doc_id count as so many documents; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm import _tables

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents of a chain, about.
CHAINED = 4096
#: Sizes up to this number of words are classes of their own.
EXACT = 1024
STEPS = 40
#: Rounds of water filling at most; each but the last caps further sources.
FILLINGS = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def _in_order(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``_rank``, the place of the source in the order of code points, null last.

    Ranges of sources are sorted by themselves; a range's first place is the
    number of sources in the ranges before it.
    """
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = _tables.stored(ranged.withColumn("_range", F.spark_partition_id()), "mix-order")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each range: a table of shuffle partitions, not of sources
    start = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    return ranged.join(F.broadcast(start), "_range").withColumn("_rank", F.col("_start") + place - 1).drop("_range", "_start")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with ``target`` words: weighted shares, capped, the excess dealt again.

    Water filling: the level is what is left for each unit of weight when sources
    that it would fill beyond their cap have their cap; it rises until no further one has.
    """
    cap = F.col("source_size") * F.lit(float(MOST))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    weighted = _tables.stored(_in_order(sizes).withColumn("_weight", weight).withColumn("_cap", cap), "mix-weights")
    level = 0.0
    for _ in range(FILLINGS):
        full = F.col("_cap") <= F.col("_weight") * F.lit(level)
        words, capped, left = weighted.agg(
            F.sum("source_size"), F.coalesce(_sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0))
        ).first()
        now = level if not left else (words * SHARE - capped) / left
        if now <= level:
            break
        level = now
    return weighted.select("source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_weight")).alias("target"))


def _sum(x: Column) -> Column:
    return F.sum(x.cast("decimal(30,8)")).cast("double")


def rates(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, lambda, scale): the dual variable of every source, by Newton steps.

    ``histogram`` has (source, size, n).  lambda is null where every document
    gets ``MOST`` copies.
    """
    some = histogram.where("size > 0")
    scale = some.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")).cast("double") / F.sum("n")).alias("scale"),
        F.min("size").cast("double").alias("_least"),
    )
    by = F.col("source").eqNullSafe(F.col("_s"))
    state = wanted.join(scale.withColumnRenamed("source", "_s"), by).drop("_s")
    # at the upper end all documents are at MOST, at the lower end the rates are next to nothing
    state = state.select(
        "source", "source_size", "target", "scale",
        F.lit(-745.0).alias("_low") * F.col("scale") / F.col("_least"),
        (F.log(F.lit(float(MOST))) * F.col("scale") / F.col("_least")).alias("_high"),
        F.lit(0.0).alias("lambda"),
    ).toDF("source", "source_size", "target", "scale", "_low", "_high", "lambda")
    state = _tables.stored(state.where(F.col("target") < F.col("source_size") * float(MOST)), "mix-state")
    for step in range(STEPS):
        tilt = F.exp(F.least(F.col("lambda") * F.col("size") / F.col("scale"), F.log(F.lit(float(MOST)))))
        mass = F.col("size") * F.col("n")
        slope = F.when(tilt < MOST, mass * tilt * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = (
            some.join(state.withColumnRenamed("source", "_s"), by)
            .groupBy("source")
            .agg(_sum(mass * tilt).alias("_got"), _sum(slope).alias("_slope"))
        )
        over = F.col("_got") > F.col("target")
        low, high = F.when(over, F.col("_low")).otherwise(F.col("lambda")), F.when(over, F.col("lambda")).otherwise(F.col("_high"))
        newton = F.col("lambda") - (F.col("_got") - F.col("target")) / F.when(F.col("_slope") > 0, F.col("_slope"))
        inside = (newton > low) & (newton < high)
        done = F.abs(F.col("_got") - F.col("target")) <= F.greatest(F.lit(0.01), F.col("target") * 1e-9)
        state = _tables.stored(
            state.join(sums.withColumnRenamed("source", "_s"), by).select(
                "source", "source_size", "target", "scale", low.alias("_low"), high.alias("_high"),
                F.when(done, F.col("lambda")).when(inside, newton).otherwise((low + high) / 2).alias("lambda"),
                done.alias("_done"),
            ),
            "mix-state",
        )
        if state.where("NOT _done").isEmpty():
            break
        state = state.drop("_done")
    return state.select("source", "lambda", "scale")


def _class(size: Column) -> Column:
    """The size class: the size itself, or a share of an octave above ``EXACT``; larger sizes have larger classes."""
    return F.when(size <= EXACT, size).otherwise(EXACT + 1 + F.floor(32 * F.log2(size / float(EXACT)))).cast("int")


def _chain(cells: Column) -> Column:
    """Copies of each cell of an array of (n, words, want), from large sizes to small."""
    start = F.struct(F.lit(0).cast("double").alias("want"), F.lit(0).cast("double").alias("got"), F.array().cast("array<long>").alias("copies"))

    def step(state: Column, cell: Column) -> Column:
        want, mean = state["want"] + cell["want"], cell["words"] / cell["n"]
        copies = F.rint((want - state["got"]) / F.greatest(mean, F.lit(1.0))).cast("long")
        copies = F.least(F.greatest(copies, F.lit(0).cast("long")), cell["n"] * MOST)
        return F.struct(want.alias("want"), (state["got"] + copies * mean).alias("got"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    return F.aggregate(cells, start, step, lambda s: s["copies"])


def mix(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, source, size, source_size, target and ``_copies`` of every document."""
    sized = _tables.stored(
        docs.select(key, "source", word_count(F.col("text")).alias("size")).withColumn("_order", F.xxhash64(F.col(key), F.lit("mix"))),
        "mix-sizes",
    )
    histogram = _tables.stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("_docs"))
    totals = _tables.stored(totals, "mix-totals")
    by = F.col("source").eqNullSafe(F.col("_s"))
    solved = rates(histogram, wanted := _tables.stored(targets(totals.drop("_docs")), "mix-targets"))
    known = totals.select(F.col("source").alias("_s"), F.ceil(F.col("_docs") / CHAINED).alias("_chains"))
    known = known.join(solved.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    known = known.join(wanted.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    tilt = F.coalesce(F.exp(F.least(F.col("lambda") * F.col("size") / F.col("scale"), F.log(F.lit(float(MOST))))), F.lit(float(MOST)))
    dealt = sized.join(_tables.stored(known, "mix-known"), by).select(
        key, "source", "size", "_order", F.pmod("_order", "_chains").alias("_chain"), _class(F.col("size")).alias("_class"), tilt.alias("_rate"), "source_size", "target"
    )
    cells = dealt.groupBy("source", "_chain", "_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), _sum(F.col("size") * F.col("_rate")).alias("want")
    )
    cell = F.struct((-F.col("_class")).alias("_desc"), "_class", "n", "words", "want")
    copied = (
        cells.groupBy("source", "_chain")
        .agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
        .select("source", "_chain", F.explode(F.arrays_zip("_cells", _chain(F.col("_cells")).alias("copies"))).alias("_x"))
        .select(F.col("source").alias("_s"), F.col("_chain").alias("_ch"), F.col("_x._cells._class").alias("_cl"), F.col("_x._cells.n").alias("_n"), F.col("_x.copies").alias("_all"))
    )
    place = F.row_number().over(Window.partitionBy("source", "_chain", "_class").orderBy("_order", key))
    same = by & (F.col("_chain") == F.col("_ch")) & (F.col("_class") == F.col("_cl"))
    whole = F.floor(F.col("_all") / F.col("_n")).cast("long")
    copies = whole + (F.col("_place") <= F.col("_all") - whole * F.col("_n")).cast("long")
    return (
        dealt.withColumn("_place", place)
        .join(copied, same)
        .select(key, "source", "size", "source_size", "target", F.when(F.col("size") == 0, 1).otherwise(copies).alias("_copies"))
    )


def mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, one row per document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("_copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it has copies; empty documents stay once.

    Rows are told apart by a hash of all columns; rows that agree in it share their
    copies.  Columns travel in a struct, so that their names can't clash.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.xxhash64(*docs.columns).alias("_row"), "source", "text")
    copies = mix(whole, "_row").groupBy("_row").agg(F.sum("_copies").alias("_all"), F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_row").orderBy(F.lit(1)))
    each = F.floor(F.col("_all") / F.col("_n")).cast("int")
    number = each + (F.col("_place") <= F.col("_all") - each * F.col("_n")).cast("int")
    return (
        whole.select("_doc", "_row").withColumn("_place", place).join(copies, "_row")
        .select("_doc", F.explode(F.array_repeat(F.lit(1), number.cast("int"))).alias("_copy")).select("_doc.*")
    )
