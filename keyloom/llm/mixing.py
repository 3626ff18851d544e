"""Mixing sources to target weights by entropy balancing.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the total of all sizes (words) by weight; a
target stops at `cap` times its source's size, and the excess is shared again by weight among the others until none is
above. Document rates r minimise the relative entropy to the unit rates under sum(r * size) = target of the source and
r <= cap, so r = min(cap, exp(lambda * x)) with x = size / mean size of the source. Newton's method finds the lambda of
every source at once on the dual, whose gradient is a distributed sum; a bracket around the root guards each step, and a
source that doesn't converge is an error. Rates become copies by sequential Poisson rounding: the whole part always, the
fraction for the documents whose random number divided by their fraction is least, until the source's words meet the target;
histograms of that quotient, each within a bin of the one before, find the threshold; then a few rounds add the document
whose size is nearest to what is left.

The random number is a hash of the whole row and of its place among equal rows. Equal rows, of which a table may have
millions (all ids null, one text), are numbered within each part of the input, and counts by part give the offsets: so each
has its own number, the set of numbers depends on the rows alone, and reruns agree.

DataFrame functions only. Per-source tables hold a row for each source or for each (source, size), never a document each;
what one task orders is the rows of one threshold bin, `FEW` or what further halving can't part (equal quotients).

Defined cases: null or blank text has size 0, takes 0 words in 0 or more copies; a null source is a source of its own, last;
a source of size 0 gets the target 0; null or repeated doc_ids are rows like any other (of equal rows as many get a copy
more as the target asks for); an empty table gives an empty result; other columns (of any names) only tell rows apart in
`mix`, and are carried by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import WORD, by_position, drop_written, named_again, numbered, place_of, released, staying, together, written

CAP = 3.0
#: Newton steps at most, and steps between two written tables.
ROUNDS, STEPS = 120, 4
#: Bins of a threshold histogram, for each source; rows of a bin that are put in order; histograms at most.
BINS, FEW, DEEPEST = 4096, 1000, 8
#: Rounds that fill what the thresholds leave of a target.
FILL = 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same with target. One row per source; the window over them sorts names only."""
    ranked = sources.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    # Water filling: a source is full if cap * size / weight is at most the level. In ascending order of that ratio, the
    # level if the first k are full is (total - their caps) / (weight of the others); the first source above it ends them.
    ratio = ranked.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    free = ratio.withColumn("level", level).withColumn("water", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"])
    limit = F.lit(cap) * F.col("source_size")
    return free.select("source", "source_size", F.when(F.col("water").isNull(), limit).otherwise(F.least(limit, F.col("water") * F.col("weight"))).alias("target"))


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * x, F.lit(50.0))))


def tilts(histogram: DataFrame, per_source: DataFrame, cap: float = CAP, rounds: int = ROUNDS) -> DataFrame:
    """(source, size, n) and (source, source_size, target) -> source, source_size, target, mean_size, lam.

    lam is null where the target is the cap times the size (the root is at infinity, all rates are the cap) or the size is 0.
    """
    rows = histogram.count()
    sized = together(histogram.filter("size > 0"), rows)
    counts = sized.groupBy("source").agg(F.sum("n").alias("rows")).withColumnRenamed("source", "of")
    start = per_source.join(counts, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", (F.col("source_size") / F.col("rows")).alias("mean_size"), F.lit(0.0).alias("lam"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(False).alias("met"))
    start = written(start, "state")  # not checkpoint(): its size estimates multiply from round to round
    open_ = F.col("mean_size").isNotNull() & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    settled = start.filter(~F.coalesce(open_, F.lit(False))).select("source", "source_size", "target", "mean_size", F.lit(None).cast("double").alias("lam"))
    state = together(start.filter(open_), rows)
    for done in range(0, rounds, STEPS):
        former = state
        for _ in range(STEPS):
            state = _newton(sized.withColumnRenamed("source", "of"), state, cap)
        state = together(written(state, "state"), rows)
        if done:  # the table that this began with is read once more
            drop_written(former)
        if state.filter("not met").isEmpty():
            return settled.unionByName(state.drop("low", "high", "met"))
    raise RuntimeError(f"the dual has not converged in {rounds} steps")


def _newton(histogram: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """One guarded step for each source that isn't met; every source of state has rows in the histogram (of, size, n)."""
    x = F.col("size") / F.col("mean_size")
    rate = _rate(F.col("lam"), x, cap)
    keys = ["source", "source_size", "target", "mean_size", "lam", "low", "high", "met"]
    sums = (
        histogram.join(state, F.col("of").eqNullSafe(F.col("source")))
        .groupBy(*keys)
        .agg(F.sum(F.col("n") * F.col("size") * rate).alias("words"), F.sum(F.when(rate < cap, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
    )
    gap = F.col("words") - F.col("target")
    sums = sums.withColumn("low_", F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high_", F.when(gap > 0, F.col("lam")).otherwise(F.col("high")))
    newton = F.col("lam") - gap / F.col("slope")
    # A step that jumps far out of a bracket open at one side counts as outside.
    near = F.abs(newton) <= 4 * F.abs(F.col("lam")) + 4
    bounded = F.when((F.col("slope") > 0) & (newton > F.col("low_")) & (newton < F.col("high_")) & near, newton)
    half = (
        F.when(F.col("low_") < -1e8, F.least(F.col("high_") * 2, F.lit(-1.0)))
        .when(F.col("high_") > 1e8, F.greatest(F.col("low_") * 2, F.lit(1.0)))
        .otherwise((F.col("low_") + F.col("high_")) / 2)
    )
    done = F.col("met") | (F.abs(gap) <= 1e-9 * F.col("target")) | (F.col("high_") - F.col("low_") < 1e-13 * F.abs(F.col("lam")))
    return sums.withColumn("done", done).select("source", "source_size", "target", "mean_size", F.when(F.col("done"), F.col("lam")).otherwise(F.coalesce(bounded, half)).alias("lam"), F.col("low_").alias("low"), F.col("high_").alias("high"), F.col("done").alias("met"))


def _comparable(kind: T.DataType) -> bool:
    """Whether a column of this type can be hashed."""
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, rate, row (its place in the input)."""
    rows = by_position(docs).withColumn("row", F.monotonically_increasing_id())
    return _mixed(rows, docs, id_col, text_col, source_col, cap)


def _mixed(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, source_col: str, cap: float) -> DataFrame:
    """rows: docs by position, and `row`."""
    key, text, source = (F.col(place_of(docs, c)) for c in (id_col, text_col, source_col))
    whole = F.xxhash64(*[F.col(f"c{k}") for k, f in enumerate(docs.schema.fields) if _comparable(f.dataType)])
    sized = written(rows.select(key.alias("doc_id"), source.cast("string").alias("source"), size_of(text).alias("size"), whole.alias("content"), "row"), "sizes")
    histogram = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    per_source = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap)
    solved = written(tilts(histogram, per_source, cap), "tilts").withColumnRenamed("source", "of")

    x = F.col("size") / F.col("mean_size")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.coalesce(_rate(F.col("lam"), x, cap), F.lit(cap)))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "content", "among"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    known = _among(sized).join(solved, F.col("source").eqNullSafe(F.col("of")), "left").select("doc_id", "row", "source", "size", "source_size", "target", rate.alias("rate"), unit.alias("unit"))
    sure = F.floor(F.col("rate") + 1e-9)
    known = known.withColumn("sure", sure.cast("long")).withColumn("part", F.greatest(F.col("rate") - sure, F.lit(0.0)))
    # u / (u + part / (1 - part)) rises with the sequential Poisson quotient u / part, and lies in (0, 1).
    quotient = F.when((F.col("part") > 1e-9) & (F.col("size") > 0), F.col("unit") / (F.col("unit") + F.col("part") / (1 - F.least(F.col("part"), F.lit(1 - 1e-9)))))
    known = written(known.withColumn("quotient", quotient), "rates")
    for x in (sized, histogram, solved):
        drop_written(x)
    released(docs.sparkSession)

    picked, left = _below(known)
    for _ in range(FILL):  # the last words of a source: the document that comes nearest to them, one in each round
        fits = F.col("quotient").isNotNull() & (F.col("size") < 2 * F.col("left"))
        near = known.join(left.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).filter(fits & ~F.coalesce(F.col("quotient") < F.col("under"), F.lit(False)))
        near = near.join(picked.select("row"), "row", "left_anti")
        found = written(near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "unit", "row", "size")).alias("x")).select("source", "x.row", "x.size"), "filled")
        if found.isEmpty():
            break
        picked = picked.unionByName(found.select("row", F.lit(1).alias("more")))
        gained = found.select(F.col("source").alias("of"), F.col("size").alias("gain"))
        left = written(left.join(gained, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "under", (F.col("left") - F.coalesce("gain", F.lit(0))).alias("left")), "left")
    edges = left.select(F.col("source").alias("of"), "under")
    taken = known.join(edges, F.col("source").eqNullSafe(F.col("of")), "left").join(picked, "row", "left")
    copies = F.col("sure") + F.coalesce((F.col("quotient") < F.col("under")).cast("long"), F.lit(0)) + F.coalesce(F.col("more"), F.lit(0)).cast("long")
    return taken.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "row")


def _among(sized: DataFrame) -> DataFrame:
    """sized with `among`: the place of a row among the rows of equal content, from 0.

    The upper bits of a row's number are the part of the input that it was read in, so a group of equal rows is numbered in as
    many tasks as the input had parts, and only its counts by part meet in one.
    """
    rows = sized.withColumn("part", F.shiftright("row", 33))
    counts = rows.groupBy("content", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("content").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.sum("n").over(before)).filter("offset is not null").select("content", "part", "offset")
    own = F.row_number().over(Window.partitionBy("content", "part").orderBy("row")) - 1
    return rows.withColumn("own", own).join(offsets, ["content", "part"], "left").withColumn("among", F.col("own") + F.coalesce("offset", F.lit(0))).drop("own", "offset", "part")


def _below(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, more) of the rows beyond `under` that still are taken, and (source, under, left): all quotients below `under` are
    taken, and `left` words are still to find.

    Each round looks at the rows between the bounds of a source only, in `BINS` bins, until the bin with the threshold has
    `FEW` rows; those are put in order.
    """
    wanted = known.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("sure") * F.col("size")).alias("sure_words"), F.min("quotient").alias("low"), F.max("quotient").alias("high"), F.count("quotient").alias("n"))
    state = written(wanted.select("source", (F.col("target") - F.col("sure_words")).alias("need"), F.coalesce("low", F.lit(0.0)).alias("low"), (F.coalesce("high", F.lit(0.0)) + F.lit(1e-15)).alias("high"), "n"), "threshold")
    asked = known.filter("quotient is not null").select("row", F.col("source").alias("of"), "size", "quotient")
    for _ in range(DEEPEST):
        if state.filter(F.col("n") > FEW).isEmpty():
            break
        width = (F.col("high") - F.col("low")) / BINS
        inside = asked.join(state, F.col("of").eqNullSafe(F.col("source"))).filter("quotient >= low and quotient < high")
        bins = inside.groupBy("of", F.least(F.floor((F.col("quotient") - F.col("low")) / width), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        upto = Window.partitionBy("of").orderBy("bin")  # a source has BINS rows here at most
        runs = bins.withColumn("sum", F.sum("words").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        runs = runs.join(state, F.col("of").eqNullSafe(F.col("source")))
        over = F.min(F.when(F.col("sum") > F.col("need"), F.struct("bin", "sum", "words", "rows")))
        found = runs.groupBy("source", "need", "low", "high", "n").agg(over.alias("x"), F.sum("words").alias("all"))
        # Where no bin goes beyond the need, all rows are taken and none is left to order.
        cut = F.col("x").isNotNull()
        new = found.select(
            "source",
            F.when(cut, F.col("need") - (F.col("x.sum") - F.col("x.words"))).otherwise(F.col("need") - F.col("all")).alias("need"),
            F.when(cut, F.col("low") + F.col("x.bin") * width).otherwise(F.col("high")).alias("low"),
            F.when(cut & (F.col("x.bin") < BINS - 1), F.greatest(F.col("low") + (F.col("x.bin") + 1) * width, (F.col("low") + F.col("x.bin") * width) * (1 + 4e-16))).otherwise(F.col("high")).alias("high"),
            F.when(cut, F.col("x.rows")).otherwise(0).alias("n"),
        )
        empty = state.join(found.select(F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of")), "left_anti")
        former, state = state, written(new.unionByName(empty), "threshold")
        drop_written(former)
    inside = asked.join(state, F.col("of").eqNullSafe(F.col("source"))).filter("quotient >= low and quotient < high")
    order = Window.partitionBy("of").orderBy("quotient", "size", "row")
    run = inside.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(F.col("sum") <= F.col("need"))
    run = written(run.select("row", F.col("of").alias("source"), "size"), "ordered")
    edges = state.select("source", F.col("low").alias("under"))
    below = asked.join(edges, F.col("of").eqNullSafe(F.col("source"))).filter("quotient < under").select("source", "size")
    spent = below.unionByName(run.select("source", "size")).groupBy("source").agg(F.sum("size").alias("spent")).withColumnRenamed("source", "of")
    needs = wanted.select(F.col("source").alias("at"), (F.col("target") - F.col("sure_words")).alias("need"))
    left = edges.join(needs, F.col("source").eqNullSafe(F.col("at"))).join(spent, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "under", (F.col("need") - F.coalesce("spent", F.lit(0))).alias("left"))
    return run.select("row", F.lit(1).alias("more")), written(left, "left")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP) -> DataFrame:
    """The rows of docs, each repeated by its copies (0 or more). docs is evaluated once and written with its row numbers."""
    rows = numbered(docs, "rows")
    made = _mixed(rows, docs, id_col, text_col, source_col, cap).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return named_again(staying(rows, made), docs)
