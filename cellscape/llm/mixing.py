"""Mixing sources to target weights by entropy balancing.

Per source the rates of its documents are chosen closest in entropy to one copy each, under the constraint
that the expected tokens equal the source's target and no rate exceeds ``CAP``.  The solution is an
exponential tilt, rate = min(CAP, exp(lambda * size / mean size)); the convex dual has one lambda per
source, found by Newton steps on grouped sums.  Sizes enter in classes one per cent wide, so a source has a
bounded number of rows in the dual whatever the number of its documents.  Expected copies become whole ones by
carrying the rounding error from the largest class to the smallest, and each class deals its copies to its
documents by rank of a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellscape.llm.common import text_of, words_of
from cellscape.session import cut_lineage

CAP = 3
WEIGHTS = (1, 2, 3)
#: Sizes to here are classes of their own; above, classes grow by one per cent.
EXACT_SIZES = 100
STEP = math.log(1.01)
#: Documents ranked together; larger classes are dealt into hashed groups first.
GROUP_ROWS = 1_000
TOLERANCE = 1e-9
MAX_STEPS = 100


def source_key(source: Column) -> Column:
    """A join key without nulls that sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def size_class(size: Column) -> Column:
    grown = F.lit(EXACT_SIZES) + F.ceil(F.log(size / F.lit(float(EXACT_SIZES))) / F.lit(STEP))
    return F.when(size <= EXACT_SIZES, size).otherwise(grown).cast("int")


def target_tokens(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add ``target`` to (key, source_size): shares by weight of all tokens, stopped at cap times the source's size.

    One row per source.  The excess of stopped sources is shared again by weight until none is above.
    """
    # one row per source in the only window: sources are ranked by code point
    ranked = totals.withColumn("__r", F.row_number().over(Window.orderBy("key")) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    state = cut_lineage(ranked.withColumn("weight", F.get(cycle, F.pmod("__r", F.lit(len(weights))).cast("int"))).drop("__r"))
    level = None
    while True:  # each pass stops at least one more source or ends
        stopped = F.lit(False) if level is None else F.col("weight") * level >= cap * F.col("source_size")
        sums = state.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(stopped, cap * F.col("source_size")).otherwise(0.0)).alias("held"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not sums["open"]:
            return state.withColumn("target", F.lit(float(cap)) * F.col("source_size"))
        new = max(0.0, sums["all"] - sums["held"]) / sums["open"]
        if level is not None and new <= level * (1 + 1e-15):
            return state.withColumn("target", F.least(F.lit(float(cap)) * F.col("source_size"), F.col("weight") * F.lit(new)))
        level = new


def tilt(classes: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """Lambda per source: (key, target, mean, lam), Newton on the logarithm of the dual's gradient inside a bracket.

    A source at its cap has every rate at ``cap``; one without tokens keeps rate zero.
    """
    base = classes.groupBy("key").agg(F.sum("n").alias("__n"), F.sum("tokens").alias("__t"), F.min(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("n"))).alias("__least"))
    base = base.join(targets.select("key", "target"), "key").withColumn("mean", F.col("__t") / F.col("__n"))
    share, least = F.col("target") / F.col("__t"), F.col("__least") / F.col("mean")
    live = (F.col("__t") > 0) & (F.col("target") > 0) & (F.col("target") < cap * F.col("__t") * (1 - 1e-12))
    low = F.when(share < 1, F.log(share) / least).otherwise(F.lit(0.0))
    state = cut_lineage(
        base.select(
            "key", "target", "mean", live.alias("live"),
            F.when(live, low).alias("low"), F.when(live, F.lit(math.log(cap)) / least).alias("high"),
            F.when(live, F.least(F.greatest(low, F.log(share)), F.lit(math.log(cap)) / least)).alias("lam"),
        )
    )
    for _ in range(MAX_STEPS):
        x = F.col("tokens") / F.col("n") / F.col("mean")
        rate = F.exp(F.col("lam") * x)
        sums = classes.join(state.where("live"), "key").groupBy("key").agg(
            F.sum(F.col("tokens") * F.least(rate, F.lit(float(cap)))).alias("__g"),
            F.sum(F.when(rate < cap, F.col("tokens") * rate * x).otherwise(0.0)).alias("__h"),
        )
        gap = F.log(F.col("__g") / F.col("target"))
        step = F.col("lam") - gap * F.col("__g") / F.col("__h")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        inside = (F.col("__h") > 0) & (step > low) & (step < high)
        moved = state.join(sums, "key", "left").select(
            "key", "target", "mean", "live", low.alias("low"), high.alias("high"),
            F.when(F.abs(gap) <= TOLERANCE, F.col("lam")).when(inside, step).otherwise((low + high) / 2).alias("lam"),
            F.abs(gap).alias("gap"),
        )
        state = cut_lineage(moved)
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("key", "target", "mean", "live", "lam")


def whole_copies(classes: DataFrame, state: DataFrame, cap: int = CAP) -> DataFrame:
    """Copies that each class takes: (key, class, n, copies, target), the error carried from large to small classes."""
    x = F.col("tokens") / F.col("n") / F.col("mean")
    rate = F.when(F.col("live"), F.least(F.exp(F.col("lam") * x), F.lit(float(cap)))).when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0))
    rated = classes.join(state, "key").select("key", "target", F.struct("class", "n", (F.col("tokens") / F.col("n")).alias("m"), rate.alias("r")).alias("c"))
    lists = rated.groupBy("key", "target").agg(F.sort_array(F.collect_list("c"), asc=False).alias("cs"))  # at most some 1,500 classes a source

    def carry(acc: Column, c: Column) -> Column:
        wanted = c["n"] * c["r"] * c["m"] + acc["left"]
        taken = F.when(c["m"] > 0, F.least(F.greatest(F.round(wanted / c["m"]), F.lit(0.0)), F.lit(float(cap)) * c["n"])).otherwise(F.round(c["n"] * c["r"])).cast("long")
        return F.struct(
            (wanted - taken * c["m"]).alias("left"),
            F.concat(acc["out"], F.array(F.struct(c["class"].alias("class"), c["n"].alias("n"), taken.alias("copies"), c["r"].alias("rate")))).alias("out"),
        )

    empty = F.from_json(F.lit("[]"), "array<struct<class:int,n:bigint,copies:bigint,rate:double>>")
    done = F.aggregate("cs", F.struct(F.lit(0.0).alias("left"), empty.alias("out")), carry, lambda a: a["out"])
    return lists.select("key", "target", F.inline(done))


def deal_copies(rows: DataFrame, plan: DataFrame, order: list[str]) -> DataFrame:
    """Add ``copies`` and ``target`` to rows with key, size and class: the j-th of n gets floor((j+1)K/n) - floor(jK/n).

    A class of more than ``GROUP_ROWS`` rows is ranked in hashed groups whose first ranks come from their counts.
    """
    joined = rows.join(plan, ["key", "class"])
    joined = joined.withColumn("__group", F.pmod(F.xxhash64(*order, F.lit(7)), F.ceil(F.col("n") / GROUP_ROWS)).cast("int"))
    group = ["key", "class", "__group"]
    inside = Window.partitionBy(*group).orderBy(F.xxhash64(*order), *order)
    ranked = joined.withColumn("__at", F.row_number().over(inside) - 1)
    counts = joined.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy("key", "class").orderBy("__group").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(*group, (F.sum("__n").over(running) - F.col("__n")).alias("__start"))
    j = F.col("__start") + F.col("__at")
    exact = lambda i: F.expr(f"({i}) * copies div n")
    dealt = ranked.join(starts, group).withColumn("__j", j.cast("long"))
    return dealt.withColumn("copies", exact("__j + 1") - exact("__j")).drop("__group", "__at", "__start", "__j", "n")


def class_table(sized: DataFrame) -> DataFrame:
    return cut_lineage(sized.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("double").alias("tokens")))


def plan_mix(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies per class and (key, source_size) totals."""
    totals = classes.groupBy("key").agg(F.sum("tokens").cast("double").alias("source_size"))
    state = tilt(classes, target_tokens(totals))
    return cut_lineage(whole_copies(classes, state)), totals


def sized_rows(docs: DataFrame, doc_id: str, text: str, source: str, row: Column) -> DataFrame:
    size = F.size(words_of(text_of(text))).cast("long")
    sized = docs.select(row.alias("__row"), F.col(doc_id).alias("__id"), F.crc32(F.encode(text_of(text), "UTF-8")).alias("__crc"), source_key(F.col(source)).alias("key"), size.alias("size"))
    return sized.withColumn("class", size_class(F.col("size")))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    Null text: size 0, taken 0.  A null source is a source, the last.  Documents of equal size and source are
    dealt copies by hash rank, equal rows in any order.  Other columns are dropped.  An empty table gives no rows.
    """
    slim = cut_lineage(sized_rows(docs, doc_id, text, source, F.struct(F.col(source).alias("source"))))
    classes = class_table(slim)
    plan, totals = plan_mix(classes)
    dealt = deal_copies(slim, plan, ["__id", "size", "__crc"])
    out = dealt.join(totals, "key")
    return out.select(F.col("__id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"), F.col("__row.source").alias("source"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every document as often as its copies say, with the columns of ``docs``.

    Rows travel whole through one shuffle, so repeated or null ids need no join back.  A document without
    words counts no tokens; it is kept as often as the rate of its class says.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plan, _ = plan_mix(class_table(sized_rows(docs, doc_id, text, source, F.lit(0))))
    dealt = deal_copies(sized_rows(docs, doc_id, text, source, row), plan, ["__id", "size", "__crc"])
    repeated = dealt.where(F.col("copies") > 0).select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("__row.*")
