"""Mixing sources to target weights (operator 2) by Pareto order sampling.

A source's target, in words, is its share of the wanted total, stopped at ``most`` times its own size;
what is cut off is shared anew by weight among the others until no source is above its stop. A
document gets the whole part of target / size as certain copies. For the fractional part r, documents
of a source are ranked by the odds of a fixed random number divided by the odds of their inclusion, and
taken in that order while they bring the source's words nearer to its target. The inclusion odds are those of r times
(size / mean size) ** ``length_power``, so longer documents come in a little earlier; fixed sizes are in words, not in documents.

The rank order is never sorted in one task: ranks fall into ``BINS`` bins, sums of (source, bin) give the
bin where a source reaches its target, the rows of that bin alone fall into finer bins
(``LEVELS`` times), and then the sums of equal ranks show the rank at which it does. The random number is an md5 of seed and id, so reruns agree.
Rows of one rank (null or repeated ids) are ordered in the same way by an md5 of id and text. Of rows that are equal in
both, as many are taken as come nearest to the target, by a distributed row number. Sources are numbered over range
partitions, and the share that stops no more sources is found by sums over all sources, a few rounds of them.

A null text has size 0; documents of size 0 take part and bring no words. A null source is a source
of its own and comes last in the order of weights. A null id is hashed as an empty string; repeated rows
are ranked each. An empty table gives an empty result. Other columns pass through, whatever their names: where one has the
name of a column that is added, the added one is called name_2 (``common.added_name``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import added_name, numbered, stored, uniform

WEIGHTS, TOTAL, MOST, LENGTH_POWER = (5.0, 2.0, 1.0), 1.5, 2.0, 0.25
BINS, LEVELS = 2048, 2
#: Source facts are broadcast up to this many sources; beyond it documents are salted over SALTS rows of facts.
MOST_SOURCES, SALTS = 20_000, 64
ADDED = ("size", "source_size", "target", "copies", "taken")
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs) with targets."""
    ranked = numbered(sizes.withColumn("none_", F.col("source").isNull()), ["none_", "source"]).drop("none_")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).drop("number")
    words, weight_sum, n_stopped, rate = *rows.agg(F.sum("source_size"), F.sum("weight")).first(), 0, None
    if weight_sum is None:
        return rows.select("source", "source_size", "n_docs", F.lit(0.0).alias("target"))
    left, weight_left = total * words, weight_sum
    while True:
        rate = left / weight_left if weight_left else 0.0
        stopped = F.lit(left) * F.col("weight") / F.lit(weight_left) >= most * F.col("source_size") if weight_left else F.lit(True)
        n, own, w = rows.where(stopped).agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if n == n_stopped:
            break
        n_stopped, left, weight_left = n, total * words - most * own, weight_sum - w  # sources are only ever added to the stopped ones
    target = F.when(stopped, F.lit(most) * F.col("source_size")).otherwise(F.lit(rate) * F.col("weight"))
    return rows.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _with_facts(frame: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """``frame`` with the facts of its sources; a hot source is spread over salts if they are too many to broadcast."""
    facts = facts.withColumnRenamed("source", "s_")
    if few:
        return frame.join(F.broadcast(facts), frame["source"].eqNullSafe(facts["s_"])).drop("s_")
    facts = facts.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = frame.withColumn("own_salt_", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(facts, salted["source"].eqNullSafe(facts["s_"]) & (salted["own_salt_"] == facts["salt_"])).drop("s_", "salt_", "own_salt_")


def _ranked(frame: DataFrame, facts: DataFrame, few: bool, length_power: float) -> DataFrame:
    """Join the facts of the sources and add the Pareto rank ``q`` from the random number ``u``."""
    joined = _with_facts(frame, facts, few)
    r = F.least(F.greatest(F.col("rest") / F.col("source_size"), F.lit(1e-9)), F.lit(1 - 1e-9))
    mean = F.col("source_size") / F.col("n_docs")
    u = F.col("u")
    return joined.withColumn("q", u / (1 - u) / (r / (1 - r) * F.pow(F.greatest(F.col("size"), F.lit(1)) / F.greatest(mean, F.lit(1.0)), F.lit(length_power))))


def _narrowed(rows: DataFrame, spans: DataFrame, few: bool, at: str, inside: Column) -> DataFrame:
    """``spans`` with low, width and done moved to the bin of ``at`` where a source goes beyond its rest; behind the last bin if it never does."""
    binned = _with_facts(rows, spans, few).where(inside).withColumn("bin", F.least(F.floor((F.col(at) - F.col("low")) / F.col("width") * BINS), F.lit(BINS - 1)).cast("int"))
    bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("done").alias("done"))
    run = Window.partitionBy("source").orderBy("bin")  # BINS rows a source at most
    reached = bins.withColumn("upto", F.col("done") + F.sum("words").over(run)).where(F.col("upto") > F.col("rest"))
    cut = reached.groupBy(F.col("source").alias("c_")).agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("done"))).alias("cut"))
    step = F.col("width") / BINS
    low = F.when(F.col("cut").isNull(), F.col("low") + F.col("width")).otherwise(F.col("low") + F.col("cut.bin") * step)
    moved = {"low": low, "width": step, "done": F.coalesce(F.col("cut.done"), F.col("done"))}
    joined = spans.join(cut, spans["source"].eqNullSafe(cut["c_"]), "left")
    return stored(joined.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in spans.columns]), "spans")


def _crossing(rows: DataFrame, spans: DataFrame, few: bool, at: str, inside: Column) -> DataFrame:
    """Per source the value of ``at`` whose rows, all together, go beyond the rest: (source, value, words before it, its rows, their words)."""
    groups = _with_facts(rows, spans, few).where(inside & (F.col("rest") > 0)).groupBy("source", at).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("done").alias("done"))
    run = Window.partitionBy("source").orderBy(at)  # the different values in one of BINS ** LEVELS bins
    over = groups.withColumn("upto", F.col("done") + F.sum("words").over(run)).where(F.col("upto") > F.col("rest"))
    first = over.groupBy("source").agg(F.min(F.struct(at, (F.col("upto") - F.col("words")).alias("done"), "n", "words")).alias("x"))
    return first.select("source", F.col(f"x.{at}").alias(f"{at}_cut"), F.col("x.done").alias("done"), F.col("x.n").alias("n"), F.col("x.words").alias("words"))


def _cuts(placed: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """(source, whole, rest, low, q_cut, v_cut, k, n): what is taken of a source: ranks below q_cut, of rank q_cut those with v below v_cut, of both k of n rows. v_cut is null where one row has the rank."""
    facts = sources.select("source", "rest")
    spans = facts.withColumns({"low": F.lit(0.0), "width": F.lit(1.0), "done": F.lit(0).cast("long")})
    inside = lambda at: (F.col(at) >= F.col("low")) & (F.col(at) < F.col("low") + F.col("width"))
    for _ in range(LEVELS):
        spans = _narrowed(placed, spans, few, "place", inside("place"))
    cut = stored(_crossing(placed, spans, few, "q", inside("place")), "cut")
    # the last rank of a source is one row nearly always; else its rows are told apart by v
    tied = cut.where("n > 1")
    if tied.isEmpty():
        own = cut.withColumn("v_cut", F.lit(None).cast("double"))
    else:
        ties = facts.join(tied.select(F.col("source").alias("t_"), "q_cut", "done"), F.col("source").eqNullSafe(F.col("t_"))).drop("t_")
        ties = stored(ties.withColumns({"low": F.lit(0.0), "width": F.lit(1.0)}), "ties")
        same = F.col("q") == F.col("q_cut")
        for _ in range(LEVELS):
            ties = _narrowed(placed, ties, few, "v", same & inside("v"))
        found = _crossing(placed, ties, few, "v", same & inside("v"))
        found = found.join(tied.select(F.col("source").alias("t_"), "q_cut"), F.col("source").eqNullSafe(F.col("t_"))).drop("t_")
        own = cut.where("n = 1").withColumn("v_cut", F.lit(None).cast("double")).unionByName(found)
    size = F.col("words") / F.col("n")
    lacking = F.col("rest") - F.col("done")
    k = F.floor(lacking / size)  # a document that crosses the target stays if that leaves no more missing than without it
    k = F.least(k + F.when((k + 1) * size - lacking <= lacking - k * size, 1).otherwise(0), F.col("n"))
    own = own.withColumnRenamed("source", "c_")
    out = sources.join(spans.select(F.col("source").alias("s_"), (F.col("low") + F.col("width")).alias("low")), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    out = out.join(own, F.col("source").eqNullSafe(F.col("c_")), "left").drop("c_")
    return stored(out.withColumn("k", k.cast("long")).drop("done", "words"), "cuts")


def mix_sources(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, length_power: float = LENGTH_POWER, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` and size, source_size, target, copies, taken (= copies * size); rows of 0 copies are kept. ``most`` is a whole number of copies."""
    if most != int(most) or most < 1:
        raise ValueError(f"most must be a whole number of copies, 1 at least, not {most}")
    names = docs.columns
    inner = [f"c{k}_" for k in range(len(names))]
    at = dict(zip(names, inner, strict=True))
    text, id_ = F.col(at[text_col]), F.coalesce(F.col(at[id_col]).cast("string"), F.lit(""))
    rows = docs.toDF(*inner).withColumns({"source": F.col(at[source_col]), "size": n_words(text), "u": uniform(F.lit(str(seed)), id_), "v": uniform(F.lit(str(seed)), id_, F.coalesce(text, F.lit("")))})
    sized = stored(rows.select("source", "size", "u", "v"), "sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, total, most)
    sources = sources.withColumn("whole", F.least(F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), F.lit(int(most))))
    sources = stored(sources.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "sources")
    few = sources.count() <= MOST_SOURCES
    place = F.col("q") / (1 + F.col("q"))
    placed = stored(_ranked(sized, sources, few, length_power).select("source", "size", "q", "v", place.alias("place")), "placed")
    cuts = _cuts(placed, sources, few)

    out = _ranked(rows, cuts, few, length_power)
    last = (F.col("q") == F.col("q_cut")) & (F.col("v") == F.col("v_cut"))
    below = F.when(F.col("q_cut").isNull(), place < F.col("low")).otherwise((F.col("q") < F.col("q_cut")) | ((F.col("q") == F.col("q_cut")) & F.when(F.col("v_cut").isNull(), F.col("k") > 0).otherwise((F.col("v") < F.col("v_cut")) | (last & (F.col("k") >= F.col("n"))))))
    copies = lambda chosen: F.least(F.coalesce(F.col("whole"), F.lit(0)) + chosen.cast("long"), F.lit(int(most))).cast("int")
    result = lambda frame, chosen: frame.withColumn("copies", copies(chosen)).select(*inner, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    some = cuts.where("n > 1 and k > 0 and k < n")
    every = result(out, (F.col("rest") > 0) & F.coalesce(below, F.lit(False)))
    if not some.isEmpty():  # k of n equal rows
        part = F.coalesce(last & (F.col("n") > 1) & (F.col("k") > 0) & (F.col("k") < F.col("n")), F.lit(False))
        ranks = numbered(out.where(part).withColumn("tag_", F.monotonically_increasing_id()), ["source", "tag_"])
        firsts = ranks.groupBy(F.col("source").alias("f_")).agg(F.min("number").alias("first_"))
        ranks = ranks.join(F.broadcast(firsts) if few else firsts, ranks["source"].eqNullSafe(firsts["f_"]))
        every = result(out.where(~part), (F.col("rest") > 0) & F.coalesce(below, F.lit(False))).unionByName(result(ranks, F.col("number") - F.col("first_") < F.col("k")))
    added: list[str] = []
    for name in ADDED:
        added.append(added_name([*names, *added], name))
    return every.toDF(*names, *added)


def repeat_copies(mixed: DataFrame, columns: list[str], copies_col: str = "copies") -> DataFrame:
    """The mix itself: every document as often as it has copies."""
    names = [f"`{c}`" for c in columns]
    return mixed.where(F.col(copies_col) > 0).select(*names, F.explode(F.sequence(F.lit(1), F.col(copies_col))).alias("copy__")).select(*names)
