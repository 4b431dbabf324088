"""MinHash near-dedup (operator 7) by ProbMinHash signatures of weighted shingles.

Shingles are runs of five words; a shingle that stands c times in a document weighs 1 + ln c. Every
shingle sends arrivals of a Poisson process with its weight as rate, each to a random register; a
register keeps the shingle of its earliest arrival, and a shingle stops as soon as its next arrival is later than the latest
register. Two documents agree in a register with the probability Jaccard similarity of their
weights (the Jaccard similarity of their sets where all weights are equal).

Documents with equal shingles and weights are one class, and only classes go on. Classes that share a
band of registers are verified by exact probability Jaccard on their shingles. In each bucket all classes are
compared with a few centres first, the ones that share most buckets; then every pair of a bucket whose members are not yet
connected is compared, so no link that decides a group is left out. Small buckets are compared pair by pair;
large ones as tiles, whose tasks send on a link from each connected member to the first it is connected with,
never all pairs. There is no cap on buckets, partners or candidates.

A bucket with a large share of all rows is hot: what is joined to it is broadcast (there are few such buckets), and its rows
are dealt by themselves instead of by their bucket.

The result has a row per document: its id, component (the smallest id of its group) and whether it is kept; one row of each group is.
A text without words links with nothing and is kept. A row with a null id groups by its text as others do; a group without any id
has a null component. Repeated rows, and rows that share an id, are rows of their own: of equal texts under the smallest id of a group one is kept.
An empty table gives an empty result. Other columns, whatever their names, are left out, and kept by ``drop_near_duplicates``. A long text is read in pieces;
its shingles (8 bytes each) are held at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_one, mix64, stored
from .components import components
from .words import shingle_parts

SIZE, SIMILARITY, BANDS, ROWS, STAR_ROUNDS = 5, 0.8, 18, 4, 2
#: Ids or pairs are broadcast up to this many rows, else joined by a shuffle. Buckets beyond SMALL members are compared as tiles of TILE members.
MOST_SENT, SMALL, TILE = 400_000, 24, 192
#: A bucket is hot with more than 1 / HOT of all classes; rounding that a similarity may be off by; shingles that race for registers at once.
HOT, ROUNDING, AT_ONCE = 2000, 1e-9, 1 << 20


def weighted(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of the distinct shingles of each row, sorted by row and shingle."""
    if len(row) and row[0] == row[-1]:  # one row, maybe a very long one: no order to keep beside the values
        code = np.sort(code)
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        weight = np.diff(first, append=len(code)).astype(float)
        np.log(weight, out=weight)
        weight += 1
        return np.broadcast_to(np.int64(row[0]), len(first)), code if len(first) == len(code) else code[first], weight
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[first], code[first], 1 + np.log(np.diff(np.r_[first, len(row)]))


def prob_minhash(row: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """Signatures, rows x registers: the shingle that arrives first at each register."""
    best = np.full(rows * registers, np.inf)
    sig = np.zeros(rows * registers, np.uint64)
    for begin in range(0, len(row), AT_ONCE):
        part = slice(begin, begin + AT_ONCE)
        _race(best, sig, row[part], code[part], weight[part], rows, registers)
    return sig.reshape(rows, registers)


def _race(best, sig, row, code, weight, rows: int, registers: int) -> None:
    """Let shingles arrive at the registers that others may have reached before."""
    at, time = np.arange(len(row)), np.zeros(len(row))
    turn, ahead = 0, 1
    while len(at):
        # the next ``ahead`` arrivals of every shingle still in play
        draw = mix64(code[at, None] + mix64(np.arange(turn, turn + ahead, dtype=np.uint64), 3)[None, :], 9)
        gap = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[at, None]
        arrival = time[:, None] + np.cumsum(gap, axis=1)
        place = row[at, None] * registers + (mix64(draw, 4) % np.uint64(registers)).astype(np.int64)
        flat, when = place.ravel(), arrival.ravel()
        np.minimum.at(best, flat, when)
        won = np.flatnonzero(best[flat] == when)
        sig[flat[won]] = code[at[won // ahead]]
        last = best.reshape(rows, registers).max(1)
        time = arrival[:, -1]
        live = time < last[row[at]]
        at, time = at[live], time[live]
        turn += ahead
        ahead = int(min(64, max(1, 200_000 // max(len(at), 1), 1)))


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets with sorted elements."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if wa.min() == wa.max() and wb.min() == wb.max():
        return len(common) / (len(a) + len(b) - len(common))
    ratio = wb[ib] / wa[ia]
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], wa[ia][order], wb[ib][order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # for i: sum over j of max(x_j / x_i, y_j / y_i); x_j / x_i is larger where ratio_j < ratio_i
    below = np.concatenate([[0], np.cumsum(x)])[:-1]
    above = np.cumsum(y[::-1])[::-1]
    return float((1 / ((below + only_a) / x + (above + only_b) / y)).sum())


def _class(row: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two halves of each row's name and where its shingles begin."""
    edges = np.array([0, len(row)]) if n == 1 else np.searchsorted(row, np.arange(n + 1))
    halves = lambda c, w: (mix64(c ^ w.view(np.uint64), 21), mix64(c + w.view(np.uint64), 22))
    if n == 1:  # maybe a very long row: part by part
        sums = [np.zeros(1, np.uint64), np.zeros(1, np.uint64)]
        for k in range(0, len(code), AT_ONCE):
            for total, x in zip(sums, halves(code[k : k + AT_ONCE], weight[k : k + AT_ONCE]), strict=True):
                total += x.sum(dtype=np.uint64)
    else:
        totals = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in halves(code, weight)]
        sums = [total[edges[1:]] - total[edges[:-1]] for total in totals]
    a, b = (mix64(total + np.diff(edges).astype(np.uint64)).view(np.int64) for total in sums)
    return a, b, edges


def _masked(parts: list[np.ndarray], edges: list[np.ndarray]) -> pa.Array:
    """Names of rows, null for those without shingles."""
    if not parts:
        return pa.array([], pa.int64())
    return pa.array(np.concatenate(parts), mask=np.concatenate([np.diff(e) == 0 for e in edges]))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """(id, class_a, class_b, bands): a 128-bit name of the weighted shingles, null without words, and the band hashes."""
    def run(batches):
        for batch in batches:
            a, b, edges, hashes = [], [], [], []
            for _, n, row, code in shingle_parts(as_one(batch, "t"), size):
                r, s, w = weighted(row, code)
                for out, x in zip((a, b, edges), _class(r, s, w, n), strict=True):
                    out.append(x)
                sig = prob_minhash(r, s, w, n, bands * rows)
                band = np.zeros((n, bands), np.uint64)
                for k in range(rows):
                    band = mix64(band + sig[:, k::rows], k + 1)
                hashes.append(band.view(np.int64))
            flat = np.concatenate(hashes).ravel() if hashes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), _masked(a, edges), _masked(b, edges), lists], names=["id", "class_a", "class_b", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, class_a long, class_b long, bands array<long>")


def _shingles_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, s, w): sorted 32-bit shingle hashes and weights of the wanted classes, as bytes. wanted: id, class_a, class_b, node."""
    def run(batches):
        for batch in batches:
            a, b, edges, s_out, w_out = [], [], [], [], []
            for _, n, row, code in shingle_parts(as_one(batch, "t"), size):
                for out, x in zip((a, b, edges), _class(*weighted(row, code), n), strict=True):
                    out.append(x)
                r, code, weight = weighted(row, code >> np.uint64(32))
                ends = np.searchsorted(r, np.arange(n + 1))
                for x, y in zip(ends[:-1], ends[1:], strict=True):
                    s_out.append(code[x:y].astype("<u4").tobytes())
                    w = weight[x:y]
                    w_out.append(w.astype("<f4").tobytes() if y > x and w.max() > 1 else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), _masked(a, edges), _masked(b, edges), pa.array(s_out, pa.binary()), pa.array(w_out, pa.binary())], names=["own", "a_", "b_", "s", "w"])

    kind = docs.schema["own"].dataType.simpleString()
    ids = wanted.select("id").distinct()
    found = docs.join(_sent(ids), docs["own"].eqNullSafe(ids["id"]), "left_semi").mapInArrow(run, f"own {kind}, a_ long, b_ long, s binary, w binary")
    same = found["own"].eqNullSafe(wanted["id"]) & (found["a_"] == wanted["class_a"]) & (found["b_"] == wanted["class_b"])
    texts = stored(found.join(_sent(wanted), same).select("node", "s", "w"), "shingles")
    return texts if texts.count() == wanted.count() else stored(texts.dropDuplicates(["node"]), "shingles")  # repeated rows


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose probability Jaccard is ``similarity`` or more."""
    def run(batches):
        weights = lambda w, n: np.frombuffer(w, "<f4").astype(float) if len(w) else np.ones(n)
        for pdf in batches:
            keep = []
            for s, w, t, v in zip(pdf["s"], pdf["w"], pdf["t"], pdf["v"], strict=True):
                x, y = np.frombuffer(s, "<u4"), np.frombuffer(t, "<u4")
                keep.append(probability_jaccard(x, weights(w, len(x)), y, weights(v, len(y))) >= similarity - ROUNDING)
            yield pdf.loc[keep, ["a", "b"]]

    left, right = texts.toDF("a", "s", "w"), texts.toDF("b", "t", "v")
    return right.join(_sent(pairs), "b").join(left, "a").mapInPandas(run, "a long, b long")


def _sent(rows: DataFrame) -> DataFrame:
    """A stored table of ids, for broadcast if a count shows it to be small."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a tile's sets, by products of incidence blocks."""
    n = len(sets)
    owner = np.repeat(np.arange(n), list(map(len, sets)))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    column = rank[column]
    order = np.flatnonzero(column >= 0)
    order = order[np.argsort(column[order], kind="stable")]
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = 4096
    for at in range(0, int(rank.max(initial=-1)) + 1, width):
        x, y = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, width), np.float32)
        block[owner[x:y], column[x:y] - at] = 1
        out += block @ block.T
    return out


def _tile_links(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links (a, b) that connect the members of a tile as all its verified pairs would."""
    pdf = pdf.drop_duplicates("rep")
    sets = [np.frombuffer(x, "<u4") for x in pdf["s"]]
    weights = [np.frombuffer(x, "<f4").astype(float) if len(x) else None for x in pdf["w"]]
    sizes = np.array(list(map(len, sets)))
    rep, component = pdf["rep"].to_numpy(), pdf["component"].to_numpy()
    common = _intersections(sets)
    plain = np.array([w is None for w in weights])
    jaccard = common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1)
    open_ = np.triu(component[:, None] != component[None, :], 1) & (common > 0)
    both = plain[:, None] & plain[None, :]
    linked = open_ & both & (jaccard >= similarity - ROUNDING)
    for i, j in zip(*np.nonzero(open_ & ~both), strict=True):
        x, y = (np.ones(sizes[k]) if weights[k] is None else weights[k] for k in (i, j))
        linked[i, j] = probability_jaccard(sets[i], x, sets[j], y) >= similarity - ROUNDING
    i, j = np.nonzero(linked)
    label = np.arange(len(rep))
    while len(i):
        low = np.minimum(label[i], label[j])
        if (label[i] == label[j]).all():
            break
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label != label[label]).any():
            label = label[label]
    keep = label != np.arange(len(rep))
    return pd.DataFrame({"a": rep[keep], "b": rep[label[keep]]})


def _tiles(open_rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links of large buckets: members fall into tiles, and all pairs of tiles of a bucket are tasks of bounded size."""
    n = F.ceil(F.col("n") / TILE).cast("int")
    rows = open_rows.withColumn("tiles", n).withColumn("own", F.pmod(F.xxhash64("rep"), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("band", "h", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep", "component")
    rows = texts.join(_sent(stored(rows, "tiles")), "rep").select("band", "h", "x", "y", "rep", "component", "s", "w")
    return rows.groupBy("band", "h", "x", "y").applyInPandas(lambda pdf: _tile_links(pdf, similarity), "a long, b long")


def _by_bucket(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the facts of their buckets (band, h, hot, fact). Facts of hot buckets are broadcast, and hot rows are dealt by their node."""
    warm = F.broadcast(facts.where("hot").select(F.col("band").alias("b_"), F.col("h").alias("h_"), F.col("fact").alias("warm_")))  # HOT rows a band at most
    cold = facts.where("not hot").select(F.col("band").alias("c_"), F.col("h").alias("i_"), F.col("fact").alias("cold_"))
    out = rows.join(warm, rows["hot"] & (rows["band"] == warm["b_"]) & (rows["h"] == warm["h_"]), "left").drop("b_", "h_")
    out = out.withColumns({"deal_": F.when(F.col("hot"), F.xxhash64("rep", "band")).otherwise(F.col("h"))})
    out = out.join(cold, ~F.col("hot") & (F.col("band") == F.col("c_")) & (F.col("deal_") == F.col("i_")), "left")
    return out.withColumn("fact", F.coalesce("warm_", "cold_")).drop("c_", "i_", "deal_", "warm_", "cold_").where("fact is not null")


def _groups(docs: DataFrame, id_col: str, text_col: str, similarity: float, bands: int, rows: int, size: int, star_rounds: int) -> DataFrame:
    """(id, row, class_a, class_b, component, kept) of every row."""
    sigs = stored(signatures(docs, id_col, text_col, bands, rows, size).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # a class is named by its first row: that with the smallest id
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = sigs.where("class_a is not null").groupBy("class_a", "class_b").agg(F.min(first).alias("first")).select("class_a", "class_b", F.col("first.row").alias("node"), "first.id", "first")
    classes = stored(classes, "classes")
    reps = sigs.select("row", "bands").join(classes.select("node"), F.col("row") == F.col("node"))
    rows_ = reps.select(F.col("node").alias("rep"), F.posexplode("bands").alias("band", "h"))
    counts = stored(rows_.groupBy("band", "h").agg(F.count(F.lit(1)).alias("fact")).where("fact > 1").withColumn("hot", F.col("fact") > max(1000, classes.count() // HOT)), "counts")
    hot = F.broadcast(counts.where("hot").select("band", "h", "hot"))  # HOT rows a band at most
    marked = rows_.join(hot, ["band", "h"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    multi = stored(_by_bucket(marked, counts).withColumnRenamed("fact", "n"), "buckets")
    wanted = stored(multi.select("rep").distinct().join(classes.select("id", "class_a", "class_b", "node"), F.col("rep") == F.col("node")).drop("rep"), "wanted")
    texts = _shingles_of(docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("t")), wanted, size).withColumnRenamed("node", "rep")

    degree = multi.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = multi.drop("n").join(degree, "rep").withColumn("component", F.col("rep"))
    edges, tried = None, None
    for turn in range(star_rounds):
        ranked = stored(ranked, "open")
        # one centre a component and bucket in play: the best of all, or later the best outside the largest component
        best = F.struct("degree", F.xxhash64("rep", F.lit(turn)), "rep", "component")
        centre = ranked.groupBy("band", "h", "hot").agg(F.max(best).alias("fact")).withColumn("fact", F.struct(F.col("fact.rep").alias("b"), F.col("fact.component").alias("cb")))
        pairs = _by_bucket(ranked, centre).select("rep", "component", "fact.b", "fact.cb").where("component <> cb").select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stored(_verified(pairs, texts, similarity), "links")
        edges = found if edges is None else edges.unionByName(found)
        ranked = _still_open(ranked.drop("component"), components(edges)).withColumn("degree", F.xxhash64("rep", F.lit(turn)))
    ranked = stored(ranked.drop("degree"), "open")
    sizes = ranked.groupBy("band", "h", "hot").agg(F.count(F.lit(1)).alias("fact"))
    ranked = stored(_by_bucket(ranked, sizes).withColumnRenamed("fact", "n"), "open")
    small = ranked.where(F.col("n") <= SMALL)
    x, y = small.select("band", "h", F.col("rep").alias("a"), F.col("component").alias("ca")), small.select("band", "h", F.col("rep").alias("b"), F.col("component").alias("cb"))
    rest = stored(x.join(y, ["band", "h"]).where("a > b and ca <> cb").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    edges = edges.unionByName(_verified(rest, texts, similarity)).unionByName(_tiles(ranked.where(F.col("n") > SMALL), texts, similarity))
    groups = components(edges)
    named = classes.join(groups.withColumnRenamed("component", "group"), F.col("node") == groups["id"], "left").select("class_a", "class_b", "first", F.coalesce("group", "node").alias("group"))
    named = stored(named, "named")
    named = named.join(named.groupBy("group").agg(F.min("first").alias("least")), "group").select(F.col("class_a").alias("x"), F.col("class_b").alias("y"), F.col("least.id").alias("least_id"), F.col("least.row").alias("least_row"))
    out = sigs.select("id", "row", "class_a", "class_b").join(named, (F.col("x") == F.col("class_a")) & (F.col("y") == F.col("class_b")), "left")
    alone = F.col("class_a").isNull()
    return out.select("id", "row", "class_a", "class_b", F.when(alone, F.col("id")).otherwise(F.col("least_id")).cast("long").alias("component"), F.when(alone, F.lit(True)).otherwise(F.col("row") == F.col("least_row")).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SIZE, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(id, component, kept) for every document."""
    return _groups(docs, id_col, text_col, similarity, bands, rows, size, star_rounds).select(F.col("id").alias(id_col), "component", "kept")


def _still_open(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of buckets whose members are in more than one component, with their component."""
    groups = groups.withColumnRenamed("id", "g_")
    now = stored(buckets.join(groups, buckets["rep"] == groups["g_"], "left").drop("g_").withColumn("component", F.coalesce("component", "rep")), "now")
    mixed = now.groupBy("band", "h", "hot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "h", "hot", F.lit(1).alias("fact"))
    return _by_bucket(now, mixed).drop("fact")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SIZE, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """``docs`` with one row of each group, and all rows without words."""
    found = stored(_groups(docs, id_col, text_col, similarity, bands, rows, size, star_rounds), "groups")
    kept = found.where("kept").select(F.col("id").alias("k_"), F.col("class_a").alias("x_"), F.col("class_b").alias("y_"))
    many = stored(found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select(F.col("id").alias("m_")), "many")
    own = docs[id_col]
    if many.isEmpty():
        return docs.join(kept, own == kept["k_"], "left_semi")
    # rows that share an id, or have none, are told apart by their class
    many = _sent(many)
    single = docs.join(many, own.eqNullSafe(many["m_"]), "left_anti").join(kept, own == kept["k_"], "left_semi")
    inner = [f"c{k}" for k in range(len(docs.columns))]
    shared = docs.join(many, own.eqNullSafe(many["m_"]), "left_semi").toDF(*inner)
    at_text, at_id = (docs.columns.index(c) for c in (text_col, id_col))

    def run(batches):
        for batch in batches:
            a, b, edges = [], [], []
            for _, n, row, code in shingle_parts(as_one(batch, batch.schema.names[at_text]), size):
                for out, x in zip((a, b, edges), _class(*weighted(row, code), n), strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, _masked(a, edges), _masked(b, edges)], names=[*batch.schema.names, "class_a", "class_b"])

    shared = shared.mapInArrow(run, T.StructType([*shared.schema.fields, T.StructField("class_a", T.LongType()), T.StructField("class_b", T.LongType())]))
    same = shared[inner[at_id]].eqNullSafe(kept["k_"]) & (shared["class_a"] == kept["x_"]) & (shared["class_b"] == kept["y_"])
    first = shared.where("class_a is not null").join(kept, same, "left_semi").dropDuplicates(["class_a", "class_b"])
    return single.union(first.unionByName(shared.where("class_a is null")).select(*inner).toDF(*docs.columns))
