"""Spelling variant grouping (operator 12): a frontier of walks through a relational trie, level by level.

The words of all texts are counted (``spelled_words``); two words are near if they differ by exactly one inserted, deleted or
replaced code point. The trie is a distributed edge table: (node, label, child), one row for each first letter below a node, so a node
has at most as many edges as there are letters (90). Chains are compressed: a label runs up to the next fork or the end of a word, and
comes from the least and the greatest word below. A node is named by its prefix. The table is bucketed by node, so no level
shuffles or sorts it again: a task holds the edges of a bucket and the states stream past.

The frontier holds (word, position, node, edits) states. Each level joins it with the edges of its nodes; a label is taken with at most one
edit in all, and a state that ends a word with one edit is a pair of neighbours. An edit stands either behind the first half of a word or
before the rest of it, so a word walks two tries, one of words and one of reversed words, and starts in each at the node of the part that stays.
States are dropped where no word below has a fitting length and the same last letters, by a mask of 64 bits. Nodes with many states (at most twice ``HOT_NODES`` in a level) are
joined by a broadcast of their edges, which are few and short. Levels after the first read only the edges of forks.

Words of ``LONG`` code points or more walk a second pair of tries of their own with forks at 32, 64, 128 ... code points, whose nodes are
named by digests: a word of any length has few edges, their labels taking no more room than the word. Words of exactly
``LONG`` code points are in both.

A null text has no words, a null id is spelled as an empty string, repeated rows count each. An empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, slices, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
CUT = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Code points of a word at least, occurrences at least, and how often more frequent a form must be than its variant.
LEAST, OFTEN, RATIO = 7, 2, 10
#: Words from this length on walk tries with far forks; entries of a task's counter before it is passed on.
LONG, COUNTED = 64, 200_000
#: A node is hot with more states than this and than a 64th of the level's; states sampled to find them; edges of a bucket, which a task holds.
HOT_STATES, HOT_NODES, SAMPLED, EDGES_A_BUCKET = 100_000, 64, 200_000, 400_000


def spelled_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n): lower-cased runs of letters; where 31 divides the crc32 h of ``<id>:<run>``, without their code point h % length."""

    pattern = re.compile(f"[A-Za-zÀ-ÿ]{{{max(least, 1)},}}")  # a shorter run gives no word

    def counted(batches):
        seen: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                runs: Counter = Counter()
                for part in slices(text, CUT):
                    runs.update(pattern.findall(part))
                before = zlib.crc32(f"{'' if key.as_py() is None else key.as_py()}:".encode())
                for run, n in runs.items():
                    run = run.lower() if run.isascii() else run.translate(LOWER)
                    h = zlib.crc32(run.encode(), before)
                    if h % 31 == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) >= least:
                        seen[run] += n
                if len(seen) >= COUNTED:
                    yield _counts(seen)
                    seen = Counter()
        yield _counts(seen)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def _both_ways(words: DataFrame, ahead: str, back: str) -> DataFrame:
    """(way, key, n, m): each word and the reversed word, with the letter of their trie."""
    ways = F.explode(F.array(F.struct(F.lit(ahead).alias("way"), F.col("word").alias("key")), F.struct(F.lit(back).alias("way"), F.reverse("word").alias("key"))))
    return words.select("n", ways.alias("x")).select("x.way", "x.key", "n", F.length("x.key").alias("m"))


def _long_name(depth: Column) -> Column:
    """The node of a far fork: prefixes of more than 32 code points are named by their digest."""
    prefix = F.substring("key", F.lit(1), depth)
    return F.concat("way", F.when(depth <= 32, prefix).otherwise(F.sha2(prefix, 256)))


def _bit(length: Column, ending: Column) -> Column:
    """One of 64 bits for words of this length and these last two letters."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(length, ending), F.lit(64)).cast("int"))


def trie_edges(words: DataFrame) -> DataFrame:
    """(node, label, child, end, end_n, leaf, mask): ``end`` is the word, in the trie's direction, that ends at the child. A node that is a word has a row without label as well.

    ``leaf``: no word goes on below the child; ``mask``: bits of the lengths and last letters of the words through the edge. A word
    stands only below nodes at which the walks of words of about its length can be.
    """
    short = _both_ways(words, "f", "r")
    depth = F.explode(F.sequence(F.greatest(F.lit(1), F.floor((F.col("m") - F.when(F.col("way") == "f", 1).otherwise(0)) / 2).cast("int")), F.col("m")))
    bit = _bit(F.col("m"), F.substring("key", F.col("m") - 1, F.lit(2)))
    # the last depth is the word itself: a row without a letter, so that the node of a word has one edge more
    steps = short.select("way", "key", "n", "m", bit.alias("bit"), depth.alias("d"))
    steps = steps.select(F.concat("way", F.substring("key", F.lit(1), F.col("d"))).alias("node"), F.substring("key", F.col("d") + 1, F.lit(1)).alias("first"), F.substring("key", F.col("d") + 1, F.col("m")).alias("tail"), "n", "bit")
    forks = steps.groupBy("node", "first").agg(F.min(F.struct("tail", "n")).alias("lo"), F.max("tail").alias("hi"), F.bit_or("bit").alias("mask"))
    shared = F.expr("size(filter(sequence(1, least(length(lo.tail), length(hi))), i -> substring(lo.tail, 1, i) = substring(hi, 1, i)))")
    forks = forks.withColumn("label", F.when(F.col("first") == "", F.lit(None)).when(F.col("lo.tail") == F.col("hi"), F.col("hi")).otherwise(F.substring("hi", F.lit(1), shared)))
    ends, child = F.col("label") == F.col("lo.tail"), F.concat("node", "label")
    return forks.select("node", "label", child.alias("child"), F.when(ends, F.substring(child, 2, 1 << 30)).alias("end"), F.when(ends, F.col("lo.n")).alias("end_n"), (F.col("lo.tail") == F.col("hi")).alias("leaf"), "mask")


def far_edges(words: DataFrame) -> DataFrame:
    """The same for long words, with forks at 32, 64, 128 ... letters only: an edge for each label below a node."""
    far = _both_ways(words, "F", "R").withColumn("bit", _bit(F.col("m"), F.substring("key", F.col("m") - 1, F.lit(2))))
    depths = F.expr("explode(transform(sequence(5, cast(ceil(log2(m)) as int) - 1), i -> cast(1 << i as int)))")
    far = far.select("way", "key", "n", "m", "bit", depths.alias("d")).where("d < m")
    to, last = F.least(F.col("d") * 2, "m"), F.col("d") * 2 >= F.col("m")
    far = far.select(_long_name(F.col("d")).alias("node"), F.substring("key", F.col("d") + 1, to - F.col("d")).alias("label"), _long_name(to).alias("child"), F.when(last, F.col("key")).alias("end"), F.when(last, F.col("n")).alias("end_n"), last.alias("leaf"), "bit")
    far = far.groupBy("node", "label", "child").agg(F.max("end").alias("end"), F.max("end_n").alias("end_n"), F.min("leaf").alias("leaf"), F.bit_or("bit").alias("mask"))
    return far


def _starts(words: DataFrame, long: bool) -> DataFrame:
    """Each word at the node of its first half, a reversed one of an odd number of letters one letter further; a long one at the node of its first 32 letters."""
    rows = _both_ways(words, *("FR" if long else "fr"))
    half = F.floor((F.col("m") + F.when(F.col("way") == "f", 0).otherwise(1)) / 2).cast("int")
    rows = rows.withColumn("pos", F.lit(32) if long else half)
    node = _long_name(F.lit(32)) if long else F.concat("way", F.substring("key", F.lit(1), F.col("pos")))
    return rows.select("key", "n", "pos", node.alias("node")).withColumns({"edits": F.lit(0), "depth": F.col("pos")})


def _cost(piece: Column, label: Column, move: Column) -> Column:
    """0 for equal strings, 1 for one inserted letter or one greater one, else 2."""
    one = F.when(move == 0, label > piece).otherwise(F.lit(True)) & (F.levenshtein(piece, label, 1) == 1)
    return F.when(piece == label, 0).when(one, 1).otherwise(2)


def _cost_of_long(piece: Column, label: Column, move: Column) -> Column:
    """The same for strings of any length, by their first difference."""
    @F.pandas_udf("int")
    def cost(pieces: pd.Series, labels: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(pieces, labels, strict=True):
            if a == b:
                out.append(0)
                continue
            x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
            unlike = np.flatnonzero(x != y[: len(x)]) if len(x) <= len(y) else np.zeros(1, int)
            k = int(unlike[0]) if len(unlike) else len(x)
            same = len(x) == len(y) and a[k + 1 :] == b[k + 1 :] and b > a
            out.append(1 if same or (len(y) == len(x) + 1 and a[k:] == b[k + 1 :]) else 2)
        return pd.Series(out, dtype="int32")

    return cost(piece, label)


def _advance(joined: DataFrame, cost_of) -> DataFrame:
    """States at the children of their edges, those that end a word with one edit, and those that go on from there.

    Near words find each other: of a pair the shorter one walks to the longer, of two of one length the one with the smaller letter (in the trie's direction) to the other. So a
    walk inserts a letter (``move`` -1) or takes a greater one for its own. After its edit it follows its own letters, so the word it can reach
    has the length ``depth + m - pos - move`` and, two letters or more before the end, the same last letters.
    """
    m, size = F.length("key"), F.length("label")
    left = m - F.col("pos") - size - F.col("move")  # letters behind the label
    ending = F.substring("key", m - 1, F.lit(2))
    own = F.substring("key", F.col("pos") + 1, size) == F.col("label")
    met = F.col("mask").bitwiseAND(_bit(F.col("depth") + m - F.col("pos") - F.col("move"), ending)) != 0
    kept = own & (F.col("move") == 0)
    can = (left >= 0) & ((kept & (F.col("edits") == 0)) | ((left < 2) | met) & (kept | (F.col("edits") == 0)))
    taken = joined.where((F.col("edits") == 0) | own).withColumn("move", F.explode(F.array(F.lit(-1), F.lit(0)))).where(can).withColumn("to", F.col("pos") + size + F.col("move"))
    piece = F.substring("key", F.col("pos") + 1, F.col("to") - F.col("pos"))
    taken = taken.withColumn("cost", cost_of(piece, F.col("label"), F.col("move"))).where("edits + cost <= 1").withColumn("edits", F.col("edits") + F.col("cost"))
    found = F.col("end").isNotNull() & (F.col("edits") == 1) & (F.col("to") == m)
    goes = ~F.col("leaf") & ((F.col("edits") == 0) | (F.col("to") < m))
    out = taken.select("key", "n", F.col("to").alias("pos"), F.col("child").alias("node"), "edits", F.when(found, F.col("end")).alias("end"), F.when(found, F.col("end_n")).alias("end_n"), goes.alias("goes"), F.substring("child", 1, 1).alias("way"), (F.col("depth") + size).alias("depth"))
    return out.where(F.col("goes") | F.col("end").isNotNull())


def _hot_nodes(states: DataFrame, total: int) -> list[str]:
    """Nodes with many of a level's states, by a sample of them; at most 2 ``HOT_NODES``."""
    if total <= HOT_STATES:
        return []
    share = min(1.0, SAMPLED / total)
    seen = states.sample(share, seed=7).groupBy("node").count()
    return [r["node"] for r in seen.where(F.col("count") > max(HOT_STATES, total // HOT_NODES) * share).orderBy(F.desc("count")).limit(2 * HOT_NODES).collect()]


def _walk(words: DataFrame, long: bool) -> list[DataFrame]:
    """The levels of a walk through both tries of short or of long words: states, and the pairs (key, end) found."""
    spark, n = words.sparkSession, words.count()
    if not n:
        return []
    letters = words.agg(F.sum(F.least(F.length("word"), F.lit(LONG)))).first()[0]  # no fewer than half the edges
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * letters // EDGES_A_BUCKET))
    edges = (far_edges(words) if long else trie_edges(words)).repartition(parts, "node")
    fork = F.lit(True) if long else F.count(F.lit(1)).over(Window.partitionBy("node")) > 1
    name = f"trie_{uuid.uuid4().hex}"
    edges.withColumn("fork", fork).where("label is not null").write.bucketBy(parts, "node").option("path", shared_folder(spark, "trie")).saveAsTable(name)
    trie, levels = spark.table(name), []
    now, total = _starts(words, long), 2 * n
    while total:
        edges = trie if not levels else trie.where("fork")
        hot = [] if long else _hot_nodes(now, total)
        joined = now.where(~F.col("node").isin(hot)).join(edges.hint("shuffle_hash"), "node")
        if hot:
            joined = joined.unionByName(now.where(F.col("node").isin(hot)).join(F.broadcast(edges.where(F.col("node").isin(hot))), "node"))
        levels.append(stored(_advance(joined, _cost_of_long if long else _cost), "frontier"))
        now = levels[-1].where("goes").select("key", "n", "pos", "node", "edits", "depth")
        total = now.count()
    spark.sql(f"DROP TABLE {name}")  # the files stay until the scratch folders go
    return levels


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words at a distance of exactly one edit, in both directions, each once; ``words`` has word and n."""
    levels = _walk(words.where(F.length("word") <= LONG), False) + _walk(words.where(F.length("word") >= LONG), True)
    turned = lambda c: F.when(F.col("way").isin("f", "F"), F.col(c)).otherwise(F.reverse(c))
    pair = lambda a, b, n: F.struct(turned(a).alias("word"), turned(b).alias("near"), F.col(n).alias("near_n"))
    both = F.explode(F.array(pair("key", "end", "end_n"), pair("end", "key", "n")))
    pairs = [level.where("end is not null").select(both.alias("p")).select("p.*") for level in levels]
    if not pairs:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    return reduce(DataFrame.unionByName, pairs).distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    ``form`` is the near word with the largest n (ties: the smallest in code-point order) if that is at least ``RATIO`` times the word's, else null; ``root`` the
    last word that forms lead to. A form is at least ``RATIO`` times as frequent, so no chain is longer than the logarithm of the largest n.
    """
    words = stored(spelled_words(docs, id_col, text_col), "words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    often = -F.col("best.minus") >= RATIO * F.col("n")
    out = words.join(best, "word", "left").select("word", F.when(often, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, -F.col("best.minus")).alias("form_n"))
    out = stored(out, "forms")
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    most = out.agg(F.max("form_n")).first()[0] or 1
    chain = max(1, math.floor(math.log(most / OFTEN, RATIO) + 1e-9)) if most > 1 else 1
    for _ in range(math.ceil(math.log2(chain)) if chain > 1 else 0):
        roots = stored(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
