"""Chat formatting (operator 1): roles by a hidden Markov model and Viterbi, then canonical turns.

Input rows are pieces of transcripts: a conversation, the piece's number in it, and text of one or more lines. Each
line is an observation: the speaker marker it opens with (if any), whether it opens a piece, its length class, the piece's number of lines (for the
line that opens it), whether it asks, and whether it is an item of a list, a heading or code. States are the roles. A line that neither opens a piece nor has a marker nearly always keeps the role
of the line before it; the others follow the transitions between turns. Emissions and transitions are
counted from labelled pieces, over all of them but one fold, on top of fixed prior counts, so unlabelled input works too.

Conversations are decoded exactly whatever their length and numbers. Pieces are sorted by conversation and number over range
partitions; in each, neighbours form blocks of at most ``BLOCK`` pieces and ``BLOCK_CHARS`` characters. A block's best score from each state before
it to each state at its end is a small matrix. The matrices of a conversation's blocks are combined within a partition, those products
over partitions, and the states at the borders come down the same two levels. What one group holds is a
block's pieces, a partition's matrices, or one matrix a partition, also for a conversation with a third of all rows.

A null or empty text is one empty line. A row without conversation or number stands alone. Numbers may be negative, repeat or have gaps.
Rows with equal numbers follow each other in the order of a hash of their text; repeated rows are pieces each. An
empty table gives an empty result. A missing or unknown role is no label. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ROLES = ("system", "user", "assistant")
BLOCK, BLOCK_CHARS = 64, 4_000_000
LENGTHS = (20, 60, 120, 240, 480, 960)  # bounds of the length classes of a line
# Speaker markers of common transcript styles.
MARKERS = {
    "system": ("system", "instructions?", "context"),
    "user": ("user", "human", "you", "customer", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "model", "agent", "answer", "a", "gpt"),
}
OPEN = "^[\\s#*>]*[<\\[(|]*\\s*(?i:{})\\s*[|>\\])]*\\*{{0,2}}\\s*(?:[:>]|(?<=[|>\\])])\\s*$)\\*{{0,2}}[ \\t]*"
SHAPE = "^\\s*(?:[-*•]\\s|\\d{1,3}[.)]\\s|#{1,6}\\s|```|\\||    )"
N_LENGTHS, N_SIZES = len(LENGTHS) + 1, 4
N_OBS = 4 * 2 * N_LENGTHS * N_SIZES * 2 * 2


def opening(role: str, inside: bool = False) -> str:
    """The pattern of a role's markers. Inside a piece neither single letters nor what stands in a quote or heading count."""
    words = [w for w in MARKERS[role] if not inside or len(w) > 1]
    return (OPEN.replace("[\\s#*>]*", "[\\s*]*") if inside else OPEN).format("|".join(words))


def marker(line: Column, place: Column) -> Column:
    """0 without a marker, else the place of its role in ROLES plus 1; ``place``: the line's in its piece."""
    def first(inside: bool) -> Column:
        out = F.lit(0)
        for k, role in reversed(list(enumerate(ROLES, 1))):
            out = F.when(line.rlike(opening(role, inside)), k).otherwise(out)
        return out

    return F.when(place == 0, first(False)).otherwise(first(True))


def observation(line: Column, place: Column, lines: Column) -> Column:
    size = F.length(line)
    length = sum(((size >= n).cast("int") for n in LENGTHS), F.lit(0))
    many = F.when(place > 0, 0).when(lines == 1, 1).when(lines <= 3, 2).otherwise(3)
    ask = F.rtrim(line).endswith("?").cast("int")
    shape = line.rlike(SHAPE).cast("int")
    return ((((marker(line, place) * 2 + (place == 0).cast("int")) * N_LENGTHS + length) * N_SIZES + many) * 2 + ask) * 2 + shape


def _fields(obs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marker, opens a piece or has a marker) of observations."""
    of_marker = N_OBS // 4
    mark, first = obs // of_marker, obs // (of_marker // 2) % 2
    return mark, (first == 1) | (mark > 0)


@dataclass
class RoleModel:
    """Log scores; state 0 stands before the first line, states 1.. are ROLES. Within a piece roles nearly always stay."""

    emit: np.ndarray  # N_OBS x 4
    turn: np.ndarray  # 4 x 4
    stay: np.ndarray  # 4 x 4

    @classmethod
    def of(cls, emissions: dict[tuple[int, int], int], turns: dict[tuple[int, int], int]) -> RoleModel:
        obs = np.arange(N_OBS)
        mark, _ = _fields(obs)
        e = np.ones((N_OBS, 4)) * 0.02
        for state in (1, 2, 3):
            e[mark == state, state] += 1.0
            e[mark == 0, state] += 0.1
        for (state, o), n in emissions.items():
            e[o, state] += n
        e[:, 0] = 0
        prior = np.array([[0, 3, 6, 1], [0, 0.5, 8, 1], [0, 0.2, 1, 8], [0, 0.2, 8, 1]], float)
        for (a, b), n in turns.items():
            prior[a, b] += n
        stay = np.eye(4) * 0.98 + 0.005
        stay[:, 0] = 0
        stay[0] = prior[0]
        with np.errstate(divide="ignore"):
            return cls(np.log(e / np.maximum(e.sum(0), 1e-300)), np.log(prior / prior.sum(1, keepdims=True)), np.log(stay / stay.sum(1, keepdims=True)))

    def steps(self, obs: np.ndarray) -> np.ndarray:
        """len(obs) x 4 x 4: the score of each step from state to state, with what the line shows."""
        opens = _fields(obs)[1]
        return np.where(opens[:, None, None], self.turn, self.stay) + self.emit[obs][:, None, :]


def product(steps: np.ndarray) -> np.ndarray:
    """The best score from each state before to each state at the end of a row of steps."""
    total = steps[0]
    for step in steps[1:]:
        total = (total[:, :, None] + step[None]).max(1)
    return total


def viterbi(steps: np.ndarray, before: int = 0, last: int | None = None) -> np.ndarray:
    """The best states of a row of steps; of equal ones the smallest at the end of each step."""
    score, back = np.full(4, -np.inf), []
    score[before] = 0
    for step in steps:
        all_ = score[:, None] + step
        back.append(all_.argmax(0))
        score = all_.max(0)
    states = [int(score.argmax()) if last is None else last]
    for b in back[:0:-1]:
        states.append(int(b[states[-1]]))
    return np.array(states[::-1], np.int64)


def fit_roles(pieces: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", held_out_fold: bool = True) -> RoleModel:
    """Counts over all labelled pieces (without the held-out fold); what comes to the driver is a table of fixed size.

    A transition is counted between pieces with numbers t and t + 1; a piece with no labelled one right before it counts as the start of a conversation.
    """
    state = F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.col(role_col))).cast("int")
    rows = pieces.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), state.alias("s"), _observed(F.col(text_col)).alias("o")).where("s > 0")
    rows = rows.where(F.crc32(F.coalesce(F.col("c").cast("string"), F.lit("")).cast("binary")) % 5 != 0) if held_out_fold else rows
    emissions = rows.select("s", F.explode("o").alias("o")).groupBy("s", "o").count().collect()
    one = rows.groupBy("c", "t").agg(F.min("s").alias("s"))
    nxt = one.select("c", (F.col("t") - 1).alias("t"), F.col("s").alias("n"))
    firsts = one.join(one.select("c", (F.col("t") + 1).alias("t")), ["c", "t"], "left_anti").groupBy("s").count().collect()
    turns = one.join(nxt, ["c", "t"]).groupBy("s", "n").count().collect()
    return RoleModel.of({(r["s"], r["o"]): r["count"] for r in emissions}, {**{(r["s"], r["n"]): r["count"] for r in turns}, **{(0, r["s"]): r["count"] for r in firsts}})


def _observed(text: Column) -> Column:
    return F.element_at(F.transform(F.array(F.split(F.coalesce(text, F.lit("")), "\n")), lambda lines: F.transform(lines, lambda line, k: observation(line, k, F.size(lines)))), 1)


def format_chats(pieces: DataFrame, model: RoleModel, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conversation, number, role, n_segments, rendered, markers) of every piece, in canonical turns.

    ``rendered`` is ``<|role|>``, a line end, the text and ``<|end|>`` with a line end, for each run of lines of one role; ``<|`` in a text is escaped, so ``parse_turns``
    reads exactly the turns back. A speaker marker is taken off only where a turn begins and has the marker's role; it stands in ``markers`` (one for each turn, mostly empty), so marker and
    text of all turns, joined by line ends, are the piece.
    """
    spark = pieces.sparkSession
    sent = spark.sparkContext.broadcast(model)
    rows = pieces.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), F.col(text_col).alias("x"))
    rows = rows.withColumns({"h": F.xxhash64("x"), "tie": F.monotonically_increasing_id(), "o": _observed(F.col("x"))})
    order, parts = ["c", "t", "h", "tie"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = pieces.schema[conv_col].dataType.simpleString()
    blocks = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    blocks = blocks.mapInPandas(lambda batches: _blocks(batches, sent.value), f"part int, block long, c {kind}, alone boolean, t array<long>, x array<string>, o array<array<int>>, m array<double>")
    blocks = stored(blocks, "blocks")
    borders = _borders(blocks.where("not alone").select("c", "part", "block", "m"), sent)
    ready = blocks.drop("m").join(borders, ["part", "block"], "left").withColumns({"before": F.coalesce("before", F.lit(0)), "last": F.coalesce("last", F.lit(-1))})

    @F.pandas_udf("array<struct<role:string,n_segments:int,rendered:string,markers:array<string>>>")
    def decode(observed: pd.Series, texts: pd.Series, before: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([_render(o, x, sent.value, b, e) for o, x, b, e in zip(observed, texts, before, last, strict=True)])

    out = ready.withColumn("done", decode("o", "x", "before", "last")).select("c", F.explode(F.arrays_zip("t", "done")).alias("r"))
    return out.select(F.col("c").alias(conv_col), F.col("r.t").alias(turn_col), F.col("r.done.role").alias("role"), F.col("r.done.n_segments").alias("n_segments"), F.col("r.done.rendered").alias("rendered"), F.col("r.done.markers").alias("markers"))


def escaped(text: str) -> str:
    """``<|`` becomes ``<\\|``, and what looks like that already gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def parse_turns(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendering."""
    turns = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", rendered, re.DOTALL)
    return [(role, re.sub(r"<(\\*)\\\|", r"<\1|", text)) for role, text in turns]


def _blocks(batches, model: RoleModel):
    """Blocks of a sorted partition: neighbours of one conversation, at most BLOCK pieces and, beyond the first, BLOCK_CHARS characters."""
    def row(part, number, c, alone, items):
        m = product(model.steps(np.concatenate([np.asarray(o, np.int64) for _, _, o in items]))).ravel()
        return part, number, c, alone, [t for t, _, _ in items], [x for _, x, _ in items], [o for _, _, o in items], m

    names = ["part", "block", "c", "alone", "t", "x", "o", "m"]
    open_, chars, number, at = [], 0, 0, None
    for pdf in batches:
        done = []
        turns = pdf["t"].astype("Int64").to_numpy(object, na_value=None)
        for part, c, t, x, o in zip(pdf["part"], pdf["c"].astype(object).where(pdf["c"].notna(), None), turns, pdf["x"], pdf["o"], strict=True):
            alone = c is None or t is None
            chars += len(x or "")
            if open_ and (alone or at[2:] != (c, False) or len(open_) == BLOCK or chars > BLOCK_CHARS):
                done.append(row(at[0], number, *at[2:], open_))
                number, open_, chars = number + 1, [], len(x or "")
            at = (part, None, c, alone)
            open_.append((t, x, o))
        yield pd.DataFrame(done, columns=names)
    if open_:
        yield pd.DataFrame([row(at[0], number, *at[2:], open_)], columns=names)


def _render(observed, texts, model: RoleModel, before: int, last: int) -> list[dict]:
    obs = np.concatenate([np.asarray(o, np.int64) for o in observed])
    states = viterbi(model.steps(obs), int(before), None if last < 0 else int(last)).tolist()
    mark, at, out = _fields(obs)[0], 0, []
    for text in texts:
        segments: list[tuple[int, str, list[str]]] = []  # state, marker, lines
        for k, line in enumerate((text or "").split("\n")):
            state = states[at + k]
            if segments and segments[-1][0] == state:
                segments[-1][2].append(line)
                continue
            said = re.match(opening(ROLES[state - 1], k > 0), line) if mark[at + k] == state else None
            segments.append((state, said[0] if said else "", [line[said.end() if said else 0 :]]))
        at += k + 1
        rendered = "".join(f"<|{ROLES[s - 1]}|>\n{escaped(chr(10).join(x))}<|end|>\n" for s, _, x in segments)
        out.append({"role": ROLES[segments[0][0] - 1], "n_segments": len(segments), "rendered": rendered, "markers": [m for _, m, _ in segments]})
    return out


def _borders(blocks: DataFrame, sent) -> DataFrame:
    """(part, block, before, last) for conversations of more than one block: the states before and at the end of each on the best path."""
    square = lambda parts: np.stack([np.asarray(p, float).reshape(4, 4) for p in parts])

    @F.pandas_udf("array<double>")
    def combined(parts: pd.Series) -> pd.Series:
        return pd.Series([product(square(rows)).ravel() for rows in parts])

    @F.pandas_udf("array<int>")
    def path(parts: pd.Series, before: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([viterbi(square(rows), int(b), None if e < 0 else int(e)) for rows, b, e in zip(parts, before, last, strict=True)])

    def down(level: DataFrame, key: str) -> DataFrame:
        """A row for each part of a level, with the states before and at its end."""
        states = level.withColumn("states", path(F.transform("parts", lambda p: p["m"]), "before", "last"))
        before = F.concat(F.array("before"), F.slice("states", 1, F.greatest(F.size("states") - 1, F.lit(0))))
        pairs = F.arrays_zip(F.transform("parts", lambda p: p[key]).alias(key), before.alias("before"), F.col("states").alias("last"))
        return states.select(*[x for x in ("c", "part") if x in level.columns], F.explode(pairs).alias("p")).select("*", f"p.{key}", "p.before", "p.last").drop("p")

    inside = stored(blocks.groupBy("c", "part").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("parts")), "level")
    over = inside.select("c", "part", combined(F.transform("parts", lambda p: p["m"])).alias("m"), F.size("parts").alias("n"))
    over = over.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "m"))).alias("parts"), F.sum("n").alias("n")).where("n > 1")
    over = stored(down(over.drop("n").withColumns({"before": F.lit(0), "last": F.lit(-1)}), "part"), "level")
    return down(inside.join(over, ["c", "part"]), "block").select("part", "block", "before", "last")
