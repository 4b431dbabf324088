"""Secret scans (operator 5): fixed patterns, and formats learned by grammar inference.

The fixed patterns give the base spans and, from all documents, labelled
credentials: the values of assignments, the access keys and the long hex runs. For each kind a
probabilistic automaton is inferred by merging compatible states of the prefix tree of its examples; one more
is inferred from other candidates. A candidate is any run of
``[A-Za-z0-9+/_.=-]`` of ``MIN_CANDIDATE`` characters or more with letters and digits that no base span overlaps; of a run that one
overlaps, the parts between dots are judged alike. All candidates are
scored: one whose best format likelihood a symbol beats the background's by a margin and is no less than a floor below the
mean of that format's own examples is added as a span of kind ``format``. Both bounds are set on examples that
the automata don't see (one of ``FOLDS``): the floor lets ``RECALL`` of the format's own pass, the margin stands between those and the other
candidates, ``MARGIN`` at least where the examples pass it. With fewer than ``ENOUGH`` such examples they are ``FLOOR`` and ``MARGIN``.

The automata read characters by class and, at the end, the length; lengths beyond 128 share one symbol.

Spans are in code points, end exclusive. Every whole text is scanned where it lies, without a shuffle, once to learn and once to mark. The examples of a kind are
the ``EXAMPLES`` strings of all documents with the smallest hashes, each whole; a kind with fewer than 5 different strings in the table is
not learned.
Null texts count as empty and have no span; repeated rows are scanned each; an empty table, or one without credentials, yields
base spans only. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from itertools import accumulate
from statistics import fmean

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grammar import Automaton, symbols_of

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # the maximal runs of 16 or more
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "format")

KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
MIN_CANDIDATE, MARGIN, FLOOR = LEAST["assign"], 0.35, 0.6
CANDIDATE = re.compile(f"[A-Za-z0-9+/_.=-]{{{MIN_CANDIDATE},}}")
PART = re.compile(f"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}")
EXAMPLES, SALTS, FOLDS, ENOUGH, RECALL = 400, 8, 5, 5, 0.98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns, sorted."""
    lower, out = text.encode("utf-8", "replace").lower(), []
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be credentials and touch no base span (``base`` is sorted)."""
    starts, reach = [a for a, _, _ in base], [0, *accumulate((b for _, _, b in base), max)]
    free = lambda m: reach[bisect_left(starts, m.end())] <= m.start()  # noqa: E731 - how far the spans that begin before its end go
    out = []
    for run in CANDIDATE.finditer(text):
        for m in [run] if free(run) else filter(free, PART.finditer(text, *run.span())):
            s = m[0]
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
                out.append(m.span())
    return out


def value_of(text: str, span: tuple[int, int, int]) -> str:
    """The credential of a base span: of an assignment its value, else all of it."""
    start, kind, end = span
    return ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


def _fold(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % FOLDS


class Formats:
    """One automaton a kind of credential and one for other candidates, with bounds set on examples they don't see."""

    def __init__(self, examples: dict[str, list[str]]):
        self.kinds = {}
        others = examples.get("other", [])
        seen = [s for s in others if _fold(s)] or others
        self.other = Automaton([symbols_of(s) for s in seen] or [symbols_of(c * 16) for c in "a0x"])
        for kind, strings in examples.items():
            if kind == "other" or len(strings) < 5:
                continue
            fixed = "AKIA" if kind == "access" else ""
            coded = [symbols_of(s, fixed) for s in strings if _fold(s)] or [symbols_of(s, fixed) for s in strings]
            model = Automaton(coded)
            mean = fmean(map(model.score, coded))
            gain = lambda s, model=model, fixed=fixed: model.score(symbols_of(s, fixed)) - self.other.score(symbols_of(s))
            own = [s for s in strings if not _fold(s)]
            floor, margin = FLOOR, MARGIN
            if len(own) >= ENOUGH:
                least = lambda values: sorted(values)[int((1 - RECALL) * len(own))]
                floor = mean - least(model.score(symbols_of(s, fixed)) for s in own) + 0.05
                gains, most = least(map(gain, own)), max(map(gain, others), default=0.0)
                margin = min(gains, max(MARGIN, (gains + most) / 2))
            self.kinds[kind] = (fixed, model, mean, floor, margin)

    def is_secret(self, s: str) -> bool:
        plain = self.other.score(symbols_of(s))
        for fixed, model, mean, floor, margin in self.kinds.values():
            score = model.score(symbols_of(s, fixed))
            if score >= mean - floor and score - plain >= margin > 0:
                return True
        return False


def learn_formats(docs: DataFrame, text_col: str = "text", examples: int = EXAMPLES) -> Formats:
    """Infer the automata from a bounded number of strings a kind, out of all documents."""
    def run(batches):
        least: dict[str, dict[str, str]] = {}  # of each kind the strings with the smallest hashes so far
        for pdf in batches:
            for t in pdf["t"]:
                base = base_spans(t)
                for kind, s in [*((KINDS[b[1]], value_of(t, b)) for b in base), *(("other", t[a:b]) for a, b in candidates(t, base))]:
                    least.setdefault(kind, {})[s] = hashlib.md5(s.encode("utf-8", "replace")).hexdigest()
                    if len(least[kind]) >= 4 * examples:
                        least[kind] = dict(sorted(least[kind].items(), key=lambda x: (x[1], x[0]))[:examples])
        rows = [(kind, s) for kind, found in least.items() for s, _ in sorted(found.items(), key=lambda x: (x[1], x[0]))[:examples]]
        yield pd.DataFrame(rows, columns=["kind", "s"])

    found = docs.select(F.col(text_col).alias("t")).where("t is not null").mapInPandas(run, "kind string, s string").distinct()
    # a kind is dealt over SALTS; of each share the first by hash come to the driver, which keeps the first of all
    by_hash = Window.partitionBy("kind", F.pmod(F.xxhash64("s"), F.lit(SALTS))).orderBy("h", "s")
    found = found.withColumn("h", F.md5("s")).withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= examples).toPandas().sort_values(["kind", "h", "s"])
    return Formats({k: g["s"].tolist()[:examples] for k, g in found.groupby("kind")})


def find_secrets(docs: DataFrame, formats: Formats | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>), base spans and those of the learned formats, by start and kind."""
    sent = docs.sparkSession.sparkContext.broadcast(formats if formats is not None else learn_formats(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known: dict[str, bool] = {}
        for pdf in batches:
            rows = []
            for t in pdf["t"]:
                t = t if isinstance(t, str) else ""
                spans = base_spans(t)
                added = []
                for a, b in candidates(t, spans):
                    s = t[a:b]
                    if s not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[s] = sent.value.is_secret(s)
                    if known[s]:
                        added.append((a, 3, b))
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans + added)])
            yield pd.DataFrame({"id": pdf["id"], "spans": rows})

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def secrets_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of base spans, and all spans as text."""
    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "format")
    return found.select(F.col(id_col), *[count(k) for k in LEAST], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
