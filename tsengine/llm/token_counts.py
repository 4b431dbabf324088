"""Token counts (operator 8): a two-tier lookup on the map side, without a shuffle of the texts' pre-tokens.

Texts are cut into chunks at places where the byte-level pre-tokenizer always cuts: before a run
of non-space characters with the one space in front of it; a chunk holds one pre-token or a few. Tier one is a compact broadcast table
with the token counts of the chunks that are frequent in a bounded sample (counted by a grouping of that sample's partial
counts, the only shuffle); it only saves time and never decides a result. Tier two is a bounded cache in each worker, filled by encoding the chunks
that were missing, all of a batch in one call. Every whole text is counted.

Nulls count as empty: 0 bytes, 0 tokens, ``over_limit`` false. Repeated rows and ids are counted
each. A long text is counted in slices, cut before such a space. An empty table gives an empty result. Only the id and text columns are read; others, with
whatever names, are left out.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Unicode white space, as the pre-tokenizer's pattern understands it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A single space between other characters, where a long text may be cut; a chunk begins there.
CUT = re.compile(f"[^{SPACE}] (?=[^{SPACE}])")
#: Chunks kept by a worker process, for all its tasks, before its cache starts anew; the rows sampled for tier one, its size.
CACHE, SAMPLE_ROWS, FREQUENT = 700_000, 2_000, 30_000
_counters: dict[str, Counts] = {}


class Counts:
    """Token counts of whole texts, by the library's own encoding of chunks."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.sentences = path.endswith(".model")
        if self.sentences:
            import sentencepiece

            self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.frequent = frequent or {}
        self.cache = dict(self.frequent)

    @classmethod
    def of(cls, path: str, frequent: dict[str, int]) -> Counts:
        """The one of this worker process."""
        if path not in _counters:
            _counters[path] = cls(path, frequent)
        return _counters[path]

    def whole(self, text: str) -> int:
        return len(self.encoder.encode(text, add_special_tokens=False).ids)

    def count(self, texts: list[str]) -> list[int]:
        if self.sentences:
            return [len(x) for x in self.encoder.encode(texts, num_threads=1)] if texts else []
        out = []
        for text in texts:
            if self.special and self.special.search(text):
                out.append(self.whole(text))
            else:
                out.append(sum(map(self._sliced, slices(text, CUT))))
        return out

    def _sliced(self, text: str) -> int:
        chunks = CHUNK.findall(text)
        try:
            return sum(map(self.cache.__getitem__, chunks))
        except KeyError:
            if len(self.cache) > CACHE:
                self.cache = dict(self.frequent)
            missing = list({c for c in chunks if c not in self.cache})
            got = self.encoder.encode_batch_fast(missing, add_special_tokens=False)
            self.cache.update(zip(missing, map(len, got), strict=True))
            return sum(map(self.cache.__getitem__, chunks))


def frequent_chunks(docs: DataFrame, path: str, text: str, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> dict[str, int]:
    """Tier one: token counts of the most frequent chunks of about ``rows`` sampled texts, at most ``most``."""
    total = docs.count()
    if not total or path.endswith(".model"):
        return {}

    def partial(batches):
        seen = Counter()
        for pdf in batches:
            seen.update(chain.from_iterable(CHUNK.findall(t) for t in pdf["t"] if isinstance(t, str)))
        top = [(c, n) for c, n in seen.most_common(2 * most) if n > 1 and len(c) <= 40]
        yield pd.DataFrame(top, columns=["chunk", "n"])

    part = docs.select(F.col(text).alias("t")).sample(min(1.0, rows / total), seed=5).mapInPandas(partial, "chunk string, n long")
    top = part.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(most)
    names = [r["chunk"] for r in top.select("chunk").collect()]
    counts = Counts(path)
    return dict(zip(names, map(len, counts.encoder.encode_batch_fast(names, add_special_tokens=False)), strict=True))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", tier_one: bool = True) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text. ``tokenizer``: path of a .json or .model file."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_chunks(docs, tokenizer, text_col) if tier_one else {})
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counts = Counts.of(tokenizer, frequent.value)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["t"]]
            n = pd.Series(counts.count(texts), dtype="int64")
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": pd.Series([len(t.encode()) for t in texts], dtype="int64"), "n_tokens": n, "over_limit": n > limit})

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
