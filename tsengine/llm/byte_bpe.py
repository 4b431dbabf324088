"""Byte-level BPE (operator 11): encoding in overlapping chunks, decoding by concatenation of raw bytes.

A text of more than ``CHUNK`` characters is cut into chunks that overlap by ``OVERLAP``. All chunks of all texts are split into pre-tokens in
parallel, each from its own first character, which need not begin a pre-token. Splitting goes from left to right and looks ahead by at most
``AHEAD`` characters, so once two neighbours have a boundary in common within their overlap, they agree from there on: the first such place is the cut
between them, and by induction from the first chunk all cuts are boundaries of the whole text. (Behind white space no cut is made: what follows it decides where it is split.) The pieces between the cuts are encoded in parallel. Texts in which
some pair of chunks has no common boundary (a run of letters longer than the overlap) are cut anew with chunks and overlaps four times as large, until one
chunk holds them. Shorter texts are one chunk, encoded where they are read.

A pre-token is looked up in a bounded cache of the worker, the missing ones are encoded by the library's merges. The library's
Unicode tables are its own: characters that the pattern's engine here takes for letters or numbers and the library's does not are replaced by a symbol while the text is split.

Encoded texts are rows (row, id, piece, pieces, ids): ids as little-endian unsigned 32-bit integers, pieces from 0. A piece has the length of a chunk, but for
long runs, so no text's ids stand in one row. Decoding maps each piece to its bytes; texts with several pieces are digested in order, a piece at a time.

A null text is empty and has one piece without ids. Null and repeated ids and repeated rows are texts each. An empty table gives an empty result. Only the
id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored

#: Characters of a chunk and of its overlap with the next; characters that decide a boundary lie no farther behind it than this.
CHUNK, OVERLAP, AHEAD = 1 << 16, 1 << 10, 4
#: Pre-tokens kept by a worker process, for all its tasks, before its cache starts anew; chunks in a file of the shared folder.
CACHE, CHUNKS_A_FILE = 700_000, 256
_coders: dict[tuple[str, str], Coder] = {}


class Coder:
    """Splits, encodes and decodes by the ranks of a file and the pattern of its pre-tokens."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.parts = regex.compile(pattern)
        self.bytes_of = {v: k for k, v in table.items()}
        self.cache: dict[str, bytes] = {}
        letters = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([b]): b for b in range(256)}
        self.unlike: dict[int, str] = {}
        for kind in (r"\p{L}", r"\p{N}"):
            probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
            known = set(probe.decode_bytes(probe.encode_ordinary(letters)).decode())
            self.unlike.update((ord(c), "§") for c in regex.findall(kind, letters) if c not in known)
        self.odd = regex.compile(f"[{chr(min(self.unlike, default=0x10FFFF))}-\U0010ffff]")

    @classmethod
    def of(cls, ranks: str, pattern: str) -> Coder:
        """The one of this worker process."""
        if (ranks, pattern) not in _coders:
            _coders[ranks, pattern] = cls(ranks, pattern)
        return _coders[ranks, pattern]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, from its first character on; together they are the text."""
        if self.unlike and self.odd.search(text):
            same = text.translate(self.unlike)
            if same != text:
                out, at = [], 0
                for part in self.parts.findall(same):
                    out.append(text[at : at + len(part)])
                    at += len(part)
                return out
        return self.parts.findall(text)

    def encode(self, text: str) -> bytes:
        parts = self.split(text)
        try:
            return b"".join(map(self.cache.__getitem__, parts))
        except KeyError:
            if len(self.cache) > CACHE:
                self.cache = {}
            for part in {p for p in parts if p not in self.cache}:
                self.cache[part] = np.array(self.library.encode_ordinary(part), "<u4").tobytes()
            return b"".join(map(self.cache.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _rows(batches, *columns: int):
    """Values of a row at a time, so a batch of long texts is never decoded at once."""
    for batch in batches:
        cols = [batch.column(c) for c in columns]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in cols)


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _in_batches(rows, names: list[str], types: list[pa.DataType], weight, most: int = 4 << 20, least: int = 2048):
    """Batches of at most about ``most`` units of weight and ``least`` rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= most or len(held) >= least:
            yield _batch(names, types, held)
            held, size = [], 0
    if held:
        yield _batch(names, types, held)


def _chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(row, k, last, text): overlapping chunks of (row, text), stored in files of a few chunks."""

    def run(batches):
        def each():
            for row, text in _rows(batches, 0, 1):
                n = max(1, -(-max(0, len(text) - overlap) // size))
                for k in range(n):
                    yield row, k, k == n - 1, text[k * size :] if k == n - 1 else text[k * size : (k + 1) * size + overlap]

        yield from _in_batches(each(), ["row", "k", "last", "text"], [pa.string(), pa.int64(), pa.bool_(), pa.string()], lambda r: len(r[3]))

    spark, path = texts.sparkSession, shared_folder(texts.sparkSession, "chunks")
    chunks = texts.select("row", "text").mapInArrow(run, "row string, k long, last boolean, text string")
    chunks.write.option("maxRecordsPerFile", CHUNKS_A_FILE).parquet(path)
    return spark.read.schema(chunks.schema).parquet(path)


def _cuts(chunks: DataFrame, ranks: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """(row, k, begin, end, good): where each chunk's piece begins and ends in it; ``good``: the chunk has a boundary in common with the next one."""

    def run(batches):
        coder = Coder.of(ranks, pattern)

        def each():
            for row, k, last, text in _rows(batches, 0, 1, 2, 3):
                ends = np.cumsum([0, *map(len, coder.split(text))])
                sure = ends[ends <= len(text) - AHEAD]
                tail = [] if last else [e - size for e in sure[sure >= size].tolist() if not text[e - 1].isspace()]
                yield row, k, last, (sure[sure <= overlap] if k else sure[:0]).tolist(), tail

        numbers = pa.list_(pa.int64())
        yield from _in_batches(each(), ["row", "k", "last", "head", "tail"], [pa.string(), pa.int64(), pa.bool_(), numbers, numbers], lambda r: 1)

    marks = chunks.mapInArrow(run, "row string, k long, last boolean, head array<long>, tail array<long>")
    order = Window.partitionBy("row").orderBy("k")
    marks = marks.withColumn("end", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    return marks.select("row", "k", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("begin"), (F.col("end") + size).alias("end"), (F.col("last") | F.col("end").isNotNull()).alias("good"))


def _pieces(docs: DataFrame, ranks: str, pattern: str, size: int, overlap: int) -> DataFrame | None:
    """(row, id, piece, pieces, text): the pieces of long texts (row, id, text), cut at boundaries."""
    out, ids, texts = None, docs.select("row", "id"), docs.select("row", "text")
    while True:
        chunks = _chunks(texts, size, overlap)
        cuts = stored(_cuts(chunks, ranks, pattern, size, overlap), "cuts")
        bad = cuts.where(~F.col("good")).select("row").distinct()
        again = not bad.isEmpty()
        right = cuts.join(bad, "row", "left_anti") if again else cuts
        piece = F.substring("text", F.col("begin").cast("int") + 1, F.coalesce(F.col("end") - F.col("begin"), F.lit((1 << 31) - 1)).cast("int"))
        found = chunks.join(right, ["row", "k"]).select("row", F.col("k").alias("piece"), piece.alias("text"))
        found = found.join(right.groupBy("row").agg(F.count(F.lit(1)).alias("pieces")), "row")
        out = found if out is None else out.unionByName(found)
        if not again:
            return out.join(ids, "row").select("row", "id", "piece", "pieces", "text")
        texts, size, overlap = stored(texts.join(bad, "row", "left_semi"), "again"), size * 4, overlap * 4


def _texts(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk, and longer ones with a fresh name for each row, stored."""
    all_ = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    few = F.length("text") <= size + overlap
    name = F.concat_ws("-", F.lit(uuid.uuid4().hex), F.spark_partition_id(), F.monotonically_increasing_id())
    return all_.where(few), stored(all_.where(~few).withColumn("row", name), "long-texts")


def _encoded(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``rows`` (row, id, piece, pieces, text) with ``ids`` in place of the text."""
    fields = rows.drop("text").schema.simpleString()[7:-1].replace(":", " ")

    def run(batches):
        coder = Coder.of(ranks, pattern)
        for batch in batches:
            ids = pa.array([coder.encode(t.as_py()) for t in batch.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ids], ["row", "id", "piece", "pieces", "ids"])

    return rows.select("row", "id", "piece", "pieces", "text").mapInArrow(run, f"{fields}, ids binary")


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, id, piece, pieces, ids) of every whole text; ``row`` names the texts of several pieces."""
    short, long_ = _texts(docs, id_col, text_col, size, overlap)
    short = short.select(F.lit(None).cast("string").alias("row"), "id", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces"), "text")
    return _encoded(short, ranks, pattern).unionByName(_encoded(_pieces(long_, ranks, pattern, size, overlap), ranks, pattern)).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` with ``bytes`` in place of ``ids``: the raw bytes of the ids, one after the other."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.drop("ids").schema)

    def run(batches):
        coder = Coder.of(ranks, pattern)
        for batch in batches:
            raw = pa.array([coder.decode(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], [*batch.schema.names[:-1], "bytes"])

    return encoded.select(*encoded.drop("ids").columns, "ids").mapInArrow(run, f"{fields}, bytes binary")


def bpe_digest(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text; texts of one piece are digested where they are encoded."""
    short, long_ = _texts(docs, id_col, text_col, size, overlap)
    kind = docs.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names, types = ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]

    def at_once(batches):
        coder = Coder.of(ranks, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = coder.encode(text.as_py())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], ["id", *names])

    def in_order(batches):
        coder, now, n, hashes = Coder.of(ranks, pattern), None, 0, None
        for batch in batches:
            for k in range(batch.num_rows):
                row, ids = batch.column(0)[k].as_py(), batch.column(4)[k].as_py()
                if row != now:
                    now, n, hashes = row, 0, (hashlib.sha256(), hashlib.sha256())
                n += len(ids) // 4
                hashes[0].update(ids)
                hashes[1].update(coder.decode(ids))
                if batch.column(2)[k].as_py() == batch.column(3)[k].as_py() - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(k, 1), pa.array([n]), pa.array([hashes[0].hexdigest()]), pa.array([hashes[1].hexdigest()])], ["id", *names])

    pieces = _encoded(_pieces(long_, ranks, pattern, size, overlap), ranks, pattern)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    whole = pieces.repartition(parts, "row").sortWithinPartitions("row", "piece").mapInArrow(in_order, schema)
    return short.mapInArrow(at_once, schema).unionByName(whole).withColumnRenamed("id", id_col)
