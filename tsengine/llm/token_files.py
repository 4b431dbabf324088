"""Token-ID files (operator 4): flat unsigned integers and 64-bit document offsets, memory-mapped.

A set of files is a folder with, for each shard, ``N-X.ids`` (flat little-endian unsigned integers,
16 bits where the vocabulary allows it, else 32), ``N-X.off`` (64-bit offsets of its documents, one
more than documents) and ``N-X.doc`` (64-bit document ids), and the Parquet table ``index`` with a
row per shard: file name, counts and ``base``, the ids in all shards before it, a prefix sum over
the shards. Documents are in ascending id order over the shards. File names hold a fresh number
for each task attempt and the index names only the attempts that succeeded, so a task that is run
again after an executor is lost does no harm.

A null text has only the end id. A null document id sorts last and reads back as null; equal ids
stand in the order of a hash of their text, repeated rows each. An empty table gives a folder with an empty index. Other
columns are left out.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import open_folder, shared_folder, slices

_SPLIT = re.compile("[^ \t\n\r]+")
#: White space behind another character, where a long text may be cut.
_CUT = re.compile("[^ \t\n\r][ \t\n\r]")
#: In lower-case Latin-1 text without apostrophes (which open contractions): runs of letters, and runs of what is neither letter nor white space.
_LATIN = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\t-\r \x85\xa0]+")
#: Chunks kept by a worker process, for all its tasks, before its cache starts anew; null document ids are stored as this number.
CACHE, NULL_ID = 700_000, -(1 << 63)
_encoders: dict[str, Ids] = {}
INDEX = "shard int, name string, width int, n_docs long, n_ids long"


class Ids:
    """Token ids of whole texts as bytes, by the library's own encoding of white-space separated chunks.

    Cutting at ASCII white space changes nothing for a tokenizer whose pre-tokenizer drops white
    space and whose normalizer works on characters; texts with special tokens, and tokenizers
    for which a probe shows a difference, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.width = 2 if self.encoder.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        probe = "A, b\n c's  d."
        self.chunks = self.whole(probe) == b"".join(map(self.whole, _SPLIT.findall(probe)))
        probe = "Ab, C\xc9 d1-2 (x)\xa0\xb2z."
        self.folds = self.chunks and self.whole(probe) == b"".join(map(self.whole, _LATIN.findall(probe.lower())))
        self.cache: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Ids:
        """The one of this worker process."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.chunks or self.special and self.special.search(text):
            return self.whole(text)
        return b"".join(map(self._sliced, slices(text, _CUT)))

    def _sliced(self, text: str) -> bytes:
        if self.folds and "'" not in text and _latin(text):
            chunks = _LATIN.findall(text.lower())
        else:
            chunks = _SPLIT.findall(text)
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            if len(self.cache) > CACHE:
                self.cache = {}
            missing = list({c for c in chunks if c not in self.cache})
            for c, e in zip(missing, self.encoder.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                self.cache[c] = array(self.code, e.ids).tobytes()
            return b"".join(map(self.cache.__getitem__, chunks))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text, append ``end_id``, write the files; returns the folder (a new shared one if not given)."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files", scratch=False)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("t"), F.col("t")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.repartitionByRange(parts, order[0], order[1]).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        ids, shard = Ids.of(tokenizer), TaskContext.get().partitionId()
        store, top = open_folder(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        end, sizes, docs_seen, out = np.array([end_id], ids.kind).tobytes(), [], [], None
        for pdf in batches:
            if out is None and len(pdf):
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}.ids", buffer_size=1 << 20)
            for text in pdf["t"]:
                piece = ids.encode(text) + end
                out.write(piece)
                sizes.append(len(piece) // ids.width)
            docs_seen.append(pdf["id"].astype("Int64").fillna(NULL_ID).to_numpy(np.int64))
        if out is None:
            return
        out.close()
        offsets = np.zeros(len(sizes) + 1, "<i8")
        np.cumsum(sizes, out=offsets[1:])
        for end_of, values in (("off", offsets), ("doc", np.concatenate(docs_seen).astype("<i8"))):
            with store.open_output_stream(f"{top}/{name}.{end_of}") as f:
                f.write(values.tobytes())
        yield pd.DataFrame([(shard, name, ids.width, len(sizes), int(offsets[-1]))], columns=["shard", "name", "width", "n_docs", "n_ids"])

    ranged.mapInPandas(write, INDEX).write.parquet(f"{folder}/shards")
    shards = spark.read.schema(INDEX).parquet(f"{folder}/shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/index")
    return folder


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document of a set of files: id, start, n_tokens, ids_crc32, and with ``with_ids`` its ids as 32-bit bytes.

    Shards on a local or mounted disk are memory-mapped; those of other stores are read by ranges.
    """
    index = spark.read.parquet(f"{folder}/index")
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        from pyarrow import fs

        store, top = open_folder(folder)
        for pdf in batches:
            for name, width, n_docs, base in zip(pdf["name"], pdf["width"], pdf["n_docs"], pdf["base"], strict=True):
                get = lambda end, kind, name=name: np.frombuffer(store.open_input_file(f"{top}/{name}.{end}").read(), kind)
                offsets, doc = get("off", "<i8"), get("doc", "<i8")
                if isinstance(store, fs.LocalFileSystem):
                    flat = np.memmap(f"{top}/{name}.ids", f"<u{width}", "r") if offsets[-1] else np.zeros(0, f"<u{width}")
                    piece = lambda a, b, flat=flat: flat[a:b]
                else:
                    file = store.open_input_file(f"{top}/{name}.ids")
                    piece = lambda a, b, file=file, width=width: np.frombuffer(file.read_at(int(b - a) * width, int(a) * width), f"<u{width}")
                for at in range(0, n_docs, 2000):
                    to = min(at + 2000, n_docs)
                    raw = [piece(offsets[k], offsets[k + 1]).astype("<u4").tobytes() for k in range(at, to)]
                    out = pd.DataFrame({"id": pd.array(doc[at:to], "Int64"), "start": base + offsets[at:to], "n_tokens": np.diff(offsets[at : to + 1]), "ids_crc32": [zlib.crc32(x) for x in raw]})
                    out.loc[out["id"] == NULL_ID, "id"] = pd.NA
                    yield out.assign(ids=raw) if with_ids else out

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)  # a fixed number, as the few rows of the index would else be one task
    shards = index.select("name", "width", "n_docs", "base").repartition(parts, "name")
    return shards.mapInPandas(read, schema).withColumnRenamed("id", id_col)
