"""Benchmark decontamination (operator 3): an FM-index for each training shard.

A shard is a run of whole documents of about ``SHARD_BYTES``, or a piece of a longer document that takes up the last words of
the piece before it. Test phrases are windows of consecutive item words. Of those of all blocks, the ones go on whose first, middle and last ``GRAM`` words
all stand in the shard somewhere (by hashes, so some more may). Their words are the alphabet of the shard's index; all other words are one separator, and stretches between separators that are
shorter than the shortest phrase cannot hold one and are left out. The phrases are searched backward through wavelet-tree ranks, all at once, occurrences
are located by sampled suffix positions, and the covered words are merged into removal spans.

Documents are never shuffled and are read once. The phrases are built by Spark: long items are cut into pieces that overlap by a window less one word, pieces
are grouped into blocks of about ``BLOCK_WORDS`` words, and each block is a set of flat arrays in the shared folder
(the words, where each different window starts, and which items it is of). Tasks map them into memory and keep the last ones used, so a benchmark of any size works.
Word hashes have 64 bits; a match takes as many equal hashes as the phrase has words.

Null texts and empty texts have no words and are never hit; null items and items without words have
no window. Repeated rows and equal ids are handled each; item ids are a set of strings, in which
all items without an id are one null, the last: it counts in ``n_items`` and is left out of ``items_sha256``, as in the SQL. With an
empty benchmark nothing is hit. Columns with whatever names are passed on untouched; the five columns that are added stand last, and
one whose name the input has is called name_2 (``common.added_name``).
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added_name, as_one, mix64, open_folder, quoted, shared_folder, stored
from .fm_index import FMIndex
from .words import word_parts

WINDOW, GRAM, SHARD_BYTES, BLOCK_WORDS, PIECE_WORDS = 10, 4, 4 << 20, 4_000_000, 1 << 16
#: Bytes of phrase blocks that a worker process keeps, beyond the one in use.
KEPT_BYTES = 128_000_000
ADDED = [("n_words", "bigint"), ("n_hit", "bigint"), ("span_start", "array<bigint>"), ("span_end", "array<bigint>"), ("item_ids", "array<string>")]
ARRAYS = {"words": "<u8", "text": "<i4", "start": "<i4", "length": "<i4", "owner_at": "<i4", "owner": "<i4", "head": "<u4", "middle": "<u4", "tail": "<u4"}
GRAM_BITS = 24
_kept: dict[str, Phrases] = {}


class Phrases:
    """The different windows of a block of items, as places in one array of symbols, and the items of each window."""

    def __init__(self, arrays: dict[str, np.ndarray], names: list[str | None]):
        self.names, self.arrays = names, arrays
        self.words, self.text, self.start, self.length, self.owner_at, self.owner, *self.grams = (arrays[k] for k in ARRAYS)
        self.bytes = sum(x.nbytes for x in arrays.values())

    @classmethod
    def of(cls, items: list[tuple[str | None, np.ndarray]], window: int) -> Phrases:
        """From pieces of items with their word hashes; a piece shorter than a window is one window."""
        names = sorted({i for i, _ in items}, key=lambda x: (x is None, x or ""))
        number = {x: k for k, x in enumerate(names)}
        size = np.array([len(w) for _, w in items], np.int64)
        code = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        words, text = np.unique(code, return_inverse=True)
        own = np.minimum(size, window)
        count = np.where(size > 0, size - own + 1, 0)
        begin = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(items)), count)
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begin[piece]
        length = own[piece]
        # windows with equal names of 128 bits are one
        padded = np.concatenate([code, np.zeros(window, np.uint64)])
        a, b = length.astype(np.uint64), mix64(length.astype(np.uint64), 5)
        for k in range(window):
            w = np.where(length > k, padded[start + k], np.uint64(0))
            a, b = mix64(a ^ w, k + 1), mix64(b + w, 99 - k)
        owner = np.array([number[i] for i, _ in items], np.int64)[piece] if items else piece
        order = np.lexsort((owner, b, a))
        a, b, owner, start, length = a[order], b[order], owner[order], start[order], length[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, np.bool_)
        once = new | np.r_[True, owner[1:] != owner[:-1]] if len(a) else new
        which = np.cumsum(new) - 1
        start, length = start[new], length[new]
        gram = _grams(padded)
        far = np.maximum(length - GRAM, 0)
        grams = {"head": gram[start], "middle": gram[start + far // 2], "tail": gram[start + far]} if len(start) else dict.fromkeys(("head", "middle", "tail"), gram[:0])
        arrays = {**grams, "words": words, "text": text.ravel(), "start": start, "length": length, "owner_at": np.searchsorted(which[once], np.arange(int(new.sum()) + 1)), "owner": owner[once]}
        return cls({k: np.ascontiguousarray(v, ARRAYS[k]) for k, v in arrays.items()}, names)

    def write(self, folder: str) -> str:
        store, top = open_folder(folder)
        name = uuid.uuid4().hex  # a task that runs again writes files of its own
        store.create_dir(top, recursive=True)
        for end, data in [*((k, v.tobytes()) for k, v in self.arrays.items()), ("names", json.dumps(self.names).encode())]:
            with store.open_output_stream(f"{top}/{name}.{end}") as f:
                f.write(data)
        return name

    @classmethod
    def read(cls, folder: str, name: str) -> Phrases:
        """From the files of a block; mapped where the folder is on a local or mounted disk."""
        from pyarrow import fs

        if name in _kept:
            _kept[name] = _kept.pop(name)  # the last one used
            return _kept[name]
        store, top = open_folder(folder)

        def get(end, kind):
            path = f"{top}/{name}.{end}"
            if isinstance(store, fs.LocalFileSystem) and store.get_file_info(path).size:
                return np.memmap(path, kind, "r")
            return np.frombuffer(store.open_input_file(path).read(), kind)

        out = cls({k: get(k, kind) for k, kind in ARRAYS.items()}, json.loads(bytes(get("names", "u1"))))
        while _kept and sum(x.bytes for x in _kept.values()) + out.bytes > KEPT_BYTES:
            _kept.pop(next(iter(_kept)))
        _kept[name] = out
        return out

    def likely(self, seen: np.ndarray) -> np.ndarray:
        """The windows whose grams a shard has, and those too short for one."""
        out = np.flatnonzero(seen[self.grams[0]] | (self.length < GRAM))
        for gram in self.grams[1:]:
            out = out[seen[gram[out]] | (self.length[out] < GRAM)]
        return out


def _grams(code: np.ndarray) -> np.ndarray:
    """A short hash of each word with the GRAM - 1 that follow it (fewer at the end)."""
    code = np.concatenate([code, np.zeros(GRAM - 1, np.uint64)])
    n = len(code) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = mix64(out ^ code[k : n + k], k)
    return (out >> np.uint64(64 - GRAM_BITS)).astype(np.uint32)


def find(blocks, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str | None]]]:
    """(whether each word of a shard is covered by a window of the blocks, pairs of a row and an item found there)."""
    covered = np.zeros(len(code), np.bool_)
    seen = np.zeros(1 << GRAM_BITS, np.bool_)
    seen[_grams(code)] = True
    parts, words, lengths = [], [], []
    for block in blocks if len(code) else ():
        some = block.likely(seen)
        if len(some):
            length = block.length[some].astype(np.int64)
            at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(block.start[some].astype(np.int64), length)
            parts.append((block, some))
            words.append(block.words[block.text[at]])
            lengths.append(length)
    if not parts:
        return covered, []
    alphabet, symbol = np.unique(np.concatenate(words), return_inverse=True)
    length = np.concatenate(lengths)
    place = np.minimum(np.searchsorted(alphabet, code), len(alphabet) - 1)
    known = alphabet[place] == code
    edge = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (row[1:] != row[:-1])])
    size = np.diff(np.r_[edge, len(code)])
    keep = known[edge] & (size >= length.min())
    first, size = edge[keep], size[keep]
    if not len(first):
        return covered, []
    # the stretches one after another, each followed by the separator 1; the sentinel 0 is last
    start = np.cumsum(size + 1) - (size + 1)
    word_at = np.arange(int((size + 1).sum())) - np.repeat(start, size + 1) + np.repeat(first, size + 1)
    text = place[np.minimum(word_at, len(code) - 1)] + 2
    text[start + size] = 1
    index = FMIndex(np.append(text, 0), len(alphabet) + 2)
    which, at = index.locate(*index.search(symbol.ravel() + 2, np.cumsum(length) - length, length))
    begin = word_at[at]
    change = np.bincount(begin, minlength=len(code) + 1) - np.bincount(begin + length[which], minlength=len(code) + 1)
    found = []
    pair = np.unique(row[begin].astype(np.int64) * len(length) + which)
    r, p = np.divmod(pair, len(length))
    base = 0
    for block, some in parts:
        own = (p >= base) & (p < base + len(some))
        w, rows = some[p[own] - base], r[own]
        n = (block.owner_at[w + 1] - block.owner_at[w]).astype(np.int64)
        take = np.repeat(block.owner_at[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found += [(x, block.names[y]) for x, y in zip(np.repeat(rows, n).tolist(), block.owner[take].tolist(), strict=True)]
        base += len(some)
    return np.cumsum(change[:-1]) > 0, found


def write_phrases(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> tuple[str, list[str]]:
    """(folder, names of blocks): the items' windows as files."""
    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0), []
            for at, n, row, _, _, code, _, ends in word_parts(as_one(batch, "t")):
                parts.append(code)
                if not ends:
                    continue
                code, parts = np.concatenate(parts), []
                for r, codes in enumerate(np.split(code, np.searchsorted(row, np.arange(1, n))) if n > 1 else [code]):
                    pieces = [codes[k : k + PIECE_WORDS + window - 1].astype("<u8").tobytes() for k in range(0, max(len(codes) - window + 1, 1), PIECE_WORDS) if len(codes)]
                    if pieces:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([at + r] * len(pieces))), pa.array(pieces, pa.binary())], names=["i", "c"])

    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").mapInArrow(run, "i string, c binary")
    items = stored(items.distinct(), "items")  # repeated rows of a benchmark count once
    total = (items.agg(F.sum(F.length("c"))).first()[0] or 0) // 8
    blocks, folder = max(1, -(-total // block_words)), shared_folder(benchmark.sparkSession, "phrases")

    def build(table: pa.Table) -> pa.Table:
        pieces = [(i, np.frombuffer(c, "<u8")) for i, c in zip(table.column("i").to_pylist(), table.column("c").to_pylist(), strict=True)]
        return pa.table({"name": [Phrases.of(pieces, window).write(folder)]})

    made = items.withColumn("block", F.pmod(F.xxhash64("i", "c"), F.lit(blocks))).groupBy("block").applyInArrow(build, "name string")
    return folder, [r["name"] for r in stored(made, "blocks").orderBy("name").collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` and n_words, n_hit, span_start and span_end (merged removal spans in UTF-8 bytes), item_ids (sorted strings)."""
    folder, blocks = write_phrases(benchmark, item_col, item_text_col, window, block_words)
    names = docs.columns
    at_text = names.index(text_col)
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    added = T._parse_datatype_string(", ".join(f"{n} {kind}" for n, kind in ADDED)).fields

    def run(batches):
        for batch in batches:
            yield _search(batch, folder, blocks, at_text, window)

    out = inner.mapInArrow(run, T.StructType([*inner.schema.fields, *added]))
    new: list[str] = []
    for n, _ in ADDED:
        new.append(added_name([*names, *new], n))
    return out.toDF(*names, *new)


def _search(batch: pa.RecordBatch, folder: str, blocks: list[str], at_text: int, window: int) -> pa.RecordBatch:
    n_words = np.zeros(batch.num_rows, np.int64)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}  # of each row the runs of covered words: first, end, first byte, end byte
    found: dict[int, set[str | None]] = {}
    carry = None
    for at, n, row, first, end, code, begins, ends in word_parts(as_one(batch, batch.schema.names[at_text]), SHARD_BYTES):
        new = len(code)
        if not begins:  # the row goes on: its last words once more, as a window may stand across
            row, first, end, code = (np.concatenate([x, y]) for x, y in zip(carry, (row, first, end, code), strict=True))
        carry = None if ends else tuple(x[max(0, len(code) - window + 1) :] for x in (row, first, end, code))
        covered, pairs = find((Phrases.read(folder, name) for name in blocks), row, code)
        for r, item in pairs:
            found.setdefault(at + r, set()).add(item)
        edges = np.searchsorted(row, np.arange(n + 1))
        base = n_words[at] - (len(code) - new) if n == 1 else 0
        n_words[at : at + n] += np.diff(edges) if n > 1 else new
        if not covered.any():
            continue
        start = np.flatnonzero(covered & np.r_[True, ~covered[:-1] | (row[1:] != row[:-1])])
        stop = np.flatnonzero(covered & np.r_[~covered[1:] | (row[1:] != row[:-1]), True])
        for r, x, y in zip(row[start].tolist(), start.tolist(), stop.tolist(), strict=True):
            w = int(base) - int(edges[r])
            run, own = (x + w, y + 1 + w, int(first[x]), int(end[y])), runs.setdefault(at + r, [])
            while own and run[0] <= own[-1][1]:  # goes on from the piece before
                a, b, c, d = own.pop()
                run = (min(a, run[0]), max(b, run[1]), min(c, run[2]), max(d, run[3]))
            own.append(run)
    n_hit = np.zeros(batch.num_rows, np.int64)
    begins_at, ends_at, names = ([[] for _ in range(batch.num_rows)] for _ in range(3))
    for r, own in runs.items():
        n_hit[r] = sum(y - x for x, y, _, _ in own)
        begins_at[r], ends_at[r] = [a for _, _, a, _ in own], [b for _, _, _, b in own]
        names[r] = sorted(found[r], key=lambda x: (x is None, x or ""))
    lists = [pa.array(x, pa.list_(pa.int64())) for x in (begins_at, ends_at)] + [pa.array(names, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words), pa.array(n_hit), *lists], names=[*batch.schema.names, *(n for n, _ in ADDED)])


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, and the SHA-256 of its item ids joined by commas."""
    n_words, n_hit, _, _, items = quoted(found.columns[-5:])
    return found.select(F.col(id_col), n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` with its removal spans cut out of the text, one space in place of each; other texts unchanged."""
    _, n_hit, start, end, _ = quoted(found.columns[-5:])
    text = quoted([text_col])[0]
    raw = text.cast("binary")
    kept = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), end).alias("a"), F.concat(start, F.array(F.octet_length(raw).cast("long"))).alias("b"))
    cut = F.concat_ws(" ", F.transform(kept, lambda x: F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")).cast("string")))
    return found.withColumn(text_col, F.when(n_hit > 0, cut).otherwise(text))


def items_sha256(items: list[str]) -> str:
    """The digest of one list of item ids, for tests and other engines."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
