"""Suffix-array dedup (operator 6): remove bytes covered by long strings that start in an earlier document.

A string is ``LENGTH`` bytes of one document; "earlier" means a smaller id. The smallest id of each string is
found without shuffling a row for every byte:

* Documents are dealt into groups by a hash. The smallest hash of the 16-byte pieces of a string is its anchor, and
  neighbouring strings mostly have the same one, so a text falls into stretches of strings with one anchor.
* Groups ask which of their anchors occur in other documents too; buckets of anchors answer with bits.
* The stretches with shared anchors, each different one once a group with its smallest id, meet in shards by
  anchor; equal strings have equal anchors. A shard sorts the suffixes of its different stretches in two stages, and
  neighbours with ``LENGTH`` common first bytes are equal strings: their smallest id is known.
* An anchor whose stretches have more than ``SHARD_BYTES`` in all is hot: its stretches are split into their single strings,
  which meet by a hash of the string instead, so a hot anchor is spread over all shards and equal strings still meet.
* Shards answer with the smallest ids, run-length coded and only where they matter; groups mark what is covered.

All three visits of a group read the same shuffled documents. What a shard gets for one hot anchor is each of its
different strings once a group; what a bucket gets for one anchor is one entry a group. Strings are judged on the input and never cross documents.

Null texts count as empty. A null id counts as larger than all others. Rows with equal ids never remove from each
other; repeated rows are handled each. Stretches that meet with equal 64-bit hashes are compared byte by byte; if any differ
(a chance of 3 in 10 ** 10 for a shard of 10 ** 5 stretches) the run ends with an error that asks for another ``salt``. Texts under ``LENGTH`` bytes stay whole. An empty table gives
an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, utf8_pieces
from .suffix_sort import prefix_words, shares_prefix, suffix_order
from .words import _BASE, _INVERSE, _power

LENGTH, PIECE = 50, 16
GROUP_BYTES, BUCKET_BYTES, SHARD_BYTES, RUN_BYTES = 1_500_000, 40_000_000, 5_000_000, 1 << 20
LAST = (1 << 63) - 1


def _values(salt: int) -> np.ndarray:
    """A random number for each byte."""
    return mix64(np.arange(256, dtype=np.uint64), 17 + salt)


def stretches(data: np.ndarray, starts: np.ndarray, length: int, salt: int = 0):
    """(row, first string's start, number of strings, anchor, content hash) of the stretches of a run of rows."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_values(salt)[data] * _power(_BASE, n), out=total[1:])
    back = _power(_INVERSE, n + 1)
    low = mix64((total[PIECE:] - total[:-PIECE]) * back[: n - PIECE + 1])
    wide, size = length - PIECE + 1, 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])  # the smallest of the pieces of each string
    valid = np.ones(len(low), np.bool_)
    tails = (starts[1:, None] - np.arange(1, length)).ravel()
    valid[tails[(tails >= np.repeat(starts[:-1], length - 1)) & (tails < len(low))]] = False
    edge = valid.copy()
    edge[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    first = np.flatnonzero(edge)
    stop = np.flatnonzero(valid & np.concatenate([~valid[1:] | (low[1:] != low[:-1]), [True]])) + 1
    end = stop + length - 1
    content = mix64((total[end] - total[first]) * back[first] + (end - first).astype(np.uint64))
    return np.searchsorted(starts, first, "right") - 1, first, stop - first, mix64(low[first], 31), content


def _pieces(texts: pa.Array, length: int):
    """Runs of rows as (row numbers, offsets in the rows, data, starts); long rows in overlapping parts."""
    for at, data, starts in utf8_pieces(texts, RUN_BYTES):
        if len(starts) > 2 or len(data) <= 2 * RUN_BYTES:
            yield np.arange(at, at + len(starts) - 1), np.zeros(len(starts) - 1, np.int64), data, starts
        else:
            for k in range(0, len(data), RUN_BYTES):
                part = data[k : k + RUN_BYTES + length - 1]
                yield np.array([at]), np.array([k]), part, np.array([0, len(part)])


def _group(table: pa.Table, length: int, salt: int):
    """All stretches of a group: row, start in the row, strings, anchor, content hash, and their bytes on demand."""
    texts = table.column("t").combine_chunks()
    out, runs = [], []
    for rows, base, data, starts in _pieces(texts, length):
        row, first, count, anchor, content = stretches(data, starts, length, salt)
        out.append((rows[row], first - starts[row] + base[row], count, anchor, content, np.full(len(row), len(runs)), first))
        runs.append(data)
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
    return (*columns, runs)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").fill_null(LAST).to_numpy()


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    """A part in [0, parts) from the upper half of a 64-bit hash."""
    return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _asked(row: np.ndarray, anchor: np.ndarray, buckets: int):
    """The group's different anchors by (bucket, lower half), and whether two documents of the group have them."""
    key = (_part(anchor, buckets).astype(np.uint64) << np.uint64(32)) | (anchor & np.uint64(0xFFFFFFFF))
    order = np.lexsort((row, key))
    sorted_key, sorted_row = key[order], row[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(key) else np.zeros(0, np.bool_)
    which = np.cumsum(new) - 1
    several = np.zeros(int(new.sum()), np.bool_)
    several[which[1:][~new[1:] & (sorted_row[1:] != sorted_row[:-1])]] = True
    back = np.empty(len(key), np.int64)
    back[order] = which
    return sorted_key[new], several, back


def _split(group: tuple, hot: np.ndarray, length: int, salt: int):
    """The columns of a group with its hot stretches split into their single strings, and which rows are such strings."""
    *columns, runs = group
    row, start, count, anchor, content, run, first = columns
    pick, rest = np.flatnonzero(hot), np.flatnonzero(~hot)
    n = count[pick]
    owner = np.repeat(pick, n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at, names = first[owner] + step, np.zeros(len(owner), np.uint64)
    powers = _power(_BASE, length)
    for r in np.unique(run[owner]).tolist():
        own = np.flatnonzero(run[owner] == r)
        for k in range(0, len(own), 1 << 14):
            part = own[k : k + (1 << 14)]
            names[part] = mix64((_values(salt)[runs[r][at[part][:, None] + np.arange(length)]] * powers).sum(1) + np.uint64(length))  # the content hash of a stretch of one string
    singles = (row[owner], start[owner] + step, np.ones(len(owner), np.int64), anchor[owner], names, run[owner], at)
    return (*(np.concatenate([x[rest], y]) for x, y in zip(columns, singles, strict=True)), runs), np.arange(len(rest) + len(owner)) >= len(rest)


def _compared(source: np.ndarray, where: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
    """Stretches with one hash must have equal bytes; else another salt is needed."""
    again = np.flatnonzero(first != np.arange(len(first)))
    ends = np.cumsum(size[again])
    at = 0
    while at < len(again):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[again[at]] + RUN_BYTES, "right")))
        part = again[at:to]
        n = size[part]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (n != size[first[part]]).any() or (source[np.repeat(where[part], n) + inside] != source[np.repeat(where[first[part]], n) + inside]).any():
            raise ValueError("two different strings have one hash: run again with another salt")
        at = to


def _rows(columns: dict) -> pa.Table:
    kinds = {"b": pa.int32(), "part": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, salt: int = 0) -> DataFrame:
    """(id, n_bytes, span_start, span_end, kept): the maximal removed runs in bytes, and the bytes that stay."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    groups, buckets, shards = (max(1, -(-total // size)) for size in (group_bytes, bucket_bytes, shard_bytes))
    usual = 2 * length - PIECE  # bytes of a stretch without repeated pieces, at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    rows = rows.select(F.pmod(F.xxhash64("id", "t"), F.lit(groups)).cast("int").alias("b"), "id", "t")

    def ask(table: pa.Table) -> pa.Table:
        row, _, count, anchor, content, *_ = _group(table, length, salt)
        key, several, back = _asked(row, anchor, buckets)
        once = np.unique(content, return_index=True)[1]
        size = np.bincount(back[once], count[once] + length - 1, len(key)).astype(np.int64)
        over = np.minimum(np.maximum(size - usual, 0), (1 << 32) - 1)  # nearly always 0
        bucket = (key >> np.uint64(32)).astype(np.int64)
        at = np.searchsorted(bucket, np.unique(bucket)).tolist() + [len(key)]
        out = {"b": [], "part": [], "keys": [], "several": [], "over": []}
        for x, y in zip(at, at[1:], strict=False):
            out["b"].append(table.column("b")[0].as_py())
            out["part"].append(int(bucket[x]))
            out["keys"].append(key[x:y].astype("<u4").tobytes())
            out["several"].append(np.packbits(several[x:y]).tobytes())
            out["over"].append(over[x:y].astype("<u4").tobytes())
        return _rows(out)

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        sizes = list(map(len, keys))
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("several").to_pylist(), sizes, strict=True)]).astype(np.bool_)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        shared = several.copy()
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        over = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("over").to_pylist()]).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], ~same])) if len(flat) else np.zeros(0, np.int64)
        hot = np.zeros(len(flat), np.bool_)
        if len(flat):
            hot[order] = np.repeat(np.add.reduceat(over[order] + usual, begin) > shard_bytes, np.diff(np.append(begin, len(flat))))
        masks = [[np.packbits(x).tobytes() for x in np.split(bits, np.cumsum(sizes)[:-1])] for bits in (shared, hot)]
        return _rows({"b": table.column("b").to_pylist(), "part": table.column("part").to_pylist(), "mask": masks[0], "hot": masks[1]})

    def send(table: pa.Table, masks: pa.Table) -> pa.Table:
        out = {"part": [], "b": [], "names": [], "counts": [], "low": [], "high": [], "bytes": [], "hot": []}
        if table.num_rows and masks.num_rows:
            group = _group(table, length, salt)
            key, _, back = _asked(group[0], group[3], buckets)
            bucket = (key >> np.uint64(32)).astype(np.int64)
            shared, hot = np.zeros(len(key), np.bool_), np.zeros(len(key), np.bool_)
            for part, mask, warm in zip(*(masks.column(k).to_pylist() for k in ("part", "mask", "hot")), strict=True):
                x, y = np.searchsorted(bucket, [part, part + 1])
                shared[x:y] = np.unpackbits(np.frombuffer(mask, np.uint8), count=y - x)
                hot[x:y] = np.unpackbits(np.frombuffer(warm, np.uint8), count=y - x)
            keep = shared[back]
            (row, _, count, anchor, content, run, first, runs), single = _split((*(x[keep] for x in group[:-1]), group[-1]), hot[back][keep], length, salt)
            doc = _ids(table)[row]
            meet = mix64(np.where(single, content, anchor), 5)
            keep = np.arange(len(row))
            if len(keep):
                shard = _part(meet[keep], shards)
                keep = keep[np.lexsort((content[keep], shard))]
                new = np.flatnonzero(np.concatenate([[True], content[keep][1:] != content[keep][:-1]]))
                low, high = np.minimum.reduceat(doc[keep], new), np.maximum.reduceat(doc[keep], new)
                keep = keep[new]
                shard = _part(meet[keep], shards)
                at = np.searchsorted(shard, np.unique(shard)).tolist() + [len(keep)]
                b = table.column("b")[0].as_py()
                for x, y in zip(at, at[1:], strict=False):
                    part = keep[x:y]
                    out["part"].append(int(shard[x]))
                    out["b"].append(b)
                    out["names"].append(content[part].tobytes())
                    out["hot"].append(np.unique(anchor[part][single[part]] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
                    out["counts"].append(count[part].astype("<u4").tobytes())
                    out["low"].append(low[x:y].astype("<i8").tobytes())
                    out["high"].append(high[x:y].astype("<i8").tobytes())
                    out["bytes"].append(b"".join(runs[r][f : f + c + length - 1].tobytes() for r, f, c in zip(run[part].tolist(), first[part].tolist(), count[part].tolist(), strict=True)))
        return _rows(out)

    def smallest(table: pa.Table) -> pa.Table:
        whole = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        names, counts, low, high = whole("names", "<u8"), whole("counts", "<u4"), whole("low", "<i8"), whole("high", "<i8")
        sizes = list(map(len, names))
        flat, count = np.concatenate(names), np.concatenate(counts).astype(np.int64)
        different, first, which = np.unique(flat, return_index=True, return_inverse=True)
        doc = np.full(len(different), LAST, np.int64)
        np.minimum.at(doc, which, np.concatenate(low))
        # the different stretches, a separator after each, as one text
        source = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        where = np.concatenate([[0], np.cumsum(count + length - 1)])
        _compared(source, where, first[which], np.diff(where))
        own = count[first] + length - 1
        start = np.cumsum(own + 1) - (own + 1)
        text = np.zeros(int((own + 1).sum()), np.uint8)
        inside = np.arange(len(text)) - np.repeat(start, own + 1)
        keep = inside < np.repeat(own, own + 1)
        text[keep] = source[(np.repeat(where[first], own + 1) + inside)[keep]] + 1  # UTF-8 has no byte 255
        of = np.repeat(np.arange(len(different), dtype=np.int64), own + 1)
        is_start = inside < np.repeat(count[first], own + 1)
        words = prefix_words(text)
        order = suffix_order(text, words, depth=-(-length // 8) * 8)
        order = order[is_start[order]]
        begin = np.flatnonzero(~shares_prefix(order, words, length))
        least = np.zeros(len(text), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[of[order]], begin), np.diff(np.append(begin, len(order))))
        # run lengths of equal smallest ids over the strings of each different stretch
        values, owner = least[is_start], of[is_start]
        edge = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]))
        length_of, value_of, owner_of = np.diff(np.append(edge, len(values))), values[edge], owner[edge]
        runs_at = np.searchsorted(owner_of, np.arange(len(different) + 1))
        below = np.minimum.reduceat(value_of, runs_at[:-1])
        out = {"b": [], "names": [], "runs": [], "lengths": [], "values": [], "hot": []}
        for b, ask, top, hot in zip(table.column("b").to_pylist(), np.split(which, np.cumsum(sizes)[:-1]), high, table.column("hot").to_pylist(), strict=True):
            ask = ask[below[ask] < top]  # else no document of the group has a string that starts earlier
            if len(ask):
                n = runs_at[ask + 1] - runs_at[ask]
                take = np.repeat(runs_at[ask] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out["b"].append(b)
                out["hot"].append(hot)
                out["names"].append(different[ask].tobytes())
                out["runs"].append(n.astype("<u4").tobytes())
                out["lengths"].append(length_of[take].astype("<u4").tobytes())
                out["values"].append(value_of[take].astype("<i8").tobytes())
        return _rows(out)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table.column("t").to_pylist()
        ids = table.column("id")
        spans = [([], []) for _ in texts]
        if answers.num_rows and table.num_rows:
            whole = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in answers.column(name).to_pylist()])
            name, n, lengths, values = whole("names", "<u8"), whole("runs", "<u4").astype(np.int64), whole("lengths", "<u4").astype(np.int64), whole("values", "<i8")
            by = np.argsort(name, kind="stable")
            begins = (np.cumsum(n) - n)[by]
            n, name = n[by], name[by]
            group = _group(table, length, salt)
            hot = np.isin((group[3] & np.uint64(0xFFFFFFFF)).astype(np.uint32), whole("hot", "<u4"))
            (row, start, _, _, content, *_), _ = _split(group, hot, length, salt)
            place = np.minimum(np.searchsorted(name, content), len(name) - 1)
            hit = np.flatnonzero(name[place] == content)
            m = n[place[hit]]
            take = np.repeat(begins[place[hit]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            owner = np.repeat(hit, m)
            size, value = lengths[take], values[take]
            shift = np.cumsum(size) - size
            first_of = np.repeat(shift[np.cumsum(m) - m], m) if len(m) else shift
            at = start[owner] + shift - first_of
            keep = value < _ids(table)[row[owner]]
            row, begin, end = row[owner][keep], at[keep], at[keep] + size[keep] + length - 1
            order = np.lexsort((begin, row))
            row, begin, end = row[order], begin[order], end[order]
            for r, x, y in zip(*(np.split(v, np.flatnonzero(row[1:] != row[:-1]) + 1) for v in (row, begin, end)), strict=True):
                if len(r):
                    far = np.maximum.accumulate(y)
                    new = np.concatenate([[True], x[1:] > far[:-1]])
                    spans[int(r[0])] = (x[new].tolist(), far[np.concatenate([new[1:], [True]])].tolist())
        kept = []
        for t, (x, y) in zip(texts, spans, strict=True):
            kept.append(b"".join(t[a:b] for a, b in zip([0, *y], [*x, len(t)], strict=True)) if x else t)
        return pa.table({"id": ids, "n_bytes": pa.array(list(map(len, texts)), pa.int64()), "span_start": pa.array([s[0] for s in spans], pa.list_(pa.int64())), "span_end": pa.array([s[1] for s in spans], pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})

    asked = rows.groupBy("b").applyInArrow(ask, "b int, part int, keys binary, several binary, over binary")
    answered = asked.groupBy("part").applyInArrow(answer, "b int, part int, mask binary, hot binary")
    sent = rows.groupBy("b").cogroup(answered.groupBy("b")).applyInArrow(send, "part int, b int, names binary, counts binary, low binary, high binary, bytes binary, hot binary")
    found = sent.groupBy("part").applyInArrow(smallest, "b int, names binary, runs binary, lengths binary, values binary, hot binary")
    out = rows.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(cut, "id long, n_bytes long, span_start array<long>, span_end array<long>, kept binary")
    return out.withColumnRenamed("id", id_col)


def repeats_digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, and the SHA-256 of what stays."""
    cut = F.aggregate(F.zip_with("span_start", "span_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return removed.select(F.col(id_col), "n_bytes", cut.alias("n_removed"), F.size("span_start").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
