import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F

from tsengine.llm import byte_bpe, centroids, spelling

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Runs of letters, digits, symbols and white space, contractions, and characters on which Unicode versions differ.
BITS = ["a", "b", "don't", "'s", "'re", "'", "'l", " ", "  ", "\n", "\t", "é", "中", "文", "1", "２", "!", "?", "　", "\x85", "՘", "\U000323b0", "\U00011de1", "😀", "​", "\x00"]


def library():
    with open(RANKS, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def odd_texts():
    draw = random.Random(3)
    out = [(k, "".join(draw.choice(BITS) for _ in range(draw.choice([0, 1, 5, 60, 700, 3000])))) for k in range(150)]
    out += [(200, "a" * 3000), (201, " " * 3000), (202, "a" * 1500 + " " + "b" * 1500), (203, None), (None, "x y"), (None, "x y"), (7, "seven again " * 90), (204, "\n" * 400 + "x" * 700 + "'s" * 300), (205, "<|endoftext|>" * 40)]
    return out


def digests(lib, rows):
    out = []
    for key, text in rows:
        ids = np.array(lib.encode_ordinary(text or ""), "<u4")
        out.append((key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "overlap"), [(64, 16), (97, 7)])
def test_byte_bpe(spark, size, overlap):
    lib, rows = library(), odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "piece": F.lit("x")})
    got = byte_bpe.bpe_digest(df, RANKS, PATTERN, size=size, overlap=overlap).collect()
    assert sorted(map(tuple, got), key=str) == digests(lib, rows)


def test_byte_bpe_pieces(spark):
    lib, rows = library(), [(k, t) for k, t in odd_texts() if k is not None and k != 7]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = byte_bpe.encode(df, RANKS, PATTERN, size=64, overlap=16).cache()
    assert encoded.groupBy("doc_id").agg((F.max("pieces") == F.count("*")).alias("whole"), F.count_distinct("piece").alias("n"), F.max("pieces").alias("p")).where("not whole or n <> p").count() == 0
    assert encoded.agg(F.max("pieces")).first()[0] > 20
    whole = {}
    for r in sorted(byte_bpe.decode(encoded, RANKS, PATTERN).collect(), key=lambda r: r["piece"]):
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["bytes"])
    assert whole == {k: (t or "").encode() for k, t in rows}
    ids = {}
    for r in sorted(encoded.collect(), key=lambda r: r["piece"]):
        ids[r["doc_id"]] = ids.get(r["doc_id"], b"") + bytes(r["ids"])
    assert all(np.frombuffer(ids[k], "<u4").tolist() == lib.encode_ordinary(t or "") for k, t in rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.bpe_digest(none, RANKS, PATTERN).count() == 0 and byte_bpe.encode(none, RANKS, PATTERN).count() == 0


def test_byte_bpe_very_long_text(spark):
    lib = library()
    text = "".join(random.Random(5).choice(BITS[:20]) for _ in range(400_000))
    df = spark.createDataFrame([("long", text), ("short", "a b")], "doc_id string, text string")
    assert sorted(map(tuple, byte_bpe.bpe_digest(df, RANKS, PATTERN).collect()), key=str) == digests(lib, [("long", text), ("short", "a b")])


def variants(rows):
    """The rows of the contract by brute force."""
    seen = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for key, text in rows:
        for run in spelling.RUN.findall(text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return len(b) == len(a) + 1 and a[k:] == b[k + 1 :]

    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and v != w and one(v, w)] for w in words}
    form = {}
    for w, all_ in near.items():
        best = min(((-words[v], v) for v in all_), default=None)
        if best and -best[0] >= 10 * words[w]:
            form[w] = best[1]

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def spelled(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(2)})
    return sorted(map(tuple, spelling.spelling_variants(df).collect()), key=lambda r: r[0])


def typo(draw, w):
    k, c = draw.randrange(len(w)), draw.choice("abcéÀxz")
    return draw.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w])


def test_spelling(spark):
    draw = random.Random(11)
    stems = ["abababab", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "information", "formation", "Straßenbahn", "ÉLÉPHANTS", "windows", "running", *("".join(draw.choice("abcd") for _ in range(draw.randrange(6, 12))) for _ in range(60))]
    texts = []
    for k in range(300):
        words = [typo(draw, s) if draw.random() < 0.3 else s for s in (draw.choice(stems[: 5 + k % 60]) for _ in range(25))]
        texts.append((k, " ".join(words) + (".x1" if k % 2 else "")))
    rows = [*texts, (None, texts[0][1]), (None, texts[0][1]), (5, None), (6, ""), texts[1]]
    got = spelled(spark, rows)
    assert got == variants(rows) and sum(r[4] for r in got) > 300
    assert spelled(spark, []) == [] and spelled(spark, [(1, "short only")]) == []


def test_spelling_chain_and_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT_STATES", 5)
    chain = [("abcdefgh", 2), ("abcdefgx", 25), ("abcdefyx", 260), ("abcdezyx", 2700)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain, 100) if zlib.crc32(f"{k}:{w}".encode()) % 31]
    rows += [(k, " ".join(f"prefix{a}{b}q" for a in "abcdefgh" for b in "abcdefgh")) for k in range(3)]
    got = spelled(spark, rows)
    assert got == variants(rows)
    assert {r[0]: r[2] for r in got}["abcdefgh"] == "abcdezyx"


def test_spelling_long_words(spark):
    draw = random.Random(2)
    long = ["".join(draw.choice("ab") for _ in range(n)) for n in (62, 63, 64, 65, 66, 96, 127, 128, 129, 130, 300, 5000)]
    words = []
    for w in long:
        places = [0, 1, 31, 32, 33, len(w) // 2, len(w) - 2, len(w) - 1, *(draw.randrange(len(w)) for _ in range(8))]
        words += [w, *(w[:k] + w[k + 1 :] for k in places), *(w[:k] + "c" + w[k:] for k in places), *(w[:k] + "d" + w[k + 1 :] for k in places), w + "e"]
    rows = [(k, " ".join(words)) for k in range(2)]
    assert spelled(spark, rows) == variants(rows)
    one = [(1, "q" * 1_000_000 + " " + "q" * 1_000_000 + " " + ("q" * 999_999 + " ") * 2)]
    assert [(len(r[0]), r[3], r[4]) for r in spelled(spark, one)] == [(999_999, 2, 1), (1_000_000, 2, 1)]


def lloyd(ids, v, k=16, rounds=3):
    order = sorted(range(len(v)), key=lambda i: (hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest() if ids[i] is not None else "~", v[i].tolist()))
    c = v[order[:k]]
    for turn in range(rounds + 1):
        far = ((v[:, None, :] - c[None]) ** 2).sum(2)
        at = far.argmin(1)
        if turn < rounds:
            c = np.array([[int(s) // int((at == j).sum()) for s in v[at == j].sum(0)] if (at == j).any() else c[j] for j in range(len(c))], np.int64)
    return at, far.min(1), c


def grouped(n, groups, spread, seed=1):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(groups, 64)) * 10
    return (middle[draw.integers(groups, size=n)] + spread * draw.normal(size=(n, 64))).astype(np.float32)


@pytest.mark.parametrize(("groups", "spread", "scans"), [(12, 0.3, 0.7), (1, 1.0, 1.01)])
def test_clusters(spark, groups, spread, scans):
    x = grouped(600, groups, spread)
    x[400:450] = x[3]  # copies, and ties between equal starts
    bad = [None, [], [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63]
    ids = [*range(590), None, None, 3, 3, *range(594, 600)]
    rows = [*zip(ids, x.tolist(), strict=True), *((1000 + k, b) for k, b in enumerate(bad))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "id": F.lit("a"), "cluster": F.lit(7)})
    got = centroids.cluster_vectors(df).collect()
    v = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    at, far, c = lloyd(ids, v)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    inertia = np.bincount(at, far, 16)
    want = sorted(((i, int(j), int(d), int(inertia[j]), int(far.sum()), digest[j]) for i, j, d in zip(ids, at, far, strict=True)), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    assert np.mean([r["scanned"] for r in got]) < scans


def test_clusters_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    few = centroids.cluster_vectors(spark.createDataFrame([(1, [0.5] * 64), (2, [-0.5] * 64)], schema)).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in few) == [(1, 0), (2, 0)] and len({r["cluster"] for r in few}) == 2
    wide = spark.createDataFrame([(k, [float(k * 90_000)] * 64) for k in range(20)], schema)  # beyond what doubles add exactly
    x = np.array([[float(k * 90_000)] * 64 for k in range(20)])
    assert sorted(r["distance"] for r in centroids.cluster_vectors(wide).collect()) == sorted(lloyd(list(range(20)), np.floor(64 * x).astype(np.int64))[1].tolist())
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e12] * 64)], schema)).collect()


def test_loosening():
    draw = np.random.default_rng(4)
    for _ in range(40):
        d = int(draw.integers(2, 6))
        old, new = draw.normal(size=(3, d)) * 3, draw.normal(size=(3, d)) * 3
        new[0] = old[0] + 0.1 * draw.normal(size=d)
        radius = np.abs(draw.normal(size=3)) * 2
        bound = centroids.loosening(old, new, radius)
        for i in range(3):
            x = draw.normal(size=(4000, d))
            x = old[i] + x / np.linalg.norm(x, axis=1, keepdims=True) * radius[i] * draw.random((4000, 1)) ** 0.3
            for j in range(3):
                lost = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert lost.max() <= bound[i, j] + 1e-9
        assert (bound <= np.linalg.norm(new - old, axis=1) * (1 + 1e-6)).all()
    flat = centroids.loosening(np.array([[0.0, 9.0], [0.0, 0.0]]), np.array([[0.0, 9.0], [1.0, 0.0]]), np.array([1.0, 1.0]))
    assert flat[0, 1] < 0.2  # a centroid that moves across the line to a far sphere hardly comes nearer
