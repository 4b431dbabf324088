import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("tokenizers")
from pyspark.sql import functions as F

from tsengine.llm import chat, decontaminate, embed_dedup, minhash, mix, quality, secrets, suffix_dedup, token_counts, token_files
from tsengine.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sy") for b in ("ta", "po", "wen", "dis", "or")]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", ",", ".", "é"]) for _ in range(n))


def corpus():
    base = [prose(k, 60 + k) for k in range(12)]
    near = base[0].split()
    near[3] = "changed"
    texts = [*base, base[0], " ".join(near), None, "", "a", base[1][:80] + prose(99, 40), prose(7, 4000)]
    rows = [(k, t, f"s{k % 3}" if k % 5 else None) for k, t in enumerate(texts)]
    return [*rows, rows[2]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_and_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path).toPandas().sort_values(["doc_id", "n_tokens"])
    want = sorted((k, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in corpus())
    assert list(got[["doc_id", "n_bytes", "n_tokens"]].itertuples(index=False, name=None)) == want
    assert token_counts.count_tokens(empty, path).count() == 0
    for text in ("<|endoftext|> a  <|endoftext|>", "Don't  'll\n\n x y", "İ ΣΣ 日本"):
        assert token_counts.Counts(path).count([text]) == [len(lib.encode(text, add_special_tokens=False).ids)]
    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    out = token_files.read_token_files(spark, token_files.write_token_files(docs, path)).toPandas().sort_values("start")
    at = 0
    for row, (k, t) in zip(out.itertuples(), sorted(((k, t) for k, t, _ in corpus()), key=lambda x: x[0]), strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, path)).count() == 0


def test_decontaminate(spark, docs, empty):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    text = {k: t for k, t, _ in corpus()}
    items = [(1, " ".join(words(text[4])[10:25])), (2, "ZZ top"), (3, text[5]), (4, None), (5, "a"), (10, text[4])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, block_words=60)
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.contamination_digest(found).collect()}
    for k, t, _ in corpus():
        w, hit, names = words(t), set(), set()
        for i, x in items:
            x = words(x)
            for s in range(max(1, len(x) - 9) if x else 0):
                g = x[s : s + 10]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        names.add(str(i))
        row = got[k, len(w)]
        assert (row["n_hit"], row["n_items"], row["items_sha256"]) == (len(hit), len(names), decontaminate.items_sha256(list(names)))
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(found).collect()}
    assert cut[0] == text[0] and words(cut[5]) == [] and cut[14] is None
    assert decontaminate.contamination_digest(decontaminate.find_contamination(empty, bench)).count() == 0
    assert decontaminate.contamination_digest(decontaminate.find_contamination(docs, bench.limit(0))).where("contaminated").count() == 0


def test_suffix_dedup(docs, empty):
    got = {(r["doc_id"], r["kept_sha256"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.repeats_digest(suffix_dedup.remove_repeats(docs, group_bytes=2000, shard_bytes=3000, bucket_bytes=5000)).collect()}
    first, want = {}, set()
    raw = sorted((k, (t or "").encode()) for k, t, _ in corpus())
    for k, b in raw:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(k, first.get(b[p : p + 50], k))
    for k, b in raw:
        mark = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                mark[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~mark[:-1]])
        want.add((k, hashlib.sha256(kept).hexdigest(), int(mark.sum()), int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum())))
    assert got == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_minhash(docs, empty):
    got = {r["doc_id"]: r["component"] for r in minhash.near_duplicates(docs).collect()}
    assert got[12] == 0 and got[13] == 0 and got[14] == 14 and got[15] == 15
    assert all(got[k] == k for k in range(12))
    assert minhash.near_duplicates(empty).count() == 0
    rows = np.zeros(3, np.int64)
    assert minhash.probability_jaccard(np.arange(3), np.ones(3), np.arange(1, 5), np.ones(4)) == pytest.approx(2 / 5)
    assert (minhash.prob_minhash(rows, np.arange(3, dtype=np.uint64) + np.uint64(9), np.ones(3), 1, 64) >= 9).all()


def test_near_group_is_one(spark):
    """Copies of one text with a few changes each: large buckets, tiles, and the same groups as brute force."""
    draw = random.Random(3)
    base = prose(1, 120).split()
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(draw.choice([1, 2, 3, 5])):
            t[draw.randrange(len(t))] = draw.choice(WORDS) + str(draw.randrange(99))
        texts.append(" ".join(t))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in minhash.near_duplicates(frame).collect()}
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(sets)))
    for _ in range(len(sets)):
        for i in range(len(sets)):
            for j in range(i):
                if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in range(len(sets))):
            break
    assert got == dict(enumerate(label))


def test_embeddings(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(60, 8))
    x[20:40] = x[:20] + draw.normal(size=(20, 8)) * 0.15
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[0].tolist()), (61, None), (62, [0.0] * 8), (63, [float("nan")] * 8), (64, [None] * 8), (65, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embed_dedup.similar_vectors(frame, block=16).collect()}
    good = [(i, np.array(v)) for i, v in rows[:61]]
    for i, v in good:
        links = sum(1 for j, w in good if j != i and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.95)
        assert got[i]["n_links"] == links
    assert got[60]["component_id"] == 0 and not got[60]["kept"] and all(got[k]["component_id"] == k and got[k]["n_links"] == 0 for k in range(61, 66))
    assert embed_dedup.similar_vectors(frame.limit(0)).count() == 0


def test_mix(docs, empty):
    out = mix.mix_sources(docs).toPandas()
    by = out.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert (abs(by.taken - by.target) <= by.most / 2 + 1).all() and (by.target <= 2 * by["size"] + 1e-6).all() and (out.taken <= 2 * out["size"]).all()
    assert out.sort_values(["doc_id", "taken"]).taken.tolist() == mix.mix_sources(docs).toPandas().sort_values(["doc_id", "taken"]).taken.tolist()
    assert mix.mix_sources(empty).count() == 0


def test_secrets(spark, empty):
    draw = random.Random(4)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(18)) for _ in range(40)]
    rows = [(k, f"{prose(k, 20)} password={h} é {prose(k, 5)}") for k, h in enumerate(hexes)] + [(90, "token: secret: abcdefghijkl AKIA" + "Z" * 16), (91, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.secrets_digest(secrets.find_secrets(frame)).collect()}
    assert (got[0]["n_assign"], got[0]["n_hex"]) == (1, 1) and (got[90]["n_assign"], got[90]["n_access"]) == (0, 1)
    start = rows[0][1].index("password")
    assert got[0]["spans"].split(",")[0] == f"assign:{start}:{start + 27}" and got[91]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(empty.select("doc_id", "text")).count() == 0


def test_learned_formats(spark):
    """A credential without a keyword is found by its format; other runs with digits are not; base spans stay."""
    draw = random.Random(8)
    key = lambda: "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    other = lambda: f"{draw.choice(WORDS)}-{draw.choice(WORDS)}-{draw.choice(WORDS)}-{draw.randrange(10, 99)}"
    rows = [(k, f"api_key={key()} {prose(k, 4)} {other()}") for k in range(120)]
    bare = {500 + k: key() for k in range(20)}
    plain = {600 + k: other() for k in range(20)}
    frame = spark.createDataFrame([*rows, *((k, f"{prose(k, 6)} {v} end") for k, v in {**bare, **plain}.items())], "doc_id long, text string")
    formats = secrets.learn_formats(frame.where("doc_id < 200"))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(frame, formats).collect()}
    assert all([x[0] for x in got[k]] == ["assign"] for k, _ in rows)
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    found = {k for k, v in bare.items() if got[k] == [("format", texts[k].index(v), texts[k].index(v) + 24)]}
    assert len(found) >= 18 and not any(got[k] for k in plain)


def test_secrets_in_a_very_long_text(spark):
    """Many spans and candidates in one text: the same as in its lines, in time proportional to their number."""
    lines = [f"token=abcdefgh{k:08d} z{k:015d}y .{k:x}" for k in range(60_000)]
    text = "\n".join(lines)
    base = secrets.base_spans(text)
    found = secrets.candidates(text, base)
    assert (len(base), len(found)) == (60_000, 60_000)
    assert [text[a:b] for a, b in found[:50]] == [s[a:b] for s in lines[:50] for a, b in secrets.candidates(s, secrets.base_spans(s))]


def test_quality(spark, empty):
    rows = [(k, prose(k, 50) if k % 3 else " ".join(w + "$$$" for w in prose(k, 50).split())) for k in range(120)]
    frame = spark.createDataFrame([*rows, (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows], "doc_id long, quality int")
    out = quality.score_quality(frame, quality.train_quality(frame, labels)).toPandas().set_index("doc_id").score
    assert all((out[k] >= quality.THRESHOLD) == (k % 3 > 0) for k, _ in rows) and 0 <= out[500] <= 1
    none = quality.train_quality(frame, labels.limit(0))
    assert set(quality.score_quality(frame, none).toPandas().score) == {0.5}


def test_chat(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ("Human: " if t % 2 == 0 else "AI: ") + prose(c * 9 + t, 8)) for c in range(3) for t in range(150)]
    frame = spark.createDataFrame([*rows, (None, 1, "user", "x"), (7, None, "user", None)], "conv_id long, turn long, role string, text string")
    model = chat.fit_roles(frame)
    got = chat.format_chats(frame, model).toPandas()
    both = got.merge(pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]), on=["conv_id", "turn"])
    assert len(got) == len(rows) + 2 and (both.role_x == both.role_y).all()
    assert both.rendered.iloc[0].startswith("<|") and "Human:" not in "".join(both.rendered)
    obs = [np.array([int(o) for o in np.random.default_rng(c).integers(0, chat.N_OBS, 40)]) for c in range(3)]
    for o in obs:
        steps = model.steps(o)
        path = chat.viterbi(steps)
        score = lambda p, steps=steps: sum(steps[i][a, b] for i, (a, b) in enumerate(zip([0, *p[:-1]], p, strict=True)))
        assert score(list(path)) == pytest.approx(chat.product(steps)[0].max())


def test_clashing_names(spark, docs):
    odd = docs.withColumns({**{c: F.lit("x") for c in ("size", "source_size", "target", "low", "whole", "rest", "q", "u", "v", "n", "k", "copies", "Taken")}, "component": F.lit(1), "score": F.lit(None)})
    mixed = mix.mix_sources(odd)
    assert mixed.columns == [*odd.columns, "size_2", "source_size_2", "target_2", "copies_2", "taken_2"] and mixed.where("size = 'x'").count() == docs.count()
    found = decontaminate.find_contamination(docs.withColumns({c: F.lit(7) for c in ("n_words", "N_hit", "span_start", "item_ids")}), spark.createDataFrame([(1, corpus()[5][1])], "item_id long, text string"))
    assert found.columns[-5:] == ["n_words_2", "n_hit_2", "span_start_2", "span_end", "item_ids_2"]
    cut = decontaminate.cut_spans(found)
    assert cut.where("n_words = 7 and N_hit = 7").count() == docs.count() and decontaminate.contamination_digest(found).where("contaminated").count() == 1
    assert cut.where("doc_id = 5").first()["text"].strip() == ""
    assert mix.repeat_copies(mixed, odd.columns, "copies_2").columns == odd.columns and mix.repeat_copies(mixed, odd.columns, "copies_2").count() > 0
    assert minhash.near_duplicates(odd).count() == docs.count()
    assert token_counts.count_tokens(odd, tokenizer_path("byte_bpe_50k.json"), tier_one=False).count() == docs.count()


def test_sql_agrees(spark):
    """Every query with SQL gives the rows of its SQL on whole small tables."""
    import duckdb

    from tsengine.llm import queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, folder).toPandas(), con.sql(sql).df()
        key, columns = got.columns[0], sorted(got.columns)
        a, b = (x[columns].sort_values(key).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(a, b, check_exact=True)


def test_hot_anchor_is_spread(spark, tmp_path, monkeypatch):
    """A short passage in many contexts: each context is a stretch of its own, all with one anchor."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n))
    passage = "this short line stands in each and every document, as it is"
    texts = [f"{words(200)} {passage} {words(200)}" for _ in range(150)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sort, seen = suffix_dedup.suffix_order, str(tmp_path)

    def spy(text, *given, **named):
        with open(f"{seen}/{random.random()}", "w") as f:
            f.write(str(len(text)))
        return sort(text, *given, **named)

    monkeypatch.setattr(suffix_dedup, "suffix_order", spy)
    got = suffix_dedup.remove_repeats(given, group_bytes=20_000, shard_bytes=3_000).collect()
    first = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], k)
    for r in got:
        t = texts[r["doc_id"]]
        marks = [p for p in range(len(t) - 49) if first[t[p : p + 50]] < r["doc_id"]]
        assert (r["span_start"], r["span_end"]) == (([marks[0]], [marks[-1] + 50]) if marks else ([], []))
    sizes = [int(x.read_text()) for x in tmp_path.iterdir()]
    assert len(got) == 150 and max(sizes) < 2 * 3_000


def test_axes_sample_is_not_empty(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SAMPLE_ROWS", 20)
    fit, sizes = embed_dedup.rotation, []
    monkeypatch.setattr(embed_dedup, "rotation", lambda sample, width: sizes.append(len(sample)) or fit(sample, width))
    v = np.random.default_rng(3).normal(size=(2_000, 4))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    embed_dedup.similar_vectors(rows)
    assert 5 < sizes[0] < 40


def test_items_without_an_id(spark):
    line = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(0, f"before {line} after"), (1, f"{line} and red green blue"), (2, "none of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, line), (None, "seven eight nine ten"), (7, "red green blue")], "item_id long, text string")
    for block_words in (2_000_000, 5):
        found = decontaminate.find_contamination(docs, bench, block_words=block_words)
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.contamination_digest(found).collect()}
        assert got == {0: (11, 1, decontaminate.items_sha256([])), 1: (14, 2, decontaminate.items_sha256(["7"])), 2: (0, 0, decontaminate.items_sha256([]))}
        assert {r["doc_id"]: r["text"].split() for r in decontaminate.cut_spans(found).collect()}[0] == ["before", "after"]


def test_formats_are_learned_from_all(spark):
    """Short credentials with dots are candidates; a rare kind in a large table is learned, from whole strings."""
    assert secrets.candidates("see ab.12-cd.34xy now, Abc123Def456", []) == [(4, 17), (23, 35)]
    long = "token = " + "a1" * 150
    rows = [(k, f"nothing {k}") for k in range(30_000)] + [(30_000 + k, f"password: Zq{k}.x7-{k}.Yw9") for k in range(5)] + [(40_000, long)]
    texts = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).repartition(4)
    got = secrets.learn_formats(texts)
    assert "assign" in got.kinds
    coded = [secrets.symbols_of(s) for s in [f"Zq{k}.x7-{k}.Yw9" for k in range(5)] + ["a1" * 150]]
    assert got.kinds["assign"][2] == pytest.approx(np.mean([secrets.Automaton(coded).score(s) for s in coded]), abs=0.05)


def _role_frame(spark):
    rows = [(1, t, "assistant" if t == 0 else "user", "x" * (300 if t == 0 else 20)) for t in (-1, 0, 1)]  # negative turns
    rows += [(2, 5, "user", f"piece {k}?") for k in range(1000)]  # one turn, again and again
    rows += [(3, k * 3 - 500, "user", "the same") for k in range(700)]  # gaps, repeated texts
    return rows, spark.createDataFrame([*rows, (None, 1, "user", ""), (None, 1, "user", ""), (7, None, "user", None)], "conv_id long, turn long, role string, text string")


def test_chat_turns(spark, monkeypatch):
    """Any turn numbers; decoding by blocks equals one pass over the whole conversation; no block is too large."""
    rows, frame = _role_frame(spark)
    frame = frame.withColumns({"block": F.lit("b"), "t": F.lit(1), "role_2": F.lit(None)})
    model = chat.fit_roles(frame)
    got = chat.format_chats(frame, model).toPandas()
    assert len(got) == len(rows) + 3 and got.conv_id.isna().sum() == 2
    assert sorted(got[got.conv_id == 1].turn) == [-1, 0, 1]
    for c in (1, 3):
        texts = [x for k, _, _, x in sorted(r for r in rows if r[0] == c)]
        obs = [o for r in spark.createDataFrame([(x,) for x in texts], "text string").select(chat._observed(F.col("text")).alias("o")).collect() for o in r["o"]]
        whole = [chat.ROLES[k - 1] for k in chat.viterbi(model.steps(np.array(obs)))]
        assert got[got.conv_id == c].sort_values("turn").role.tolist() == whole
    assert chat.format_chats(frame.limit(0), model).count() == 0
    batch = pd.DataFrame([(0, 2, 5, "x", np.array([1])) for _ in range(1000)], columns=["part", "c", "t", "x", "o"])
    sizes = [len(x) for pdf in chat._blocks([batch], model) for x in pdf["t"]]
    assert sum(sizes) == 1000 and max(sizes) <= chat.BLOCK


def test_viterbi_is_best_of_all_paths():
    import itertools

    draw = np.random.default_rng(5)
    model = chat.RoleModel.of({(s, int(o)): int(n) for s in (1, 2, 3) for o, n in zip(draw.integers(0, chat.N_OBS, 60), draw.integers(1, 9, 60), strict=True)}, {(1, 2): 4, (2, 3): 9, (3, 2): 7})
    for _ in range(5):
        steps = model.steps(draw.integers(0, chat.N_OBS, 6))
        score = lambda p, steps=steps: sum(steps[i][a, b] for i, (a, b) in enumerate(zip((0, *p[:-1]), p, strict=True)))
        best = max(map(score, itertools.product((1, 2, 3), repeat=6)))
        assert score(chat.viterbi(steps).tolist()) == pytest.approx(best) and chat.product(steps)[0].max() == pytest.approx(best)


def test_chat_keeps_all_text(spark):
    """The rendering parses back to the pieces, whatever they hold."""
    texts = ["Options:\na: red\nq: blue\nmodel: T5", "Human: hi\n\n> a: quoted\n## Instructions:\n", "AI: <|end|>\n<|user|>\nme <\\| <\\\\|end|> <|", "User: one\nAssistant: two\nUser: three\n\n", "", None, "Question: x", "\n\nsystem:\nbe kind\n", "a <b>\n" * 30_000 + "User: x"]
    frame = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], x) for c in range(3) for t, x in enumerate(texts)], "conv_id long, turn long, role string, text string")
    model = chat.fit_roles(spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], ("User: ", "Assistant: ")[t % 2] + prose(c + t, 9)) for c in range(20) for t in range(6)], frame.schema))
    for r in chat.format_chats(frame, model).collect():
        turns = chat.parse_turns(r["rendered"])
        assert len(turns) == r["n_segments"] == len(r["markers"]) and turns[0][0] == r["role"]
        assert "\n".join(m + x for m, (_, x) in zip(r["markers"], turns, strict=True)) == (texts[r["turn"]] or "")
        if r["turn"] == 0:
            assert "a: red\nq: blue" in r["rendered"]
        if r["turn"] == 3:
            assert turns == [("user", "one"), ("assistant", "two"), ("user", "three\n\n")] and r["markers"] == ["User: ", "Assistant: ", "User: "]


def test_chat_noised_table(spark):
    """The given pieces joined by threes, some with markers and some without: lines are given back to their roles."""
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    names = {"system": ("System", "Instructions"), "user": ("User", "Human", "Customer"), "assistant": ("Assistant", "AI", "Bot")}
    draw, rows, wanted = random.Random(4), [], {}
    for c, g in talks.groupby("conv_id"):
        lines = [(r.role, (f"{draw.choice(names[r.role])}: " if draw.random() < 0.8 else "") + (r.text or "").replace("\n", " ")) for r in g.itertuples()]
        for k in range(0, len(lines), 3):
            wanted[c, k] = [role for role, _ in lines[k : k + 3]]
            rows.append((c, k, "\n".join(x for _, x in lines[k : k + 3])))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    right = total = 0
    for r in chat.format_chats(frame, chat.fit_roles(spark.createDataFrame(talks))).collect():
        got = [role for role, x in chat.parse_turns(r["rendered"]) for _ in x.split("\n")]
        right += sum(a == b for a, b in zip(got, wanted[r["conv_id"], r["turn"]], strict=True))
        total += len(got)
    assert right / total > 0.8


def test_chat_held_out(spark):
    """Held-out accuracy on the given table, against turns that always alternate."""
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.format_chats(talks, chat.fit_roles(talks)).join(talks.select("conv_id", "turn", F.col("role").alias("want")), ["conv_id", "turn"])
    got = got.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0)
    right = got.agg(F.avg((F.col("role") == F.col("want")).cast("int")), F.avg((F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant") == F.col("want")).cast("int"))).first()
    assert right[0] > 0.95 and right[0] > right[1] + 0.1


def test_mix_ties(spark):
    """Rows that share an id, or have none, meet the target as others do; sources of any number are filled without one-task windows."""
    def gap(rows):
        out = mix.mix_sources(spark.createDataFrame(rows, SCHEMA)).toPandas()
        assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
        by = out.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
        return (abs(by.taken - by.target) / by.most).max()

    line = "ten words are in this one line as it is"
    assert gap([(None, line, "a")] * 100) <= 0.5
    assert gap([(7, line, "a")] * 99 + [(8, line, None)] * 31) <= 0.5
    assert gap([(None, line.replace("ten", f"n{k}"), "a") for k in range(90)] + [(k, line, "b") for k in range(50)]) <= 0.5
    assert gap([(k, line if k % 3 else None, f"s{k % 40}") for k in range(400)]) <= 0.5
    few = mix.MOST_SOURCES
    try:
        rows = [(k, line, f"s{k % 7}" if k % 7 else None) for k in range(300)]
        one = mix.mix_sources(spark.createDataFrame(rows, SCHEMA)).toPandas().sort_values("doc_id").taken.tolist()
        mix.MOST_SOURCES = 1
        assert mix.mix_sources(spark.createDataFrame(rows, SCHEMA)).toPandas().sort_values("doc_id").taken.tolist() == one
    finally:
        mix.MOST_SOURCES = few


def test_mix_targets(spark):
    """Shares by weight with stops, against filling the sources one after another."""
    draw = random.Random(2)
    sizes = [(f"s{k:03d}" if k else None, draw.choice([0, 1, 5, 50, 900]), 1) for k in range(25)]
    got = {r["source"]: r["target"] for r in mix.source_targets(spark.createDataFrame(sizes, "source string, source_size long, n_docs long")).collect()}
    names = [s for s, _, _ in sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))]
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    size = {s: n for s, n, _ in sizes}
    stopped = set()
    for _ in sizes:
        rate = (1.5 * sum(size.values()) - 2 * sum(size[s] for s in stopped)) / sum(weight[s] for s in size if s not in stopped)
        stopped |= {s for s in size if rate * weight[s] >= 2 * size[s]}
    assert all(got[s] == pytest.approx(2 * size[s] if s in stopped else rate * weight[s]) for s in size)
    assert sum(got.values()) == pytest.approx(1.5 * sum(size.values()))


def test_long_text_in_pieces(monkeypatch):
    """Words, shingles and hits of a long row are the same however it is cut, over blocks of the benchmark too."""
    import pyarrow as pa

    from tsengine.llm import words

    draw = random.Random(6)
    text = " ".join(draw.choice(WORDS) + ("é" * 40 if k % 500 == 3 else "") for k in range(6000))
    values = pa.array(["a b", text, "", None, text[:50] + "x" * 5000], pa.string()).fill_null("")
    whole = [x for x in words.word_parts(values, 1 << 24)]
    parts = [x for x in words.word_parts(values, 700)]
    flat = lambda found: sorted((at + r, a, b, int(c)) for at, _, row, first, end, code, _, _ in found for r, a, b, c in zip(row.tolist(), first.tolist(), end.tolist(), code, strict=True))
    assert len(parts) > 20 and flat(parts) == flat(whole)
    shingled = lambda limit: sorted((at + int(r), int(c)) for at, _, row, code in words.shingle_parts(values, 5, limit) for r, c in zip(row, code, strict=True))
    assert shingled(700) == shingled(1 << 24)
    w = text.split()
    items = [("a", " ".join(w[90:150])), (None, " ".join(w[2000:2012])), ("b", "one two"), ("c", " ".join(w[5990:]))]
    code = {i: words.words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[3] for i, t in items}
    blocks = {"x": decontaminate.Phrases.of([(i, code[i]) for i in ("a", None)], 10), "y": decontaminate.Phrases.of([(i, code[i]) for i in ("b", "c", "a")], 10)}
    monkeypatch.setattr(decontaminate.Phrases, "read", classmethod(lambda cls, folder, name: blocks[name]))
    got = []
    for limit in (700, 1 << 24):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", limit)
        got.append(decontaminate._search(pa.RecordBatch.from_arrays([values], names=["t"]), "", ["x", "y"], 0, 10).to_pydict())
    assert got[0] == got[1] and got[0]["n_words"] == [2, 6000, 0, 0, got[0]["n_words"][4]]
    hit = {k for a, b in ((90, 150), (2000, 2012), (5990, 6000)) for k in range(a, b)}
    assert got[0]["n_hit"][1] == len(hit) and got[0]["item_ids"][1] == ["a", "c", None]


def test_near_duplicates_without_ids(spark):
    """One row of each group is kept, also among rows without an id, rows that share one, and repeated rows."""
    base = [prose(k, 80) for k in range(6)]
    near = base[0].replace(base[0].split()[40], "changed", 1)
    rows = [(None, base[0]), (None, base[0]), (None, near), (5, base[1]), (5, base[1]), (None, base[1]), (7, base[2]), (7, base[3]), (8, base[3]), (9, None), (9, ""), (None, "?!"), (10, base[4])]
    frame = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, component string").withColumns({c: F.lit(1) for c in ("class_a", "kept", "n", "hot", "k_")})
    got = minhash.near_duplicates(frame).toPandas()
    assert len(got) == len(rows) and got.kept.sum() == 1 + 1 + 1 + 1 + 3 + 1
    assert sorted(got[got.component == 5].kept) == [False, False, True] and sorted(got[got.component == 7].doc_id) == [7, 7, 8]
    out = minhash.drop_near_duplicates(frame)
    left = out.toPandas()
    assert out.columns == frame.columns and len(left) == 8
    assert sorted(left.text.fillna("-")) == sorted([base[0] if base[0] in set(left.text) else near, base[1], base[2], base[3], base[4], "-", "", "?!"])


def test_hot_bucket_is_dealt(spark, monkeypatch):
    """Hot buckets give the same groups."""
    draw = random.Random(5)
    base = prose(1, 200).split()
    texts = []
    for k in range(60):
        t = list(base)
        t[draw.randrange(200)] = f"n{k}"
        texts.append(" ".join(t))
    frame = spark.createDataFrame(list(enumerate(texts + [prose(k, 50) for k in range(50, 60)])), "doc_id long, text string")
    want = {r["doc_id"]: r["component"] for r in minhash.near_duplicates(frame).collect()}
    monkeypatch.setattr(minhash, "max", lambda *x: 5, raising=False)  # the least size of a hot bucket
    assert {r["doc_id"]: r["component"] for r in minhash.near_duplicates(frame).collect()} == want
    assert {want[k] for k in range(60)} == {0} and all(want[k] == k for k in range(60, 70))


def test_held_out_credentials(spark):
    """With the base patterns hidden, formats learned from some labelled credentials find the others among all candidates."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("text is not null").collect()]
    found = {"other": set()}
    for t in texts:
        base = secrets.base_spans(t)
        for b in base:
            found.setdefault(secrets.KINDS[b[1]], set()).add(secrets.value_of(t, b))
        found["other"].update(t[a:b] for a, b in secrets.candidates(t, base))
    out = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % 4 == 0
    formats = secrets.Formats({k: [s for s in sorted(v) if not out(s)] for k, v in found.items()})
    held = {k: [s for s in v if out(s)] for k, v in found.items()}
    hits = sum(formats.is_secret(s) for k, v in held.items() if k != "other" for s in v)
    wrong = sum(map(formats.is_secret, held["other"]))
    assert hits >= 0.98 * sum(len(v) for k, v in held.items() if k != "other") > 100 and wrong == 0
    assert len(formats.kinds["hex"][1].step) > 1 and len(formats.kinds["assign"][1].step) > 1


def test_ranker_by_another_solver():
    """Plain gradient descent on the same pairs ends at the same order."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, len(quality.FEATURES)))
    label = (x[:, 0] - 0.5 * x[:, 3] + draw.normal(size=300) * 0.5 > 0).astype(int)
    got = quality.fit_ranker(x, label, ridge=0.05)
    z = np.clip((x - x.mean(0)) / x.std(0), -5, 5)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    d = (z[good][:, None] - z[bad][None]).reshape(-1, z.shape[1])  # all pairs instead of drawn ones
    w = np.zeros(z.shape[1])
    for _ in range(1500):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 0.05 * w)
    assert np.corrcoef(z @ w, got.latent(x))[0, 1] > 0.99


def test_pipeline(spark, tmp_path):
    """Every stage on a small corpus against a brute-force version of it; columns stay, scratch folders go."""
    import re
    from pathlib import Path

    import corpus_pipeline
    from tokenizers import Tokenizer

    passage = prose(70, 40)
    texts = [prose(k, 80) if k % 4 else " ".join(w + "$$$" for w in prose(k, 80).split()) for k in range(60)]
    texts[1] += " " + passage + " " + prose(71, 30)
    near = texts[2].split()
    near[50] = "changed"
    texts += [texts[2], " ".join(near), texts[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_hit string, size string, copies int"
    rows = [(k, t, "x", f"s{k % 2}", len(t), "s", "h", "z", 7) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out.cache()
        seen[name] = docs.orderBy("doc_id").collect()
    assert {r["doc_id"] for r in seen["quality"]} == {k for k in range(63) if k >= 60 or k % 4}
    assert {r["doc_id"] for r in seen["near_dedup"]} == {k for k in range(60) if k % 4}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    got = {r["doc_id"]: r for r in seen["decontaminate"]}
    assert set(got) == {k for k in range(60) if k % 4} and all(got[k]["text"] == texts[k] for k in got if k != 1)
    assert words(got[1]["text"]) == words(texts[1].replace(passage, " ")) and got[1]["n_chars"] == len(got[1]["text"])
    assert all((r["score"], r["n_hit"], r["size"], r["copies"]) == ("s", "h", "z", 7) for r in seen["mix"])
    size = {k: len(got[k]["text"].split()) for k in got}
    taken = {}
    for r in seen["mix"]:
        assert r["text"] == got[r["doc_id"]]["text"]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert max(taken.values()) <= 2
    total = {s: sum(n for k, n in size.items() if k % 2 == s) for s in (0, 1)}
    rate = 1.5 * sum(total.values()) / 7
    target = {0: 2 * total[0], 1: 1.5 * sum(total.values()) - 2 * total[0]} if rate * 5 >= 2 * total[0] else {0: rate * 5, 1: rate * 2}
    for s in (0, 1):
        assert abs(sum(size[k] * n for k, n in taken.items() if k % 2 == s) - target[s]) <= max(size.values())
    from tsengine.llm import common

    before = common.n_scratch()
    final = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert common.n_scratch() - before == len(corpus_pipeline.STAGES)
    lib, at = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 0
    assert [r["doc_id"] for r in final] == sorted(k for k, n in taken.items() for _ in range(n))
    for r in final:
        ids = np.array([*lib.encode(got[r["doc_id"]]["text"], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    folder = Path(common._made[-1].removeprefix("file://"))
    assert folder.exists()
    common.remove_scratch(before)
    assert not folder.exists()


def test_sliced_texts(monkeypatch):
    """Long texts give the same tokens in slices."""
    from tokenizers import Tokenizer

    from tsengine.llm import common

    cut = common.slices
    small = lambda text, pattern: cut(text, pattern, 50)
    monkeypatch.setattr(token_counts, "slices", small)
    monkeypatch.setattr(token_files, "slices", small)
    text = prose(3, 900) + "  \n\n x\u00a0y  " + "\u65e5\u672c " * 40 + " don't  'll " + prose(4, 100) + "z" * 300
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
    assert len(list(small(text, token_counts.CUT))) > 20
    assert token_counts.Counts(a).count([text, text.replace(" ", "  ")]) == [len(Tokenizer.from_file(a).encode(t, add_special_tokens=False).ids) for t in (text, text.replace(" ", "  "))]
    coder = token_files.Ids(b)
    assert coder.encode(text) == coder.whole(text)


def test_equal_hashes_are_compared():
    source = np.frombuffer(b"abcdabcdabce", np.uint8)
    suffix_dedup._compared(source[:8], np.array([0, 4, 8]), np.array([0, 0]), np.array([4, 4]))
    with pytest.raises(ValueError):
        suffix_dedup._compared(source, np.array([0, 4, 8, 12]), np.array([0, 0, 0]), np.array([4, 4, 4]))


def test_recall_on_given_table(spark):
    """All pairs of a given table with probability Jaccard of 0.8 or more, by brute force over shared shingles, are in one group."""
    import re
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["component"] for r in minhash.near_duplicates(docs).collect()}
    weights, where = {}, defaultdict(list)
    for k, t in docs.select("doc_id", "text").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        seen = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()
        weights[k] = {s: 1 + np.log(n) for s, n in seen.items()}
        for s in seen:
            where[s].append(k)
    pairs = Counter((a, b) for ks in where.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    links = 0
    for (a, b), n in pairs.items():
        if n * 2 < min(len(weights[a]), len(weights[b])):
            continue  # similarity is below a half
        names = {s: i for i, s in enumerate(sorted({*weights[a], *weights[b]}))}
        sides = [(np.array(sorted(names[s] for s in w), np.uint64), np.array([v for _, v in sorted((names[s], v) for s, v in w.items())])) for w in (weights[a], weights[b])]
        if minhash.probability_jaccard(*sides[0], *sides[1]) >= 0.8:
            links += 1
            assert got[a] == got[b]
    assert links > 50


def test_one_long_row_is_like_many():
    """Names, weights and signatures of a row do not hang on the path for single rows."""
    draw = np.random.default_rng(1)
    code = draw.integers(0, 50, 300).astype(np.uint64)
    one = minhash.weighted(np.zeros(300, np.int64), code)
    two = minhash.weighted(np.repeat([0, 1], 300), np.r_[code, code])
    half = len(one[1])
    assert (one[0] == 0).all() and (two[1][half:] == one[1]).all() and (two[2][:half] == one[2]).all()
    a, b = minhash._class(*one, 1), minhash._class(*two, 2)
    assert a[0][0] == b[0][0] == b[0][1] and a[1][0] == b[1][1]
    assert (minhash.prob_minhash(*one, 1, 72)[0] == minhash.prob_minhash(*two, 2, 72)[1]).all()


def test_empty_tables(spark, empty):
    rows = empty.withColumns({c: F.lit(1) for c in ("spans", "score", "held_out", "predicted")})
    assert secrets.secrets_digest(secrets.find_secrets(rows)).count() == 0
    none = quality.train_quality(rows, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score_quality(rows, none, score_col="score_2").count() == 0
    assert minhash.drop_near_duplicates(rows).count() == 0 and suffix_dedup.repeats_digest(suffix_dedup.remove_repeats(rows)).count() == 0
