"""Every operator against a brute-force version on small tables with nulls, empty texts, ties, repeats and extra columns."""

import html
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attnloom.llm import html_text, licenses, mixing, near_vectors, neighbours, ngram_join, packing, secrets, token_files, toxicity
from attnloom.llm.components import components
from attnloom.llm.encoding import Encoder, encoder, tokenizer_path
from attnloom.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component int"
chance = random.Random(5)


def sentence(n):
    return " ".join(chance.choice(["alpha", "Beta,", "gamma", "delta.", "été", "x1"]) + str(chance.randrange(400)) for _ in range(n))


def corpus():
    base = [sentence(80) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):  # near copies with one to eight words changed
        w = chance.choice(base).split()
        for _ in range(chance.randrange(1, 9)):
            w[chance.randrange(len(w))] = "changed" + str(chance.randrange(99))
        rows.append((100 + k, " ".join(w)))
    passage = sentence(40)
    rows += [(200 + k, sentence(30) + " " + passage + "\n" + sentence(20)) for k in range(15)]
    rows += [(300 + k, base[0]) for k in range(20)] + [(400, None), (401, ""), (402, " \n"), (403, "two words"), (404, "TWO words"), (405, sentence(3000))]
    rows += [(500, base[1]), (500, base[1])]
    return [(i, t, "en", [None, "a", "b", "hot", "hot", "hot"][n % 6], len(t or ""), 0.1, 7) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowest(pairs, nodes):
    of = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(of[a], of[b])
            changed |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    return of


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 1500)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 1500)}


def test_exact_check_moves_each_set_once(spark, monkeypatch):
    """Sets travel to their pairs in one shuffle and are in no stored step; pairs keep their order, ids may repeat."""
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[: 50 + i % 11])) for i in range(12)] + [(20, "one two three"), (21, "ONE two three"), (22, "four")]
    rows += [(3, " ".join(f"x{k}" for k in range(30))), (30, " ".join(f"x{k}" for k in range(29))), (3, rows[3][1]), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    ids = sorted({i for i, _ in rows if i is not None})
    wanted = [(a, b) for a in ids for b in ids if a != b and (a + b) % 7]
    steps = []
    store = ngram_join.stored
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "stored", lambda df, label: steps.append((label, df)) or store(df, label))
    got = {tuple(r) for r in ngram_join._checked(table, spark.createDataFrame(wanted, "a long, b long")).collect()}

    sets = [(i, shingles(t)) for i, t in rows]
    linked = {(i, j) for i, p in sets for j, q in sets if i is not None and j is not None and 100 * len(p & q) >= 75 * len(p | q)}
    assert got == linked & set(wanted)
    assert {(3, 30), (30, 3)} <= got
    assert not [label for label, df in steps if "shingles" in df.columns]
    plan = dict(steps)["linked"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "array_intersect" not in plan


def test_jaccard_components(docs, none, rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = lowest(links, sets)
    got = ngram_join.jaccard_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((r[0], len(sets[r[0]]), of[r[0]]) for r in rows)
    kept = ngram_join.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[0] for r in rows if of[r[0]] == r[0]})
    assert ngram_join.jaccard_components(none).collect() == []


def test_packing(docs, none, rows):
    path = tokenizer_path("byte_bpe_50k.json")
    encoder = Encoder(path).tokenizer
    expected = []
    for i, text, *_ in rows:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        expected += [(i, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    got = packing.packed_documents(docs, path, 64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == sorted(expected)
    total = 0
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at, total = 0, total + 1
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 64
    lengths = np.array([r.length for r in got])
    assert packing.least_bins(lengths, 64) <= total <= packing.least_bins(lengths, 64) * 1.1 + 1
    assert packing.packed_documents(none, path).collect() == []


@pytest.mark.parametrize("sizes", [[6, 6, 6, 4, 4, 4], [7] * 5, [5] * 6, [10], [], [3] * 7, [6, 5, 5, 4]])
def test_bounds_never_exceed_the_best(sizes):
    best = 0 if not sizes else next(n for n in range(1, 10) if any(all(sum(s for s, b in zip(sizes, at, strict=True) if b == k) <= 10 for k in range(n)) for at in itertools.product(range(n), repeat=len(sizes))))
    lengths = np.array(sizes, np.int64)
    assert packing.least_bins(lengths, 10) <= best <= packing.best_fit(lengths, 10)[2]


def test_mixing(docs, none, rows):
    got = mixing.mixed(docs).collect()
    sizes = {}
    for _, text, _, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left, free = left - sum(2 * sizes[s] for s in over), free - over
    assert len(set(sizes.values())) == len(names)
    of_size = {n: s for s, n in sizes.items()}
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        assert r.target in [pytest.approx(target[s]) for s in names]
        taken[of_size[r.source_size]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 100 for s in names)
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert sorted(map(key, mixing.mixed(docs.repartition(7)).collect())) == sorted(map(key, got))
    copies = mixing.mixed_rows(docs)
    assert copies.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in copies.collect()) == sum(r.taken for r in got)
    assert mixing.mixed(none).collect() == []


def test_mixing_repeated_and_sized(spark):
    texts = [(7, "a", "w " * 100)] * 2000 + [(i, "b", "w " * (1 + i % 90)) for i in range(3000)] + [(None, "c", None)] * 3 + [(1, None, "x y")]
    frame = spark.createDataFrame(texts, "doc_id long, source string, text string").repartition(3)
    got = mixing.mixed(frame).collect()
    for size in (200_000, sum(1 + i % 90 for i in range(3000))):
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 100
    assert len(got) == len(texts) and all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    b = [r for r in got if r.source_size != 200_000 and r["size"] > 2]
    share = [np.mean([r.taken == 2 * r["size"] for r in b if low <= r["size"] < low + 30]) for low in (3, 60)]
    assert share[1] > 1.3 * share[0] > 0  # long documents are likelier


def test_columns_of_any_name(spark):
    names = "doc_id long, text string, source string, target int, docs int, bucket int, ranking int, _size int, _at int, score int, spans int, chance int, _band int, missing int, copies int"
    frame = spark.createDataFrame([(i, f"word{i} some more words", "ab"[i % 2], *range(i, i + 12)) for i in range(40)], names)
    marks = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    given = {tuple(r) for r in frame.collect()}
    for out in (mixing.mixed_rows(frame), toxicity.without_toxic(frame, marks), secrets.without_secrets(frame)):
        assert out.columns == frame.columns and {tuple(r) for r in out.collect()} <= given


def test_secrets(spark, none):
    values = ["".join(chance.choices("0123456789abcdef", k=32)) for _ in range(60)]
    texts = [f"été token = {v} end" for v in values] + ["plain words only", None, "", "API_KEY: 'Abc+/=_.-1234' AKIA" + "B2" * 9, "secret=short password=" + "z" * 12]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, spans double")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.secret_scan(frame).collect()}
    for i, text in enumerate(texts):
        base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 12]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
        assert [s for s in found[i] if s[0] != "format"] == sorted(base, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    assert found[60] == found[61] == found[62] == []
    masked = {r.doc_id: r.text for r in secrets.without_secrets(frame).collect()}
    assert masked[0] == "été [secret] end" and masked[61] is None and masked[60] == texts[60]
    assert secrets.secret_scan(none).collect() == []


@pytest.mark.parametrize("task", [secrets._examples, ngram_join._signatures, ngram_join._frequent, ngram_join._fronts(np.zeros(0, np.uint64)), toxicity._places])
def test_workers_of_other_operators_forget_tokenizers(task):
    encoder(tokenizer_path("byte_bpe_50k.json")).encode(["alpha beta"])
    held = pa.RecordBatch.from_pydict({"doc_id": [1], "mix": [2], "toxic": [0], "text": ["password = abcdefgh12345678"]})
    assert sum(b.num_rows for b in task(iter([held]))) or task is ngram_join._frequent
    assert encoder.cache_info().currsize == 0


def test_grammar_keeps_formats_apart():
    codes = ["".join([*"key-", *(chance.choice("0123456789") for _ in range(12)), "-", *(chance.choice("GHIJ") for _ in range(4))]) for _ in range(200)]
    automaton = secrets.Automaton([c.translate(secrets._SHAPE) for c in codes]).merge()
    own = min(automaton.score(c.translate(secrets._SHAPE)) for c in codes)
    assert all(automaton.score(w.translate(secrets._SHAPE)) < own for w in ("ordinarylongword", "http-request.header", "GGGG-0000-key-0000"))


@pytest.mark.parametrize("count", [1, 3, 12])
def test_formats_from_few_credentials(spark, count):
    key = lambda: "".join(chance.choices("GHJKMN", k=8)) + "-" + "".join(chance.choices("0123456789", k=8))
    words = ["".join(chance.choices("etaoinshrdlu", k=chance.randrange(12, 18))) for _ in range(400)]
    words += ["".join(chance.choices("GHJxyzt0123-", k=14)) + "xyzt" for _ in range(200)]
    near, plain = key(), " ".join(words[:200])
    texts = [f"token={key()}" for _ in range(count)] + [plain, " ".join(words[200:]), f"sent {near} by mail"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.secret_scan(frame).collect()}
    assert found[len(texts) - 1] == [("format", 5, 5 + len(near))]
    assert found[count] == found[count + 1] == [] and all(len(found[i]) == 1 for i in range(count))


def test_toxicity_learns_without_held_out_rows(spark, none):
    rows, labels = [], []
    for i in range(1500):
        bad = i % 4 == 0
        w = sentence(40).split()
        if bad:
            w[5:5], w[20:20] = ["nastyword"], ["vilething" + str(chance.randrange(9))]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, "")]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame, marks).collect()}
    for i in range(1500):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in range(1500) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert 0 <= got[5000].score < 0.5 and got[5000].predicted == 0
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(frame, flipped).collect()} == {i: r.score for i, r in got.items()}
    assert toxicity.toxicity(none, marks).collect() == []
    assert {r.predicted for r in toxicity.toxicity(frame, marks.limit(0)).collect()} == {0}


def test_token_files(spark, docs, none, rows):
    path = tokenizer_path("word_bpe_49k.json")
    folder = scratch_path(spark, "files")
    got = token_files.read_token_files(token_files.write_token_files(docs, folder, path), folder).collect()
    encoder, at, expected = Encoder(path).tokenizer, 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert token_files.read_token_files(token_files.write_token_files(none, scratch_path(spark, "files"), path), folder).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    own = Encoder(tokenizer_path(name))
    texts = ["", "a", "foo's bar", "  a  b\n\nc ", "İx, y", "x́y z", "日本 a b", "a\n \nb", "90's 'tis", "\ta b", "a b", "(a) [b]\n", " lead", "trail ", "a.\n\n\nB", "Ünï. ¿Qué? 12ab 3.5e-7"]
    texts += ["".join(chance.choices("ab É.,'\n\t1-é", k=30)) for _ in range(300)]
    assert [e.tolist() for e in own.encode(texts)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_have_the_ids_of_the_file(spark, name):
    library = Tokenizer.from_file(tokenizer_path(name))
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = [w for t in added for w in (t, f"one {t} two{t}\n{t}", t.upper(), f"été{t} 日本", t[:-1], f"{t[0]} {t[1:]}")]
    texts += ["".join(chance.choices(["<|", "endoftext", "|>", "startof", " ", "a", ".", "\n", *added], k=12)) for _ in range(300)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [e.tolist() for e in Encoder(tokenizer_path(name)).encode(texts)] == expected
    assert library.token_to_id("<|endoftext|>") in expected[texts.index("<|endoftext|>")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    folder, at = scratch_path(spark, "files"), 0
    got = {r.doc_id: tuple(r)[1:] for r in token_files.read_token_files(token_files.write_token_files(frame, folder, tokenizer_path(name)), folder).collect()}
    packed = {}
    for r in packing.packed_documents(frame, tokenizer_path(name), 64).collect():
        packed[r.doc_id] = packed.get(r.doc_id, {}) | {r.piece: bytes(r.ids)}
    for i, ids in enumerate(expected):
        ids = np.array([*ids, 2], "<u4").tobytes()
        assert got[i] == (at, len(ids) // 4, zlib.crc32(ids))
        assert b"".join(packed[i][k] for k in sorted(packed[i])) == ids
        at += len(ids) // 4


def vectors():
    made = np.random.default_rng(1)
    base = made.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + k, (base[k % 5] + 0.15 * made.normal(size=8)).tolist()) for k in range(200)]
    rows += [(400 + k, base[0].tolist()) for k in range(30)] + [(500 + k, (2.0 * base[1]).tolist()) for k in range(3)]
    return rows + [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, [None] * 8), (604, [float("inf")] + [1.0] * 7)]


def usable(v):
    return v is not None and None not in v and np.isfinite(v).all() and any(v)


@pytest.mark.parametrize("sizes", [(64, 2048, 8), (6, 10, 3)])
def test_near_vectors(spark, monkeypatch, sizes):
    for name, size in zip(("CELLS", "CHUNK", "BLOCK"), sizes):
        monkeypatch.setattr(near_vectors, name, size)
    rows = vectors()
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if usable(v)}
    pairs = [(a, b) for a, b in itertools.combinations(good, 2) if good[a] @ good[b] >= 0.9]
    of, n = lowest(pairs, [i for i, _ in rows]), {i: 0 for i, _ in rows}
    for p in pairs:
        for i in p:
            n[i] += 1
    frame = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = near_vectors.near_vectors(frame).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, n[i], of[i], of[i] == i) for i, _ in rows)
    assert near_vectors.near_vectors(frame.limit(0)).collect() == []


def test_near_vectors_of_any_norm_and_length(spark):
    base = np.random.default_rng(2).normal(size=(20, 6))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate((v, s) for v in base for s in (1.0, 1e-200, 1e200, 3.0))]
    rows += [(100, [1.0, 0.0]), (101, [2.0, 0.0, 0.0]), (102, [1.0, 0.0, 0.0, 0.0, 0.0, 1e-3])]
    good = {}
    for i, v in rows:
        v = np.pad(np.array(v) / np.abs(v).max(), (0, 6 - len(v)))
        good[i] = v / np.linalg.norm(v)
    pairs = [(a, b) for a, b in itertools.combinations(good, 2) if good[a] @ good[b] >= 0.9]
    of, n = lowest(pairs, list(good)), {i: sum(i in p for p in pairs) for i in good}
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, n[i], of[i], of[i] == i) for i in good)


@pytest.mark.parametrize(("shard", "leaf"), [(8192, 512), (40, 8)])
def test_nearest(spark, shard, leaf):
    rows = vectors()
    good = {i: np.array(v) for i, v in rows if usable(v)}
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    got = neighbours.nearest(frame, frame.filter("id % 100 = 0"), 10, shard=shard, leaf=leaf).orderBy("query_id", "rank").collect()
    for q in (i for i in good if i % 100 == 0):
        expected = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        assert [(pytest.approx(r.score), r.vec_id) for r in got if r.query_id == q] == expected
    assert neighbours.nearest(frame.limit(0), frame, 10).collect() == []


def brute_nearest(rows, k):
    good = [(i, np.array(v)) for i, v in rows if usable(v)]
    width = max(len(v) for _, v in good)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    for q, at in good:
        if q % 100 == 0:
            far = [(np.abs(at - v).max(), i, v) for i, v in good if i != q]
            exact = [(float(m * np.sqrt((((at - v) / (m or 1.0)) ** 2).sum())), i) for m, i, v in far]
            yield q, sorted(exact)[:k]


@pytest.mark.parametrize("kind", ["far from zero", "huge", "tiny", "lengths", "clusters", "repeated"])
def test_nearest_of_any_norm(spark, kind):
    made = np.random.default_rng(3)
    points = made.normal(size=(500, 6))
    if kind == "far from zero":
        points = 1e6 + 0.01 * points
    elif kind == "huge":
        points = points * 1e200
    elif kind == "tiny":
        points = points * 1e-200
    elif kind == "clusters":
        points = points + 100 * np.repeat(made.normal(size=(10, 6)), 50, axis=0)
    rows = [(i, v.tolist()[: 3 + i % 4 if kind == "lengths" else 6]) for i, v in enumerate(points)]
    if kind == "repeated":
        rows += [(7, rows[7][1])] * 200
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    found = {}
    for r in neighbours.nearest(frame, frame.filter("id % 100 = 0"), 10, shard=40, leaf=8).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((pytest.approx(r.score, rel=1e-9), r.vec_id))
    for q, expected in brute_nearest(rows, 10):
        assert found[q] == expected


def test_nearest_skips_cells_and_keeps_recall(spark):
    made = np.random.default_rng(4)
    points = made.normal(size=(2000, 6)) + 50 * np.repeat(made.normal(size=(20, 6)), 100, axis=0)
    cells = neighbours.Cells(points[::100])
    gaps, error = cells.gaps(points)
    own = gaps.argmin(axis=1)
    away = neighbours.differences(points, cells.pivots[own])
    cells.set_rings([(c, 100, away[own == c].min(), away[own == c].max(), error[own == c].max()) for c in range(20)], 40)
    assert cells.others(gaps, error, np.full(2000, 2.0), 1.0).mean() < 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    found = {}
    for r in neighbours.nearest(frame, frame.filter("id % 100 = 0"), 10, factor=0.7, shard=100, leaf=8).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(found[q] & {i for _, i in expected}) / 10 for q, expected in brute_nearest(rows, 10)]
    assert sum(hits) / len(hits) >= 0.9


PAGES = {
    "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now please.</div><article><h1>Head</h1><p>One &amp;\n two.</p>"
    "<div class='related-posts'>More</div><p>Three<br>four</p></article><footer>&copy; me</footer>": "Head\n\nOne & two.\n\nThree four",
    "<body><div id=menu><a href=a>A</a> <a href=b>B</a></div><p>" + "Long text here. " * 20 + "</p><p>" + "And more text. " * 20 + "</p><div><a href=c>c</a></div><div class=comments><p>" + "I disagree. " * 40 + "</p></div>": ("Long text here. " * 20).strip() + "\n\n" + ("And more text. " * 20).strip(),
    "": "",
    "<script>var t='</p>';</script><!-- x -->": "",
}


def test_pages(spark):
    frame = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate(PAGES)] + [(99, None, None, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(frame).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(PAGES.values())} | {99: ("", 0)}
    assert html_text.extract(frame.limit(0)).collect() == []
    assert html.unescape("&copy;") == "©"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h2><a href=#x>Title</a></h2><p>Body.</p><ul><li><a href=r>Ref one</a></li></ul></article>", "Title\n\nBody.\n\nRef one"),
        ("<article><section id='search-algorithms'><h2 id=related-work>Related work</h2><p>Kept.</p></section><div class='alert'>Take care.</div></article>", "Related work\n\nKept.\n\nTake care."),
        ("<article><p>Kept.</p><div class='share social'>Tweet</div><ul role=navigation><li>Next</li></ul></article>", "Kept."),
        ("<html><head><title>T</title><meta charset=utf-8><body><article><p>No end of head.</p></article>", "No end of head."),
        ("<title>T</title><style>p{}</style><article><p>No head.</p></article>", "No head."),
        ("<article><p>One <svg class='i'/> two.</p><iframe src='x' /><object data='y'/><p>Three.</p><button>Go<p>Four.</p></article>", "One two.\n\nThree.\n\nGo\n\nFour."),
        ("<article><p>One <svg><path d='M0'/><text>no</text></svg>two.</p><script src=x />no</script></article>", "One two."),
    ],
)
def test_article_text_is_kept(page, text):
    assert html_text.main_text(page) == text


LONG = ("Long text here. " * 20).strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # the main text in <div>s beside a teaser card
        (f"<body><nav>Menu</nav><div>{LONG}</div><div>{LONG}</div><article><p>Teaser.</p></article><footer>f</footer>", f"{LONG}\n\n{LONG}\n\nTeaser."),
        # runs of short lines at both ends, and none beyond a gap
        (f"<div>By A</div><div><a href=x>x</a></div><p>Egg</p><p>Milk</p><p>Salt</p><p>{LONG}</p><ul><li>Bake</li><li>Rest</li><li>Cut</li><li>Eat</li></ul><nav>n</nav><p>(c)</p>",
         f"Egg\n\nMilk\n\nSalt\n\n{LONG}\n\nBake\n\nRest\n\nCut\n\nEat"),
        # beside a heavy article light lines are none of its text, short lines of articles are
        (f"<div>Crumbs</div><article><p>{LONG}</p><p>{LONG}</p></article><article><p>Thanks</p></article><div>All rights reserved by the makers of this very page, 2020.</div>", f"{LONG}\n\n{LONG}\n\nThanks"),
    ],
)
def test_windows_act_beside_articles(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # wrappers with names of asides
        (f"<article><h1>Head</h1><div class='elementor-widget'><p>{LONG}</p></div><div class='elementor-widget'><p>{LONG}</p></div></article>", f"Head\n\n{LONG}\n\n{LONG}"),
        (f"<div class='content with-sidebar'><p>{LONG}</p><div class='sidebar'>Side</div></div>", LONG),
        (f"<div class='body has-banner'><p>{LONG}</p></div>", LONG),
        (f"<nav>Menu</nav><div class='widget'><h1>Head</h1><p>{LONG}</p><div class='related-posts'>More</div></div><footer>f</footer>", f"Head\n\n{LONG}"),
        # readers' comments and adverts, however long
        (f"<main><p>{LONG}</p><section id='comments'><p>First!</p></section></main>", LONG),
        (f"<article><p>Short.</p><div id='comments'><p>{LONG}</p><p>{LONG}</p></div></article>", "Short."),
        (f"<article><p>{LONG}</p></article><section id='comments'><article class='comment'><p>No.</p></article><article><p>{LONG}</p></article></section>", LONG),
        (f"<article><p>{LONG}</p><p class='advert'>Buy<p>End.</p><p class='lead advertised'>Kept.</p></article>", f"{LONG}\n\nEnd.\n\nKept."),
        # a long box beside a short article is no wrapper, nor is one of related pages inside
        (f"<article><p>Short.</p><div class='related'><p>{LONG}</p></div></article>", "Short."),
        (f"<article><p>Short.</p></article><div class='sidebar'><p>{LONG}</p><p>{LONG}</p></div>", "Short."),
        # articles inside a list of other pages; headers that never end
        (f"<article><p>{LONG}</p></article><section class='related-posts'><article><p>Card.</p></article><article><p>Card.</p></article></section>", LONG),
        (f"<header><p>Site</p><article><p>{LONG}</p></article>", LONG),
        # very deep elements
        ("<div class='sidebar'>" * 20000 + "x", "x"),
    ],
)
def test_names_do_not_make_asides_of_wrappers(page, text):
    assert html_text.main_text(page) == text


def test_licences(spark, none):
    texts = [sentence(12) + ".\nReleased under the MIT License.\n" + sentence(20), "Licensed under the Apache License, Version 2.0.", sentence(60), None, "", "MIT!! MIT!!"]
    texts += [sentence(chance.randrange(5, 60)) for _ in range(200)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(x.family, texts[r.doc_id][x.start : x.end].strip()) for x in r.licences] for r in licenses.license_scan(frame).collect()}
    assert got[0] == [("mit", "Released under the MIT License.")] and got[1] == [("apache", "Licensed under the Apache License, Version 2.0.")]
    assert all(not own for i, own in got.items() if i > 1)
    assert licenses.license_scan(none).collect() == []


def test_regression_decides_the_family():
    def chances(**of):
        return np.array([of.get(c.replace("-", "_"), 0.0) for c in licenses.CLASSES])

    other = "You may use these files as the licence of the institute at Cambridge, Massachusetts allows."
    assert licenses._family(other, chances(mit=0.95, none=0.05))[0] == "mit"
    assert licenses._family(other, chances(mit=0.7, gpl=0.3))[0] == "unknown"
    assert licenses._family("Released under the MIT License.", chances(mit=0.7, gpl=0.3)) == ("mit", 1.0)
    assert licenses._family("Released under the MIT License.", chances(mit=0.4, gpl=0.35, bsd=0.25))[0] == "unknown"
    assert licenses._family("Released under the MIT License.", chances(unknown=0.8, mit=0.2))[0] == "unknown"


def test_families_of_templates_and_others(spark):
    texts = [t + "." for ts in licenses.TEMPLATES.values() for t in ts] + ["Licensed under the Zebra license.", "Subject to the Quux public license version 7."]
    texts += [sentence(chance.randrange(5, 60)) for _ in range(200)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [x.family for x in r.licences] for r in licenses.license_scan(frame).collect()}
    expected = [[f] for f, ts in licenses.TEMPLATES.items() for _ in ts] + [["unknown"]] * 2 + [[]] * 200
    assert [got[i] for i in range(len(texts))] == expected


def test_statements_over_lines_short_ones_and_copies(spark):
    wrapped = "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."
    long = sentence(70).replace(".", "") + " Released under the MIT License " + sentence(70).replace(".", "")
    texts = [wrapped, sentence(9) + "\n\n" + wrapped + "\n\n" + sentence(9), "MIT License", "License: MIT", "GNU GPL v3", "subject to the terms of the\nMozilla Public License, v. 2.0", long, "The MIT is in Cambridge", "MIT!! MIT!!", "To the ershnd.", "THIS!!", "BY,!!", "is is is is is is"]
    copies = [sentence(30)] * 400
    frame = spark.createDataFrame(list(enumerate([*texts, *copies, *(sentence(chance.randrange(5, 60)) for _ in range(200))])), "doc_id long, text string")
    got = {r.doc_id: [(x.family, x.start, x.end) for x in r.licences] for r in licenses.license_scan(frame).collect()}
    own = {i: [(f, texts[i][a:b].strip()) for f, a, b in got[i]] for i in range(len(texts))}
    assert own[0] == own[1] == [("cc-by-nc", wrapped)]
    assert [own[i] for i in (2, 3, 4)] == [[("mit", texts[2])], [("mit", texts[3])], [("gpl", texts[4])]]
    assert own[5] == [("mpl", texts[5])]
    assert [f for f, _ in own[6]] == ["mit"] and "MIT License" in own[6][0][1]
    assert not any(got[i] for i in range(7, len(got)))


def test_short_runs_and_rests_are_scored():
    class Known:
        automata = [None]

        def matches(self, value):
            return value in ("Kq7-Zx81-Pw3", "00112233445566aa-XYZ9", "GHIJ-KLMN-OPQ")

    text = "see Kq7-Zx81-Pw3 and 00112233445566aa-XYZ9 or 00112233445566bbGHIJ-KLMN-OPQ"
    got = [(text[s:e], secrets.KINDS[k]) for s, e, k in secrets.spans_of(text, Known())]
    assert got == [("Kq7-Zx81-Pw3", "format"), ("00112233445566aa", "hex"), ("-XYZ9", "format"), ("00112233445566bb", "hex"), ("GHIJ-KLMN-OPQ", "format")]
