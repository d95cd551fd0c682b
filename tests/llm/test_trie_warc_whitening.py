"""Conversation trie, archives and whitening against brute force, with nulls, ties, repeats, long inputs and clashing columns."""

import base64
import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from attnloom.llm import prefix_trie, warc, whitening
from attnloom.session import scratch_path, shared_dir

chance = random.Random(11)
TURNS = "conv_id long, turn long, role string, text string, node string, parent int, depth int, part int, place int"
PAGES = "page_id long, url string, html string, row long, frame string, payload string"
VECTORS = "vec_id long, embedding array<float>, x int, component int, n int"


def key(row):
    return repr(tuple(row))


# ------------------------------------------------------------ trie


def trie_of(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0), tie, role, text))
    convs = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        head = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        rebuilt[c] = tuple(convs.get(base, [])[:head] + own[head:])
    ids = {(): 0}  # sequences as numbers of (number of all but the last, last)
    members, ends, above, size = collections.defaultdict(list), collections.defaultdict(list), {0: None}, {0: 0}
    depth = {0: 0}
    for c, turns in rebuilt.items():
        at = 0
        members[0].append(c)
        for turn in turns:
            child = ids.setdefault((at, turn), len(ids))
            above[child], size[child], depth[child] = at, len(turn[1].encode()), depth[at] + 1
            at = child
            members[at].append(c)
        ends[at].append(c)
    kids = collections.Counter(a for a in above.values() if a is not None)
    leaves, saved = collections.Counter(), collections.Counter()
    for node in sorted(members, key=lambda v: -depth[v]):
        leaves[node] += not kids[node]
        saved[node] += (len(members[node]) - 1) * size[node]
        if above[node] is not None:
            leaves[above[node]] += leaves[node]
            saved[above[node]] += saved[node]
    return [
        (min(m), depth[v], None if above[v] is None else min(members[above[v]]), len(m), kids[v], leaves[v], saved[v],
         hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest())
        for v, m in members.items()
    ]


def conversations():
    rows = []
    for c in [*range(60), *range(-12, 0), 1003, 10**18]:
        rows += [(c, t, chance.choice(["user", None, "tool"]), chance.choice(["a", "b", "été", "", None])) for t in range(chance.randrange(1, 14))]
    rows += [(200, t, "user", "x" * (t % 3)) for t in range(2500)]  # a long chain, over two buckets of places
    rows += [(205 + 5 * k, 0, "user", "same") for k in range(40)]  # many with one common turn
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "bot", "tie"), (7, None, "user", "first"), (None, 0, "user", "nowhere")]
    rows += [(300, 1, "user", "again")] * 2100  # one row, repeated beyond a bucket
    rows += [(401, 0, "user", "z" * 300_000)]
    return rows


def test_trie(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "n", 1, 2, 3, 4) for r in rows], TURNS).repartition(3)
    got = [tuple(r) for r in prefix_trie.conversation_trie(df).collect()]
    assert sorted(got, key=key) == sorted(trie_of(rows), key=key)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.conversation_trie(none).collect() == []
    only = spark.createDataFrame([(None, 0, "user", "x", "n", 1, 2, 3, 4)], TURNS)
    assert prefix_trie.conversation_trie(only).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "brush"])
def test_subtree_totals(spark, shape):
    n = 300
    above = {
        "chain": [None, *range(n - 1)],
        "star": [None] + [0] * (n - 1),
        "random": [None, None] + [chance.randrange(max(1, i - 9), i + 1) - 1 for i in range(2, n)],
        "brush": [None] + [i - 1 if i < n // 2 else i - n // 2 for i in range(1, n)],
    }[shape]
    level = []
    for p in above:
        level.append(0 if p is None else level[p] + chance.randrange(1, 4))
    weight = [chance.randrange(100) for _ in above]
    kids = collections.Counter(p for p in above if p is not None)
    nodes = spark.createDataFrame([(bytes([i // 256, i % 256]), p if p is None else bytes([p // 256, p % 256]), level[i], kids[i], weight[i]) for i, p in enumerate(above)],
                                  "node binary, parent binary, level long, kids long, w long")
    want = list(weight)
    for i in sorted(range(n), key=lambda i: -level[i]):
        if above[i] is not None:
            want[above[i]] += want[i]
    got = {r["node"][0] * 256 + r["node"][1]: r["w"] for r in prefix_trie.subtree_totals(nodes, ["w"]).collect()}
    assert got == dict(enumerate(want))


# ------------------------------------------------------------ archives


def pages(n=400):
    words = ["<p>", "</p>", "<div class='x'>", "text", "link", "über", "\r\n\r\n", "WARC/1.1"]
    rows = [(i, f"http://host/{i}?a b\n\tc" if i % 50 == 0 else f"http://host/{i}", " ".join(chance.choice(words) + str(chance.randrange(90)) for _ in range(60))) for i in range(n)]
    rows += [(1000 + i, None, rows[3][2]) for i in range(30)] + [(2000, "u", None), (2001, "u", ""), (None, "u", "no id"), (None, None, "no id"), (None, "v", "alone")]
    rows += [(3000, "u", "twice"), (3000, "u", "twice"), (3000, "w", "twice"), (4000, "u", "long " * 400_000)]
    return rows


def archived(spark, rows, folder):
    df = spark.createDataFrame([(*r, 1, "f", "p") for r in rows], PAGES).repartition(3)
    archives = warc.write_archives(df, folder)
    return archives, [tuple(r) for r in warc.read_archives(archives, folder).collect()]


def expected(rows):
    groups = collections.defaultdict(list)
    for page_id, _, text in rows:
        groups[text or ""].append(-1 if page_id is None else page_id)
    out = []
    for text, ids in groups.items():
        data, ids = text.encode(), sorted(ids, reverse=True)
        own = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = None if ids[0] < 0 else ids[0]
        out += [(None if i < 0 else i, len(data), own, "revisit" if k else "response", first if k else None) for k, i in enumerate(ids)]
    return out


def test_archives(spark):
    rows, folder = pages(), scratch_path(spark, "warc")
    archives, got = archived(spark, rows, folder)
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    seen, named = {}, []
    for a in archives.collect():
        data = open(f"{folder.removeprefix('file:')}/{a['archive']}", "rb").read()
        assert len(data) == a["bytes"]
        content, at = warc.read_dictionary(data)
        assert content and data[:4] == bytes.fromhex("5d2a4d18")
        count = 0
        while at < len(data):  # every record is a frame of its own
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)).decompressobj()
            text = reader.decompress(data[at:])
            at = len(data) - len(reader.unused_data)
            head = dict(line.split(": ", 1) for line in text.split(b"\r\n\r\n", 1)[0].decode().split("\r\n")[1:])
            assert text.endswith(b"\r\n\r\n") and head["WARC-Record-ID"] not in seen
            seen[head["WARC-Record-ID"]] = head.get("X-Page-Id")
            if head["WARC-Type"] == "revisit":
                named.append((head["WARC-Refers-To"], head.get("X-Refers-To-Page-Id")))
            count += 1
        assert count == a["records"]
    assert len(seen) == len(rows) and all(seen[i] == page for i, page in named)
    plain = sum(len((t or "").encode()) for _, _, t in rows[:400])
    assert sum(a["bytes"] for a in archives.collect()) < plain


def test_archives_keep_short_payloads_apart(spark):
    rows, folder = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer text"), (4, "d", "longer text")], scratch_path(spark, "warc")
    df = spark.createDataFrame([(*r, 1, "f", "p") for r in rows], PAGES)
    archives = warc.write_archives(df, folder, least_bytes=5)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(archives, folder).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_no_archives(spark):
    _, got = archived(spark, [], scratch_path(spark, "warc"))
    assert got == [] and shared_dir(spark)


def test_damaged_archive(spark):
    folder = scratch_path(spark, "warc")
    archives, _ = archived(spark, pages(40), folder)
    name = archives.first()["archive"]
    path = f"{folder.removeprefix('file:')}/{name}"
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data[:-40])
    with pytest.raises(Exception):
        warc.read_archives(archives, folder).collect()


# ------------------------------------------------------------ whitening


def faddeev(m):
    """Coefficients of det(x - m), lowest power first, in whole numbers."""
    d = len(m)
    m = np.array(m, object)
    c, held = [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        held = m.dot(held) + c[-1] * np.identity(d, dtype=object)
        c.append(-sum(m.dot(held)[i, i] for i in range(d)) // k)
    return c[::-1]


def gram(rows, d, low=-9, high=9):
    x = np.array([[chance.randrange(low, high + 1) for _ in range(d)] for _ in range(rows)], object)
    return [[int(v) for v in r] for r in x.T.dot(x)]


@pytest.mark.parametrize("matrix", [gram(9, 6), gram(3, 6), [[5, 0, 0], [0, 5, 0], [0, 0, 2]], [[0, 0], [0, 0]], [[7]], gram(8, 4, -(10**12), 10**12)])
def test_characteristic_polynomial(spark, matrix):
    c = whitening.characteristic_polynomial(spark, matrix)
    assert c == faddeev(matrix)
    values = sorted(np.linalg.eigvalsh(np.array(matrix, float)), reverse=True)
    found = whitening.largest_roots(c, 4)
    positive = [v for v in values if v > 1e-9 * max(1.0, values[0])][: sum(k for _, k in found)]
    flat = [float(r) for r, k in found for _ in range(k)][: len(positive)]
    assert np.allclose(flat, positive, rtol=1e-9)
    for root, times in found:
        axes = whitening.null_space(matrix, root, times)
        assert np.allclose(axes @ axes.T, np.eye(times), atol=1e-12)
        assert np.allclose(axes @ np.array(matrix, float), float(root) * axes, atol=1e-9 * float(root))


def test_multiple_root():
    found = whitening.largest_roots(faddeev([[5, 0, 0], [0, 5, 0], [0, 0, 2]]), 3)
    assert [k for _, k in found] == [2, 1] and all(abs(r - w) < Fraction(1, 10**30) for (r, _), w in zip(found, (5, 2), strict=True))


def test_exact_sums_of_large_entries():
    x = np.array([[chance.randrange(-(1 << 62), 1 << 62) for _ in range(3)] for _ in range(700)], np.int64)
    assert (whitening.cross_sums(x) == x.astype(object).T.dot(x.astype(object))).all()


def vectors():
    gen = np.random.default_rng(4)
    rows = [(i, [float(v) for v in gen.normal(size=6) * [3, 2, 1, 1, 0.5, 0]]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(50)] + [(500, rows[1][1]), (500, rows[1][1]), (None, rows[2][1])]
    return rows, [(600, None), (601, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (602, [float("nan")] * 6), (603, [float("inf")] + [0.0] * 5), (604, []), (605, [1.0, 2.0])]


def test_whitening(spark):
    rows, odd = vectors()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows + odd], VECTORS).repartition(3)
    got = whitening.whitened(df).collect()
    x = np.floor(256 * np.array([np.float32(v) for _, v in rows], float))
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    values, axes = np.linalg.eigh((u - u.mean(0)).T @ (u - u.mean(0)) / n)
    want = ((x - s / n) @ axes[:, ::-1][:, :4]) / np.sqrt(values[::-1][:4])
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    for k in range(4):
        own = [r for r in got if r["component"] == k + 1]
        assert np.allclose([r["explained"] for r in own], values[::-1][k] / values.sum(), rtol=1e-9)
        column = collections.defaultdict(set)
        for (i, _), w in zip(rows, want[:, k], strict=True):
            column[i].add(w)
        sign = next(np.sign(r["whitened"] * next(iter(column[0]))) for r in own if r["vec_id"] == 0)
        assert all(min(abs(sign * r["whitened"] - w) for w in column[r["vec_id"]]) < 1e-7 for r in own)
    deviations = collections.Counter((i, int(((n * v - s) ** 2).sum())) for (i, _), v in zip(rows, x, strict=True))
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviations
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_edges(spark):
    def run(rows):
        return whitening.whitened(spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTORS)).collect()

    assert run([]) == [] and run([(1, [1.0, 2.0])] * 3) == [] and run([(1, None)]) == [] and run([(1, [])]) == []
    two = run([(1, [0.0, 1.0]), (2, [1.0, 1.0])])  # one direction with variance
    assert {r["component"] for r in two} == {1} and sorted(abs(r["whitened"]) for r in two) == [1.0, 1.0]
    square = run([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])])  # equal eigenvalues
    assert len(square) == 8 and max(r["identity_error"] for r in square) < 1e-12
    far = run([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [5.0, 9.0])])
    assert [r["deviation"] is None for r in far] == [r["vec_id"] < 3 for r in far] and all(np.isfinite(r["whitened"]) for r in far)


def test_queries(spark):
    for query in (prefix_trie.op11_conversation_trie, warc.op12_warc, whitening.op13_embedding_whitening):
        assert query(spark, "/root/testdata/sf0.001").select(F.count("*")).first()[0]
