"""Nearest neighbours and the Jaccard join against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import components, jaccard, neighbours
from quarrylog.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def brute(ids, x, q, k=10):
    d = np.sqrt(np.square(x - x[list(ids).index(q)]).sum(axis=1))
    m = np.array(ids) != q
    order = np.lexsort((np.array(ids)[m], d[m]))[:k]
    return list(zip(np.array(ids)[m][order].tolist(), d[m][order].tolist(), strict=True))


def recall(rows, ids, x, queries):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in queries:
        want, got = brute(ids, x, q), sorted(found.get(q, []))
        assert [r for r, _, _ in got] == list(range(1, len(want) + 1))
        assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        place = {i: k for k, i in enumerate(ids)}
        for _, v, s in got:
            assert s == pytest.approx(float(np.sqrt(np.square(x[place[v]] - x[place[q]]).sum())), rel=1e-12)
        hits += len({v for v, _ in want} & {v for _, v, _ in got})
        total += len(want)
    return hits / total


def test_neighbours(spark):
    rows = QUERIES["op8_neighbours"](spark, SF).collect()
    data = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in data], np.array([r.embedding for r in data], dtype=np.float64)
    assert recall(rows, ids, x, [i for i in ids if i % 100 == 0]) >= 0.95


def test_neighbours_odd(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "FLOATS", 20)
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 8)).astype(np.float32)
    x[50:150] = x[50]  # one very common vector
    bad = [(1000, None), (1100, [0.0] * 8), (1200, [None, *[1.0] * 7]), (1300, [float("nan"), *[1.0] * 7]), (1400, [float("inf"), *[1.0] * 7]), (None, [1.0] * 8), (1500, [])]
    rows = [(k, [float(v) for v in x[k]]) for k in range(300)]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in [*rows, *bad, (1600, [1.0, 2.0])]], "vec_id long, embedding array<float>, id string, block int")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert {g.query_id for g in got} == set(range(0, 300, 50))
    assert recall(got, list(range(300)), x.astype(np.float64), range(0, 300, 50)) >= 0.9
    assert [g.vec_id for g in sorted(got, key=lambda g: g.rank) if g.query_id == 50] == list(range(51, 61))
    few = neighbours.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(g.vec_id for g in few) == [1, 2, 3]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0 and neighbours.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize(("kind", "width"), [("normal", 64), ("clustered", 64), ("clustered", 16)])
def test_neighbours_verify_few(spark, kind, width):
    """On 50,000 vectors, several blocks: recall, and how few vectors are verified (normal ones have no near neighbours: the hardest case)."""
    r = np.random.default_rng(5)
    n = 50_000
    x = r.standard_normal((n, width))
    if kind == "clustered":
        x = x * 0.4 + r.standard_normal((40, width))[r.integers(0, 40, n)]
    x = x.astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float32()))})
    df = spark.createDataFrame(table).repartition(4)
    rows = neighbours.nearest(df, F.col("vec_id") % 1000 == 0).collect()
    assert recall(rows, range(n), x.astype(np.float64), range(0, n, 1000)) >= 0.95
    verified = {q.query_id: q.verified for q in rows}
    assert len(verified) == 50 and sum(verified.values()) / 50 / n < (0.2 if kind == "normal" else 0.1)


def test_jaccard_query(spark, same_as_sql):
    same_as_sql(QUERIES["op10_ngram_jaccard"](spark, SF), ORACLE_SQL["op10_ngram_jaccard"])


def sets_of(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [sets_of(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least.setdefault(find(k), []).append(d)
    key = lambda k: min((d for d in least[find(k)] if d is not None), default=None)
    return sorted((str(d), len(sets[k]), str(key(k))) for k, (d, _) in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_jaccard_odd(make, odd_rows):
    assert got(jaccard.jaccard_components(make(odd_rows))) == brute_components([r[:2] for r in odd_rows])
    assert jaccard.jaccard_components(make(odd_rows).limit(0)).count() == 0
    docs = make(odd_rows)
    kept = jaccard.keep_one_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert [r.doc_id for r in rows if r.doc_id in (1, 2)] == [1] and sum(not sets_of(r.text) for r in rows) == sum(not sets_of(t) for _, t, *_ in odd_rows)


@pytest.mark.parametrize("side", [4, 20, 1000])
def test_jaccard_hot_group(make, monkeypatch, side):
    """Many near copies around the threshold, of several sizes, with split lists and several components in each."""
    for name, value in (("SHORT", 2), ("PART", 16), ("SIDE", side), ("ROUNDS", 1), ("REACH", 1)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(6)
    base = [f"w{k}" for k in range(70)]
    rows = []
    for k in range(110):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
            w[r.randrange(70)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(f"y{r.randrange(50)}" for _ in range(30)) + " " + " ".join(base[:52])) for k in range(30)]
    rows += [(300 + k, " ".join(base[: 70 - k % 50] + [f"z{k * 100 + j}" for j in range(r.choice([0, 3, 9]))])) for k in range(60)]
    assert got(jaccard.jaccard_components(make(rows))) == brute_components(rows)


def test_jaccard_tiles(spark, monkeypatch):
    """Every pair that the length filter lets pass, with a row outside the largest component, meets in a tile of bounded size; others need not."""
    monkeypatch.setattr(jaccard, "SIDE", 50)
    r = random.Random(8)
    rows = [(t, k, r.randint(1, 4000), 1, -1 if r.random() < 0.7 else k, -1, size) for t, size in ((1, 900), (2, 40)) for k in range(size)]
    tiles = {}
    for x in jaccard._tiles(spark.createDataFrame(rows, "token long, cid long, n long, pos long, comp long, major long, total long")).collect():
        assert x.minor == (x.comp != -1)
        for c in x.copies:
            tiles.setdefault((x.token, c.salt), []).append((x.cid, c.role))
    met = {(t, a, b) for (t, _), members in tiles.items() for a, i in members if i < 2 for b, j in members if j}
    assert max(map(len, tiles.values())) <= 4 * 50 and len(met) < 0.5 * 900 * 900
    for t, a, n, _, _, _, _ in rows:
        for u, b, m, _, comp, _, _ in rows:
            if t == u and a != b and comp != -1 and 100 * n >= 80 * m and 100 * m >= 80 * n:
                assert (t, a, b) in met


def test_components(spark):
    path = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (5000, 4000)]
    rows = components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()
    found = {r.node: r.component for r in rows}
    assert set(found.values()) == {0, 1000, 4000} and len(found) == 201 + 50 + 2
    more = components.merge_components(spark.createDataFrame(list(found.items()), "node long, component long"), spark.createDataFrame([(200, 1003), (1, 9999), (70, 71)], "a long, b long"))
    now = {r.node: r.component for r in more.collect()}
    assert now[1049] == 0 and now[9999] == 0 and now[5000] == 4000 and len(now) == len(found) + 1


def test_may_share_is_a_bound():
    r = np.random.default_rng(2)
    for _ in range(200):
        x, y = (np.unique(r.integers(0, 60, r.integers(1, 60), dtype=np.uint64) << np.uint64(57)) for _ in range(2))
        h = [np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=jaccard.RANGES)[None].astype("<u2") for s in (x, y)]
        if jaccard.linked(x, y):
            assert jaccard.may_share(h[0], np.array([len(x)]), h[1], np.array([len(y)]))[0]
