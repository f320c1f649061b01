"""Operator 2: scoring by a hashed maximum-entropy language model with a class-factored softmax.

Words lie in classes, these in classes of classes, and so on: a tree in which a node has up to
``WIDE`` children of about equal frequency, so that a frequent word is few steps from the root.
P(word | history) is the product of the steps down, each a softmax over a node's children. A
word of the broadcast table is a leaf by itself. All others, seen or not, share one leaf, below
which a word's hash leads to one of the far leaves; there is one for every ``LEAF`` such words
of the counted vocabulary, so that their depth grows with the input. Only the few words of a
far leaf share its probability by their smoothed counts, which come by a join.

Each softmax is a maximum-entropy model: the log unigram plus one row of weights for each
feature of the history, found by hashing the words' own hashes with the node: the word before
and, for the first step, also the two before together and skips to the second and third
before. The number of rows grows with the vocabulary.

Counts, vocabulary and training cover all learning documents. Each partition makes AdaGrad
updates over its own tokens; the partitions' weights meet in a two-level tree of averages,
each row weighted by how often the partition has updated it. Scoring goes in sparse numpy
batches: only the rows that a batch's features name are gathered. Counts of words that are
too rare for the broadcast table come by a join.

The unigram base and the model take the same tokens: lower-cased words and an end each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, materialize, mix64, slices, word_hashes

#: Children of a node. Features of the first step, and of the others: places in ``history``.
WIDE, FIRST, LATER = 16, (0, 1, 2, 3), (0,)
#: Words with counts at every scorer, at most; counts of others come by a join.
TABLE = 1 << 18
#: Words for each far leaf, on average, at most.
LEAF = 4
#: Rows of weights at least, and for each root of the number of words.
LEAST_ROWS, ROWS = 1 << 17, 64
RATE, BATCH, PRIOR = 0.8, 4096, 0.1
END = np.uint64(0xE2D0E2D0E2D0E2D1)
#: Rows of weights that travel together.
CHUNK = 1 << 12
#: Leading bits of a hash that lead to its place in the table.
_PLACE = 21


def token_stream(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of an Arrow string column, each row's words and an end, and the number of tokens of each row."""
    words, n = word_hashes(column)
    ends = np.cumsum(n + 1) - 1
    out = np.full(len(words) + len(n), END, dtype=np.uint64)
    place = np.ones(len(out), dtype=bool)
    place[ends] = False
    out[place] = words
    return out, n + 1


def count_words(docs: DataFrame) -> DataFrame:
    """(w, c): tokens of all texts by hash. Partitions count for themselves first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts: list = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            w, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return w, np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

        def rows() -> Iterator:
            w, c = merged()
            parts.clear()
            for k in range(0, len(w), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(w[k : k + (1 << 16)].view(np.int64)), pa.array(c[k : k + (1 << 16)])], names=["w", "c"])

        for batch in batches:
            for part in slices(batch, "text"):
                parts.append(np.unique(token_stream(part["text"])[0], return_counts=True))
                if len(parts) > 8:
                    parts[:] = [merged()]
                    if len(parts[0][0]) > 1 << 22:
                        yield from rows()
        if parts:
            yield from rows()

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words (hash order), with counts and ranks, totals, and the tree; counts of bins below ``least`` are not here.

    ``path`` and ``child`` have a row for each leaf, by rank, and one for all words that are not
    here: the nodes from the root down (-1 beyond the leaf) and the child taken at each.
    """

    word: np.ndarray
    count: np.ndarray
    rank: np.ndarray
    total: int
    distinct: int
    least: int = 1 << 30

    def __post_init__(self) -> None:
        mass = np.zeros(len(self.word) + 1)
        mass[self.rank] = self.count
        mass[-1] = self.total - int(self.count.sum()) + PRIOR * (self.distinct - len(self.word) + 1)
        self.bias, self.path, self.child = _tree(mass)
        self.far_depth = 0
        while LEAF * WIDE**self.far_depth < self.distinct - len(self.word):
            self.far_depth += 1
        self.far_leaves = WIDE**self.far_depth
        self.rows = -(-max(LEAST_ROWS, ROWS * int(self.distinct**0.5)) // CHUNK) * CHUNK
        self._first: np.ndarray | None = None

    def far_leaf(self, tokens: np.ndarray) -> np.ndarray:
        return ((tokens >> np.uint64(1)) % np.uint64(self.far_leaves)).astype(np.int64)

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Index of each token, -1 if it isn't here. The leading bits lead to the first word that has them; the few others follow it."""
        out = np.full(len(tokens), -1, dtype=np.int64)
        if not len(self.word):
            return out
        if self._first is None:
            self._first = np.searchsorted(self.word, np.arange(1 << _PLACE, dtype=np.uint64) << np.uint64(64 - _PLACE)).astype(np.int32)
        at = self._first.take((tokens >> np.uint64(64 - _PLACE)).astype(np.int32))
        who = np.arange(len(tokens))
        while len(who):
            there = at < len(self.word)
            who, at = who[there], at[there]
            found, wanted = self.word.take(at), tokens.take(who)
            hit = found == wanted
            out[who[hit]] = at[hit]
            more = found < wanted
            who, at = who[more], at[more] + 1
        return out

    def steps(self, tokens: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """By level: which token, row of the bias, the node's key, and child taken. ``at`` are the tokens' places here."""
        leaf = np.full(len(at), len(self.word), dtype=np.int64)
        leaf[at >= 0] = self.rank[at[at >= 0]]
        path, child, out = self.path.take(leaf, axis=0), self.child.take(leaf, axis=0), []
        for k in range(path.shape[1]):
            who = np.flatnonzero(path[:, k] >= 0)
            node = path[who, k]
            out.append((who, node, node.astype(np.uint64), child[who, k]))
        far = np.flatnonzero(at < 0)
        last, leaf, first = len(self.bias) - 1, self.far_leaf(tokens[far]), len(self.bias)
        for k in range(self.far_depth):
            prefix = leaf // WIDE ** (self.far_depth - k - 1)
            out.append((far, np.full(len(far), last, dtype=np.int32), (first + prefix // WIDE).astype(np.uint64), (prefix % WIDE).astype(np.int8)))
            first += WIDE**k
        return [x for x in out if len(x[0])]


def _tree(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Biases of the nodes (a last row of zeros for far ones), and each leaf's path and children, for leaves of this mass in this order.

    A node of up to ``WIDE`` leaves has them as children; others are cut at the leaf nearest to
    each ``WIDE``-th of their mass. Children without a leaf have no mass worth naming.
    """
    whole = np.concatenate([[0], np.cumsum(mass)])
    lo, hi, node, made = np.array([0]), np.array([len(mass)]), np.array([0]), 1
    part = np.arange(1, WIDE)
    biases, paths, children = [], [], []
    while len(lo) and len(mass) > 1:
        goal = whole[lo][:, None] + (whole[hi] - whole[lo])[:, None] * part / WIDE
        cut = np.searchsorted(whole, goal).clip(1, len(mass))
        cut -= goal - whole[cut - 1] < whole[cut] - goal
        cut = np.where((hi - lo <= WIDE)[:, None], lo[:, None] + part, cut).clip(lo[:, None], hi[:, None])
        edge = np.concatenate([lo[:, None], cut, hi[:, None]], axis=1)
        own = np.diff(whole[edge], axis=1)
        biases.append(np.where(np.diff(edge, axis=1) > 0, np.log(np.maximum(own, 1e-9) / own.sum(axis=1, keepdims=True)), -60.0).astype(np.float32))
        size = hi - lo
        seg = np.repeat(np.arange(len(lo)), size)
        leaf = lo[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size)
        paths.append(np.full(len(mass), -1, dtype=np.int32))
        paths[-1][leaf] = node[seg]
        children.append(np.zeros(len(mass), dtype=np.int8))
        for k in range(WIDE - 1):
            children[-1][leaf] += leaf >= cut[seg, k]
        a, z = edge[:, :-1].ravel(), edge[:, 1:].ravel()
        inner = z - a > 1
        lo, hi = a[inner], z[inner]
        node, made = made + np.arange(len(lo)), made + len(lo)
    wide = lambda rows, kind: np.stack(rows, axis=1) if rows else np.zeros((len(mass), 0), dtype=kind)
    return np.concatenate([*biases, np.zeros((1, WIDE), dtype=np.float32)]), wide(paths, np.int32), wide(children, np.int8)


def count_bin():
    return F.floor(F.log2("c") * 16).cast("int")


def vocabulary(counts: DataFrame, most: int = TABLE) -> Vocabulary:
    """The words above a count that not more than ``most`` words reach, found from a histogram of counts (a few hundred bins)."""
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    step = count_bin()
    bins = counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    held, least = 0, 1 << 30
    for r in sorted(bins, key=lambda r: -r.b):
        if held + r.n > most:
            break
        held, least = held + r.n, r.b
    kept = counts.where(step >= least).toPandas()
    word, count = kept.w.to_numpy(dtype=np.int64).view(np.uint64), kept.c.to_numpy(dtype=np.int64)
    order = np.argsort(word)
    word, count = word[order], count[order]
    rank = np.empty(len(word), dtype=np.int64)
    rank[np.lexsort((word, -count))] = np.arange(len(word))
    return Vocabulary(word, count, rank, int(total or 0), int(distinct), least)


_ODD = [np.uint64(2 * k + 0x9E3779B97F4A7C15) for k in range(4)]
_STEP, _MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def history(tokens: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """For each token, hashes of the word before, the two before together, the second and the third before; of what is before the text too."""
    start = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(tokens)) - start
    back = []
    for j in (1, 2, 3):
        shifted = np.zeros(len(tokens), dtype=np.uint64)  # before the text
        shifted[j:] = np.where(place[j:] >= j, tokens[:-j] if j <= len(tokens) else tokens[:0], np.uint64(0))
        back.append(shifted)
    one, two, three = back
    return [one * _ODD[0], mix64(one) + two * _ODD[1], two * _ODD[2], three * _ODD[3]]


def weight_rows(context: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """Rows of weights of one feature, by its hash and the node's key."""
    x = context ^ (key * _STEP)
    x = (x ^ (x >> np.uint64(29))) * _MIX
    x ^= x >> np.uint64(32)
    return ((x * _ODD[0] >> np.uint64(32)) * np.uint64(rows) >> np.uint64(32)).astype(np.int32)


class Batch:
    """The steps of some tokens: who takes them, rows of the bias, children taken; and for each feature the steps (a range) that have it, with their rows of weights."""

    def __init__(self, v: Vocabulary, tokens: np.ndarray, at: np.ndarray, contexts: list[np.ndarray]):
        levels = v.steps(tokens, at)
        self.parts, begin = [], 0
        for k, (who, _, key, _) in enumerate(levels):
            for f in FIRST if k == 0 else LATER:
                self.parts.append((begin, begin + len(who), weight_rows(contexts[f].take(who), key, v.rows)))
            begin += len(who)
        if levels:
            self.who, self.bias, _, self.child = map(np.concatenate, zip(*levels, strict=True))
        else:
            self.who, self.bias, self.child = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int8)


_ONES = np.ones(WIDE, dtype=np.float32)


class Model:
    """Rows of weights, each with the sum of its squared gradients and the number of its uses."""

    def __init__(self, bias: np.ndarray, rows: int, weights: np.ndarray | None = None):
        self.bias = bias
        self.weights = np.zeros((rows, WIDE), dtype=np.float32) if weights is None else weights
        self.squares, self.uses = np.ones(rows, dtype=np.float32), np.zeros(rows, dtype=np.float32)

    def scores(self, b: Batch) -> np.ndarray:
        """Bias and weights of each step's children, with the largest at 0."""
        z = self.bias.take(b.bias, axis=0)
        for first, stop, rows in b.parts:
            z[first:stop] += self.weights.take(rows, axis=0)
        z -= z.max(axis=1, keepdims=True)
        return z

    def log_probability(self, b: Batch) -> np.ndarray:
        """Of each step."""
        z = self.scores(b)
        own = z[np.arange(len(z)), b.child]
        return own - np.log(np.exp(z, out=z) @ _ONES)

    def update(self, b: Batch) -> None:
        """One AdaGrad step: a row's gradients of the batch count as one."""
        if not len(b.child):
            return
        g = self.scores(b)
        np.exp(g, out=g)
        g /= (g @ _ONES)[:, None]
        g[np.arange(len(g)), b.child] -= 1
        row = np.concatenate([r for _, _, r in b.parts]).astype(np.uint64)
        step = np.concatenate([np.arange(first, stop, dtype=np.uint64) for first, stop, _ in b.parts])
        key = (row << np.uint64(32)) | step
        key.sort()
        row, step = (key >> np.uint64(32)).astype(np.int32), (key & np.uint64(0xFFFFFFFF)).astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        times = np.diff(np.append(first, len(row)))
        total = g.take(step.take(first), axis=0)
        if len(several := np.flatnonzero(times > 1)):
            begin = times[several]
            total[several] = np.add.reduceat(g.take(step[np.repeat(times > 1, times)], axis=0), np.cumsum(begin) - begin)
        row = row.take(first)
        squares = self.squares.take(row) + np.einsum("ij,ij->i", total, total)
        self.squares[row] = squares
        self.uses[row] += times
        total *= (RATE / np.sqrt(squares))[:, None]
        self.weights[row] -= total


def _batches(v: Vocabulary, part) -> Iterator[tuple[slice, Batch]]:
    """Tokens of an Arrow string column by ``BATCH``; the first item is (all tokens, their numbers by row, places in the vocabulary)."""
    tokens, n = token_stream(part)
    at, contexts = v.find(tokens), history(tokens, n)
    yield tokens, n, at
    for k in range(0, len(tokens), BATCH):
        s = slice(k, k + BATCH)
        yield s, Batch(v, tokens[s], at[s], [x[s] for x in contexts])


def train(docs: DataFrame, v: Vocabulary) -> np.ndarray:
    """The model's weights after one pass over all texts.

    Neighbouring partitions train as one where all their weights would outweigh half the texts.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(v)
    docs = docs.coalesce(max(spark.sparkContext.defaultParallelism, v.total * 6 // (2 * v.rows * (4 + 2 * WIDE))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        v = shared.value
        model = Model(v.bias, v.rows)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                work = _batches(v, part["text"])
                next(work)
                for _, b in work:
                    model.update(b)
        me = TaskContext.get().partitionId()
        for k in range(0, v.rows, CHUNK):
            if model.uses[k : k + CHUNK].any():
                payload = model.uses[k : k + CHUNK].astype("<f4").tobytes() + model.weights[k : k + CHUNK].astype("<f2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([me], pa.int64()), pa.array([k // CHUNK], pa.int32()), pa.array([payload], pa.binary())], names=["part", "chunk", "payload"])

    def average(table):
        import pyarrow as pa

        uses, total = np.zeros(CHUNK), np.zeros((CHUNK, WIDE))
        for x in table["payload"]:
            x = x.as_py()
            n = np.frombuffer(x, dtype="<f4", count=CHUNK).astype(np.float64)
            kind = "<f2" if len(x) == CHUNK * (4 + 2 * WIDE) else "<f4"
            uses += n
            total += n[:, None] * np.frombuffer(x, dtype=kind, offset=4 * CHUNK).reshape(CHUNK, WIDE)
        total /= np.maximum(uses, 1)[:, None]
        payload = uses.astype("<f4").tobytes() + total.astype("<f4").tobytes()
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})

    local = materialize(docs.select("text").mapInArrow(run, "part long, chunk int, payload binary"), "lm-weights")
    wide = int(local.agg(F.max("part")).first()[0] or 0) + 1
    groups = max(1, int(wide**0.5))
    schema = "chunk int, payload binary"
    half = local.groupBy("chunk", (F.col("part") % groups).alias("g")).applyInArrow(average, schema)
    out = np.zeros((v.rows, WIDE), dtype=np.float32)
    for r in half.groupBy("chunk").applyInArrow(average, schema).toLocalIterator():  # bounded: the model's size
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(bytes(r.payload), dtype="<f4", offset=4 * CHUNK).reshape(CHUNK, WIDE)
    return out


def _score_pass(docs: DataFrame, v: Vocabulary, weights: np.ndarray) -> DataFrame:
    """Kind 0: a row a document with what is known at once; kind 1: (document, word, times) of words outside the table."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((v, weights))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        v, weights = shared.value
        model = Model(v.bias, v.rows, weights)
        row = TaskContext.get().partitionId() << 36
        unigram = np.log10((v.count + PRIOR) / (v.total + PRIOR * (v.distinct + 1)))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                work = _batches(v, part["text"])
                tokens, n, at = next(work)
                known = at >= 0
                score, base = np.zeros(len(tokens)), np.zeros(len(tokens))
                if len(v.count):
                    base[known] = unigram[at[known]]
                for s, b in work:
                    score[s] = np.bincount(b.who, weights=model.log_probability(b), minlength=len(score[s]))
                score /= np.log(10)
                first = np.cumsum(n) - n
                sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), base, score)]
                m = len(n)
                ids = np.arange(row, row + m)
                row += m
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, dtype=np.int32)), pa.array(ids), part["doc_id"].cast(pa.int64()), pa.array(n), *map(pa.array, sums)], names=["kind", "r", "doc_id", "n", "known", "base", "score"])
                far = np.flatnonzero(~known)
                if len(far):
                    r, w = np.repeat(ids, n)[far], tokens[far]
                    order = np.lexsort((w, r))
                    r, w = r[order], w[order]
                    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])]))
                    times = np.diff(np.append(new, len(r)))
                    m = len(new)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, dtype=np.int32)), pa.array(r[new]), pa.array(w[new].view(np.int64)), pa.array(times), pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.float64())] * 2], names=["kind", "r", "doc_id", "n", "known", "base", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, r long, doc_id long, n long, known long, base double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32 of doc_id mod 10 is not 0 and scores all. Null text
    is empty: one end token. Repeated rows are scored each; without learning documents every
    score is that of an empty vocabulary. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    learning = docs.where(crc32_of_id(F.col("doc_id")) % 10 != 0).select("text")
    counts = materialize(count_words(learning), "lm-counts")
    v = vocabulary(counts)
    weights = train(learning, v)
    found = materialize(_score_pass(docs, v, weights), "lm-scores")
    rows = found.where("kind = 0").drop("kind")
    leaf = lambda w: F.shiftrightunsigned(w, 1) % v.far_leaves
    rare = found.where("kind = 1").select("r", F.col("doc_id").alias("w"), F.col("n").alias("times"), leaf("doc_id").alias("leaf"))
    # A far leaf's few words travel as one row, so that one join gives a word's count and its leaf's.
    leaves = counts.where(count_bin() < v.least).groupBy(leaf("w").alias("_leaf")).agg(F.sum("c").alias("leaf_c"), F.count(F.lit(1)).alias("leaf_n"), F.map_from_entries(F.collect_list(F.struct("w", "c"))).alias("of"))
    rare = rare.join(leaves, F.col("leaf") == F.col("_leaf"), "left").withColumn("c", F.coalesce(F.try_element_at("of", F.col("w")), F.lit(0)))
    share = F.log10(F.col("c") + PRIOR) - F.log10(F.coalesce("leaf_c", F.lit(0)) + PRIOR * (F.coalesce("leaf_n", F.lit(0)) + 1))
    top = F.log10(F.col("c") + PRIOR)
    below = float(np.log10(v.total + PRIOR * (v.distinct + 1)))
    more = rare.groupBy("r").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (top - below)).alias("more_base"),
        F.sum(F.col("times") * share).alias("more_score"),
    )
    out = rows.join(more.withColumnRenamed("r", "_r"), F.col("r") == F.col("_r"), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        "doc_id",
        (crc32_of_id(F.col("doc_id")) % 10 == 0).alias("held_out"),
        F.col("n").alias("n_tokens"),
        plus("known", "more_known").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        plus("score", "more_score").alias("score"),
    )
