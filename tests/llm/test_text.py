"""Language model, token counts, packing, language ID and media against brute force."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarrylog.llm import langmodel, language, media, packing, token_counts
from quarrylog.llm.common import word_hashes
from quarrylog.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b  a\n", None, "", " ", "A a aA", "w" * 40_000 + " x", "é\u00a0é é"]
    h, n = word_hashes(pa.array(texts))
    assert n.tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def check_lm(rows, docs):
    texts = [(d, [*words(t), None]) for d, t in docs]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 if d is not None else True for d, _ in texts}
    c = Counter(w for d, t in texts if not held[d] for w in t)
    total, kinds = sum(c.values()), len(c)
    want = sorted((str(d), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t), 4), held[d], total) for d, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4), r.held_out, r.train_tokens) for r in rows) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)


def test_lm_query(spark):
    rows = QUERIES["op2_lm_scoring"](spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_lm(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def _vocabulary(kinds, kept, seed=0):
    """Words by falling counts, of which the first ``kept`` are in the table."""
    count = np.maximum(1, 400_000 // np.arange(1, kinds + 1))
    every = langmodel.mix64(np.arange(kinds, dtype=np.uint64) + np.uint64(seed))
    order = np.argsort(every[:kept])
    return langmodel.Vocabulary(every[:kept][order], count[:kept][order], order, int(count.sum()), kinds), every, count


def test_lm_is_a_distribution():
    """Over all leaves, near and far, the probabilities after any history sum to 1, with any weights; without weights they are the counts'."""
    for kinds, kept in ((1, 1), (2, 2), (40, 40), (3000, 3000), (3000, 2990), (3000, 2000), (400_000, 50_000)):
        v, every, count = _vocabulary(kinds, kept)
        if kinds > kept:
            assert np.bincount(v.far_leaf(every[kept:])).max() < 10 * langmodel.LEAF
        leaves = np.arange(v.far_leaves, dtype=np.uint64) << np.uint64(1)  # one hash for each
        tokens = np.concatenate([v.word, leaves])
        at = np.concatenate([np.arange(kept), np.full(len(leaves), -1)])
        b = langmodel.Batch(v, tokens, at, [np.full(len(tokens), 7 + k, dtype=np.uint64) for k in range(4)])
        model = langmodel.Model(v.bias, v.rows)
        plain = np.exp(np.bincount(b.who, weights=model.log_probability(b), minlength=len(tokens)))
        assert np.allclose(plain[np.argsort(v.rank)], count[:kept] / (count.sum() + 0.1 * (kinds - kept + 1)), rtol=1e-3)
        model.weights[:] = np.random.default_rng(1).standard_normal(model.weights.shape)
        assert np.exp(np.bincount(b.who, weights=model.log_probability(b), minlength=len(tokens))).sum() == pytest.approx(1, abs=1e-3)


def test_lm_vocabulary_finds_words():
    v, every, _ = _vocabulary(300_000, 200_000)
    at = v.find(every)
    assert (at[200_000:] == -1).all() and (v.word[at[:200_000]] == every[:200_000]).all()
    few = langmodel.Vocabulary(np.array([1, 2, 5, 2**63], dtype=np.uint64), np.array([4, 3, 2, 1]), np.arange(4), 10, 4)
    assert few.find(np.array([0, 1, 2, 3, 5, 6, 2**63, 2**64 - 1], dtype=np.uint64)).tolist() == [-1, 0, 1, -1, 2, -1, 3, -1]


def test_lm_matches_a_plain_softmax():
    """Batches, sorting and gathering give what a loop over steps, children and features gives: probabilities, then one update."""
    r = np.random.default_rng(3)
    v, every, _ = _vocabulary(500, 300)
    tokens, n = every[r.integers(0, 500, 200)], np.array([120, 80])
    at, contexts = v.find(tokens), langmodel.history(tokens, n)
    model = langmodel.Model(v.bias, v.rows)
    model.weights[:] = r.standard_normal(model.weights.shape) / 3
    weights, got = model.weights.astype(np.float64), np.zeros(200)
    want, gradient = np.zeros(200), {}
    for k in range(200):
        leaf = v.rank[at[k]] if at[k] >= 0 else len(v.word)
        steps = [(int(x), v.bias[x], int(c)) for x, c in zip(v.path[leaf], v.child[leaf], strict=True) if x >= 0]
        first = len(v.bias)
        for d in range(v.far_depth if at[k] < 0 else 0):
            way = int(v.far_leaf(tokens[k : k + 1])[0]) // langmodel.WIDE ** (v.far_depth - d - 1)
            steps.append((first + way // langmodel.WIDE, np.zeros(langmodel.WIDE), way % langmodel.WIDE))
            first += langmodel.WIDE**d
        for d, (node, bias, child) in enumerate(steps):
            rows = [int(langmodel.weight_rows(contexts[f][k : k + 1], np.array([node], dtype=np.uint64), v.rows)[0]) for f in ((0, 1, 2, 3) if d == 0 else (0,))]
            z = np.exp(bias + sum(weights[x] for x in rows))
            p = z / z.sum()
            want[k] += np.log(p[child])
            p[child] -= 1
            for x in rows:
                gradient[x] = gradient.get(x, 0) + p
    b = langmodel.Batch(v, tokens, at, contexts)
    got = np.bincount(b.who, weights=model.log_probability(b), minlength=200)
    assert np.allclose(got, want, atol=1e-4)
    model.update(b)
    for x, g in gradient.items():
        weights[x] -= langmodel.RATE * g / np.sqrt(1 + (g * g).sum())
    assert np.allclose(model.weights, weights, atol=1e-4) and set(np.flatnonzero(model.uses)) == set(gradient)


def test_lm_learns():
    """A node comes near the frequencies that its children have after a word."""
    v = langmodel.Vocabulary(np.arange(1, 5, dtype=np.uint64), np.full(4, 100), np.arange(4), 400, 4)
    y = np.arange(400) % 4 % 3
    contexts = [np.full(400, 9, dtype=np.uint64)] * 4
    model = langmodel.Model(v.bias, v.rows)
    for _ in range(600):
        model.update(langmodel.Batch(v, v.word[y], y, contexts))
    b = langmodel.Batch(v, v.word, np.arange(4), [c[:4] for c in contexts])
    assert np.allclose(np.exp(model.log_probability(b)), [0.5, 0.25, 0.25, 0], atol=0.05)


def test_lm_odd(make, odd_rows):
    check_lm(langmodel.score_documents(make(odd_rows)).collect(), [r[:2] for r in odd_rows])
    assert langmodel.score_documents(make([]).limit(0)).count() == 0


def test_token_edits():
    count = token_counts.counter()
    r = random.Random(5)
    pieces = ["a", " ", "  ", "\n", " b", "don't", "é", "12", "\t", "漢", ".", "\x1c", "\u3000"]
    for _ in range(400):
        s = "".join(r.choice(pieces) for _ in range(r.randint(0, 60)))
        tree = token_counts.TokenTree(s, count, leaf=r.choice([1, 3, 8]))
        for _ in range(5):
            a = r.randint(0, len(s))
            b, new = min(len(s), a + r.randint(0, 8)), "".join(r.choice(pieces) for _ in range(r.randint(0, 20)))
            s = s[:a] + new + s[b:]
            tree.edit(a, b, new)
            assert tree.text() == s and tree.tokens == count(s) and tree.length == len(s)


def test_token_edits_are_local():
    count = token_counts.counter()
    tree = token_counts.TokenTree("some words of plain text " * 4000, count)
    before = tree.encoded
    tree.edit(50_000, 50_005, "other")
    assert tree.encoded - before < 4 * token_counts.LEAF


@pytest.mark.parametrize("kind", ["letters", "mixed", "lines", "ends", "digits", "marks", "scripts", "quotes"])
def test_token_edits_without_spaces(kind):
    """1,000 edits in 100,000 characters re-encode little, and the counts are those of the whole text. (In a run of one character alone all tokens after an edit shift: 20 edits, counts only.)"""
    count, r = token_counts.counter(), random.Random(kind)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    piece = {
        "letters": word, "mixed": lambda: word() + r.choice(["1", "22", ",", "-", ";", "'s", "'"]), "lines": lambda: word() + r.choice("\n\t"), "ends": lambda: "\n" * 9,
        "digits": lambda: str(r.randint(0, 99999)), "marks": lambda: r.choice("!?.,;-_'\"") * r.randint(1, 3), "scripts": lambda: r.choice(["漢字", "かな", "слово", "é\u0301", "🙂", "٣"]), "quotes": lambda: r.choice(["'s", "'re", "'", "a", "ll", "x'd"]),
    }[kind]
    text = ""
    while len(text) < 100_000:
        text += "".join(piece() for _ in range(1000))
    text = text[:100_000]
    tree = token_counts.TokenTree(text, count)
    assert tree.tokens == count(text)
    before, size = tree.encoded, len(text)
    edits = 20 if kind == "ends" else 1000
    for k in range(edits):
        a = r.randint(0, len(text))
        b, new = min(len(text), a + r.randint(0, 6)), piece()[: r.randint(0, 6)]
        text = text[:a] + new + text[b:]
        tree.edit(a, b, new)
        if k % (edits // 4) == 0:
            assert tree.text() == text and tree.tokens == count(text)
    assert tree.tokens == count(text) and (kind == "ends" or tree.encoded - before < 20 * size)


def test_token_counts(spark, make, odd_rows):
    count = token_counts.counter()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for rows, source in ((QUERIES["op4_token_counts"](spark, SF).collect(), docs), (token_counts.count_tokens(make(odd_rows)).collect(), [r[:2] for r in odd_rows])):
        want = []
        for d, t in source:
            edited = t or ""
            for a, b, new in token_counts.scrub_edits(t or ""):
                edited = edited[:a] + new + edited[b:]
            want.append((str(d), len(t or ""), count(t or ""), len(edited), count(edited)))
        assert sorted((str(r.doc_id), r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) for r in rows) == sorted(want)
    assert token_counts.scrub_edits("mail a.b@c.de, 1234567") == [(15, 22, "<NUMBER>"), (5, 13, "<MAIL>")]


def check_packing(rows, docs, window=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in docs)
    sequences = defaultdict(list)
    pieces = defaultdict(lambda: defaultdict(list))
    for r in rows:
        assert len(r.ids) == r.length > 0 and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens][r.start].append(tuple(r.ids))
    for s in sequences.values():
        assert [a for a, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= window
    got = Counter()
    for (d, n), starts in pieces.items():
        flat = Counter()
        for start, found in starts.items():
            for ids in found:
                flat.update((start + k, i) for k, i in enumerate(ids))
        assert {k for k, _ in flat} == set(range(n))
        got[d, n] += sum(flat.values()) // n
    assert got == Counter((d, len(ids)) for (d, ids), m in want.items() for _ in range(m))
    texts = defaultdict(set)
    for d, ids in want:
        texts[d].add(ids)
    for (d, n), starts in pieces.items():
        if len(texts[d]) == 1 and all(len(x) == 1 for x in starts.values()):
            assert tuple(i for s in sorted(starts) for i in starts[s][0]) in texts[d]
    fills = [sum(n for _, n in s) for s in sequences.values()]
    return sum(0 if f & (f - 1) == 0 else window - f for f in fills)


def test_packing(spark, make, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check_packing(packing.pack(docs, with_ids=True).collect(), [(r.doc_id, r.text) for r in docs.collect()]) == 0
    assert check_packing(packing.pack(make(odd_rows), with_ids=True).collect(), [r[:2] for r in odd_rows]) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_bounds_open_windows():
    out = []
    p = packing.SumOfSquares(64, 0, lambda *x: out.append(x), most_open=5)
    r = random.Random(2)
    docs = [np.full(r.randint(1, 150), k, dtype="<u4") for k in range(400)]
    for k, ids in enumerate(docs):
        p.add(k, ids)
        assert p.n <= 6
    p.finish()
    assert sum(len(x[0][2]) for x in out) == sum(map(len, docs))
    fills = Counter()
    for (_, _, ids), s, _ in out:
        fills[s] += len(ids)
    assert all(f == 64 or f & (f - 1) == 0 for f in fills.values())


def test_sum_of_squares_choice():
    """The level chosen is the one that makes the sum of squares least."""
    p = packing.SumOfSquares(16, 0, lambda *x: None)
    r = random.Random(3)
    for k in range(300):
        size = r.randint(1, 15)
        levels = [0, *[h for h in range(1, 17 - size) if p.count[h]]]

        def after(h):
            c = p.count.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 16
            return int((c[1:16] ** 2).sum())

        assert after(p._choose(size)) == min(map(after, levels))
        p.add(k, np.zeros(size, dtype="<u4"))


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_language"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_odd(make, odd_rows):
    docs = make(odd_rows)
    rows = language.identify(docs).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        letters = any(x.isalpha() for x in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    kept = language.keep_languages(docs)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} >= {t for _, t, *_ in odd_rows if t and t.startswith(("the", "one two", "un deux"))}
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(make([(1, "abc def"), (2, None)])).collect()} == {"und"}


def test_keep_languages_where_nothing_is_learned(make):
    docs = make([(1, "plain words"), (2, "12 34"), (3, None), (4, "\u0451"), (4, "\u0451"), (5, "")])
    kept = language.keep_languages(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 4]


def test_filters_have_all_and_correct_false_ones():
    r = np.random.default_rng(4)
    codes = np.unique(r.integers(0, 2**32, 150_000, dtype=np.uint64)).astype(np.uint32)
    masks = np.full((1, len(codes)), 1, dtype=np.uint64)
    masks[0, : len(codes) // 2] |= np.uint64(2)
    f = language.Filters(["a", "b"], codes, masks)
    n = np.array([len(codes)])
    assert np.allclose(f.shares(codes, n)[0], [1, 0.5], atol=0.01)
    other = r.integers(0, 2**32, 100_000, dtype=np.uint64).astype(np.uint32)
    assert f.shares(other, np.array([len(other)]))[0].max() < 0.01


def test_many_languages():
    langs = [f"l{k:03}" for k in range(130)]
    codes = np.arange(130, dtype=np.uint32) * np.uint32(7919)
    masks = np.zeros((3, 130), dtype=np.uint64)
    for k in range(130):
        masks[k // 63, k] = np.uint64(1 << (k % 63))
    f = language.Filters(langs, codes, masks)
    assert f.shares(codes, np.ones(130, dtype=np.int64)).argmax(axis=1).tolist() == list(range(130))


def test_media(spark, make, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, source in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (make(odd_rows), [r[:2] for r in odd_rows])):
        rows = media.audio_digest(df).collect()
        want, by_text = [], defaultdict(set)
        for d, t in source:
            raw = (t or "").encode()
            payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setparams((1, 1, 24000, 0, "NONE", ""))
                w.writeframes(payload)
            want.append((str(d), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest()))
        assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows) == sorted(want)
        for r in rows:
            by_text[r.payload_sha256].add(r.feature)
        assert all(len(x) == 1 for x in by_text.values())
    assert media.audio_digest(docs.limit(0)).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(24000) / 24000
    samples = (128 + 100 * np.sin(2 * np.pi * 440 * t)).astype(np.uint8)
    y = media.resample(samples, 0, 16000)[1000:15000]
    assert abs(np.abs(np.fft.rfft(y)).argmax() * 16000 / 14000 - 440) < 2
    assert np.allclose(media.resample(samples, 3000, 3500), media.resample(samples, 0, 16000)[3000:3500])


def plain_features(payload):
    """Log-mels and energies by direct convolution and a discrete Fourier transform written out, in double precision."""
    x = [(b - 128) / 128 for b in payload]
    taps, up, down = media.TAPS, media.UP, media.DOWN
    n = np.arange(taps * up) - (taps * up - 1) / 2
    h = np.sinc(n / 3) * np.hamming(len(n))
    y, frames = [], 1 + max(0, -(-(-(-len(x) * up // down) - 400) // 160))
    for m in range(frames * 160 + 240):  # samples beyond the end are silent, the filter still reaches back
        phase, centre = m * down % up, m * down // up
        own = h[phase::up][::-1]
        own = own / own.sum()
        y.append(sum(own[k] * (x[centre - taps // 2 + k] if 0 <= centre - taps // 2 + k < len(x) else 0) for k in range(taps)))
    y = np.array(y)
    k, t = np.arange(257)[:, None], np.arange(400)
    wave_ = np.exp(-2j * np.pi * k * t / 512)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, mel(8000), 42) / 2595) - 1)
    f = np.arange(257) * 16000 / 512
    mels, energy = [], []
    for j in range(frames):
        w = y[j * 160 : j * 160 + 400] * np.hanning(400)
        power = np.abs(wave_ @ w) ** 2
        mels.append([np.log10(max(1e-8, sum(p * max(0, min((g - a) / (b - a), (c - g) / (c - b))) for p, g in zip(power, f, strict=True)))) for a, b, c in zip(edge, edge[1:], edge[2:])])  # noqa: B905
        energy.append(10 * np.log10((w * w).mean() + 1e-10))
    return np.array(mels), np.array(energy)


@pytest.mark.parametrize("size", [1, 64, 600, 2000])
def test_features_match_direct_sums(size):
    payload = media.padded(bytes(random.Random(size).choices(b"etaoin shrdlu ETAOIN\n\xc3\xa9", k=size)))
    mels, energy = media.log_mels(np.frombuffer(payload, dtype=np.uint8))
    want, loud = plain_features(payload)
    assert mels.shape == want.shape and np.allclose(mels, want, atol=2e-3) and np.allclose(energy, loud, atol=2e-3)
    tensors, table = media.unpack_tensors(media.pack_tensors(mels, media.segments(energy)))
    assert tensors.shape[1:] == (media.PATCH, media.MELS) and table.schema.field("tensor").type.shape == [media.PATCH, media.MELS]
    assert np.allclose(tensors.reshape(-1, media.MELS)[: len(want)], want, atol=1e-2) and (tensors.reshape(-1, media.MELS)[len(want) :] == -8).all()


def test_digest_describes_what_is_stored(make):
    """The feature of the query is that of tensors and spans unpacked here, over several tensors and spans that cross their borders."""
    text = "abc " * 9000 + "\x01" * 30_000 + "zyx " * 5000
    r = media.audio_digest(make([(1, text)])).first()
    mels, energy = media.log_mels(np.frombuffer(media.padded(text.encode()), dtype=np.uint8))
    spans = [[media.milliseconds(a), media.milliseconds(b)] for a, b in media.segments(energy)]
    half = mels.astype(np.float16)
    found = dict(x.split("=") for x in r.feature.split(";"))
    assert int(found["tensors"]) == -(-len(mels) // media.PATCH) > 3 and int(found["frames"]) == len(mels) and int(found["ms"]) == media.milliseconds(len(mels))
    assert int(found["spans"]) == len(spans) and int(found["active"]) == sum(b - a for a, b in spans) and found["first"] == f"{spans[0][0]}-{spans[0][1]}"
    assert int(found["crc"], 16) == zlib.crc32(repr(spans).encode(), zlib.crc32(half.tobytes()))


def test_segments():
    e = np.array([-50, -9, -5, -1, 0, -5, -9, -50, -1, -4, -50], dtype=np.float32)
    assert media.segments(e) == [(3, 6), (8, 10)]


def test_tensors(make):
    rows = media.audio_tensors(make([(1, "abc " * 20_000), (2, None)])).orderBy("doc_id", "patch").collect()
    assert [r.patch for r in rows if r.doc_id == 1] == list(range(len(rows) - 1)) and all(len(r.tensor) == media.PATCH * media.MELS for r in rows)
    assert all(a.end_ms == b.start_ms for a, b in zip(rows[:-2], rows[1:-1], strict=True))
    import pyarrow as pa

    t = media.as_tensors(pa.array([r.tensor for r in rows], pa.list_(pa.float32())))
    assert t.type.shape == [media.PATCH, media.MELS] and len(t) == len(rows)


def test_lm_history_tells_rare_words_apart():
    """Words and pairs in a history have rows of their own, also those outside the table."""
    import pyarrow as pa

    tokens, n = langmodel.token_stream(pa.array(["zig alpha x", "zag alpha x", "zog beta x"]))
    one, pair, two, three = (langmodel.weight_rows(x, np.zeros(len(x), dtype=np.uint64), 1 << 17) for x in langmodel.history(tokens, n))
    after = np.array([1, 5, 9])
    assert len(set(one[after])) == len(set(pair[after + 1])) == len(set(two[after + 1])) == len(set(three[after + 2])) == 3


def test_scrub_edits_replace_whole_addresses():
    for left, right in ((1, 1), (63, 10), (64, 254), (65, 255), (5000, 3000)):
        text = f"to <{'a' * left}@{'b.' * right}de>, or"
        assert token_counts.scrub_edits(text) == [(4, len(text) - 5, "<MAIL>")]
