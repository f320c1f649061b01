"""Operator 7: language ID by language-bitmask n-gram filters.

Each word of one Bloom filter's array is a bitmask over languages (the filters of all
languages, bit-sliced): the AND of an n-gram's words tells at once all languages that
contain it. A text's n-grams give a popcount for each language, corrected by that
language's false-positive rate (its fill to the power of the number of hashes); the
language with the largest corrected share wins.

n-grams are 4 bytes of lower-cased text with everything but letters as one space. Counts
come from all learning documents. A language's filter takes an n-gram if it makes up at
least ``LEAST`` of that language's n-grams (so 1 / LEAST of them at most: the model is
bounded) and at least ``SHARE`` of its frequency in the language that has it most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, crc32_of_id, slices

N, LEAST, SHARE = 4, 1e-5, 0.5
SLOTS, HASHES = 1 << 20, 3
#: Bytes of text that are taken at once: an n-gram takes some 60 times its letter's room in between.
SLICE = 1 << 19
#: Documents with a smaller share of known n-grams than this, beyond doubt, are no language at all.
REJECT = 0.1

_CLEAN = np.full(256, 32, dtype=np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of an Arrow string column, and the number of each row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pc.fill_null(pc.utf8_lower(column.cast(pa.large_string())), "")
    text = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text, pa.scalar("  ", pa.large_string()), pa.scalar(" ", pa.large_string()))
    raw, offsets = column_bytes(text)
    b = _CLEAN[raw]
    # One space for a run of them, within a row.
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    keep[offsets[1:] - 1] = True  # the space between rows
    keep[offsets[1:] - 2] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    b, offsets = b[keep].astype(np.uint32), place[offsets]
    if len(b) < N:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets) - 1, dtype=np.int64)
    code = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    good = np.ones(len(code), dtype=bool)
    for back in range(1, N):  # those that reach into the next row
        at = offsets[1:-1] - back
        good[at[(at >= 0) & (at < len(good))]] = False
    row = np.concatenate([[0], np.cumsum(good)])
    ends = row[np.minimum(offsets, len(code))]
    return code[good], np.diff(ends)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of (text, lang), over all rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[str, list] = {}
        held = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            code, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return code, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def rows() -> Iterator:
            for lang in sorted(found):
                code, n = merged(found[lang])
                for k in range(0, len(code), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code[k : k + (1 << 16)])), pa.array(code[k : k + (1 << 16)].astype(np.int64)), pa.array(n[k : k + (1 << 16)])], names=["lang", "gram", "n"])
            found.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                code, n = grams(part["text"])
                label = np.array(part["lang"].to_pylist(), dtype=object)
                row = np.repeat(np.arange(len(n)), n)
                for lang in set(label.tolist()):
                    parts = found.setdefault(lang, [])
                    parts.append(np.unique(code[(label == lang)[row]], return_counts=True))
                    held += len(parts[-1][0])
                    if len(parts) > 8 and sum(len(c) for c, _ in parts[1:]) > len(parts[0][0]):
                        held -= sum(len(c) for c, _ in parts)
                        found[lang] = [merged(parts)]
                        held += len(found[lang][0][0])
                if held > 1 << 23:  # many languages: hand over, and begin anew
                    yield from rows()
                    held = 0
        yield from rows()

    counted = docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The bit-sliced filters. ``masks``: (n-gram codes, rows of 64-bit words)."""

    def __init__(self, langs: list[str], codes: np.ndarray, masks: np.ndarray):
        self.langs = langs
        self.table = np.zeros((max(1, (len(langs) + 62) // 63), SLOTS), dtype=np.uint64)
        for w in range(len(self.table)):
            for slot in self._slots(codes):
                np.bitwise_or.at(self.table[w], slot, masks[w])
        fill = np.array([np.count_nonzero(self.table[k // 63] & np.uint64(1 << (k % 63))) / SLOTS for k in range(len(langs))])
        self.false = fill**HASHES

    @staticmethod
    def _slots(code: np.ndarray) -> Iterator[np.ndarray]:
        x = code.astype(np.uint64)
        for odd in _ODD[:HASHES]:
            y = x * odd
            yield ((y ^ (y >> np.uint64(29))) & np.uint64(SLOTS - 1)).astype(np.int64)

    def shares(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each row and language: the share of n-grams that it contains, corrected."""
        out = np.zeros((len(n), len(self.langs)))
        ends = np.concatenate([[0], np.cumsum(n)])
        slots = list(self._slots(code))
        for w, table in enumerate(self.table):
            hit = table[slots[0]]
            for slot in slots[1:]:
                hit &= table[slot]
            for k in range(63 * w, min(63 * w + 63, len(self.langs))):
                total = np.concatenate([[0], np.cumsum((hit >> np.uint64(k % 63)) & np.uint64(1), dtype=np.int64)])
                hits = np.diff(total[ends])
                out[:, k] = np.clip((hits / np.maximum(n, 1) - self.false[k]) / (1 - self.false[k]), 0, 1)
        return out


def learn(docs: DataFrame) -> Filters:
    """Filters from (text, lang), rows with a null lang or text left out. The driver gets 1 / LEAST n-grams a language at most."""
    counts = count_grams(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    counts = counts.persist()
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        counts.unpersist()
        return Filters([], np.zeros(0, dtype=np.uint32), np.zeros((1, 0), dtype=np.uint64))
    spark = docs.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(x, float(totals[x])) for x in langs], "lang string, total double"))
    kept = counts.join(sizes, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("p")).where(F.col("p") >= LEAST).toPandas()
    counts.unpersist()
    best = kept.groupby("gram").p.transform("max")
    kept = kept[kept.p >= SHARE * best]
    codes, back = np.unique(kept.gram.to_numpy(), return_inverse=True)
    which = kept.lang.map({x: k for k, x in enumerate(langs)}).to_numpy()
    masks = np.zeros(((len(langs) + 62) // 63, len(codes)), dtype=np.uint64)
    np.bitwise_or.at(masks, (which // 63, back), np.left_shift(np.uint64(1), (which % 63).astype(np.uint64)))
    return Filters(langs, codes.astype(np.uint32), masks)


def predict(docs: DataFrame, filters: Filters, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds lang_pred and score, or what ``names`` calls them, to ``docs`` (their other columns unchanged).

    ``und`` with score 0 if text is null or has no letter, or nothing was learned. Ties go to
    the smaller language name. Only the text is looked at. Own columns win over clashing ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    base = docs.drop(*names)
    names_in, text_at = base.columns, [c.lower() for c in base.columns].index("text")
    base = base.toDF(*(f"_c{k}" for k in range(len(names_in))))  # whatever the columns are called
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        model = shared.value
        langs = np.array(model.langs, dtype=object)
        for batch in batches:
            for part in slices(batch, f"_c{text_at}", SLICE):
                text = part[f"_c{text_at}"]
                letters = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\pL"), False))
                if len(langs):
                    shares = model.shares(*grams(text))
                    best = shares.argmax(axis=1)
                    lang, score = np.where(letters, langs[best], "und"), np.where(letters, shares[np.arange(len(best)), best], 0.0)
                else:
                    lang, score = np.full(len(letters), "und", dtype=object), np.zeros(len(letters))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang.tolist(), type=pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema).toDF(*names_in, *names)


def learned(docs: DataFrame) -> Filters:
    """Learns from the documents whose crc32 of doc_id mod 4 is not 2."""
    return learn(docs.where(crc32_of_id(F.col("doc_id")) % 4 != 2).select("text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """Adds lang_pred and score to all documents, and held_out: whether none was learned from them."""
    return predict(docs, learned(docs)).withColumn("held_out", crc32_of_id(F.col("doc_id")) % 4 == 2)


def keep_languages(docs: DataFrame) -> DataFrame:
    """The documents that are in some learned language, all columns unchanged.

    und goes, and so does what hardly shares an n-gram with any language: a share below REJECT
    by more than one over the root of the text's length, so that a short text stays in doubt.
    Where nothing could be learned (no text with a lang, say) only texts without a letter and
    null ones go. An empty table stays empty; repeated rows stay or go together.
    """
    filters = learned(docs)
    if not filters.langs:
        return docs.where(F.col("text").rlike(r"\pL"))
    found = predict(docs, filters, ("_lid_lang", "_lid_score"))
    doubt = 1 / F.sqrt(F.length("text"))
    return found.where((F.col("_lid_lang") != "und") & (F.col("_lid_score") + doubt >= REJECT)).drop("_lid_lang", "_lid_score")
