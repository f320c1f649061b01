"""What workers hold in memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from quarrylog.llm import language, packing


class _Caught:
    """Stands for documents and keeps the function that goes to the workers."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self

    def groupBy(self, *_):  # noqa: N802
        return self

    def agg(self, *_):
        return self


def test_language_takes_a_bounded_part_of_a_batch_at_once(spark):
    caught = _Caught()
    language.count_grams(caught)
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{'abcdefghij'[k % 10]}{chr(97 + k % 23)}" for k in r.integers(0, 10_000, 1000)) for _ in range(1000)]  # 4 MB
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en", "de"] * 500})
    tracemalloc.start()
    rows = sum(b.num_rows for b in caught.run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 1000 and peak < 64 << 20


def test_encoder_gives_few_words_at_once_to_the_tokenizer():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    plain, most = encoder.tokenizer, []

    class Watched:
        def encode_batch_fast(self, words, **options):
            most.append(len(words))
            return plain.encode_batch_fast(words, **options)

    encoder.tokenizer = Watched()
    words = [f"w{k}x" for k in range(20_000)]
    ids, counts = encoder.encode(pa.array([" ".join(words), None, words[7]]))
    want = plain.encode(" ".join(words), add_special_tokens=False).ids
    assert ids[: counts[0]].tolist() == want and counts[1] == 0
    assert ids[counts[0] :].tolist() == plain.encode(words[7], add_special_tokens=False).ids
    assert sum(most) == 20_000 and max(most) <= 1 << 12
