"""Language labelling holds little more than the words' codes, and portions change nothing."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sleevenotes.llm import language_crf


def model():
    rng, k = np.random.default_rng(3), 4
    weights, lexicon = rng.normal(size=(language_crf.FEATURES, k)), rng.normal(size=(language_crf.LEXICON, k))
    return language_crf.Model(
        list("abcd"), weights.astype(np.float32), lexicon.astype(np.float32), 1.0, rng.normal(size=(k, k)).astype(np.float32), np.zeros(k, np.float32)
    )


def prose(n, words):
    rng = np.random.default_rng(4)
    vocabulary = np.array(["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(5_000)])
    return [" ".join(rng.choice(vocabulary, words)) for _ in range(n)]


def test_memory_of_a_batch_is_a_few_bytes_a_word():
    known, texts = model(), pa.array(prose(4_000, 500), pa.large_string())
    tracemalloc.start()
    labels, scores, _ = language_crf.document_labels(known, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 2,000,000 words: 64 bytes each when all of them were weighed together, 13 now
    assert len(labels) == len(scores) == 4_000 and peak < 30 * 2_000_000


def test_portions_change_nothing(monkeypatch):
    known, texts = model(), pa.array([*prose(300, 40), None, "", "12 34", "ß ñ é", *prose(2, 900)], pa.large_string())
    labels, scores, langs = language_crf.document_labels(known, texts, with_words=True)
    whole = language_crf.words_of(texts)
    for name, size in (("SPLIT_AT_ONCE", 500), ("WORDS_AT_ONCE", 700), ("DISTINCT_AT_ONCE", 16)):
        monkeypatch.setattr(language_crf, name, size)
    parts = language_crf.words_of(texts)
    assert whole.distinct.take(pa.array(whole.codes)).equals(parts.distinct.take(pa.array(parts.codes)))
    assert (whole.bounds == parts.bounds).all()
    again = language_crf.document_labels(known, texts, with_words=True)
    assert labels.equals(again[0]) and np.allclose(scores, again[1], atol=1e-6) and langs == again[2]
    assert len(language_crf.document_labels(known, texts.slice(0, 0))[0]) == 0
