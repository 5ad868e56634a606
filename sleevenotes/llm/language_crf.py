"""Language of each word by a linear-chain conditional random field, and from that the language of each document.

Words are runs of letters, lower-cased. A word's emission scores come from hashed features (its two- and three-letter sequences with
marked ends, its first and last three letters) and from a lexicon: how the learning documents use the word, by language.
Transition scores are learned too, on sequences joined from passages of several languages, so that the model follows a
text that switches. Forward-backward gives each word's distribution over languages; a document's language is the one with the
largest share of its letters, and that share is the score.

The lexicon counts every word of every learning document (hashed into LEXICON buckets). Only the weights are fitted on a bounded
sample: about SAMPLE distinct texts of each language, of longer ones a passage of SAMPLE_CHARS. Prediction reads whole texts, in Arrow batches:
each distinct word of a batch is scored once, and documents of similar length go through forward-backward together. Texts are split and words
weighed in portions, so that what a task holds of a batch besides its text and one code a word does not grow with it.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if there is nothing to learn from.
Repeated rows get equal results. Documents without id, text or lang are not learned from. Ties go to the language that is first in
alphabetical order. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
FEATURES = 1 << 16
LEXICON = 1 << 14
SAMPLE = 300
SAMPLE_CHARS = 20_000
SEQUENCES, WORDS_IN_SEQUENCE, BATCH, EPOCHS = 6_144, 48, 256, 3
RATE = 0.2
#: What is in memory at once: words in forward-backward, distinct words as features, text as words' codes, text while it is split.
WORDS_AT_ONCE, DISTINCT_AT_ONCE = 250_000, 16_384
TEXT_AT_ONCE, SPLIT_AT_ONCE = 24 << 20, 2 << 20


def learned_from(doc_id: Column) -> Column:
    """False for a third of the documents, which are held out."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


# -- words and their features --------------------------------------------------------------------------------------


@dataclass
class Words:
    """The words of a batch of texts: distinct ones, the code of each word in turn, and where each text begins and ends."""

    distinct: pa.Array
    codes: np.ndarray
    bounds: np.ndarray


def words_of(texts: pa.Array) -> Words:
    parts = [_words_of(part) for (part,) in in_runs(texts, size=SPLIT_AT_ONCE)]
    if len(parts) == 1:
        return parts[0]
    # each part has its own distinct words; together they are numbered anew
    every = pa.concat_arrays([part.distinct for part in parts]).dictionary_encode()
    number = every.indices.to_numpy().astype(np.int32)
    last = np.cumsum([len(part.distinct) for part in parts])
    codes = np.concatenate([number[b - len(part.distinct) : b][part.codes] for part, b in zip(parts, last, strict=True)])
    return Words(every.dictionary, codes, np.concatenate([[0], np.cumsum(np.concatenate([np.diff(part.bounds) for part in parts]))]))


def _words_of(texts: pa.Array) -> Words:
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int32)
    empty = pc.index(flat.dictionary, "").as_py()  # of texts without letters
    ends = offsets[1:] - offsets[0]
    if empty >= 0:
        real = codes != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        codes = codes[real]
    return Words(flat.dictionary, codes, np.concatenate([[0], ends]))


def features_of(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all words, one after the other; where each word's begin; and each word's bucket in the lexicon."""
    words = distinct.to_pylist()
    points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    wide = np.concatenate([points, np.zeros(3, np.uint64)])
    n = len(points)
    two = wide[:n] * np.uint64(0x9E3779B97F4A7C15) + wide[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two + wide[2 : n + 2] * np.uint64(0x165667B19E3779F9)
    four = three + wide[3 : n + 3] * np.uint64(0x27D4EB2F165667C5)
    mix = lambda h, salt: ((h ^ (h >> np.uint64(29)) ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # characters of the word from here on
    at = np.arange(n)
    head, tail = at == np.repeat(starts, sizes), left == 4
    table = np.stack([mix(two, 1), mix(three, 2), mix(four, 3)], axis=1).astype(np.int64)
    valid = np.stack([left >= 2, left >= 3, (left >= 4) & (head | tail)], axis=1)
    per_word = np.add.reduceat(valid.sum(axis=1), starts) if n else np.zeros(0, np.int64)
    # the whole word, for the lexicon: a sum of terms that depend on character and place
    place = (at - np.repeat(starts, sizes)).astype(np.uint64)
    term = (points + np.uint64(1)) * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    term = (term ^ (term >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    word = np.add.reduceat(term, starts) if n else np.zeros(0, np.uint64)
    bucket = ((word ^ (word >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - 14)).astype(np.int64)
    return table[valid], np.cumsum(per_word) - per_word, bucket


# -- the model -----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # FEATURES x labels
    lexicon: np.ndarray  # LEXICON x labels: log-odds
    lexicon_weight: float
    transitions: np.ndarray  # from x to
    start: np.ndarray
    meta: dict = field(default_factory=dict)

    def emissions(self, distinct: pa.Array) -> np.ndarray:
        out = np.zeros((len(distinct), len(self.labels)), np.float32)
        for a in range(0, len(distinct), DISTINCT_AT_ONCE):
            feats, starts, bucket = features_of(distinct.slice(a, DISTINCT_AT_ONCE))
            out[a : a + DISTINCT_AT_ONCE] = np.add.reduceat(self.weights[feats], starts, axis=0) + self.lexicon_weight * self.lexicon[bucket]
        return out


def _normed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = rows.sum(axis=-1, keepdims=True)
    return rows / total, total


def word_marginals(
    model: Model, scores: np.ndarray, codes: np.ndarray, bounds: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each word's distribution over the labels, given its whole document (forward-backward), for some whole documents at a time.

    With them come the documents, where the words of each begin, and the places of all these words in ``codes``.
    """
    step = np.exp(model.transitions).astype(np.float32)
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    at = 0
    while at < len(order):
        own = max(1, int(np.searchsorted(np.cumsum(n[order[at:]]), WORDS_AT_ONCE, side="right")))
        docs = order[at : at + own]
        at += own
        size = n[docs]
        first = np.cumsum(size) - size
        places = np.repeat(bounds[docs] - first, size) + np.arange(size.sum())
        own_codes = codes[places]
        out = np.empty((len(places), len(model.labels)), np.float32)
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # documents with more than t words
        alpha = None
        for t in range(size[0]):
            here = first[: active[t]] + t
            e = odds[own_codes[here]]
            alpha = e * np.exp(model.start) if t == 0 else e * (alpha[: active[t]] @ step)
            alpha = _normed(alpha)[0]
            out[here] = alpha
        beta = np.ones((0, len(model.labels)), np.float32)
        for t in range(size[0] - 1, -1, -1):
            k = active[t]
            if len(beta) < k:  # documents that end here
                beta = np.concatenate([beta, np.ones((k - len(beta), beta.shape[1]), np.float32)])
            here = first[:k] + t
            out[here] = _normed(out[here] * beta)[0]
            beta = _normed((odds[own_codes[here]] * beta) @ step.T)[0]
        yield docs, first, places, out


def document_labels(model: Model, texts: pa.Array, with_words: bool = False) -> tuple[pa.Array, np.ndarray, list[list[str]] | None]:
    """Language and score of each text; with_words: and the language of each of its words."""
    words = words_of(texts)
    labels = pa.array([*model.labels, UNKNOWN])
    n, k = len(words.bounds) - 1, len(model.labels)
    if not k or not len(words.codes):
        return labels.take(pa.array(np.full(n, k))), np.zeros(n), [[] for _ in range(n)] if with_words else None
    letters = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False).astype(np.float64)
    share, of_word = np.zeros((n, k)), np.zeros(len(words.codes) if with_words else 0, np.int32)
    for docs, first, places, marginals in word_marginals(model, model.emissions(words.distinct), words.codes, words.bounds):
        share[docs] = np.add.reduceat(marginals * letters[words.codes[places], None], first, axis=0)
        if with_words:
            of_word[places] = marginals.argmax(axis=1)
    best = share.argmax(axis=1)
    total = share.sum(axis=1)
    score = np.divide(share.max(axis=1), total, out=np.zeros(n), where=total > 0)
    best[total == 0] = k
    per_word = None
    if with_words:
        named = [model.labels[j] for j in of_word]
        per_word = [named[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    return labels.take(pa.array(best)), np.clip(score, 0.0, 1.0), per_word


# -- learning ------------------------------------------------------------------------------------------------------


def lexicon_counts(learning: DataFrame) -> DataFrame:
    """lang, bucket, n over all words of all learning documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for texts, langs in in_runs(batch.column("text"), batch.column("lang")):
                words = words_of(texts)
                bucket = np.concatenate(
                    [
                        np.zeros(0, np.int64),
                        *(features_of(words.distinct.slice(a, DISTINCT_AT_ONCE))[2] for a in range(0, len(words.distinct), DISTINCT_AT_ONCE)),
                    ]
                )
                coded = langs.dictionary_encode()
                of_word = np.repeat(coded.indices.to_numpy(), np.diff(words.bounds))
                for k, lang in enumerate(coded.dictionary.to_pylist()):
                    found = np.bincount(bucket[words.codes[of_word == k]], minlength=LEXICON)
                    sums[lang] = sums.get(lang, 0) + found
        for lang, found in sums.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(used), "bucket": pa.array(used), "n": pa.array(found[used])})

    counted = learning.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def in_runs(texts: pa.Array, *more: pa.Array, size: int | None = None) -> Iterator[tuple[pa.Array, ...]]:
    """The arrays in runs of at most ``size`` (or TEXT_AT_ONCE) bytes of text, up to a text; no texts are one run."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    total = int(sizes[-1]) if len(sizes) else 0
    runs = total // (size or TEXT_AT_ONCE) + 1
    cuts = np.searchsorted(sizes, total * np.arange(1, runs) // runs, side="right")
    bounds = np.unique(np.concatenate([[0], cuts, [len(texts)]]))
    bounds = bounds if len(texts) else [0, 0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield tuple(x.slice(a, b - a) for x in (texts, *more))


def fit(learning: DataFrame) -> Model:
    """The model learned from the documents' text and lang (rows without either are left out)."""
    usable = learning.select("text", "lang").filter("text is not null and lang is not null")
    counts = lexicon_counts(usable).collect()  # LEXICON rows a language at most
    labels = sorted({r.lang for r in counts})
    k = len(labels)
    empty = Model(labels, np.zeros((FEATURES, k), np.float32), np.zeros((LEXICON, k), np.float32), 1.0, np.zeros((k, k)), np.zeros(k))
    if k == 0:
        return empty
    table = np.zeros((LEXICON, k))
    for r in counts:
        table[r.bucket, labels.index(r.lang)] = r.n
    rates = (table + 0.1) / (table.sum(axis=0) + 0.1 * LEXICON)
    empty.lexicon = (np.log(rates) - np.log(rates).mean(axis=1, keepdims=True)).astype(np.float32).clip(-4, 4)
    if k == 1:
        return empty
    # distinct texts are drawn, and of a long text a passage: neither copies nor long documents keep a language out of the sample
    hashed = usable.withColumn("h", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < SAMPLE / n))
    begin = F.pmod(F.shiftright("h", 30), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    passage = F.col("text").substr(begin, F.lit(SAMPLE_CHARS))
    drawn = hashed.filter(chosen).select("lang", "h", passage.alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = drawn.orderBy("h").limit(4 * SAMPLE * k).collect()
    return _trained(empty, [r.text for r in rows], [r.lang for r in rows])


def _trained(model: Model, texts: list[str], langs: list[str]) -> Model:
    """Adaptive gradient steps on the log-likelihood of sequences joined from passages of the sample."""
    words = words_of(pa.array(texts, pa.large_string()))
    feats, starts, bucket = features_of(words.distinct)
    n_feats = np.diff(np.append(starts, len(feats)))
    k, rng = len(model.labels), np.random.default_rng(0)
    of_doc = np.array([model.labels.index(x) for x in langs])
    of_word = np.repeat(of_doc, np.diff(words.bounds))
    pools = [words.codes[of_word == j] for j in range(k)]
    usable = [j for j in range(k) if len(pools[j])]
    if not usable:
        return model
    length = WORDS_IN_SEQUENCE
    x, y = np.empty((SEQUENCES, length), np.int64), np.empty((SEQUENCES, length), np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < length:
            size = min(length - at, int(rng.integers(6, length + 1)))
            j = usable[int(rng.integers(len(usable)))]
            place = int(rng.integers(len(pools[j])))
            x[s, at : at + size] = pools[j][(place + np.arange(size)) % len(pools[j])]
            y[s, at : at + size] = j
            at += size
    weights, trans, start, lex = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k), 0.5
    seen_w, seen_t, seen_s, seen_l = np.full((FEATURES, k), 1e-2), np.full((k, k), 1e-2), np.full(k, 1e-2), 1e-2
    eye = np.eye(k)
    for _ in range(EPOCHS):
        for a in np.split(rng.permutation(SEQUENCES), SEQUENCES // BATCH):
            used, codes = np.unique(x[a], return_inverse=True)
            codes = codes.reshape(x[a].shape)
            rows = np.repeat(starts[used] - (np.cumsum(n_feats[used]) - n_feats[used]), n_feats[used])
            own = feats[rows + np.arange(len(rows))]
            first = np.cumsum(n_feats[used]) - n_feats[used]
            scores = np.add.reduceat(weights[own], first, axis=0) + lex * model.lexicon[bucket[used]]
            odds = np.exp(scores - scores.max(axis=1, keepdims=True))[codes]
            step = np.exp(trans)
            alpha, beta = np.empty(odds.shape), np.ones(odds.shape)
            for t in range(length):
                alpha[:, t] = _normed(odds[:, t] * (np.exp(start) if t == 0 else alpha[:, t - 1] @ step))[0]
            for t in range(length - 2, -1, -1):
                beta[:, t] = _normed((odds[:, t + 1] * beta[:, t + 1]) @ step.T)[0]
            gamma = _normed(alpha * beta)[0]
            pairs = alpha[:, :-1, :, None] * step * (odds[:, 1:] * beta[:, 1:])[:, :, None, :]
            pairs /= pairs.sum(axis=(2, 3), keepdims=True)
            truth = eye[y[a]]
            miss = (truth - gamma).reshape(-1, k)
            g_word = np.stack([np.bincount(codes.ravel(), miss[:, j], len(used)) for j in range(k)], axis=1)
            spread = np.repeat(g_word, n_feats[used], axis=0)
            g_w = np.stack([np.bincount(own, spread[:, j], FEATURES) for j in range(k)], axis=1) / len(a)
            g_t = (np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:]) - pairs.sum(axis=(0, 1))) / len(a)
            g_s = (truth[:, 0] - gamma[:, 0]).mean(axis=0)
            g_l = float((g_word * model.lexicon[bucket[used]]).sum() / len(a))
            for seen, g in ((seen_w, g_w), (seen_t, g_t), (seen_s, g_s)):
                seen += g * g
            seen_l += g_l * g_l
            weights += RATE * g_w / np.sqrt(seen_w)
            trans += RATE * g_t / np.sqrt(seen_t)
            start += RATE * g_s / np.sqrt(seen_s)
            lex += RATE * g_l / math.sqrt(seen_l)
    return Model(model.labels, weights.astype(np.float32), model.lexicon, lex, trans.astype(np.float32), start.astype(np.float32))


# -- documents -----------------------------------------------------------------------------------------------------


def predicted(docs: DataFrame, model: Model, with_words: bool = False) -> DataFrame:
    """The documents with two more columns, lang_pred and score; with_words: and word_langs, the language of each word."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    text, own = names.index("text"), plain.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES and LEXICON rows

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores, per_word = [], [], []
            for (texts,) in in_runs(batch.column(text)):
                lang, score, found = document_labels(model, texts, with_words)
                langs.append(lang)
                scores.append(score)
                per_word += found or []
            columns = [*batch.columns, pa.concat_arrays(langs), pa.array(np.concatenate(scores))]
            fields = [*own, "lang_pred", "score"]
            if with_words:
                columns.append(pa.array(per_word, pa.list_(pa.string())))
                fields.append("word_langs")
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    extra = ", lang_pred string, score double" + ", word_langs array<string>" * with_words
    out = plain.mapInArrow(label, kinds + extra)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), *out.columns[len(names) :])


def identified(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The documents with a language whose score is at least least_score, with their own columns."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias("text" if c == "text" else f"c{k}") for k, c in enumerate(names)))
    out = predicted(plain, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return out.select(*(F.col("text" if c == "text" else f"c{k}").alias(c) for k, c in enumerate(names)))
