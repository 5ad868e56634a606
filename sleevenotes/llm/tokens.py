"""Token ids of whole texts, computed in Arrow batches.

A byte-level BPE never merges across its own pre-token boundaries. A space after a visible character always starts a new
pre-token, and so does a full stop or comma after a letter. So texts are cut at such spaces and every distinct piece, without
its closing stop or comma, is encoded once by the ``tokenizers`` library; the ids are gathered by position. Texts with white
space before a space (rare) are encoded whole. The result equals ``Tokenizer.encode(text, add_special_tokens=False)`` for
every text; null counts as empty.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space of any kind directly before a space: the only place where cutting at the space could change the ids.
UNSAFE_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}] "
# Certain to be one pre-token, with or without a space before it.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
LETTERS_AND_STOP = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]$"
ENCODE_AT_ONCE = 16_384
TEXT_AT_ONCE = 24 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str, one_piece: bool = False):
    """one_piece: for texts that are one pre-token, so that the library need not look for others."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    found = Tokenizer.from_file(path)
    if one_piece:
        found.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return found


def _encoded(path: str, texts: list[str], one_piece: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and how many each has."""
    encode = tokenizer(path, one_piece).encode_batch_fast
    ids, counts = [np.zeros(0, np.uint32)], []
    for at in range(0, len(texts), ENCODE_AT_ONCE):
        found = [e.ids for e in encode(texts[at : at + ENCODE_AT_ONCE], add_special_tokens=False)]
        counts += map(len, found)
        ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
    return np.concatenate(ids), np.array(counts, dtype=np.int64)


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges values[start : start + count], one after the other."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    shift = np.repeat((starts - (np.cumsum(counts) - counts)).astype(kind), counts)
    shift += np.arange(total, dtype=kind)
    return values[shift]


class PieceCache:
    """Ids of pieces that a worker has met more than once. It starts anew when it has KEPT pieces, so its memory is bounded."""

    KEPT = 600_000

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, path: str, stems: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each stem's start and count in them. A stem stands for itself with a space before it."""
        words, get = stems.to_pylist(), self.place.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        letters = pc.match_substring_regex(stems, LETTERS).to_numpy(zero_copy_only=False)
        starts, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        known = at >= 0
        starts[known], counts[known] = self.starts[at[known]], self.counts[at[known]]
        parts, size = [self.ids], len(self.ids)
        for which in (True, False):
            rows = np.flatnonzero(~known & (letters == which))
            new, n = _encoded(path, [" " + words[i] for i in rows], which)
            starts[rows], counts[rows] = size + np.cumsum(n) - n, n
            parts.append(new)
            size += len(new)
        ids = np.concatenate(parts)
        again = np.flatnonzero(~known & (times > 1))
        if len(self.place) + len(again) > self.KEPT:
            self.__init__()
        if len(again) <= self.KEPT:
            n = len(self.place)
            self.place.update((words[i], n + k) for k, i in enumerate(again))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts[again]) - counts[again]])
            self.counts = np.concatenate([self.counts, counts[again]])
            self.ids = np.concatenate([self.ids, gathered(ids, starts[again], counts[again])])
        return ids, starts, counts


@lru_cache(maxsize=2)
def piece_cache(path: str) -> PieceCache:
    return PieceCache()


def _by_pieces(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    pieces = pc.split_pattern(texts, " ")
    bounds = pieces.offsets.to_numpy().astype(np.int64)
    flat = pieces.flatten().dictionary_encode()
    words, codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    first = bounds[:-1] - bounds[0]
    # distinct pieces to stems and closing marks
    marked = pc.match_substring_regex(words, LETTERS_AND_STOP)
    stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
    stem = stems.indices.to_numpy().astype(np.int64)
    mark = np.where(marked.to_numpy(zero_copy_only=False), 1 + pc.ends_with(words, ",").to_numpy(zero_copy_only=False), 0)
    times = np.bincount(stem, weights=np.bincount(codes, minlength=len(words)), minlength=len(stems.dictionary))
    ids, starts, counts = piece_cache(path).look_up(path, stems.dictionary, times)
    marks, n_marks = _encoded(path, ["", ".", ","])
    pair_starts = np.stack([starts[stem], len(ids) + (np.cumsum(n_marks) - n_marks)[mark]], axis=1)
    pair_counts = np.stack([counts[stem], n_marks[mark]], axis=1)
    word_ids = gathered(np.concatenate([ids, marks]), pair_starts.ravel(), pair_counts.ravel())
    n_ids = pair_counts.sum(axis=1)
    # a text's first piece has no space before it
    used, place = np.unique(codes[first], return_inverse=True)
    more, n_more = _encoded(path, words.take(pa.array(used)).to_pylist())
    codes[first] = len(words) + place
    n_ids = np.concatenate([n_ids, n_more])
    lengths = n_ids[codes]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out = gathered(np.concatenate([word_ids, more]), (np.cumsum(n_ids) - n_ids)[codes], lengths)
    return out, ends[bounds[1:] - bounds[0]] - ends[first]


def token_ids(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, each closed by end_id; and how many each has (uint32, int64).

    Worked off in runs of TEXT_AT_ONCE bytes or less, up to a text,, which bounds the memory.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    total = int(sizes[-1]) if len(sizes) else 0
    runs = total // TEXT_AT_ONCE + 1
    cuts = np.searchsorted(sizes, total * np.arange(1, runs) // runs, side="right")
    bounds = np.unique(np.concatenate([[0], cuts, [len(texts)]]))
    found = [_token_ids(path, texts.slice(a, b - a), end_id) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    if len(found) == 1:
        return found[0]
    none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(none, *found, strict=True))


def _token_ids(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    rare = pc.match_substring_regex(texts, UNSAFE_SPACE).to_numpy(zero_copy_only=False)
    plain, whole = np.flatnonzero(~rare), np.flatnonzero(rare)
    parts, counts, starts, at = [], np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for rows, encode in ((plain, _by_pieces), (whole, lambda p, t: _encoded(p, t.to_pylist()))):
        if len(rows):
            ids, c = encode(path, texts.take(pa.array(rows)) if len(rows) < n else texts)
            counts[rows], starts[rows] = c, at + np.cumsum(c) - c
            parts.append(ids)
            at += len(ids)
    closed = counts + 1
    out = np.full(int(closed.sum()), end_id, dtype=np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(closed) - 1] = False
    out[keep] = parts[0] if len(parts) == 1 else gathered(np.concatenate(parts), starts, counts)
    return out, closed
