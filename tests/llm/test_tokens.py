import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from cases import no_documents, odd_documents
from tokenizers import Tokenizer

from sleevenotes.llm import packing, token_files, tokens
from sleevenotes.llm.queries import TOKENIZER

LIBRARY = Tokenizer.from_file(TOKENIZER)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="ab .,\n\t É'st1<|endoftext|>", max_size=30)), max_size=6))
def test_ids_are_those_of_the_library(texts):
    ids, counts = tokens.token_ids(TOKENIZER, pa.array(texts, pa.string()), 2)
    assert ids.tolist() == [i for t in texts for i in plain(t)]
    assert counts.tolist() == [len(plain(t)) for t in texts]


def test_the_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens.PieceCache, "KEPT", 3)
    tokens.piece_cache.cache_clear()
    texts = [" ".join(f"w{k} w{k}" for k in range(9)), "w1 w2 w3 w3"] * 3
    for _ in range(3):
        ids, _counts = tokens.token_ids(TOKENIZER, pa.array(texts), 2)
        assert ids.tolist() == [i for t in texts for i in plain(t)]
    tokens.piece_cache.cache_clear()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_ranks_round_trip(ranks):
    control, data = token_files.encode_ranks(np.array(ranks, np.uint32))
    assert token_files.decode_ranks(control, data, len(ranks)).tolist() == ranks


def test_files_round_trip(spark, tmp_path):
    docs = odd_documents(spark)
    out = token_files.round_trip(docs, TOKENIZER, f"file://{tmp_path}/t", with_ids=True).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at, want = 0, []
    for r in rows:
        ids = plain(r.text)
        want.append((r.doc_id, at, len(ids), crc(ids), ids))
        at += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want


def test_small_files_hold_whole_documents(spark, tmp_path):
    docs = odd_documents(spark)
    files = token_files.write_token_files(docs, f"file://{tmp_path}/t", TOKENIZER, tokens_per_file=300).collect()
    assert len(files) > 5 and sum(f.n_docs for f in files) == docs.count()
    read = token_files.read_token_files(spark, f"file://{tmp_path}/t", docs.schema["doc_id"].dataType).collect()
    assert sorted(r.ids_crc32 for r in read) == sorted(crc(plain(r.text)) for r in docs.collect())


def test_no_documents(spark):
    assert token_files.round_trip(no_documents(spark), TOKENIZER).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert packing.packed_documents(no_documents(spark), TOKENIZER).count() == 0


def test_pieces_and_their_places(spark):
    docs = odd_documents(spark)
    out = packing.packed_documents(docs, TOKENIZER, limit=64, with_ids=True).collect()
    want = []
    for r in docs.collect():
        ids = plain(r.text)
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(r.doc_id, k, a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(((r.doc_id, r.piece, r.start, r.ids) for r in out), key=order) == sorted(want, key=order)
    assert all(r.ids_crc32 == crc(r.ids) and r.length == len(r.ids) for r in out)
    check_places(out, 64)


def check_places(rows, limit):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_local_search_never_needs_more_bins(lengths):
    first = packing.best_fit(lengths, 40)
    squares = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    before, n = squares(first), len(first)
    bins = packing.local_search(first, lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 40 for b in bins)
    assert len(bins) <= n and squares(bins) >= before


def test_local_search_empties_a_bin():
    # best fit leaves 6+3 and 5+4 and 2+2: exchanging makes room for the last bin
    lengths = [6, 5, 4, 3, 2]
    assert len(packing.local_search([[0, 3], [1, 2], [4]], lengths, 10)) == 2


@pytest.mark.parametrize("low,high", [(1, 1024), (300, 700), (600, 620), (1024, 1024)])
def test_shards_and_rounds(spark, low, high):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(int(x),) for x in rng.integers(low, high + 1, 3_000)], "length long")
    out = packing.pack(items, 1024, shard=800).collect()
    assert len(out) == 3_000
    n = check_places(out, 1024)
    total = sum(r.length for r in out)
    best = len(packing.pack_shard([r.length for r in out], 1024))
    assert total / 1024 <= n <= best * 1.01 + 1
