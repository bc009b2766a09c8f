"""Encoding, decoding and packing against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from treeline.llm.bpe_reuse import ChunkEncoder, encode_decode
from treeline.llm.encoding import Encoder, words_apart
from treeline.llm.packing import Plan, non_negative, pack, patterns, tokenizer_path
from treeline.llm.words import buffer

from .conftest import odd_rows, prose

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_encode_and_decode(odd, none, library):
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in encode_decode(odd, chunk_bytes=64).collect()), key=repr)
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert encode_decode(none).count() == 0


@pytest.mark.parametrize("chunk_bytes", [2, 16, 1024])
def test_chunks_at_any_place(library, chunk_bytes):
    texts = [t or "" for _, t in odd_rows()] + ["don't we'll", "a" * 500, " x y \x1c z\x85q", prose(9, 500)]
    chunks = ChunkEncoder(Encoder(PATH), chunk_bytes)
    for _ in range(2):
        ids, before = chunks.encode(*buffer(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[before[i]: before[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_joins_that_disagree_are_mended_by_the_whole_text(library):
    chunks = ChunkEncoder(Encoder(PATH), 16)
    own = chunks.encoder.by_library
    texts = [prose(7, 100), prose(8, 100)]
    chunks._agree = lambda data, starts, ends, counts, broken, doc_of: ([b""] * len(broken), {0, 1})
    ids, before = chunks.encode(*buffer(pa.array(texts)))
    assert [ids[before[i]: before[i + 1]].tolist() for i in (0, 1)] == [x.tolist() for x in own(texts)]


def test_tokenizers_whose_words_touch_encode_whole_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    assert words_apart(PATH) and not words_apart(path)
    ids, _ = ChunkEncoder(Encoder(path), 16).encode(*buffer(pa.array(["a b  c", None])))
    assert ids.tolist() == Tokenizer.from_file(path).encode("a b  c", add_special_tokens=False).ids


@pytest.mark.parametrize("size", [7, 4096])
def test_packing(odd, none, library, size):
    out = pack(odd, size=size, n_bins=min(size, 128)).toPandas()
    want = {}
    for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").collect():
        want[r.doc_id] = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
    for r in out[out.doc_id.notna()].itertuples():
        assert r.start == r.piece * size
        assert r.length == min(size, len(want[r.doc_id]) - r.start)
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start: r.start + r.length])
    assert len(out) == sum(-(-len(x) // size) for x in want.values()) + 3  # the repeated row, two without id
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= size
    assert pack(none).count() == 0


def test_plan_is_near_the_bound():
    draw = np.random.default_rng(4)
    lengths, n = np.unique(np.minimum(4096, draw.lognormal(6.5, 1, 50_000).astype(int) + 1), return_counts=True)
    plan = Plan(dict(zip(lengths.tolist(), n.tolist())), 4096, 128, 3)
    bound = -(-int((lengths * n).sum()) // 4096)
    assert bound <= plan.n_sequences <= 1.02 * bound
    fill = np.zeros(plan.n_sequences, np.int64)
    for length, a, b, first, copies, _ in plan.slots:
        np.add.at(fill, first + np.arange(b - a) // copies, length)
    assert fill.max() <= 4096 and fill.sum() == (lengths * n).sum()


def test_patterns_fill_and_fit():
    ways = patterns(12, 3)
    assert (ways @ np.arange(13) == 12).all() and ways.sum(1).max() == 3
    assert len({tuple(w) for w in ways.tolist()}) == len(ways) == 1 + 6 + 12
    want = ways[[0, 5, 9]].T @ np.array([3.0, 7.0, 2.0])
    x = non_negative(ways.T, want)
    assert (x >= 0).all() and np.allclose(ways.T @ x, want, atol=1e-6)
