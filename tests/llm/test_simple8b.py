import random
import base64
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm import simple8b as B

IDS = st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_256), st.integers(0, 2**60), st.integers(0, 2**64 - 1), st.just(0)), max_size=400)


@settings(deadline=None, max_examples=200)
@given(st.lists(IDS, max_size=4))
def test_round_trip(texts):
    arrays = [np.array(x, np.uint64) for x in texts]
    for x, (w, o) in zip(arrays, B.encode(arrays)):
        assert (B.decode(w, o, len(x)) == x).all() and len(o) == -(-len(x) // B.BLOCK)


def plain(x):
    """One id at a time: the selector of most ids that fit, within the block."""
    out = []
    for k in range(0, len(x), B.BLOCK):
        b, i = x[k : k + B.BLOCK], 0
        while i < len(b):
            for s in range(1, 16):
                c, w = int(B.COUNTS[s]), int(B.WIDTHS[s])
                part = b[i : i + c]
                if all(v < 1 << w for v in part):
                    out.append(s << 60 | sum(v << (j * w) for j, v in enumerate(part)))
                    i += c
                    break
            else:
                out += [0, b[i]]
                i += 1
    return out


@settings(deadline=None, max_examples=100)
@given(IDS)
def test_same_words_as_one_at_a_time(x):
    assert B.encode([np.array(x, np.uint64)])[0][0].tolist() == plain(x)


def test_negative_ids_are_refused():
    with pytest.raises(ValueError):
        B.encode([np.array([1, -2])])


def test_zeros_and_escapes():
    w, o = B.encode([np.zeros(1000, np.uint64)])[0]
    assert len(w) == 15 and len(o) == 8  # a block of 128 zeros takes two words, the last of 104 one
    w, _ = B.encode([np.array([2**60], np.uint64)])[0]
    assert w.tolist() == [0, 2**60]


@settings(deadline=None, max_examples=200)
@given(st.text(st.sampled_from("ab é\n\t .,'s0  "), max_size=40))
def test_pieces_give_the_same_ids(t):
    tokens = B.Tokens(B.vocabulary_bytes(B.VOCABULARY))
    assert tokens.ids(t).tolist() == tokens.encode(t)


def test_tables_round_trip(spark):
    tokens = B.Tokens(B.vocabulary_bytes(B.VOCABULARY))
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = B.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert B.decode(np.frombuffer(r.words, "<u8"), np.array(r.offsets), r.n_tokens).tolist() == tokens.encode(docs[r.doc_id])
        assert r.n_words * 8 == len(r.words)


def test_awkward(awkward, nothing):
    rows = B.coded(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].words is None and by[3].n_tokens is None and by[3].offsets is None
    assert by[4].n_tokens == 0 and by[4].words == b"" and list(by[4].offsets) == []
    assert by[6].n_tokens > 60_000 and by[6].n_words * 8 == len(by[6].words)
    assert B.coded(nothing).count() == 0


def test_ids_are_the_vocabularys_own_whatever_the_white_space():
    tokens = B.Tokens(B.vocabulary_bytes(B.VOCABULARY))
    r = random.Random(3)
    for _ in range(400):
        t = "".join(r.choice(["a", "word", " ", "  ", "\n", "\t", "\r\n", "é", ",", "\u00a0", "'s", "12", "\x1c"]) for _ in range(r.randrange(25)))
        assert tokens.ids(t).tolist() == tokens.encode(t), repr(t)
    # a vocabulary that merges white space across a line's end
    merged = B.vocabulary_bytes(B.VOCABULARY).rstrip() + b"\n" + base64.b64encode(b"\n \n") + b" 999999\n"
    tokens = B.Tokens(merged)
    assert tokens.ids("a\n \nb").tolist() == tokens.encode("a\n \nb")
