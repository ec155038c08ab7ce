"""Token ids as Simple-8b words.

A 64-bit word's upper 4 bits are a selector that says how many ids of how many bits its lower 60 bits hold. Selector 0
is an escape: the next word is one raw id, for ids of over 60 bits. Ids are coded in blocks of BLOCK; the offset of each block's first word is
kept, so that the blocks of a text, or of a whole batch of texts, are decoded in step with each other by array operations.

Tokens are those of a byte-level BPE vocabulary file, whose path is a parameter; it is read where the plan is made and goes to the workers with it
(a vocabulary of more than MOST_BYTES is refused). A text is cut before each space that stands between two characters that aren't white space,
where the vocabulary's own pattern always cuts, so a worker can keep the ids of frequent pieces.

Defined results: a null text has null words, null offsets and null counts; an empty text has no tokens, no words and no
offsets; a null id is kept; repeated rows are coded one by one; texts are coded whole; an empty table gives an empty
table; other columns are ignored. Negative ids are refused.
"""

from __future__ import annotations

import base64
import re
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm.common import arrow_map, pick

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The public pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 128
#: By selector: ids a word, bits an id. 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Pieces whose ids a worker keeps; texts that are coded at a time, by their number of ids, about.
KNOWN, TOGETHER = 500_000, 1 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
MOST_BYTES = 64 << 20


class Tokens(dict):
    """What follows a space -> the ids of both as bytes of int32."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encode(" " + piece)).tobytes()
        if len(self) < KNOWN and len(piece) < 64:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        first, *rest = CUT.split(text)
        return np.frombuffer(b"".join([array("i", self.encode(first)).tobytes(), *map(self.__getitem__, rest)]), np.int32)


def widths(v: np.ndarray) -> np.ndarray:
    """Bits of each id; 0 of 0."""
    out = np.zeros(v.shape, np.uint8)
    for b in (32, 16, 8, 4, 2, 1):
        big = (v >> out.astype(np.uint64)) >= np.uint64(1) << np.uint64(b)
        out[big] += b
    return out + (v > 0).astype(np.uint8)


def blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its number of blocks; of each block its number of ids."""
    n = -(-lengths // BLOCK)
    sizes = np.full(int(n.sum()), BLOCK)
    full = n > 0
    sizes[np.cumsum(n)[full] - 1] = lengths[full] - (n[full] - 1) * BLOCK
    return n, sizes


def encode(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, offset of each block's first word) of each array of ids."""
    lengths = np.array([len(x) for x in texts], np.int64)
    n, sizes = blocks(lengths)
    if not len(sizes):
        return [(np.empty(0, np.uint64), np.empty(0, np.int32)) for _ in texts]
    v = np.zeros((len(sizes), BLOCK + int(COUNTS.max())), np.uint64)
    flat = np.concatenate(texts)
    if flat.dtype.kind != "u" and len(flat) and flat.min() < 0:
        raise ValueError("ids can't be negative")
    inside = np.arange(BLOCK) < sizes[:, None]
    v[:, :BLOCK][inside] = flat
    # the most bits within the next c places, for each c of a selector, from windows of powers of two
    bits = widths(v)
    spans = {1: bits}
    while max(spans) * 2 <= COUNTS.max():
        k = max(spans)
        spans[2 * k] = np.maximum(spans[k], np.pad(spans[k][:, k:], ((0, 0), (0, k))))
    choice = np.zeros((len(sizes), BLOCK), np.uint8)
    for s in range(15, 0, -1):
        c = int(COUNTS[s])
        k = 1 << (c.bit_length() - 1)
        most = np.maximum(spans[k][:, :BLOCK], spans[k][:, c - k : c - k + BLOCK])
        choice[most <= WIDTHS[s]] = s
    # all blocks walk from word to word in step
    block, at, word = [], [], []
    live, pos, count = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    while len(live):
        p = pos[live]
        s = choice[live, p]
        block.append(live)
        at.append(p)
        word.append(count[live])
        pos[live] = p + COUNTS[s]
        count[live] += 1 + (s == 0)
        live = live[pos[live] < sizes[live]]
    block, at, word = map(np.concatenate, (block, at, word))
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    chosen, to = choice[block, at], start[block] + word
    for s in range(16):
        rows = np.flatnonzero(chosen == s)
        if not len(rows):
            continue
        if s == 0:
            out[to[rows] + 1] = v[block[rows], at[rows]]
            continue
        w = np.full(len(rows), s << 60, np.uint64)
        for j in range(int(COUNTS[s]) if s > 1 else 0):
            w |= v[block[rows], at[rows] + j] << np.uint64(j * int(WIDTHS[s]))
        out[to[rows]] = w
    ends = np.cumsum(n)
    result = []
    for a, b in zip(ends - n, ends):
        if a == b:
            result.append((np.empty(0, np.uint64), np.empty(0, np.int32)))
        else:
            result.append((out[start[a] : start[b - 1] + count[b - 1]], (start[a:b] - start[a]).astype(np.int32)))
    return result


def decode(words: np.ndarray, offsets: np.ndarray, n_tokens: int) -> np.ndarray:
    """The ids again: all blocks in step."""
    _, sizes = blocks(np.array([n_tokens]))
    out = np.zeros((len(sizes), BLOCK + int(COUNTS.max())), np.uint64)
    live, pos, word = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), offsets.astype(np.int64).copy()
    while len(live):
        w = words[word[live]]
        chosen = (w >> np.uint64(60)).astype(np.int64)
        for s in np.unique(chosen):
            rows = live[chosen == s]
            if s == 0:
                out[rows, pos[rows]] = words[word[rows] + 1]
            elif s > 1:
                j = np.arange(COUNTS[s])
                out[rows[:, None], pos[rows][:, None] + j] = (w[chosen == s][:, None] >> (j * WIDTHS[s]).astype(np.uint64)) & np.uint64((1 << int(WIDTHS[s])) - 1)
        pos[live] += COUNTS[chosen]
        word[live] += 1 + (chosen == 0)
        live = live[pos[live] < sizes[live]]
    return out[:, :BLOCK][np.arange(BLOCK) < sizes[:, None]]


MADE: dict[bytes, Tokens] = {}


def vocabulary_bytes(path: str) -> bytes:
    raw = Path(path).read_bytes()
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return raw


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_words, offsets, words of every document: a map without a shuffle."""

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batch: pa.RecordBatch) -> dict:
        key = sent.value
        tokens = MADE[key] if key in MADE else MADE.setdefault(key, Tokens(key))
        texts = [None if t is None else tokens.ids(t) for t in batch.column("text").to_pylist()]
        got, part, size = [], [], 0
        for x in texts:
            if x is not None:
                part.append(x)
                size += len(x)
            if size > TOGETHER:
                got += encode(part)
                part, size = [], 0
        each = iter(got + encode(part) if part else got)
        rows = [(None,) * 4 if x is None else (len(x), len(w), o, w.astype("<u8").tobytes()) for x in texts for w, o in [next(each) if x is not None else (None, None)]]
        n, k, o, w = zip(*rows)
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "n_words": k, "offsets": o, "words": w}

    return arrow_map(pick(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")), run, "doc_id long, n_tokens long, n_words long, offsets array<int>, words binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
