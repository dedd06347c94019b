"""Token ids in binary, packed by best fit decreasing into rows of one length."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ends every document; the id is free in the rank file.
END_OF_DOCUMENT = 50256
CAPACITY = 2048
_REMEMBERED = 400_000
_BYTES_A_SHARD = 8 << 20


class _Encoder:
    """Ids of a text as little-endian 16-bit bytes.

    No pre-token holds a space anywhere but at its start, unless it is white space only. So a text can be cut before each
    space that follows a visible character, and the ids of each piece be remembered (by the piece without its space),
    without changing the ids. A text with other spaces is encoded whole.
    """

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("H", self.encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self.whole(first) + b"".join(map(self.known.__getitem__, rest))
        except KeyError:
            pass
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        for piece in set(rest).difference(self.known):
            if not piece or piece[-1].isspace():
                return self.whole(text)
            self.known[piece] = self.whole(f" {piece}")
        if first[-1:].isspace():
            return self.whole(text)
        return self.whole(first) + b"".join(map(self.known.__getitem__, rest))


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, part, n_tokens, ids, row)``: each document's ids and an end mark, cut into parts of at most ``capacity``.

    ``row`` numbers what a task puts out.
    """
    end = np.array([END_OF_DOCUMENT], "<u2").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, row = _encoder(tokenizer), 0
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = (encoder.encode(text) if text else b"") + end
                for part, at in enumerate(range(0, len(ids), 2 * capacity)):
                    piece = ids[at : at + 2 * capacity]
                    rows.append((doc, part, len(piece) // 2, piece, row))
                    row += 1
            yield pd.DataFrame(rows, columns=["doc_id", "part", "n_tokens", "ids", "row"])

    # ids travel as text: pandas has no null among 64-bit integers
    cut_up = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, "doc_id string, part int, n_tokens int, ids binary, row long")
    return cut_up.withColumn("doc_id", F.col("doc_id").cast("long"))


def best_fit(lengths: Iterable[int], capacity: int) -> list[int]:
    """The bin of each length, given in decreasing order: the fullest bin that still has room, else a new one.

    A segment tree over the free space 0..capacity counts the open bins; the search goes to the least free space that is
    enough, in logarithmic time.
    """
    width = 1 << capacity.bit_length()
    tree, open_bins, out, used = [0] * (2 * width), [[] for _ in range(capacity + 1)], [], 0

    def add(space: int, by: int) -> None:
        at = space + width
        while at:
            tree[at] += by
            at >>= 1

    def least_enough(need: int) -> int:
        at = need + width
        if tree[at]:
            return need
        while at > 1:  # up to the first right neighbour that has a bin, then down to its leftmost
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < width:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - width
            at >>= 1
        return -1

    for length in lengths:
        space = least_enough(length)
        if space < 0:
            space, chosen, used = capacity, used, used + 1
        else:
            chosen = open_bins[space].pop()
            add(space, -1)
        out.append(chosen)
        left = space - length
        if left:
            open_bins[left].append(chosen)
            add(left, 1)
    return out


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into rows of ``capacity`` ids -> ``(shard, row, n_tokens, doc_ids, parts, cu_seqlens, position_resets, input_ids)``.

    ``input_ids`` is one row of the id matrix (little-endian 16-bit, padded with the end mark), ``cu_seqlens`` starts at
    0 and ends at ``n_tokens``, and ``position_resets`` are the offsets at which positions start again at 0. Segment i
    holds part ``parts[i]`` of document ``doc_ids[i]``; its parts in order give the document's ids and one end mark back.

    Rows are dealt by their place in the input (task and row number, not content) into shards of about 8 MB of text, so
    that a task packs a bounded number of segments, however often a row is repeated; an overlong document's parts spread
    over shards. Which rows meet in a shard depends on how the input is partitioned, what the packs hold does not. The
    rank file at ``tokenizer`` must be at the same path on every executor.

    Cases: null and empty texts are a lone end mark, so every row of ``docs`` is in the result, repeated ones too; null
    ids are kept; an empty table gives no rows; other columns are not read.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = partitions_for(total, _BYTES_A_SHARD, 1)
    pieces = token_pieces(docs, tokenizer, capacity, id_col, text_col)
    shard = F.pmod(F.xxhash64(F.spark_partition_id(), "row"), F.lit(shards)).cast("int")
    dealt = pieces.select(shard.alias("shard"), F.col("doc_id").cast("string").alias("doc_id"), "part", "n_tokens", "ids")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        docs_in = [None if x is None else int(x) for x in pdf["doc_id"]]
        n, part, ids = pdf["n_tokens"].tolist(), pdf["part"].tolist(), pdf["ids"].tolist()
        order = sorted(range(len(n)), key=lambda i: (-n[i], docs_in[i] is None, docs_in[i] or 0, part[i], ids[i]))
        bins: list[list[int]] = []
        for i, b in zip(order, best_fit([n[i] for i in order], capacity), strict=True):
            if b == len(bins):
                bins.append([])
            bins[b].append(i)
        shard, pad, rows = int(pdf["shard"].iloc[0]), np.full(capacity, END_OF_DOCUMENT, "<u2").tobytes(), []
        for row, own in enumerate(bins):
            ends = list(accumulate(n[i] for i in own))
            rows.append((shard, row, ends[-1], [docs_in[i] for i in own], [part[i] for i in own], [0, *ends], [0, *ends[:-1]], b"".join([ids[i] for i in own]) + pad[2 * ends[-1] :]))
        return pd.DataFrame(rows, columns=["shard", "row", "n_tokens", "doc_ids", "parts", "cu_seqlens", "position_resets", "input_ids"])

    schema = "shard int, row int, n_tokens int, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"
    return dealt.groupBy("shard").applyInPandas(place, schema)


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in rows of 2,048 ids."""
    return pack(table(spark, sf_dir, "documents"))
