"""Benchmark decontamination: character seeds on one diagonal, bit-parallel edit bound of pieces, exact verification."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .texts import STEP, add_columns

#: A seed is so many characters; a piece is asked for at most so many seeds. Longest piece (it fits a machine word).
SAMPLED, REPEATS, PIECE = 6, 12, 60
#: Share of the items at the edit limit, edited at random places, that the seeds have to find.
RECALL = 0.99
#: Characters of items that a task searches for at once.
BLOCK_CHARS = 1_000_000
_BLOCK, _CHUNK, _GAP = 1 << 16, 4096, 160
_SHIFT = np.int64(1 << 40)
_WHITE = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def _normal(text: str | None) -> str:
    return b" ".join(_words(text)).decode("utf-8", "surrogatepass")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` characters from each place on."""
    count = max(0, len(codes) - size + 1)
    h = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h += codes[i : count + i]
            h *= _ODD
            if i % 2:
                h ^= h >> np.uint64(31)
    return h


def best_distance(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``item`` to any part of ``text``, and that part's end (bit-parallel, Myers 1999)."""
    size = len(item)
    if not size:
        return 0, 0
    at = text.find(item)
    if at >= 0:
        return 0, at + size
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    pv, mv, score, best, end = full, 0, size, size, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def _pieces(size: int) -> list[tuple[int, int]]:
    """(start, end) of an item's equal pieces."""
    edges = np.linspace(0, size, -(-size // PIECE) + 1).astype(int).tolist()
    return list(zip(edges, edges[1:], strict=False))


@lru_cache(4096)
def _seeding(size: int, max_edits: float, most: int, longest: int) -> tuple[int, int]:
    """(characters of a seed, seeds asked for) by which an item of ``size`` characters at the edit limit is found.

    The most seeds that one of the pieces within the limit keeps in ``RECALL`` of drawn edits; where that is under two,
    seeds get shorter, down to the length of which any such edits leave one whole.
    """
    edits = int(max_edits * size)
    sure = -(-(size - edits) // (edits + 1))
    if size > PIECE:
        sure = min(-(-(b - a - int(max_edits * (b - a))) // (int(max_edits * (b - a)) + 1)) for a, b in _pieces(size))
    sure = max(1, sure)
    rng = np.random.Generator(np.random.PCG64(size))
    edited = np.argsort(np.argsort(rng.random((500, size)), axis=1), axis=1) < edits
    for seed in range(longest, sure, -1):
        best = np.zeros(len(edited), int)
        for a, b in _pieces(size):
            if b - a >= seed:
                hurt = np.cumsum(np.pad(edited[:, a:b], ((0, 0), (1, 0))), axis=1)
                kept = (hurt[:, seed:] == hurt[:, :-seed]).sum(axis=1)
                best = np.maximum(best, np.where(hurt[:, -1] <= int(max_edits * (b - a)), kept, 0))
        need = int(np.sort(best)[int(len(best) * (1 - RECALL))])
        if need >= 2:
            return seed, min(need, most)
    return min(sure, longest), 1


class LeakIndex:
    """Seeds (runs of ``sampled`` characters or fewer) of the items' pieces.

    If an item is within the limit, so is one of its pieces, over its own length. A place of the text is tried where
    enough seeds of a piece lie on nearly one diagonal, ``repeats`` at most; how many are enough, and how long they are,
    follows from the item's length and ``max_edits`` (``_seeding``). Tried places pass a bit-parallel edit distance of
    the piece, many at a time, and then the exact distance of the item.
    """

    def __init__(self, items: list[tuple[int, str]], max_edits: float, repeats: int, sampled: int):
        self.max_edits = max_edits
        self.items = [(i, n) for i, t in items if (n := _normal(t))]
        owner, first, size, need, by_seed = [], [], [], [], defaultdict(list)
        for k, (_, text) in enumerate(self.items):
            length, asked = _seeding(min(len(text), 512), max_edits, repeats, sampled)
            for a, b in _pieces(len(text)):
                by_seed[length].append(len(owner))
                owner.append(k)
                first.append(a)
                size.append(b - a)
                need.append(asked)
        self.owner, self.first, self.size, self.need = (np.array(x, np.int64) for x in (owner, first, size, need))
        self.allowed = (self.size * max_edits).astype(np.int64)
        self.width = int(self.allowed.max(initial=0)) + 1
        self.tables = []
        for length, pieces in sorted(by_seed.items()):
            made = [_grams(_codes(self.items[owner[p]][1][first[p] : first[p] + size[p]]), length) for p in pieces]
            grams = np.concatenate(made)
            bits = int(np.ceil(np.log2(len(grams) + 1))) + 5
            slots = (grams >> np.uint64(64 - bits)).astype(np.int64)
            marks = np.concatenate([p * _SHIFT - np.arange(len(g)) for p, g in zip(pieces, made, strict=True)])
            order = np.argsort(slots, kind="stable")
            used, start, count = np.unique(slots[order], return_index=True, return_counts=True)
            place = np.full(1 << bits, -1, np.int32)
            place[used] = np.arange(len(used))
            self.tables.append((length, np.uint64(64 - bits), place, start, count, marks[order]))

    def tried(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, place) where enough seeds of a piece put its start within two widths from the place on."""
        found = []
        for length, shift, place, start, count, marks in self.tables:
            for low in range(0, len(codes), _BLOCK):
                grams = _grams(codes[low : low + _BLOCK + 2 * PIECE], length)
                slot = place[(grams >> shift).astype(np.int64)]
                at = np.flatnonzero(slot >= 0)
                slot = slot[at]
                n = count[slot]
                base = np.repeat(start[slot] - np.cumsum(n) + n, n)
                keys = marks[base + np.arange(len(base))] + np.repeat(at + (low + PIECE), n)
                keys.sort()
                last = np.arange(len(keys)) + self.need[keys // _SHIFT] - 1
                inside = np.flatnonzero(last < len(keys))
                keys = keys[inside[keys[last[inside]] - keys[inside] < self.width]]
                found.append(np.unique(keys // _SHIFT * _SHIFT + keys % _SHIFT // self.width))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return keys // _SHIFT, keys % _SHIFT * self.width - PIECE

    def within(self, codes: np.ndarray, pieces: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether a piece may be within its limit there. Characters count as equal by seven bits, so none is lost."""
        text = np.concatenate([codes & 127, np.zeros(1, np.uint32)]).astype(np.int64)
        out = np.zeros(len(pieces), bool)
        one = np.uint64(1)
        for low in range(0, len(pieces), _CHUNK):
            mine, at = pieces[low : low + _CHUNK], places[low : low + _CHUNK]
            known, row = np.unique(mine, return_inverse=True)
            masks = np.zeros((len(known), 128), np.uint64)
            for r, p in enumerate(known):
                item, a = self.items[self.owner[p]][1], self.first[p]
                own = _codes(item[a : a + self.size[p]]) & 127
                np.bitwise_or.at(masks[r], own, one << np.arange(len(own), dtype=np.uint64))
            masks, row = masks.ravel(), row * 128
            size = self.size[mine]
            top = (size - 1).astype(np.uint64)
            pv, mv = np.full(len(mine), ~np.uint64(0)), np.zeros(len(mine), np.uint64)
            score, best = size.copy(), size.copy()
            for j in range(int(size.max()) + 2 * self.width + 2 * int(self.allowed[mine].max())):
                c = at - self.allowed[mine].max() + j
                eq = masks[row + text[np.where((c >= 0) & (c < len(codes)), c, len(codes))]]
                xv = eq | mv
                with np.errstate(over="ignore"):
                    xh = (((eq & pv) + pv) ^ pv) | eq
                ph = mv | ~(xh | pv)
                mh = pv & xh
                score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
                ph, mh = ph << one, mh << one
                pv, mv = mh | ~(xv | ph), ph & xv
                np.minimum(best, score, out=best)
            out[low : low + _CHUNK] = best <= self.allowed[mine]
        return out

    def leaks(self, texts: list) -> list[list[dict]]:
        """For each text its leaks: item_id, edits, and the code points of the words in which the item lies."""
        out: list[list[dict]] = [[] for _ in texts]
        normal = [_normal(t) for t in texts]
        begin = np.cumsum([0, *(len(t) + _GAP for t in normal)])[:-1]
        codes = _codes(("\0" * _GAP).join(normal))
        pieces, places = self.tried(codes)
        near = self.within(codes, pieces, places)
        ranges = defaultdict(list)
        for p, at in zip(pieces[near].tolist(), places[near].tolist(), strict=True):
            # the gap between texts is wider than a piece's surroundings, so these lie in one text
            k, e = int(self.owner[p]), int(self.allowed[p])
            d = int(np.searchsorted(begin, at + int(self.size[p]) + 2 * self.width + e, "left")) - 1
            length = len(self.items[k][1])
            start, slack = at - int(self.first[p]) - int(begin[d]), int(length * self.max_edits) + e
            low, high = max(0, start - slack), min(len(normal[d]), start + length + 2 * self.width + slack)
            if low < high:
                ranges[d, k].append((low, high))
        for (d, k), found in ranges.items():
            item, text = self.items[k]
            best = None
            for low, high in _merged(found):
                edits, end = best_distance(text, normal[d][low:high])
                if edits <= self.max_edits * len(text) and (best is None or edits < best[0]):
                    _, back = best_distance(text[::-1], normal[d][low : low + end][::-1])
                    best = edits, low + end - back, low + end
            old = next((x for x in out[d] if x["item_id"] == item), None)
            if best and (old is None or best[0] < old["edits"]):
                if old:
                    out[d].remove(old)
                out[d].append({"item_id": item, "edits": best[0], "low": best[1], "high": best[2]})
        for text, plain, found in zip(texts, normal, out, strict=True):
            if found:
                spans = [m.span() for m in _WHITE.finditer(text)]
                for x in found:
                    low, high = x.pop("low"), x.pop("high")
                    low, high = plain.count(" ", 0, low + 1), plain.count(" ", 0, max(low, high - 1))
                    x["start"], x["end"] = (spans[low][0], spans[high][1]) if len(spans) == plain.count(" ") + 1 else (None, None)
            found.sort(key=lambda x: x["item_id"])
        return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def with_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, text_col: str = "text", keep: list[str] | None = None, repeats: int = REPEATS, sampled: int = SAMPLED, block: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a column ``leaks``: array of (item_id, edits, start, end), by item; empty where nothing leaks.

    An item leaks where some part of a text is within ``max_edits`` of the item's length in edits (lower case, words set
    apart by one space; start and end bound the words around it, in code points). Every place of every whole text is
    searched. Items go to the tasks in blocks of about ``block`` characters (an index takes some 250 bytes for each). All
    blocks are searched in one pass over the documents: for each batch of rows a task loads one index after the other and
    lets it go again, so that no task and no driver holds two; texts are neither shuffled nor written.

    An unedited item is always found. Seeds are chosen so that an item with random edits up to the limit is found with
    probability ``RECALL`` (drawn for its length); edits set evenly so as to hit every seed can hide a long item.
    ``repeats`` and ``sampled`` bound the seeds asked for and their length. An item of more than 512 characters asks for
    as many seeds of a piece as one of 512 does, which its more pieces make easier to find.

    Cases: null or empty texts and items match nothing; an item given twice is reported once; repeated rows are each
    reported; an empty ``benchmark`` gives empty arrays; a column named ``leaks`` is replaced.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    count, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-chars // block))
    indexes = []
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().collect() if count else []
        indexes.append(spark.sparkContext.broadcast(LeakIndex(sorted((r.item_id, r.text) for r in own), max_edits, repeats, sampled)))
        if blocks > 1:
            indexes[-1].__dict__.pop("_value", None)  # the driver keeps the file, not the index
    kind = "leaks array<struct<item_id: bigint, edits: int, start: int, end: int>>"
    if blocks == 1:
        return add_columns(docs, text_col, kind, lambda texts: [(x,) for x in indexes[0].value.leaks(texts)], keep)

    def search(texts: list) -> list[tuple]:
        found: list[list] = [[] for _ in texts]
        for index in indexes:
            for at in range(0, len(texts), STEP):
                for own, more in zip(found[at : at + STEP], index.value.leaks(texts[at : at + STEP]), strict=True):
                    own += more
            index.__dict__.pop("_value", None)
        return [(sorted(x, key=lambda m: (m["item_id"], m["edits"], m["start"])),) for x in found]

    return add_columns(docs, text_col, kind, search, keep, step=None)


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds, over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
