"""Cross-tokenizer alignment: where two tokenizers' tokens end at the same byte, and which of their tokens are linked.

Both id sequences of a document cover the same bytes. Pointers into all sequences of a batch advance in lockstep, as one
NumPy state; where both ends meet, a cut and the links of the group before it are emitted. Both tokenizers always end a token
before a space between words, so a text's groups are those of its pieces between such spaces: the lockstep's sequences are
a batch's pieces that are not known yet, and documents add up what was found for theirs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .common import materialize, table
from .packing import PRE_TOKEN

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens of A that one lane of the lockstep covers, so that a long document takes no more steps than others.
LANE = 1024
#: Bytes of text handled together, and of one block of documents whose pairs are looked up together.
_BATCH, _BLOCK = 2 << 20, 16 << 20
#: A group with more links than this is counted by distinct ids, not link by link.
_WIDE = 4096
#: Pieces that are remembered, each of at most so many characters, and how many are encoded as one text.
_REMEMBERED, _LONG, _RUN = 400_000, 48, 128
#: A space before a visible character and after anything but a space: no token of either tokenizer reaches across it.
_SPLIT = re.compile(r"(?<=[^ ]) (?=\S)")
#: A space that is not before a visible character.
_ODD = re.compile(r" (?!\S)")


def _pieces(text: str) -> list[str]:
    """The text cut at ``_SPLIT``; most texts have no other spaces and are cut by the faster way."""
    return _SPLIT.split(text) if text[:1] == " " or _ODD.search(text) else text.split(" ") if text else []


def _alone(piece: str) -> bool:
    """Whether a piece is too long to be remembered, or not cut off again where it is joined with others by spaces."""
    return len(piece) > _LONG or piece[0].isspace() or piece[-1] == " "


def byte_level() -> dict[str, int]:
    """The public table of byte-level vocabularies: visible Latin-1 characters stand for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level_encoder(path: str) -> tuple[dict[bytes, int], Callable[[list[str]], list[list[int]]]]:
    """The byte-level vocabulary of a tokenizer file, as bytes, and its encoder of lists of texts, special tokens as plain text.

    Where the file merges pairs in the order of the ids they give, as byte-level vocabularies do, and cuts texts by the
    public pattern, its ids are ranks and the faster rank encoder gives the same ones; else the file's own library encodes.
    """
    with open(path) as f:
        said = json.load(f)
    table_of = byte_level()
    special = {x["content"]: x["id"] for x in said["added_tokens"]}
    vocab = {bytes(table_of[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
    made = [said["model"]["vocab"][x + y] for x, y in pairs]
    before = said["pre_tokenizer"]
    plain = not said["normalizer"] and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    if plain and made == sorted(made) and len(vocab) == len(made) + 256:
        ranks = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=vocab, special_tokens={})
        return vocab, lambda texts: [ranks.encode_ordinary(t) for t in texts]
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return vocab, lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


class TokenizerPair:
    """Ids of pieces of texts by both tokenizers, and the bytes that each id stands for.

    A encodes a space and the text, B adds that space itself. A's pre-tokens start at the spaces between pieces, and no piece
    of B's vocabulary has a space after a visible character, which is tested when B is loaded. So the ids of a text are
    those of its pieces.
    """

    def __init__(self, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B):
        vocabulary, self.encode_a = _byte_level_encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n_a, n_b = 1 + max(vocabulary.values()), self.b.get_piece_size()
        if max(n_a, n_b) > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.bytes_a = [b""] * n_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece has a space inside: texts cannot be cut at spaces")
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))

    def encode(self, runs: list[list[str]]) -> tuple[list[str], list[str], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The runs' pieces that have ids and those that have none, then, for A and B, all ids and the places of each piece's first.

        A piece has none where the bytes of its ids are not a space and the piece. A run is encoded as one text; where its
        bytes differ, its pieces are encoded one by one. The places end with the number of ids.
        """
        found, lost, ids = [], [], ([], [])
        while runs:
            again, texts = [], [" ".join(run) for run in runs]
            for run, text, a, b in zip(runs, texts, self.encode_a([f" {t}" for t in texts]), self.b.encode(texts, num_threads=1), strict=True):
                want = f" {text}".encode()
                if b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b)):
                    found += run
                    ids[0].append(a)
                    ids[1].append(b)
                elif len(run) > 1:
                    again += [[p] for p in run]
                else:
                    lost += run
            runs = again
        starts = np.concatenate([[0], np.cumsum([1 + len(p.encode()) for p in found], dtype=np.int64)])
        flat = tuple(np.fromiter(chain.from_iterable(x), np.uint16, sum(map(len, x))) for x in ids)
        ends = [np.concatenate([[0], np.cumsum(size[x])]) for size, x in zip((self.size_a, self.size_b), flat, strict=True)]
        firsts = tuple(np.searchsorted(e, starts) for e in ends)
        if any((e[f] != starts).any() for e, f in zip(ends, firsts, strict=True)):
            raise ValueError("a token reaches across a space between pieces")
        return found, lost, flat, firsts


@lru_cache(maxsize=1)
def _known(path_a: str, path_b: str) -> Alignments:
    return Alignments(TokenizerPair(path_a, path_b))


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Groups between common ends: rows (a_from, a_to, b_from, b_to), token places, in order.

    ``ends_a`` and ``ends_b`` are the end bytes of all tokens of all documents, ascending over the whole batch, so that a
    document's last tokens end together. ``first_a`` and ``first_b`` are the places of the documents' first tokens, and
    lastly the number of tokens. Every document is a lane of its own, a long one several: a later lane starts inside the
    document, takes its first cut only as a start, and the lane before runs on until that very cut.
    """
    lengths = np.diff(first_a)
    per = -(-lengths // lane)
    doc = np.repeat(np.arange(len(lengths)), per)
    no = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    inner = no > 0
    pa_ = first_a[:-1][doc] + no * lane - inner
    pb_ = np.where(inner, np.searchsorted(ends_b, ends_a[pa_]), first_b[:-1][doc]) if len(doc) else no
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    limit = np.where(last, ends_a[first_a[1:][doc] - 1], ends_a[np.minimum(first_a[:-1][doc] + (no + 1) * lane - 1, len(ends_a) - 1)]) if len(doc) else no
    from_a, from_b, is_open, out = pa_.copy(), pb_.copy(), ~inner, []
    while len(pa_):
        at_a, at_b = ends_a[pa_], ends_b[pb_]
        step_a, step_b = at_a <= at_b, at_b <= at_a
        cut = step_a & step_b
        pa_, pb_ = pa_ + step_a, pb_ + step_b
        if cut.any():
            closed = cut & is_open
            out.append(np.stack([from_a[closed], pa_[closed], from_b[closed], pb_[closed]], 1))
            from_a, from_b, is_open = np.where(cut, pa_, from_a), np.where(cut, pb_, from_b), is_open | cut
            stay = ~(cut & (at_a >= limit))
            if not stay.all():
                pa_, pb_, from_a, from_b, is_open, limit = (x[stay] for x in (pa_, pb_, from_a, from_b, is_open, limit))
    if not out:
        return np.zeros((0, 4), np.int64)
    groups = np.concatenate(out)
    return groups[np.argsort(groups[:, 0])]


def link_counts(groups: np.ndarray, doc_of: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links of the groups as sorted distinct keys ``document << 32 | a << 16 | b``, and how many links each stands for.

    Every token of a group's A side is linked with every one of its B side. A wide group's links are counted by its distinct ids.
    """
    n_a, n_b = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    wide = n_a * n_b > _WIDE
    g, w_a, w_b = groups[~wide], n_a[~wide], n_b[~wide]
    times = w_a * w_b
    row = np.repeat(np.arange(len(g)), times)
    place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    key = (doc_of[~wide][row] << 32) | (ids_a[g[row, 0] + place // w_b[row]].astype(np.int64) << 16) | ids_b[g[row, 2] + place % w_b[row]]
    keys, counts = np.unique(key, return_counts=True)
    if not wide.any():
        return keys, counts
    more_k, more_n = [keys], [counts]
    for (a0, a1, b0, b1), d in zip(groups[wide], doc_of[wide], strict=True):
        (x, nx), (y, ny) = np.unique(ids_a[a0:a1], return_counts=True), np.unique(ids_b[b0:b1], return_counts=True)
        more_k.append(((d << 32) | (x.astype(np.int64)[:, None] << 16) | y.astype(np.int64)).ravel())
        more_n.append((nx[:, None] * ny).ravel())
    key, inverse = np.unique(np.concatenate(more_k), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, inverse, np.concatenate(more_n))
    return key, total


def groups_texts(groups: np.ndarray, last: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, n_a: int, n_b: int) -> list[str]:
    """The ids of all groups as ``a1,a2|b1;a3|b2,b3``, one text up to each of the groups ``last``."""
    if not len(groups):
        return []
    key_a, key_b = ids_a.astype(np.int64), ids_b + np.int64(2 * n_a)
    key_a[groups[:, 1] - 1] += n_a
    key_b[groups[:, 3] - 1] += n_b
    key_b[groups[last, 3] - 1] += n_b
    out = np.empty(len(key_a) + len(key_b), np.int64)
    out[np.arange(len(key_a)) + np.repeat(groups[:, 2], groups[:, 1] - groups[:, 0])] = key_a
    out[np.arange(len(key_b)) + np.repeat(groups[:, 1], groups[:, 3] - groups[:, 2])] = key_b
    return "".join(map(_shown(n_a, n_b).__getitem__, out.tolist())).split("\n")[:-1]


@lru_cache(maxsize=1)
def _shown(n_a: int, n_b: int) -> list[str]:
    """Each id with what may follow it: within a group, after a group's side, after the last group."""
    return [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;\n")) for end in ends for i in range(n)]


class Alignments:
    """What the lockstep found for pieces, kept from batch to batch: groups as text, numbers, distinct links and how often each."""

    def __init__(self, pair: TokenizerPair):
        self.pair = pair
        self.place: dict[str, int] = {}
        self.shown: list[str] = []
        #: n_a, n_b, n_groups and n_links by piece; zeros where it has no ids.
        self.numbers = np.zeros((0, 4), np.int64)
        #: Where each piece's links begin, and lastly their number; links as ``a << 16 | b``.
        self.first = np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)
        #: How many of the last pieces are not to be remembered.
        self.passing = 0

    def learn(self, pieces: set[str]) -> None:
        """Align those of ``pieces`` that are not known. If too many would be, the half that was used most stays."""
        new = pieces.difference(self.place)
        if len(self.place) and len(self.place) + len(new) > _REMEMBERED:
            self._keep(np.sort(np.argsort(self.uses, kind="stable")[::-1][: _REMEMBERED // 2]))
            self.uses //= 2
            new = pieces.difference(self.place)
        alone = [p for p in new if _alone(p)]
        # B reads its sign for a space as a space: such a piece would fail its whole run.
        signs = [p for p in new.difference(alone) if "▁" in p]
        joined = list(new.difference(alone, signs))
        self._add([*(joined[i : i + _RUN] for i in range(0, len(joined), _RUN)), *([p] for p in signs)])
        self._add([[p] for p in alone])
        self.passing = len(alone)

    def forget(self) -> None:
        """Drop the pieces that are not to be remembered: they were learned last."""
        if self.passing:
            n, self.passing = len(self.shown) - self.passing, 0
            for piece in list(islice(reversed(self.place), len(self.shown) - n)):
                del self.place[piece]
            del self.shown[n:]
            self.numbers, self.uses, self.first = self.numbers[:n], self.uses[:n], self.first[: n + 1]
            self.pairs, self.times = self.pairs[: self.first[-1]], self.times[: self.first[-1]]

    def _keep(self, which: np.ndarray) -> None:
        names = list(self.place)
        self.place = {names[k]: i for i, k in enumerate(which.tolist())}
        self.shown = [self.shown[k] for k in which.tolist()]
        at, n = _ranges(self.first[which], self.first[which + 1])
        self.pairs, self.times, self.first = self.pairs[at], self.times[at], np.concatenate([[0], np.cumsum(n)])
        self.numbers, self.uses = self.numbers[which], self.uses[which]

    def _add(self, runs: list[list[str]]) -> None:
        if not runs:
            return
        pair = self.pair
        found, lost, (ids_a, ids_b), (first_a, first_b) = pair.encode(runs)
        groups = lockstep(np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b]), first_a, first_b)
        bounds = np.searchsorted(groups[:, 0], first_a)
        keys, times = link_counts(groups, np.repeat(np.arange(len(found)), np.diff(bounds)), ids_a, ids_b)
        links = np.concatenate([[0], np.cumsum((groups[:, 1] - groups[:, 0]) * (groups[:, 3] - groups[:, 2]))])
        numbers = np.stack([np.diff(first_a), np.diff(first_b), np.diff(bounds), np.diff(links[bounds])], 1)
        more = np.append(np.searchsorted(keys >> 32, np.arange(1, len(found) + 1)), [len(keys)] * len(lost)).astype(np.int64)
        start = len(self.shown)
        self.place.update(zip([*found, *lost], range(start, start + len(found) + len(lost)), strict=True))
        self.shown += [*groups_texts(groups, bounds[1:] - 1, ids_a, ids_b, len(pair.bytes_a), len(pair.bytes_b)), *[""] * len(lost)]
        self.numbers = np.concatenate([self.numbers, numbers, np.zeros((len(lost), 4), np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + more])
        self.pairs, self.times = np.concatenate([self.pairs, keys & 0xFFFFFFFF]), np.concatenate([self.times, times])
        self.uses = np.append(self.uses, np.zeros(len(found) + len(lost), np.int64))


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one after the other, and how many each has."""
    n = stop - start
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n), n


def align_texts(texts: list[str | None], pair: TokenizerPair, known: Alignments | None = None) -> list[tuple]:
    """For each text (n_a, n_b, n_groups, n_links, groups, pairs, times): ``groups`` as text, distinct links and how often each.

    Pieces that ``known`` has need not be aligned again.
    """
    known = known or Alignments(pair)
    split = [_pieces(t) if t else [] for t in texts]
    known.learn(set().union(*split))
    places = [list(map(known.place.__getitem__, ps)) for ps in split]
    sizes = np.array(list(map(len, places)), np.int64)
    flat = np.fromiter(chain.from_iterable(places), np.int64, int(sizes.sum()))
    known.uses += np.bincount(flat, minlength=len(known.uses))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    used = np.flatnonzero(sizes)
    numbers, whole = np.zeros((len(texts), 4), np.int64), np.zeros(len(texts), bool)
    if len(used):
        numbers[used] = np.stack([np.add.reduceat(x[flat], starts[used]) for x in known.numbers.T], 1)
        whole[used] = np.logical_and.reduceat(known.numbers[flat, 0] > 0, starts[used])
    numbers[~whole] = 0
    doc = np.repeat(np.arange(len(texts)), sizes)
    mine = whole[doc]
    held, often = np.unique((doc[mine] << 32) | flat[mine], return_counts=True)
    at, n = _ranges(known.first[held & 0xFFFFFFFF], known.first[(held & 0xFFFFFFFF) + 1])
    keys, times = np.repeat(held >> 32 << 32, n) | known.pairs[at], np.repeat(often, n) * known.times[at]
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    distinct = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    keys, times = keys[distinct], np.add.reduceat(times, distinct) if len(distinct) else times
    cut = np.searchsorted(keys >> 32, np.arange(len(texts) + 1)).tolist()
    keys &= 0xFFFFFFFF
    shown = known.shown.__getitem__
    out = [(*row, ";".join(map(shown, ps)) if ok else "", keys[i:j], times[i:j]) for row, ps, ok, i, j in zip(numbers.tolist(), places, whole.tolist(), cut, cut[1:], strict=False)]
    known.forget()
    return out


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    flat = np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)), pa.array(flat))


def align(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups, pairs, times and block: both tokenizers' ids aligned by bytes.

    ``groups`` has the ids between common ends, ``a1,a2|b1;a3|b2,b3``. ``pairs`` are the document's distinct links, as
    ``a << 16 | b`` in 32 bits, ``times`` how many token pairs each stands for. ``block`` names about 16 MB of texts that
    one task read, see ``corpus_counts``. Whole texts, in batches of about 2 MB; no shuffle. Both files must be at the
    same paths on every executor.

    Cases: null and empty texts, and those that the ids' bytes do not give back, have no tokens, groups or links; control
    strings in texts are plain text; repeated rows are aligned each; kept columns of these names are replaced; an empty
    table gives no rows. A document's links are held by one task, as its distinct pairs.
    """
    new = T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>, block long")
    kept = [f for f in docs.schema if (keep is None or f.name in keep) and f.name.lower() not in {x.name for x in new}]
    at, source = [docs.columns.index(f.name) for f in kept], docs.columns.index(text_col)
    schema = T.StructType([*kept, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block, filled = _known(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(whole.column(source)), 0))
            start, bytes_before = 0, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            while start < whole.num_rows:
                stop = max(start + 1, int(np.searchsorted(bytes_before, bytes_before[start] + _BATCH)))
                batch = whole.slice(start, stop - start)
                rows = align_texts(batch.column(source).to_pylist(), known.pair, known)
                start = stop
                columns = list(zip(*rows, strict=True))
                filled += sum(len(x) for x in columns[5]) * 8
                made = [*(pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns[:5], new, strict=False)), _lists([x.astype(np.uint32).view(np.int32) for x in columns[5]], np.int32), _lists(columns[6], np.int32), pa.array(np.full(len(rows), block))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *made], names=schema.fieldNames())
                if filled >= _BLOCK:
                    block, filled = block + 1, 0

    return docs.mapInArrow(run, schema)


def corpus_counts(aligned: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` of ``align``'s written rows, with ``n_best`` and ``count_sum``.

    A pair's count is how many documents hold it linked. ``count_sum`` adds the counts up over a document's links;
    ``n_best`` is how many of them have the highest count of their A id. Documents do not meet their pairs one by one:
    each block asks once for each of its distinct pairs, and a task gets a block's documents with the block's answers.
    ``aligned`` must be a written table, as it is read twice.
    """
    in_block = aligned.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count("*").alias("n"))
    in_block = materialize(in_block, "block-pairs")
    totals = in_block.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("a", F.shiftrightunsigned("pair", 16))
    best = totals.groupBy("a").agg(F.max("total").alias("most"))
    judged = totals.join(best, "a").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    answers = in_block.select("block", "pair").join(judged, "pair").select("block", "pair", "total", "best")
    rows = aligned.select("block", "pairs", "times", *keep)
    schema = T.StructType([*(rows.schema[c] for c in keep), *T.StructType.fromDDL("n_best long, count_sum long")])

    def look_up(docs: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("pair").to_numpy())
        pair, total, best = (known.column(c).to_numpy()[order] for c in ("pair", "total", "best"))
        pairs, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
        flat, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        place = np.searchsorted(pair, flat)
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(pairs).to_numpy(zero_copy_only=False))])

        def summed(x: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(x)])
            return c[ends[1:]] - c[ends[:-1]]

        sums = [summed(n * best[place]), summed(n * total[place])] if len(flat) else [np.zeros(docs.num_rows, np.int64)] * 2
        return pa.Table.from_arrays([*(docs.column(c) for c in keep), *map(pa.array, sums)], names=schema.fieldNames())

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(look_up, schema)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token groups and links, against the corpus-wide counts of linked ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    aligned = align(docs, keep=["doc_id"]).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times", "block")
    return corpus_counts(materialize(aligned, "aligned"), keep)
