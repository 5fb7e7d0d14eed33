"""Byte-level BPE: encoding and decoding by padded matrices, and token counts by ragged arrays.

Both work on pre-tokens. A worker remembers the result of every distinct pre-token it has met, up to a bound, so
the array code runs once per distinct pre-token and not once per occurrence.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from brindle.llm.common import map_rows, mix64, tokenizer_path

INF = np.int64(1) << 40
#: Pre-tokens above this many bytes are merged by a heap, in the same order: a matrix needs a round for each merge, so its time
#: grows with the square of the bytes (figures in the README).
MATRIX_BYTES = 1024
#: Distinct pre-tokens a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 150_000


class PairTable:
    """Open-addressed hash table from a pair of ids to (rank, merged id), looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.rank = np.full(1 << bits, INF, np.int64)
        self.merged = np.zeros(1 << bits, np.int64)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[todo], return_index=True)
            takes = np.zeros(len(todo), bool)
            takes[first] = True
            takes &= free
            put = todo[takes]
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = keys[put], rank[put], merged[put]
            todo = todo[~takes]
            moved = self.keys[slot[todo]] != keys[todo]
            slot[todo[moved]] = (slot[todo[moved]] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; the slot of an unknown pair is an empty one, with rank INF."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        at = self.keys[slot]
        open_ = np.flatnonzero((at != keys) & (at != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.keys[slot[open_]]
            open_ = open_[(at != keys[open_]) & (at != np.uint64(2**64 - 1))]
        return slot


class Ranks:
    """A rank file: every two neighbours whose bytes together are a token may merge, the lowest rank first."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        rows = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items() if len(t) > 1 for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        left, right, new = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.pairs = PairTable(left, right, new, new)

    def by_heap(self, piece: bytes) -> list[int]:
        """One very long pre-token: a heap of candidate merges over a linked list, lowest rank then leftmost."""
        ids, tok = self.ids, [piece[i : i + 1] for i in range(len(piece))]
        nxt, prv = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        heap = [(r, i, tok[i] + tok[i + 1]) for i in range(len(tok) - 1) if (r := ids.get(tok[i] + tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] is None or j >= len(tok) or tok[j] is None or len(tok[i]) + len(tok[j]) != len(both):
                continue
            tok[i], tok[j], nxt[i] = both, None, nxt[j]
            if nxt[j] < len(tok):
                prv[nxt[j]] = i
                if (r := ids.get(both + tok[nxt[j]])) is not None:
                    heapq.heappush(heap, (r, i, both + tok[nxt[j]]))
            if (p := prv[i]) >= 0 and (r := ids.get(tok[p] + both)) is not None:
                heapq.heappush(heap, (r, p, tok[p] + both))
        return [ids[t] for t in tok if t is not None]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        length = np.array([len(p) for p in pieces], np.int64)
        for i in np.flatnonzero(length > MATRIX_BYTES):
            out[i] = np.array(self.by_heap(pieces[i]), "<u4").tobytes()
        whole = np.array([p in self.ids for p in pieces], bool)  # a piece that is a token itself needs no merges
        for i in np.flatnonzero(whole):
            out[i] = np.array([self.ids[pieces[i]]], "<u4").tobytes()
        short = np.flatnonzero((length > 0) & (length <= MATRIX_BYTES) & ~whole)
        for rows in np.split(short[np.argsort(length[short], kind="stable")], np.flatnonzero(np.diff(np.sort(length[short]))) + 1):
            if len(rows):
                n = int(length[rows[0]])
                step = max(1, 2_000_000 // (n + 1))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    self._bucket([pieces[i] for i in part], n, part, out)
        return out

    def _bucket(self, pieces: list[bytes], n: int, index: np.ndarray, out: list[bytes]) -> None:
        """One bucket of pieces with n bytes each: a matrix with a row for each, merged round by round.

        In a round every row that still has a mergeable pair merges its leftmost pair of minimum rank. All those rows
        lose one column then, so the matrix stays rectangular; the others leave it.
        """
        m = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), n)]
        slot = self.pairs.find(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(pieces), n - 1)
        while True:
            rank = self.pairs.rank[slot]
            best = rank.argmin(axis=1) if m.shape[1] > 1 else np.zeros(len(m), np.int64)
            row = np.arange(len(m))
            going = rank[row, best] < INF if m.shape[1] > 1 else np.zeros(len(m), bool)
            if not going.all():
                for i, ids in zip(index[~going].tolist(), m[~going].astype("<u4"), strict=True):
                    out[i] = ids.tobytes()
                m, slot, best, index = m[going], slot[going], best[going], index[going]
                row = row[: len(m)]
            if not len(m):
                return
            width = m.shape[1]
            m[row, best] = self.pairs.merged[slot[row, best]]
            keep = np.ones(m.shape, bool)
            keep[row, best + 1] = False
            m = m[keep].reshape(len(m), width - 1)
            keep = np.ones(slot.shape, bool)
            keep[row, best] = False
            slot = slot[keep].reshape(len(m), width - 2)
            has = best > 0
            slot[row[has], best[has] - 1] = self.pairs.find(m[row[has], best[has] - 1], m[row[has], best[has]])
            has = best < width - 2
            slot[row[has], best[has]] = self.pairs.find(m[row[has], best[has]], m[row[has], best[has] + 1])


class Merges:
    """A tokenizer file with an explicit merge list, byte-level pre-tokens and special tokens found inside texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        assert model["type"] == "BPE" and spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre.get("use_regex", True)
        self.prefix_space = bool(pre["add_prefix_space"])
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        assert len(np.unique(merged)) == len(merged)  # count_pieces needs that a symbol is made by one merge only
        self.pairs = PairTable(left, right, np.arange(len(merges), dtype=np.int64), merged)
        self.byte_id = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.special = {t["content"]: t for t in spec.get("added_tokens", [])}
        assert not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in self.special.values())
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def count_pieces(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols of each piece survive.

        The pieces lie in one flat array. In a round each piece's lowest-rank pair is applied wherever it occurs in that
        piece, leftmost first where occurrences overlap. No merge can make a pair of lower rank than its own (a pair's
        parts come earlier in the merge list), so this equals one merge at a time.
        """
        length = np.array([len(p) for p in pieces], np.int64)
        count = np.zeros(len(pieces), np.int64)
        owner = np.flatnonzero(length)
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        length = length[owner]
        count[owner] = length
        slot, rank = np.zeros(len(sym), np.int64), np.full(len(sym), INF)
        if len(sym) > 1:
            slot[:-1] = self.pairs.find(sym[:-1], sym[1:])
            rank[:-1] = self.pairs.rank[slot[:-1]]
        rank[np.cumsum(length) - 1] = INF  # no pair across two pieces
        while len(owner):
            start = np.concatenate(([0], np.cumsum(length)[:-1]))
            low = np.minimum.reduceat(rank, start)
            going = low < INF
            if not going.all():
                stay = np.repeat(going, length)
                sym, rank, slot = sym[stay], rank[stay], slot[stay]
                owner, length, low = owner[going], length[going], low[going]
                if not len(owner):
                    break
                start = np.concatenate(([0], np.cumsum(length)[:-1]))
            at = np.flatnonzero(rank == (low[0] if len(low) == 1 else np.repeat(low, length)))
            if len(at) > 1 and (np.diff(at) == 1).any():  # overlapping occurrences: every second one of a run, from its left
                fresh = np.concatenate(([True], np.diff(at) > 1))
                run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.pairs.merged[slot[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            length = length - np.bincount(np.searchsorted(start, at, side="right") - 1, minlength=len(length))
            at = (np.cumsum(keep) - 1)[at]
            sym, rank, slot = sym[keep], rank[keep], slot[keep]
            fresh = np.concatenate([at, at[at > 0] - 1])  # pairs with a new symbol; the others keep their ranks
            fresh = fresh[fresh < len(sym) - 1]
            slot[fresh] = self.pairs.find(sym[fresh], sym[fresh + 1])
            rank[fresh] = self.pairs.rank[slot[fresh]]
            rank[np.cumsum(length) - 1] = INF
            count[owner] = length
        return count


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stays, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=4)
def _memory(kind: str, path: str, pattern: str) -> dict:
    return {}


def _remember(memory: dict, pieces: list[list[str]], work) -> None:
    """Fill ``memory`` with the results of pieces that it lacks, in bounded portions."""
    if len(memory) > REMEMBERED:
        memory.clear()
    new = list({p for doc in pieces for p in doc}.difference(memory))
    at = 0
    while at < len(new):
        stop, size = at, 0
        while stop < len(new) and (stop == at or size + len(new[stop]) <= 1_000_000):
            size += len(new[stop])
            stop += 1
        memory.update(zip(new[at:stop], work([p.encode() for p in new[at:stop]]), strict=True))
        at = stop


def encode(texts: list[str | None], path: str, pattern: str) -> list[bytes]:
    """The ids of each text (null: empty), packed as little-endian unsigned 32-bit integers."""
    ranks, memory, find = load_ranks(path), _memory("ids", path, pattern), regex.compile(pattern).findall
    pieces = [find(t) if t else [] for t in texts]
    _remember(memory, pieces, ranks.encode_pieces)
    return [b"".join(map(memory.__getitem__, p)) for p in pieces]


def decode(ids: bytes, path: str) -> bytes:
    """The bytes that packed ids stand for. An unknown id raises KeyError, a length that is no multiple of 4 ValueError."""
    return b"".join(map(load_ranks(path).bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def count(texts: list[str | None], path: str, pattern: str) -> list[int]:
    """Token counts; special strings inside a text are one token each, as by the file's own default."""
    merges, memory, find = load_merges(path), _memory("counts", path, pattern), regex.compile(pattern).findall
    pieces, extra = [], []
    for t in texts:
        parts = merges.split.split(t) if t and merges.split else [t or ""]
        extra.append(len(parts) - 1)
        if merges.prefix_space:
            parts = [p if not p or p[0].isspace() else f" {p}" for p in parts]
        pieces.append([x for p in parts for x in find(p)])
    _remember(memory, pieces, lambda new: merges.count_pieces(new).tolist())
    return [sum(map(memory.__getitem__, p)) + e for p, e in zip(pieces, extra, strict=True)]


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # noqa: N811
    return pattern


def encode_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens of every row.

    Null and empty texts give empty ids. Rows are kept one for one, repeated ones and null ids included; other columns
    are not read. Nothing is shuffled: a lost executor's rows are encoded again from the input.
    """
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), _pattern(pattern)

    def run(ids, texts):
        packed = encode(texts, path, pattern)
        return {"doc_id": ids, "ids": packed, "n_tokens": [len(p) // 4 for p in packed]}

    return map_rows(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), run, "doc_id bigint, ids binary, n_tokens bigint", "doc_id", "text")


def decode_table(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded (binary) of rows with packed ids, one for one; null and empty ids decode to no bytes.

    decoded is null where the ids cannot be read: an unknown id, or bytes that are no whole number of ids.
    """
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def read(packed: bytes) -> bytes | None:
        try:
            return decode(packed, path)
        except (KeyError, ValueError):
            return None

    def run(doc_ids, packed):
        return {"doc_id": doc_ids, "decoded": [read(p or b"") for p in packed]}

    return map_rows(encoded, run, "doc_id bigint, decoded binary", "doc_id", "ids")


def round_trip_table(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, then its ids decoded; null is empty."""
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), _pattern(pattern)

    def run(ids, texts):
        packed = encode(texts, path, pattern)
        return {
            "doc_id": ids,
            "n_tokens": [len(p) // 4 for p in packed],
            "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [hashlib.sha256(decode(p, path)).hexdigest() for p in packed],
        }

    return map_rows(docs, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "doc_id", "text")


def count_table(docs: DataFrame, path: str | None = None, pattern: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row; null and empty texts have no bytes and no tokens."""
    path, pattern = path or tokenizer_path("byte_bpe_50k.json"), _pattern(pattern)

    def run(ids, texts):
        tokens = count(texts, path, pattern)
        return {"doc_id": ids, "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return map_rows(docs, run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", "doc_id", "text")
