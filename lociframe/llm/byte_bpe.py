"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece the last token of its encoding is unique: it is the token t, ending the prefix, that is
valid after the last token of what stands before t. Two neighbours are valid if no merge would have joined across
their border before both were complete; that is read from the tokens' own merges. The table of last tokens gives an
encoding by walking back, grows by one entry for each appended byte, and after an edit it is computed anew only until
it agrees with the old table again over the length of the longest token.

A text is first split by the tokenizer's pattern, and each piece is encoded for itself. A piece that is a token is
that token. Nulls are empty texts; an empty text has no tokens. Pieces of any length take time linear in it. Repeated
rows give equal rows; other columns are not looked at.

The vocabulary is read once on the driver, from a path that is a parameter, and sent to the tasks; its size is that of
the file, whatever the input.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.common import free_name

#: Pieces kept in each of the two generations of a worker's cache.
CACHE = 200_000
#: Characters of text that are split and encoded together, and the longest piece, in bytes, of the joint computation.
CHUNK = 1_000_000
LONGEST_JOINT = 64

#: Texts of these characters alone can be split by the standard library, at twice the speed, with equal results.
PLAIN = re.compile(r"[\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
PLAIN_SPLIT = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
        r""" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""",
}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def build_tables(ranks: dict[bytes, int]) -> dict:
    """Plain tables of a vocabulary, small enough to send to tasks.

    parts and merges: the pair that each token was merged from, and back. trie: the tokens that merging can make, read
    from their ends, as a hashed table of edges. Empty dictionaries for pieces met so far go with them; a worker keeps
    them from task to task.
    """
    parts: dict[int, tuple[int, int]] = {}
    merges: dict[tuple[int, int], int] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and (pair := _last_pair(token, rank, ranks, merges)):
            parts[rank] = pair
            merges[pair] = rank
    edges: dict[int, int] = {}
    token_of = [-1]
    for token, rank in ranks.items():
        if len(token) > 1 and rank not in parts:
            continue
        node = 0
        for byte in reversed(token):
            key = node << 8 | byte
            node = edges.get(key, 0)
            if not node:
                node = edges[key] = len(token_of)
                token_of.append(-1)
        token_of[node] = rank
    size = max(ranks.values(), default=0) + 1
    left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    for rank, pair in parts.items():
        left[rank], right[rank] = pair
    joint = {"edges": _hashed(edges), "token_of": np.array(token_of, np.int64), "left": left, "right": right,
             "merged": _hashed({a << 20 | b: r for (a, b), r in merges.items()})}
    return {"ranks": ranks, "parts": parts, "merges": merges, "joint": joint, "pieces": {}, "old_pieces": {}}


def _mix(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(values: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Open addressing: slots of keys (-1: free) and values, a quarter full at most."""
    bits = max(4, (4 * max(1, len(values)) - 1).bit_length())
    keys, vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
    todo_k = np.fromiter(values.keys(), np.int64, len(values))
    todo_v = np.fromiter(values.values(), np.int32, len(values))
    at = _mix(todo_k, bits)
    while len(todo_k):
        free = keys[at] < 0
        keys[at[free]] = todo_k[free]  # of several the last one wins; the others go on
        rest = keys[at] != todo_k
        vals[at[~rest]] = todo_v[~rest]
        todo_k, todo_v, at = todo_k[rest], todo_v[rest], (at[rest] + 1) & ((1 << bits) - 1)
    return keys, vals, bits


def _look(table: tuple[np.ndarray, np.ndarray, int], wanted: np.ndarray) -> np.ndarray:
    """Values of the keys, -1 where there is none."""
    keys, vals, bits = table
    at = _mix(wanted, bits)
    out = vals[at].astype(np.int64)
    have = keys[at]
    out[have != wanted] = -1
    todo = np.flatnonzero((have != wanted) & (have >= 0))
    while len(todo):
        at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
        have = keys[at[todo]]
        hit = have == wanted[todo]
        out[todo[hit]] = vals[at[todo[hit]]]
        todo = todo[~hit & (have >= 0)]
    return out


def _valid_pairs(joint: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Vocabulary.valid for arrays of pairs."""
    left, right = left.copy(), right.copy()
    before = np.full(len(left), 1 << 40)
    ok = np.ones(len(left), bool)
    todo = np.arange(len(left))
    while len(todo):
        a, b = left[todo], right[todo]
        merged = _look(joint["merged"], a << 20 | b)
        early = (merged >= 0) & (merged < before[todo])
        ok[todo[early]] = False
        rest_a, rest_b = joint["right"][a], joint["left"][b]
        go = ~early & ((rest_a >= 0) | (rest_b >= 0))
        todo, a, b, rest_a, rest_b = todo[go], a[go], b[go], rest_a[go], rest_b[go]
        undo_left = (rest_b < 0) | (rest_a >= 0) & (a > b)
        before[todo] = np.where(undo_left, a, b + 1)
        left[todo] = np.where(undo_left, rest_a, a)
        right[todo] = np.where(undo_left, b, rest_b)
    return ok


def last_tokens(joint: dict, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tables of last tokens of many short pieces, end to end, and where each piece starts.

    Tokens that end at a byte are found for all bytes at once, by walking back in the trie; the tables are then filled
    for the first bytes of all pieces, the second ones, and so on.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    place = np.arange(len(data)) - np.repeat(starts[:-1], sizes)  # of a byte in its piece
    ends, tokens, lengths = [], [], []
    at, node, back = np.arange(len(data)), np.zeros(len(data), np.int64), 0
    while len(at):
        node = _look(joint["edges"], node << 8 | data[at - back])
        on = node > 0
        at, node = at[on], node[on]
        token = joint["token_of"][node]
        full = token >= 0
        back += 1
        ends.append(at[full])
        tokens.append(token[full])
        lengths.append(np.full(int(full.sum()), back))
        on = place[at] >= back
        at, node = at[on], node[on]
    ends, tokens, lengths = np.concatenate(ends), np.concatenate(tokens), np.concatenate(lengths)
    order = np.lexsort((-lengths, ends, place[ends]))  # by step, then by byte, the longest token first
    ends, tokens, lengths = ends[order], tokens[order], lengths[order]
    steps = np.searchsorted(place[ends], np.arange(int(sizes.max(initial=0)) + 1))
    last = np.full(len(data), -1, np.int64)
    for lo, hi in zip(steps[:-1], steps[1:]):
        e, t, size = ends[lo:hi], tokens[lo:hi], lengths[lo:hi]
        todo = np.arange(len(e))
        while len(todo):
            first = todo[np.concatenate([[True], e[todo][1:] != e[todo][:-1]])]
            whole = size[first] == place[e[first]] + 1
            ok = whole.copy()
            part = np.flatnonzero(~whole)
            ok[part] = _valid_pairs(joint, last[e[first[part]] - size[first[part]]], t[first[part]])
            last[e[first[ok]]] = t[first[ok]]
            tried = np.zeros(len(e), bool)
            tried[first] = True
            todo = todo[~tried[todo] & (last[e[todo]] < 0)]
    if (last < 0).any():
        raise ValueError("no token ends at some byte")
    return last, starts


def _last_pair(token: bytes, rank: int, ranks: dict, merges: dict) -> tuple[int, int] | None:
    """The two tokens left when merges of lower rank are done; none if the token can't be made by merging."""
    parts = [ranks.get(token[i:i + 1]) for i in range(len(token))]
    if None in parts:
        return None
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := merges.get((parts[i], parts[i + 1]), rank)) < rank]
        if not found:
            return None
        r, i = min(found)
        parts[i:i + 2] = [r]
    return tuple(parts)


class Vocabulary:
    """Tokens, their bytes and the pair that each was merged from."""

    def __init__(self, tables: dict):
        self.tables = tables
        self.ranks, self.parts, self.merges = tables["ranks"], tables["parts"], tables["merges"]
        self._suffixes: dict[bytes, int] | None = None
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks), default=0)

    @property
    def suffixes(self) -> dict[bytes, int]:
        """Every suffix of a token that merging can make: its rank, or -1 if it is no such token."""
        if self._suffixes is None:
            usable = {t: r for t, r in self.ranks.items() if len(t) == 1 or r in self.parts}
            self._suffixes = dict.fromkeys((t[i:] for t in usable for i in range(len(t))), -1) | usable
        return self._suffixes

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(build_tables(read_ranks(path)))

    def valid(self, left: int, right: int) -> bool:
        """Whether `right` can follow `left`: undoing merges from the latest on, no border pair would have merged earlier."""
        merges, parts = self.merges, self.parts
        before = 1 << 62  # a border merge counts if it comes before the merge undone last
        while True:
            joined = merges.get((left, right))
            if joined is not None and joined < before:
                return False
            split_left, split_right = parts.get(left), parts.get(right)
            if split_left is None and split_right is None:
                return True
            # the later of both is undone; at equal rank the left one was made first
            if split_right is None or split_left is not None and left > right:
                before, left = left, split_left[1]
            else:
                before, right = right + 1, split_right[0]


class Prefixes:
    """Last token of every prefix of a byte string, with appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, data: bytes, known: dict | None = None) -> Prefixes:
        start = len(self.data)
        self.data += data
        self._extend(start + 1, len(self.data), {} if known is None else known)
        return self

    def _extend(self, first: int, final: int, known: dict) -> None:
        """Entries of the prefixes of first to final bytes; of the tokens that end a prefix, the longest are tried first."""
        data, last, rank_of, valid = self.data, self.last, self.vocabulary.suffixes.get, self.vocabulary.valid
        for end in range(first, final + 1):
            found = []
            start = end - 1
            while start >= 0 and (token := rank_of(data[start:end])) is not None:
                if token >= 0:
                    found.append((start, token))
                start -= 1
            for start, token in reversed(found):
                if start:
                    pair = (last[start - 1], token)
                    if (ok := known.get(pair)) is None:
                        ok = known[pair] = valid(*pair)
                    if not ok:
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replace bytes start:end; returns how many entries were computed anew.

        An entry depends on the bytes of the longest token before it and on their entries alone; once that many
        entries in a row agree with the old ones, the rest of the old table holds.
        """
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[:start]
        known: dict = {}
        agree, done = 0, 0
        for at in range(start + 1, len(self.data) + 1):
            self._extend(at, at, known)
            done += 1
            was = at - shift
            agree = agree + 1 if was > end and old[was - 1] == self.last[-1] else 0
            if agree >= self.vocabulary.longest:
                self.last += old[was:]
                break
        return done

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes whole texts piece by piece; pieces met before come from a cache of bounded size."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.plain = re.compile(PLAIN_SPLIT[pattern]) if pattern in PLAIN_SPLIT else None
        self.tables = vocabulary.tables
        self.lengths = np.zeros(max(vocabulary.bytes_of, default=0) + 1, np.int64)
        for rank, token in vocabulary.bytes_of.items():
            self.lengths[rank] = len(token)

    def split(self, text: str) -> list[str]:
        if self.plain is not None and PLAIN.fullmatch(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def _remember(self, found: dict[str, bytes]) -> None:
        """Two generations: when the new one is full, it becomes the old one, and what was old and not met goes."""
        new = self.tables["pieces"]
        new.update(found)
        if len(new) > CACHE:
            self.tables["old_pieces"], self.tables["pieces"] = new, {}

    def pieces(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of each piece, as the bytes of 32-bit integers."""
        new, old = self.tables["pieces"], self.tables["old_pieces"]
        missed = wanted.difference(new)
        out = {p: new[p] for p in wanted.difference(missed)}
        unknown = missed.difference(old)
        found = {p: old[p] for p in missed.difference(unknown)}
        ranks, one = self.vocabulary.ranks, np.int32
        joint: list[str] = []
        data: list[bytes] = []
        for p in unknown:
            b = p.encode("utf-8", "surrogatepass")
            if (whole := ranks.get(b)) is not None:
                found[p] = one(whole).tobytes()
            elif len(b) <= LONGEST_JOINT:
                joint.append(p)
                data.append(b)
            else:
                out[p] = np.array(Prefixes(self.vocabulary, b).ids(), one).tobytes()
        if joint:
            last, starts = last_tokens(self.tables["joint"], data)
            taken = np.zeros(len(last), bool)  # bytes that end a token of the encoding
            at, first = starts[1:] - 1, starts[:-1]
            while len(at):
                taken[at] = True
                at = at - self.lengths[last[at]]
                on = at >= first
                at, first = at[on], first[on]
            ids = last[taken].astype(one).tobytes()
            cuts = (4 * np.concatenate([[0], np.cumsum(taken)])[starts]).tolist()
            found.update((p, ids[lo:hi]) for p, lo, hi in zip(joint, cuts, cuts[1:]))
        out |= found
        self._remember(found)
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (not split or size + len(texts[at]) <= CHUNK):
                size += len(texts[at])
                split.append(self.split(texts[at]))
                at += 1
            ids = self.pieces(set(chain.from_iterable(split)))
            out += [np.frombuffer(b"".join(map(ids.__getitem__, x)), np.int32) for x in split]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """Encoding of text + more from that of text: only the last piece can change."""
        last = None
        for last in self.pattern.finditer(text):
            pass
        if last is None:
            return self.encode(more)
        keep = len(ids) - len(self.encode(text[last.start():]))
        return ids[:keep] + self.encode(text[last.start():] + more)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


def encode_texts(df: DataFrame, vocabulary_path: str, pattern: str, column: str = "text", decoded: bool = False) -> DataFrame:
    """All columns of df with `ids`, the token ids of the column, and if asked with `decoded`, the bytes of these ids.

    Columns of those names are replaced. Batches are worked and returned in slices of CHUNK characters or one row.
    """
    tables = df.sparkSession.sparkContext.broadcast(build_tables(read_ranks(vocabulary_path)))
    added = {"ids": T.ArrayType(T.IntegerType()), **({"decoded": T.BinaryType()} if decoded else {})}
    own = free_name(df, "__text")
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(tables.value), pattern)
        for batch in batches:
            texts = batch.column(own)
            rest = batch.drop_columns([own])
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, side="right")))
                ids = encoder.encode_all([t or "" for t in texts.slice(at, end - at).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = [*rest.slice(at, end - at).columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))]
                if decoded:
                    columns.append(pa.array([encoder.decode(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
                at = end

    return df.withColumn(own, F.col(column).cast("string")).select(*(f.name for f in kept), own).mapInArrow(run, schema)


def decode_ids(df: DataFrame, vocabulary_path: str, column: str = "ids") -> DataFrame:
    """All columns of df with `decoded`, the bytes of the ids."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = {r: t for t, r in ranks.value.items()}
        for lists in batches:
            yield pd.Series([b"" if ids is None else b"".join(map(bytes_of.__getitem__, ids)) for ids in lists], dtype=object)

    return df.withColumn("decoded", decode(F.col(column)))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a frame with ids and decoded."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
