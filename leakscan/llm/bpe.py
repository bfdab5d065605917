"""Byte-level BPE by dynamic programming over prefixes.

The encoding of every byte prefix of a piece ends in exactly one token, and a
token may end a prefix just when it and the token before it would not have been
merged across their border.  So one number per byte, the last token of its
prefix, holds the encodings of all prefixes: appending extends the row, and an
edit recomputes it from the place of the edit to where it agrees again.

Texts are split by the tokenizer's pattern.  A coarser split at white space
cuts nowhere else than the pattern would, so its chunks are encoded once and
looked up after that, in a cache of bounded size.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.code import sent
from leakscan.llm.words import hand_back, kept, sliced

SLICE_BYTES = 2 << 20
CACHED_CHUNKS = 100_000  # of each of two generations
KNOWN_PAIRS = 200_000
SHORT_PIECE = 64  # bytes of a piece of many, and characters of a chunk that is cached
PAIR_BITS = 20
PAIR_SLOTS = 1 << PAIR_BITS
# The characters of Unicode's White_Space, which a tokenizer's \s stands for.
WHITE = "\t-\r \x85\xa0  -     　"
CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class Vocabulary:
    """Token bytes by rank, with the merge that makes each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.usable: dict[bytes, int] = {}
        self.longest = 1
        self.known: dict[tuple[int, int], bool] = {}  # what fits() has found
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                made = self._merged(token, rank)
                if len(made) != 2:
                    continue  # no merge makes it: only a piece equal to it is encoded so
                self.parts[rank] = made[0], made[1]
                self.merges[made[0], made[1]] = rank
            self.usable[token] = rank
            self.longest = max(self.longest, len(token))

    def _merged(self, token: bytes, below: int) -> list[int]:
        """The tokens that merges of lower rank leave of these bytes."""
        row = [self.ranks[token[k : k + 1]] for k in range(len(token))]
        while True:
            best = min(
                ((m, k) for k, pair in enumerate(itertools.pairwise(row)) if (m := self.merges.get(pair, below)) < below),
                default=None,
            )
            if best is None:
                return row
            row[best[1] : best[1] + 2] = [best[0]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together.

        The merges that made both are undone from the last one back; if the
        tokens that meet at the border have a merge of their own that comes
        before the merge just undone, it would have happened first.  Of equal
        ranks the one further left happens first.
        """
        if len(self.known) > KNOWN_PAIRS:
            self.known.clear()
        found = self.known[left, right] = self._stay_apart(left, right)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        merges, parts = self.merges, self.parts
        until = len(self.ranks) + 2
        while True:
            if merges.get((left, right), until) < until:
                return False
            if left > right and left in parts:
                until, left = left, parts[left][1]
            elif right in parts:
                until, right = right + 1, parts[right][0]
            elif left in parts:
                until, left = left, parts[left][1]
            else:
                return True


class Table:
    """Prefix rows of many short pieces at once, a byte column at a time.

    Tokens are followed byte by byte through a trie; pairs already judged are
    kept in a direct-mapped table of fixed size.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        children: list[dict[int, int]] = [{}]
        token_of = [-1]
        for token, rank in vocabulary.usable.items():
            node = 0
            for byte in token:
                after = children[node].get(byte)
                if after is None:
                    after = children[node][byte] = len(children)
                    children.append({})
                    token_of.append(-1)
                node = after
            token_of[node] = rank
        # Nodes with children have a row of the next nodes; row 0 is for those without.
        row_of = np.zeros(len(children), np.int32)
        inner = [k for k, c in enumerate(children) if c]
        row_of[inner] = np.arange(1, len(inner) + 1)
        self.after = np.full((len(inner) + 1, 256), -1, np.int32)
        for k in inner:
            self.after[row_of[k], list(children[k])] = list(children[k].values())
        self.row_of, self.token_of = row_of, np.array(token_of, np.int64)
        self.size_of = np.zeros(max(vocabulary.bytes_of) + 1, np.int64)
        for rank, token in vocabulary.bytes_of.items():
            self.size_of[rank] = len(token)
        self.pairs = np.full(PAIR_SLOTS, -1, np.int64)
        self.apart = np.zeros(PAIR_SLOTS, bool)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        with np.errstate(over="ignore"):
            slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.apart[slot]
        new = np.flatnonzero(self.pairs[slot] != pair)
        if len(new):
            some, at, inverse = np.unique(pair[new], return_index=True, return_inverse=True)
            found = np.array([self.vocabulary.fits(p >> 32, p & 0xFFFFFFFF) for p in some.tolist()], bool)
            out[new] = found[inverse]
            self.pairs[slot[new[at]]], self.apart[slot[new[at]]] = some, found
        return out

    def last(self, data: np.ndarray) -> np.ndarray:
        """For pieces of one length, as rows of bytes, the last token of each prefix."""
        count, size = data.shape
        last = np.full((count, size + 1), -1, np.int64)
        for begin in range(size):
            row, node = np.arange(count), np.zeros(count, np.int64)
            for end in range(begin + 1, size + 1):
                node = self.after[self.row_of[node], data[row, end - 1]]
                alive = node >= 0
                if not alive.all():
                    row, node = row[alive], node[alive]
                    if not len(row):
                        break
                token = self.token_of[node]
                open_ = np.flatnonzero((token >= 0) & (last[row, end] < 0))
                if begin and len(open_):
                    open_ = open_[self.fits(last[row[open_], begin], token[open_])]
                last[row[open_], end] = token[open_]
        return last[:, 1:]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The tokens of each piece; none is empty."""
        out: list[list[int]] = [[]] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            by_size.setdefault(len(piece), []).append(k)
        for size, places in by_size.items():
            data = np.frombuffer(b"".join([pieces[k] for k in places]), np.uint8).reshape(-1, size)
            last = self.last(data)
            # All pieces are read back together, a token from the end at a time.
            row, end, back = np.arange(len(places)), np.full(len(places), size), []
            while len(row):
                token = last[row, end - 1]
                back.append((row, token))
                end = end - self.size_of[token]
                row, end = row[end > 0], end[end > 0]
            found: list[list[int]] = [[] for _ in places]
            for rows, tokens in reversed(back):
                for k, token in zip(rows.tolist(), tokens.tolist()):
                    found[k].append(token)
            for k, tokens in zip(places, found):
                out[k] = tokens
        return out


class Prefixes:
    """The last token of every prefix of a piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, data: bytes) -> Prefixes:
        start = len(self.data)
        self.data += data
        self.last += [0] * len(data)
        self._fill(start)
        return self

    def _fill(self, start: int, tail: list[int] | None = None, edited: int = 0) -> int:
        """Set the last tokens from ``start`` on, as far as needed; returns where it stopped.

        With the row of the bytes behind an edit in ``tail``, the rest is known
        as soon as as many places agree as the longest token has bytes.
        """
        usable, known, data, last = self.vocabulary.usable.get, self.vocabulary.known, self.data, self.last
        longest, agreed = self.vocabulary.longest, 0
        for end in range(start + 1, len(data) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                token = usable(data[begin:end])
                if token is not None:
                    if not begin:
                        break
                    pair = last[begin - 1], token
                    fits = known.get(pair)
                    if fits or fits is None and self.vocabulary.fits(*pair):
                        break
            else:
                raise ValueError(f"no token for byte {data[end - 1]}")
            last[end - 1] = token
            if tail is not None and end > edited:
                agreed = agreed + 1 if token == tail[end - edited - 1] else 0
                if agreed >= longest:
                    return end
        return len(data)

    def replace(self, start: int, stop: int, data: bytes) -> Prefixes:
        """Put ``data`` where the bytes from start to stop are; the row is recomputed only near the edit."""
        tail, edited = self.last[stop:], start + len(data)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last[start:] = [0] * (len(self.data) - start)
        end = self._fill(start, tail, edited)
        self.last[end:] = tail[end - edited :] if end < len(self.data) else []
        return self

    def tokens(self) -> list[int]:
        end, out = len(self.data), []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes and decodes texts with a vocabulary and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.table = Table(self.vocabulary)
        self.pattern = regex.compile(pattern)
        self._cache: dict[str, tuple[int, ...]] = {}
        self._older = self._cache
        self._decimals = {rank: str(rank) for rank in self.vocabulary.bytes_of}

    def pieces(self, found: list[bytes]) -> list[list[int]]:
        """The tokens of each piece; one that is a token itself is that token."""
        whole = self.vocabulary.ranks
        short = list({p for p in found if p not in whole and len(p) <= SHORT_PIECE})
        known = dict(zip(short, self.table.encode(short)))
        out = []
        for piece in found:
            rank = whole.get(piece)
            ids = [rank] if rank is not None else known.get(piece)
            out.append(Prefixes(self.vocabulary, piece).tokens() if ids is None else ids)
        return out

    def _learn(self, chunks: list[str]) -> dict[str, tuple[int, ...]]:
        """Encode chunks that are not in the cache; short ones go into it."""
        split = [self.pattern.findall(chunk) for chunk in chunks]
        ids = self.pieces([piece.encode() for parts in split for piece in parts])
        out = {}
        at = 0
        for chunk, parts in zip(chunks, split):
            n = len(parts)
            own = ids[at] if n == 1 else [i for piece in ids[at : at + n] for i in piece]
            at += n
            out[chunk] = tuple(own)
        return out

    def chunks(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """The ids of the chunks of each text."""
        # Nothing made here refers back to itself, and walking the cache again and again costs more than the work.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._chunks(texts)
        finally:
            if collects:
                gc.enable()

    def _chunks(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        split = [CHUNKS.findall(text) for text in texts]
        cache, older = self._cache, self._older
        new = []
        for chunk in set(itertools.chain.from_iterable(split)):
            if chunk not in cache:
                found = older.get(chunk)
                if found is None:
                    new.append(chunk)
                else:
                    cache[chunk] = found
        cache.update(self._learn(new))
        out = [list(map(cache.__getitem__, found)) for found in split]
        for chunk in new:
            if len(chunk) > SHORT_PIECE:
                del cache[chunk]
        if len(cache) >= CACHED_CHUNKS:
            # What is in use comes back from the older generation; the rest goes with it.
            self._older, self._cache = cache, {}
        return out

    def forget(self) -> None:
        """Empty the caches, so that a worker that has other work holds none."""
        self.vocabulary.known = {}
        self._cache = {}
        self._older = self._cache

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(self.chunks([text])[0]))

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text, null ones having none."""
        for chunks in self.chunks([text or "" for text in texts]):
            yield list(itertools.chain.from_iterable(chunks))

    def decimals(self, ids: Iterable[int]) -> str:
        """The ids in decimals, joined by one space."""
        return " ".join(map(self._decimals.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class Tokenizer:
    """What tasks need to build an encoder: ranks of at most ``most`` tokens, broadcast, and the pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, most: int = 500_000):
        with open(path, "rb") as file:
            data = file.read()
        if data.count(b"\n") > most:
            raise ValueError(f"{path} lists more than {most} tokens")
        self.key = hashlib.sha256(data + pattern.encode()).hexdigest()
        self.ranks = sent(spark).sparkContext.broadcast(data)
        self.pattern = pattern

    def encoder(self) -> Encoder:
        """Built once in each worker process, and kept until a task of another kind comes."""
        return kept(self.key, self._build)

    def _build(self) -> Encoder:
        rows = (line.split() for line in self.ranks.value.splitlines() if line)
        return Encoder({base64.b64decode(t): int(r) for t, r in rows}, self.pattern)

    def sliced(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sliced(batches, most=SLICE_BYTES, using=self.key)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids), one per row of ``docs``, whatever its id; null and empty texts have no ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoder()
        for batch in tokenizer.sliced(batches):
            ids = pa.array(list(encoder.encode_all(batch.column("text").to_pylist())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])
        encoder.forget()
        hand_back()

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, data binary): the bytes that the ids stand for; null ids give no bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoder()
        for batch in batches:
            data = pa.array([encoder.decode(ids or ()) for ids in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data], ["doc_id", "data"])

    named = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return named.mapInArrow(run, "doc_id long, data binary")


def round_trip(
    docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encode and decode each text: (doc_id, n_tokens, ids_sha256, decoded_sha256) and, on request, ids.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the
    bytes that decoding the ids gives.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoder()
        for batch in tokenizer.sliced(batches):
            sizes, hashes, decoded, kept = [], [], [], []
            for ids in encoder.encode_all(batch.column("text").to_pylist()):
                sizes.append(len(ids))
                hashes.append(hashlib.sha256(encoder.decimals(ids).encode()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.array(ids, np.int32))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(decoded)]
            columns += [pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays(columns, names)
        encoder.forget()
        hand_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return _rows(docs, id_col, text_col).mapInArrow(run, schema)
