"""Where the tokens of two tokenizers meet: a byte-level BPE (A) and a sentencepiece BPE (B).

Both encode the same bytes, a space and the text.  The spans that the libraries
report are coarse cuts: character offsets of A, byte spans of B's proto.  A
character that several tokens of A share, and a character that B spells in
single bytes, have one span for all their tokens; there the bytes that each
token decodes to say where it ends.

Neither tokenizer has a token that reads on from a visible character to a
space, so a text can be cut before such spaces, and every cut is an end of a
token of both.  Groups and links therefore lie within the pieces between cuts,
and a piece is encoded and aligned once, then looked up in a cache of bounded
size.  Where a vocabulary has such tokens, texts are encoded whole.

Corpus counts of linked ids meet the documents again in two ways: the most
frequent pairs, ``head`` at most, are broadcast; what a document has of other
pairs, none of them frequent, is joined with their counts.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import accumulate, chain
from operator import attrgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from leakscan.llm.bpe import WHITE
from leakscan.llm.code import sent
from leakscan.llm.store import stored
from leakscan.llm.words import NARROW_BYTES, kept, let_go, sliced, utf8

CACHED_PIECES = 250_000  # of each of two generations
TOGETHER = 4096  # pieces that are encoded in one go
LONG_PIECE = 128  # characters; longer pieces are not cached
HEAD = 1 << 20  # pairs whose counts are broadcast
BLOCK_PAIRS = 1 << 21
MOST_BYTES = 64 << 20  # of a tokenizer's file, which is broadcast
SPACE = "▁"  # a space in the pieces of B
# From a space that follows a visible character to the next such space; white space at the end stays with the last piece.
PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:(?! )[{WHITE}]+[^{WHITE}]+)*(?:[{WHITE}]+\\Z)?|[{WHITE}]+")
ENDS = frozenset(chr(c) for c in range(0x3001) if re.fullmatch(f"[{WHITE}]", chr(c)))
WHOLE = re.compile(r"(?s).+")
BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte: itself if visible, else the next free one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Piece(NamedTuple):
    """A stretch of text in both encodings."""

    n_a: int
    groups: str  # a1,a2|b1;a3|b2,b3
    links: bytes  # a * (number of ids of B) + b, eight bytes each
    whole: bool  # both decode to the piece


LOST = Piece(0, "", b"", False)


def refined(coarse: np.ndarray, clean: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The end of each token: the coarse one where it is clean, else as many bytes past the last clean one as tokens decode to."""
    decoded = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(clean, np.arange(1, len(sizes) + 1), 0))
    return np.concatenate([[0], coarse])[last] + decoded - np.concatenate([[0], decoded])[last]


def _flat(pairs: Iterable[tuple[int, int]], n: int) -> np.ndarray:
    return np.fromiter(chain.from_iterable(pairs), np.int64, 2 * n).reshape(n, 2)


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is among others, which ascend."""
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class Aligner:
    """Encodes with both tokenizers and lays their tokens side by side."""

    def __init__(self, json_bytes: bytes, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.a = tokenizers.Tokenizer.from_str(json_bytes.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        described = json.loads(json_bytes)
        letters = byte_letters()
        added = {t["id"]: t["content"].encode() for t in described["added_tokens"]}
        entries = {i: added[i] if i in added else bytes(letters[c] for c in e) for e, i in self.a.get_vocab().items()}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        spelled = [BYTE.match(p) if self.b.is_byte(i) else None for i, p in enumerate(pieces)]
        self.is_byte = np.array([m is not None for m in spelled])
        self.b_bytes = [
            bytes([int(m[1], 16)]) if m else p.replace(SPACE, " ").encode() for p, m in zip(pieces, spelled)
        ]
        self.ids_of_b = len(pieces)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # Each id in decimals with what may follow it, and how to read a token of a proto.
        self._written = [f"{i}{c}" for i in range(max(len(entries), len(self.a_bytes), len(pieces))) for c in ",|;"]
        self._read = attrgetter("id", "end")
        self.pattern = PIECES if self._cuts_before_spaces(described, model, pieces) else WHOLE
        self._cache: dict[str, Piece] = {}
        self._older = self._cache
        self._lossy = False  # whether there is a piece that a tokenizer does not give back

    def _cuts_before_spaces(self, described: dict, model: bytes, pieces: list[str]) -> bool:
        """Whether no token of either tokenizer reads on from a visible character to a space, nor the text is changed."""
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rule = proto.normalizer_spec
        plain = not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and rule.add_dummy_prefix
        before = described.get("pre_tokenizer") or {}
        words = described.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        return plain and words and rule.escape_whitespaces and not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def _ends(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A, ids of B, and where each token ends, in bytes; nothing if the tokens decode to something else."""
        one = self.a.encode(text, add_special_tokens=False)
        # A space stands before what B encodes.
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        b, b_spans = _flat(map(self._read, pieces), len(pieces)).T
        ids = one.ids  # a list made anew each time
        if b"".join(map(self.a_bytes.__getitem__, ids)) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return None
        a, spans = np.array(ids, np.int64), _flat(one.offsets, len(ids))
        # Bytes before each character, for offsets in characters.
        characters = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        before = np.append(characters, len(data))
        clean = spans[:, 1] == np.append(spans[1:, 0], len(text))
        a_ends = refined(before[spans[:, 1]], clean, self.a_sizes[a])
        return a, b, a_ends, refined(b_spans + 1, ~self.is_byte[b], self.b_sizes[b])

    def _lay(self, texts: list[str]) -> list[Piece]:
        """The pieces, encoded in one go; if something does not fit, one by one."""
        text = "".join(texts)
        data = text.encode()
        found = self._ends(text, data)
        stops = np.cumsum([len(t.encode()) for t in texts])
        if found is None or not (_in(stops, found[2]).all() and _in(stops, found[3]).all()):
            self._lossy |= len(texts) == 1
            return [LOST] if len(texts) == 1 else [self._lay([t])[0] for t in texts]
        a, b, a_ends, b_ends = found
        # Tokens overlap between each two ends, of whichever side, that follow each other.
        common = _in(b_ends, a_ends)
        ends = np.sort(np.concatenate([a_ends, b_ends[~common]]), kind="stable")
        links = a[np.searchsorted(a_ends, ends)] * self.ids_of_b + b[np.searchsorted(b_ends, ends)]
        # A token's place in the text of groups: after its own side's tokens before it, and the other side's of earlier groups.
        both = b_ends[common]
        a_to, b_to = np.searchsorted(a_ends, both, "right"), np.searchsorted(b_ends, both, "right")
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        a_at = np.arange(len(a)) + np.concatenate([[0], b_to])[a_group]
        b_at = np.arange(len(b)) + a_to[b_group]
        shown = np.zeros(len(a) + len(b), np.int64)
        shown[a_at], shown[b_at] = 3 * a, 3 * b
        shown[a_at[a_to - 1]] += 1  # the last of A in a group
        shown[b_at[b_to - 1]] += 2
        written = list(map(self._written.__getitem__, shown.tolist()))
        n_a, n_b = np.searchsorted(a_ends, stops, "right"), np.searchsorted(b_ends, stops, "right")
        raw = links.astype(np.int64).tobytes()
        to, link_to = (n_a + n_b).tolist(), (8 * np.searchsorted(ends, stops, "right")).tolist()
        return [
            Piece(n, "".join(written[i:j])[:-1], raw[k:m], True)
            for n, i, j, k, m in zip(np.diff(n_a, prepend=0).tolist(), [0, *to], to, [0, *link_to], link_to)
        ]

    def _learn(self, texts: list[str]) -> dict[str, Piece]:
        """Encode and align pieces, each of which starts with a space."""
        # White space at the end would run on into the next piece.
        alone = [t for t in texts if self.pattern is WHOLE or t[-1] in ENDS or SPACE in t]
        out = {t: self._lay([t])[0] for t in alone}
        rest = [t for t in texts if t not in out]
        for k in range(0, len(rest), TOGETHER):
            some = rest[k : k + TOGETHER]
            out.update(zip(some, self._lay(some)))
        return out

    def pieces(self, texts: list[str | None]) -> list[list[Piece]]:
        """The pieces of each text; none of a text that is null or empty, or that a tokenizer does not give back."""
        # Nothing made here refers back to itself, and walking the cache again and again costs more than the work.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._pieces(texts)
        finally:
            if collects:
                gc.enable()

    def _pieces(self, texts: list[str | None]) -> list[list[Piece]]:
        split = [self.pattern.findall(f" {text}") if text else [] for text in texts]
        cache, older = self._cache, self._older
        flat = list(chain.from_iterable(split))
        got = list(map(cache.get, flat))
        # Few texts are without a new piece, and most pieces are not new.
        missed = [at for at, known in enumerate(got) if known is None]
        new = []
        for piece in {flat[at] for at in missed}:
            if piece in older:
                cache[piece] = older[piece]
            else:
                new.append(piece)
        if new:
            cache.update(self._learn(new))
        for at in missed:
            got[at] = cache[flat[at]]
        to = list(accumulate(map(len, split)))
        out = [got[i:j] for i, j in zip([0, *to], to)]
        for piece in new:
            if len(piece) > LONG_PIECE:
                del cache[piece]
        if len(cache) >= CACHED_PIECES:
            # What is in use comes back from the older generation; the rest goes with it.
            self._older, self._cache = cache, {}
        if not self._lossy:
            return out
        return [found if all(p.whole for p in found) else [] for found in out]


class Pair:
    """What tasks need to build an aligner: the files of both tokenizers, broadcast."""

    def __init__(self, spark: SparkSession, json_path: str, model_path: str):
        files = []
        for path in (json_path, model_path):
            with open(path, "rb") as file:
                files.append(file.read(MOST_BYTES + 1))
            if len(files[-1]) > MOST_BYTES:
                raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
        self.key = hashlib.sha256(b"".join(base64.b64encode(f) + b"\n" for f in files)).hexdigest()
        self.files = sent(spark).sparkContext.broadcast(tuple(files))

    def aligner(self) -> Aligner:
        """Built once in each worker process, and kept with its cache until a task of another kind comes.

        A cache of each task's own would meet the frequent pieces anew in every task.
        """
        return kept(self.key, lambda: Aligner(*self.files.value))

    def sliced(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sliced(batches, most=NARROW_BYTES, using=self.key)

    @cached_property
    def ids_of_b(self) -> int:
        return sentencepiece.SentencePieceProcessor(model_proto=self.files.value[1]).vocab_size()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


GROUP = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])


def aligned(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, groups), one per row of ``docs``: the shortest stretches that both tokenizers cut alike.

    A group has its bytes ``start`` to ``stop``, counted from the space before
    the text, and its ids ``a`` and ``b``.  Texts that are null or empty, or that
    one of the tokenizers does not give back byte by byte, have no groups.
    """

    def groups(pieces: list[Piece], sizes: np.ndarray) -> Iterator[dict]:
        start = 0
        for one in ";".join(p.groups for p in pieces).split(";") if pieces else ():
            a, b = ([int(x) for x in side.split(",")] for side in one.split("|"))
            stop = start + int(sizes[a].sum())
            yield {"start": start, "stop": stop, "a": a, "b": b}
            start = stop

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = pair.aligner()
        for batch in pair.sliced(batches):
            found = [list(groups(pieces, aligner.a_sizes)) for pieces in aligner.pieces(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(GROUP))], ["doc_id", "groups"])

    schema = "doc_id long, groups array<struct<start: long, stop: long, a: array<int>, b: array<int>>>"
    return _rows(docs, id_col, text_col).mapInArrow(run, schema)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _link(pair: Pair):
    """The rows of :func:`linked`, of batches with row, doc_id and text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = pair.aligner()
        for batch in pair.sliced(batches):
            counts, digests, pairs, times = [], [], [], []
            for pieces in aligner.pieces(batch.column("text").to_pylist()):
                codes = np.sort(np.frombuffer(b"".join([p.links for p in pieces]), np.int64))
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
                n = np.diff(first, append=len(codes))
                text = ";".join([p.groups for p in pieces])
                n_groups, n_a = text.count("|"), sum([p.n_a for p in pieces])
                counts.append((n_a, 2 * n_groups + text.count(",") - n_a, n_groups, len(codes)))
                digests.append(hashlib.sha256(text.encode()).hexdigest() if pieces else "")
                pairs.append(codes[first].tobytes())
                times.append(n.astype(np.int32).tobytes())
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *columns, pa.array(digests), pa.array(pairs), pa.array(times)],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return run


def linked(docs: DataFrame, pair: Pair) -> DataFrame:
    """Of rows (doc_id, text) the numbers of tokens, groups and links, a digest of the groups, and the linked pairs.

    A table in the shared folder: texts are encoded once.  ``row`` tells rows
    apart, ``pairs`` has each pair of a row once, of eight bytes each, and
    ``times`` how often, of four.
    """
    schema = (
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs binary, times binary"
    )
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_link(pair), schema), "linked")


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and times of all rows of a batch, and where each row's begin (one more at the end)."""
    (pairs, at), (times, _) = utf8(batch.column("pairs")), utf8(batch.column("times"))
    return pairs.view(np.int64), times.view(np.int32).astype(np.int64), at // 8


def pair_counts(found: DataFrame, ids_of_b: int) -> DataFrame:
    """Rows (pair, n, best) of :func:`linked`: links of each pair, and whether no other pair of its id of B has more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            pairs, times, _ = _pairs_of(batch)
            held.append((pairs, times))
            size += len(pairs)
            if size >= BLOCK_PAIRS:
                held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size >= BLOCK_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                    held, size = [], 0
        if held:
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    counts = found.select("pairs", "times").mapInArrow(run, "pair long, n long")
    counts = stored(counts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    # At most one row for each id of B.
    most = counts.groupBy((F.col("pair") % ids_of_b).alias("b")).agg(F.max("n").alias("most"))
    met = counts.join(F.broadcast(most), F.col("pair") % ids_of_b == F.col("b"))
    return met.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """How well the links of each text agree with the corpus, one row per row of ``docs``.

    Columns: doc_id; n_a and n_b, tokens; n_groups; n_links, pairs of tokens that
    share bytes; n_best, links whose pair of ids no other pair of the same id of
    B outnumbers in the corpus; count_sum, the corpus counts of the pairs over all
    links; groups_sha256, of ``a1,a2|b1;a3|b2,b3``, empty where there are no
    tokens.  Rows are counted each by itself, whatever their ids; texts without
    groups (see :func:`aligned`) have zeros.
    """
    spark = docs.sparkSession
    found = linked(_rows(docs, id_col, text_col), pair)
    counts = stored(pair_counts(found, pair.ids_of_b), "pair-counts")
    top = counts.orderBy(F.desc("n"), "pair").limit(head).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(
        (top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy().astype(bool))
    )
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        keys, n, best = known.value
        for batch in batches:
            pairs, times, at = _pairs_of(batch)
            place = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            hit = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
            if not hit.all():
                place = np.where(hit, place, 0)
            sums = []
            for value in (best, n):
                of_pair = times * value[place] * hit if len(keys) else np.zeros(len(pairs), np.int64)
                sums.append(np.diff(np.concatenate([[0], np.cumsum(of_pair)])[at]))
            ends = np.concatenate([[0], np.cumsum(~hit)])[at].astype(np.int32)
            rare = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(x) for x in sums), *rare],
                [*kept, "head_best", "head_sum", "pairs", "times"],
            )

    schema = (
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "head_best long, head_sum long, pairs array<long>, times array<long>"
    )
    partly = stored(found.mapInArrow(run, schema), "partly-scored")
    known.destroy()
    rare = partly.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    met = rare.join(counts, "pair")
    rest = met.groupBy("row").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("tail_best"), F.sum(F.col("times") * F.col("n")).alias("tail_sum")
    )
    none = F.lit(0).cast("long")
    return partly.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("head_best") + F.coalesce("tail_best", none)).alias("n_best"),
        (F.col("head_sum") + F.coalesce("tail_sum", none)).alias("count_sum"),
        "groups_sha256",
    )
