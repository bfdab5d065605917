import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

import brute
from llm_given import SMALL
from leakscan.llm import alignment, queries, words

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    with open(JSON, "rb") as one, open(MODEL, "rb") as other:
        return alignment.Aligner(one.read(), other.read())


@pytest.fixture(scope="module")
def plain():
    """Whole texts by the public libraries: ids of A, ids of B, groups and links, by the bytes of each token alone."""
    a = tokenizers.Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = alignment.byte_letters()
    own = {i: bytes(letters.get(c, 63) for c in entry) for entry, i in a.get_vocab().items()}

    def of_piece(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def run(text):
        if not text:
            return None
        sides = [(i, own[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, of_piece(i)) for i in b.encode(text)]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
            return None
        spans = []
        for side in sides:
            at, out = 0, []
            for i, data in side:
                out.append((i, at, at + len(data)))
                at += len(data)
            spans.append(out)
        groups, start = [], 0
        for cut in sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]}):
            groups.append((start, cut, *([i for i, s, e in side if start <= s and e <= cut] for side in spans)))
            start = cut
        links = [(i, j) for _, _, ids, others in groups for i, j in _overlapping(ids, others, own, of_piece)]
        return sides, groups, links

    return run


def _overlapping(a, b, own, of_piece):
    x = 0
    for i in a:
        y = 0
        for j in b:
            if max(x, y) < min(x + len(own[i]), y + len(of_piece(j))):
                yield i, j
            y += len(of_piece(j))
        x += len(own[i])


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in groups)


def test_pieces_are_those_of_whole_texts(aligner, plain):
    draw = random.Random(3)
    letters = "ab cdeé\n\t  '’sStTre0129½²Ⅷ一二日本　\x85\xa0\x1c\x1f​🙂🧿aaaa----====____  ́ßЯ\x00▁"
    texts = ["<|endoftext|> <s>a</s><0x41>", "🧿🧿 🧿", " ", "   ", "x ", "\n \n", "é" * 400 + " " + "a" * 300]
    for n in range(1200):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        if n % 3 == 0:
            text = "".join(chr(draw.choice([32, 10, draw.randrange(32, 127), draw.randrange(128, 0x2FFF)])) for _ in range(30))
        texts.append(text.replace("▁", "") if n % 2 else text)
    assert aligner.pattern is alignment.PIECES
    lost = 0
    for text, pieces in zip(texts, aligner.pieces(texts)):
        expected = plain(text)
        if expected is None:
            assert pieces == []
            lost += bool(text)
            continue
        sides, groups, links = expected
        assert ";".join(p.groups for p in pieces) == written(groups), text
        assert sum(p.n_a for p in pieces) == len(sides[0])
        codes = np.frombuffer(b"".join(p.links for p in pieces), np.int64)
        assert codes.tolist() == [a * aligner.ids_of_b + b for a, b in links]
    assert lost > 10


def test_coarse_ends_are_refined_where_characters_are_shared():
    coarse, clean = np.array([3, 9, 9, 12]), np.array([True, False, True, True])
    assert alignment.refined(coarse, clean, np.array([3, 2, 4, 3])).tolist() == [3, 5, 9, 12]
    assert alignment.refined(coarse, ~clean, np.array([3, 2, 4, 3])).tolist() == [3, 9, 13, 16]


def expected_rows(texts, plain):
    found = {k: plain(t) for k, t in enumerate(texts)}
    counts = {}
    for one in found.values():
        for link in one[2] if one else ():
            counts[link] = counts.get(link, 0) + 1
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for k in range(len(texts)):
        if found[k] is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        (a, b), groups, links = found[k]
        best = sum(counts[link] == most[link[1]] for link in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), brute.sha(written(groups))))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_matches_brute_force(spark, texts, plain):
    rows = {r.doc_id: tuple(r[c] for c in FIELDS) for r in queries.op13_token_alignment(spark, SMALL).collect()}
    ids = sorted(texts)
    assert rows == dict(zip(ids, expected_rows([texts[i] for i in ids], plain)))


def test_pairs_beyond_the_broadcast_ones_are_joined(spark, odd, plain):
    pair = alignment.Pair(spark, JSON, MODEL)
    rows = odd.collect()
    expected = sorted(zip([str(r.doc_id) for r in rows], expected_rows([r.text for r in rows], plain)))
    for head in (alignment.HEAD, 3, 0):
        found = alignment.scored(odd, pair, head=head).collect()
        assert sorted((str(r.doc_id), tuple(r[c] for c in FIELDS)) for r in found) == expected


def test_spans_of_groups_and_empty_tables(spark, odd, none, plain):
    pair = alignment.Pair(spark, JSON, MODEL)
    rows = sorted((r.text or "", [tuple(g) for g in r.groups]) for r in
                  alignment.aligned(odd.withColumn("doc_id", odd.score), pair).join(odd.select("text", "score"), odd.score == alignment.F.col("doc_id")).collect())
    assert rows == sorted((r.text or "", plain(r.text)[1] if plain(r.text) else []) for r in odd.collect())
    assert alignment.scored(none, pair).count() == 0 and alignment.aligned(none, pair).count() == 0


def test_what_a_task_learns_serves_the_next_one(spark, monkeypatch):
    pair, learned, learn = alignment.Pair(spark, JSON, MODEL), [], alignment.Aligner._learn
    monkeypatch.setattr(alignment.Aligner, "_learn", lambda self, texts: learned.extend(texts) or learn(self, texts))
    batch = pa.RecordBatch.from_pylist([{"row": 0, "doc_id": 1, "text": "one two, one\x00 three"}])
    words.let_go()
    first = [b.to_pylist() for b in alignment._link(pair)(iter([batch]))]
    assert sorted(learned) == [" one", " one\x00", " three", " two,"]
    assert [b.to_pylist() for b in alignment._link(pair)(iter([batch]))] == first and len(learned) == 4
    # A task of another kind holds none of it.
    assert list(words.sliced(iter([batch]))) == [batch] and not words._kept
