import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import brute
from llm_given import SMALL
from leakscan.llm import attribution, bpe, language, lm, quality, queries, sharding, tiling


@pytest.fixture(scope="module")
def ranks():
    with open(queries.RANKS, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks, public_tokenizers.PATTERN)


def test_encoding_is_that_of_the_public_library(encoder, reference):
    draw = random.Random(1)
    letters = "ab cdeé\n\t  '’sStTre0129½²Ⅷ一二日本　\x85\xa0\x1c\x1f​🙂aaaa----====____  ́ßЯ"
    for n in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        if n % 3 == 0:
            text = "".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(128, 0x2FFF)])) for _ in range(40))
        assert encoder.encode(text) == reference.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_an_edit_gives_the_row_of_the_edited_bytes(encoder):
    draw = random.Random(2)
    for _ in range(200):
        data = bytes(draw.choice(b"abeinrst =-") for _ in range(draw.randint(0, 400)))
        a = draw.randint(0, len(data))
        b = draw.randint(a, min(len(data), a + 9))
        new = bytes(draw.choice(b"aeinst=-") for _ in range(draw.randint(0, 9)))
        row = bpe.Prefixes(encoder.vocabulary, data).replace(a, b, new)
        whole = bpe.Prefixes(encoder.vocabulary, data[:a] + new + data[b:])
        assert row.last == whole.last and row.tokens() == whole.tokens()
        assert bpe.Prefixes(encoder.vocabulary, data[:a]).append(data[a:]).last == bpe.Prefixes(encoder.vocabulary, data).last


def test_bpe_query(spark, texts, reference):
    for r in queries.op7_byte_bpe(spark, SMALL).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == brute.sha(" ".join(map(str, ids)))
        assert r.decoded_sha256 == brute.sha(texts[r.doc_id])


def test_bpe_of_odd_rows(spark, odd, none, reference):
    tokenizer = queries.tokenizer(spark)
    encoded = bpe.encode(odd, tokenizer)
    assert sorted((r.doc_id or -1, r.ids) for r in encoded.collect()) == sorted(
        (r.doc_id or -1, reference.encode_ordinary(r.text or "")) for r in odd.collect()
    )
    assert sorted(bytes(r["data"]) for r in bpe.decode(encoded, tokenizer).collect()) == sorted(
        (r.text or "").encode() for r in odd.collect()
    )
    assert bpe.round_trip(none, tokenizer, keep_ids=True).count() == 0


def plain_counts(text, reference, rule):
    """Tokens of each line by characters, the slow way."""
    owner = [k for k, line in enumerate(text.splitlines(keepends=True) if "\r" not in text else []) for _ in line]
    out, at = {}, 0
    data = text.encode()
    for i in reference.encode_ordinary(text):
        size = len(reference.decode_single_token_bytes(i))
        begin = len(data[:at].decode(errors="ignore"))
        end = len((data[: at + size] + b"").decode(errors="ignore"))
        end = end if data[: at + size].decode(errors="replace") == data[: at + size].decode(errors="ignore") else end + 1
        met = [owner[c] for c in range(begin, end)]
        k = {"first": met[0], "last": met[-1], "most": max(sorted(set(met)), key=met.count)}[rule]
        n, crossing = out.get(k, (0, 0))
        out[k] = n + 1, crossing + (len(set(met)) > 1)
        at += size
    return out


@pytest.mark.parametrize("rule", attribution.RULES)
def test_tokens_go_to_lines(spark, reference, rule):
    draw = random.Random(3)
    rows = [(k, "".join(draw.choice("ab é🙂\n\n  .x日") for _ in range(60))) for k in range(60)]
    found = {}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in attribution.token_counts(docs, queries.tokenizer(spark), rule=rule).collect():
        assert r.section >= 0 and 0 <= r.start < r.end
        found.setdefault(r.doc_id, {})[r.section] = r.n_tokens, r.n_crossing
    for i, text in rows:
        kept = {k: v for k, v in found.get(i, {}).items() if v[0]}
        assert kept == plain_counts(text, reference, rule)


def test_token_counts_of_listed_sections_and_odd_rows(spark, odd, none, reference):
    tokenizer = queries.tokenizer(spark)
    rows = [
        (1, "one two three", [(4, 7), (7, 7), None]), (2, "one two", None), (3, None, [(0, 5)]), (4, "", []),
        (5, "one two three", [(None, 3), (8, 13), (0, 10), (3, None), (9, 2)]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    found = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens, r.n_crossing) for r in attribution.token_counts(docs, tokenizer, sections_col="parts").collect()}
    # Of "one", " two" and " three" (from 7) the last starts in the third section, which holds the characters up to 10.
    assert found == {
        (1, -1): (None, None, 3, 1), (1, 0): (4, 7, 0, 0), (1, 1): (7, 7, 0, 0), (1, 2): (None, None, 0, 0),
        (2, -1): (None, None, 2, 0), (3, 0): (0, 5, 0, 0),
        (5, 0): (None, 3, 0, 0), (5, 1): (8, 13, 0, 0), (5, 2): (0, 10, 3, 1), (5, 3): (3, None, 0, 0), (5, 4): (9, 2, 0, 0),
    }
    total = sum(len(reference.encode_ordinary(r.text or "")) for r in odd.collect())
    assert sum(r.n_tokens for r in attribution.token_counts(odd, tokenizer).collect()) == total
    assert attribution.token_counts(none, tokenizer).count() == 0


def test_language_is_found_in_held_out_texts(spark, docs):
    rows = queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    known = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == len(known)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(docs, odd, none):
    model = language.train(docs)
    found = language.identify(odd, model)
    assert found.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score", "ambiguous"]
    at = {r.doc_id: r for r in found.collect() if r.doc_id is not None}
    assert all(at[k].lang_pred == "und" and at[k].score == 0 for k in (4, 5, 6, 8)) and at[9].lang_pred == "en"
    assert language.identify(none, model).count() == 0
    nothing = language.train(none)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    one = language.train(docs.filter("lang = 'de'"))
    assert {r.lang_pred for r in language.identify(docs, one).collect()} == {"de"}


@pytest.mark.parametrize("count", [2, 4, 7, 8, 30])
def test_codewords_are_far_apart(count):
    code = language.codewords(count)
    apart = [(code[a] != code[b]).sum() for a in range(count) for b in range(a)]
    assert min(apart) >= max(1, code.shape[1] // 4)


def test_quality_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(spark, docs, odd, none):
    labels = spark.createDataFrame([(1, 0), (3, 1), (9, 1), (9, 1), (5, None), (None, 1), (77, 5)], "doc_id long, quality int")
    assert quality.classify(odd, labels).count() == odd.count()
    assert {r.score for r in quality.classify(odd, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_scores_match_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learned = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    expected, tokens, words, pairs, texts, mass = brute.word_scores(rows, learned)
    found = {r.doc_id: r for r in queries.op8_lm_scores(spark, SMALL).collect()}
    assert len(found) == len(rows)
    errors = []
    for (i, _), use, (n, known, base), own in zip(rows, learned, expected, tokens):
        r = found[i]
        assert (r.n_tokens, r.n_known, r.held_out, r.train_tokens) == (n, known, not use, sum(words.values()))
        assert r.base_score == pytest.approx(base, rel=1e-9)
        plain = 0.0
        for before, w in zip(["\0begin", *own], own):
            context = texts if before == "\0begin" else words[before]
            weight = lm.PAIR_WEIGHT if context else 0
            plain += np.log10(weight * pairs[before, w] / max(context, 1) + (1 - weight) * (words[w] + 0.5) / mass)
        errors.append((r.score - plain) / n)
    # Levels are a quarter apart, so counts are off by an eighth at most, and a ratio of two by a quarter.
    assert np.abs(errors).max() < 0.1 and np.abs(errors).mean() < 0.01


def test_levels_are_read_back():
    keys = np.random.default_rng(1).integers(0, 2**63, 1999).astype(np.uint64)
    counts = np.arange(1, 2000) ** 2
    known = lm.segments.Filter(4, 1 << 20)
    names = lm.levels_put(keys, counts)
    level = np.searchsorted(lm.LEAST, counts, "right")
    home = lm.segments.segment(np.repeat(keys, level), 4)
    known.filled((k, known.one(names[home == k])) for k in range(4))
    read = lm.counts_read(known, keys)
    assert np.abs(np.log(read / counts)).max() < 0.2
    assert (lm.counts_read(known, keys + np.uint64(5)) > 0).mean() < 0.01


def test_full_filters_leave_words_that_are_equally_likely(docs):
    from pyspark.sql import functions as F

    rows = lm.scores(docs, F.lit(True), word_bytes=1, pair_bytes=1).collect()
    distinct = len({w for r in docs.collect() for w in brute.WORD.findall(r.text.translate(brute.LOWER))}) + 1
    assert {round(r.score / r.n_tokens, 2) for r in rows} == {round(-float(np.log10(distinct + 1)), 2)}


def test_filters_in_blocks_score_as_whole_ones(docs, odd):
    from pyspark.sql import functions as F

    for rows in (docs, odd):
        expected = sorted(lm.scores(rows, F.lit(True)).select("n_tokens", "n_known", "score").collect())
        known, filters, blocks = lm.train(rows, block_bytes=1 << 15)
        assert filters is not None and len(blocks) > 1
        found = sorted(lm.scores(rows, F.lit(True), block_bytes=1 << 15).select("n_tokens", "n_known", "score").collect())
        assert [r[:2] for r in found] == [r[:2] for r in expected]
        assert np.allclose([r.score for r in found], [r.score for r in expected])
    # The room for what is learned grows with the text.
    assert lm.segments.filter_bytes(30 * 10**9, lm.PAIR_BITS, None) == 3 * 10**9


def test_scores_of_odd_rows(odd, none):
    from pyspark.sql import functions as F

    rows = odd.collect()
    found = lm.scores(odd, F.col("doc_id") > 3)
    expected = brute.word_scores([(r.doc_id, r.text) for r in rows], [r.doc_id is not None and r.doc_id > 3 for r in rows])[0]
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found.collect())
    assert got == sorted((n, known, round(base, 6)) for n, known, base in expected)
    assert {r.base_score for r in lm.scores(odd, F.lit(None).cast("boolean")).collect()} == {0.0}
    assert lm.scores(none, F.lit(True)).count() == 0


def test_tiles_match_the_plain_loop():
    draw = random.Random(4)
    for _ in range(300):
        doc = [draw.choice("abcd") for _ in range(draw.randint(0, 40))]
        item = [draw.choice("abcd") for _ in range(draw.randint(0, 15))]
        x, y = (np.array([ord(c) for c in s], np.uint64) for s in (doc, item))
        assert sum(t[2] for t in tiling.tiles(x, y, 3)) == brute.tiled(doc, item, 3)
        # A pair that the words themselves deny is no tile.
        assert tiling.tiles(x, y, 3, lambda i, j, size: False) == []


def test_decontamination_matches_brute_force(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    word = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    grams = {k: {tuple(w[n : n + 5]) for n in range(len(w) - 4)} for k, w in ((k, word(t)) for k, t in items.items())}
    expected = set()
    for i, text in texts.items():
        words = word(text)
        own = {tuple(words[n : n + 5]) for n in range(len(words) - 4)}
        for k in items:
            if own & grams[k]:
                covered = brute.tiled(words, word(items[k]), 5)
                if covered >= 0.6 * len(word(items[k])):
                    expected.add((i, k, covered))
    found = {(r.doc_id, r.item_id, r.covered) for r in queries.op3_decontamination(spark, SMALL).collect()}
    assert found == expected and found


def test_short_items_and_repetitive_texts(spark):
    rows = [(1, "say Hello, brave new world today"), (2, "hello brave new"), (3, "word " * 40_000), (4, "word " * 700), (5, "yes"), (6, "a yes b")]
    items = [(1, "Hello brave new"), (2, "brave world"), (3, "word " * 1000), (4, "YES!"), (5, "..."), (6, "new world today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.covered) for r in tiling.contaminated(docs, benchmark).collect()}
    assert found == {(1, 1, 3), (2, 1, 3), (1, 6, 3), (3, 3, 1000), (4, 3, 700), (5, 4, 1), (6, 4, 1)}


def test_planted_and_reordered_items_are_found(spark, texts):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    found = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, SMALL).collect()}
    assert found >= {(i, k) for i, t in texts.items() for k, s in items.items() if s in t}
    words = items[0].upper().split()
    mixed = " ".join(["Other", *words[len(words) // 2 :], "between", *words[: len(words) // 2], "end"])
    docs = spark.createDataFrame([(1, mixed), (2, " ".join(words[::-1])), (3, " ".join(words[: len(words) // 3]))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in tiling.contaminated(docs, benchmark, block_words=50).collect()] == [(1, 0)]


def test_tiling_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "again and again, until there are more than thirteen"), (1, "word word"), (2, None), (None, "x " * 9), (3, "word " * 12)],
        "item_id long, text string",
    )
    found = [(r.doc_id, r.item_id, r.coverage) for r in tiling.contaminated(odd, items).collect()]
    assert sorted(found) == [(1, 1, 1.0), (2, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (9, 1, 1.0), (9, 3, 1.0)]
    assert tiling.contaminated(none, items).count() == 0
    assert tiling.contaminated(odd, items.limit(0)).count() == 0


def test_shards_are_even_and_stable(spark, odd, none):
    names = [f"s{k}" for k in range(20)]
    table, less = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    stay = table < 19
    assert (table[stay] == less[stay]).mean() > 0.9
    rows = sharding.placed(odd, names).collect()
    assert len(rows) == odd.count() and len({r.shard for r in rows if r.doc_id is None}) == 1
    assert all(r.shard == names[table[r.slot]] for r in rows)
    assert sharding.placed(none, names).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)


def test_sharding_query(spark, texts):
    rows = queries.op6_sharding(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
