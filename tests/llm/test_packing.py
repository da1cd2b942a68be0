"""Packing: ids against the tokenizer itself, pieces against a round trip, assignment against its rule."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulstat.llm import packing
from haulstat.llm.queries import LLM_QUERIES, PACKING_VOCABULARY


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PACKING_VOCABULARY)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]


def power_of_two(n):
    return n & (n - 1) == 0


def check_pieces(rows, want):
    """``rows`` (doc key, start, length, ids, doc_tokens, sequence, offset) hold each id of ``want`` once; sequences have no gap and no padding."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for key, start, length, ids, total, sequence, offset in rows:
        assert total == len(want[key]) and length == len(ids) > 0
        parts[key].append((start, ids))
        sequences[sequence].append((offset, length))
    assert {k: [i for _, ids in sorted(p) for i in ids] for k, p in parts.items()} == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY and power_of_two(at)


def test_words_give_the_tokenizers_ids(tokenizer):
    words = packing.Words(tokenizer.to_str())
    rng = random.Random(3)
    signs = "abcXYZ'éÀß×÷ÿIİı'’sltdm.,!?-_0129 \t\n\x1c\x85　́̈ñ中文ﬁΣσςκ<|>­﻿😀ǅ½²"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(20_000)]
    texts += ["don't we'll <|endoftext|>x a<|startoftext|>'s", "<|ENDOFTEXT|>", "x'S y'Ll", "", "x" * 50_000, "A" * 300 + "’" * 9]
    for text, whole in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == whole.ids, text


def test_query_round_trip(spark, sf_dir, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {k: ids_of(tokenizer, t) for k, t in docs.items()}
    rows = LLM_QUERIES["op12_packing"](spark, sf_dir).collect()
    assert rows[0].__fields__ == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = [(r.doc_id, r.start, r.length, want[r.doc_id][r.start:r.start + r.length], r.doc_tokens, r.sequence_id, r.offset) for r in rows]
    check_pieces(cut, want)
    assert all(r.ids_crc32 == zlib.crc32(np.array(c[3], "<u4").tobytes()) for r, c in zip(rows, cut))


def brute_assign(lengths, sizes, linear, quadratic):
    room, cost, out = list(sizes), [0.0] * len(sizes), []
    queue = sorted((-n, k, 0) for k, n in enumerate(lengths))
    while queue:
        length, k, start = queue.pop(0)
        length = -length
        fits = [s for s in range(len(sizes)) if room[s] >= length] or [s for s in range(len(sizes)) if room[s]]
        at = min(fits, key=lambda s: (cost[s], s))
        part = min(length, room[at])
        out.append((k, start, part, at, sizes[at] - room[at]))
        room[at] -= part
        cost[at] += linear * part + quadratic * part * part
        if part < length:
            queue = sorted(queue + [(part - length, k, start + part)])
    return out


def test_assignment_follows_its_rule():
    rng = random.Random(5)
    for _ in range(150):
        lengths = [rng.randint(1, rng.choice([3, 20, 63])) for _ in range(rng.randrange(60))]
        sizes = packing.rooms(sum(lengths), 64)
        assert sum(sizes) == sum(lengths) and all(map(power_of_two, sizes))
        assert packing.assign(lengths, sizes, 1.0, 0.03) == brute_assign(lengths, sizes, 1.0, 0.03)


def test_costs_are_balanced_and_few_documents_cut():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 6000).astype(int) + 1, packing.CAPACITY - 1).tolist()
    sizes = packing.rooms(sum(lengths), packing.CAPACITY)
    out = packing.assign(lengths, sizes)
    def spread(places):
        cost = Counter()
        for n, at in places:
            cost[at] += packing.LINEAR * n + packing.QUADRATIC * n * n
        full = [cost[k] for k, s in enumerate(sizes) if s == packing.CAPACITY]
        return max(full) / min(full)
    plain, at, room = [], 0, packing.CAPACITY  # documents one after the other, cut where a sequence ends
    for n in lengths:
        while n:
            part = min(n, room)
            plain.append((part, min(at, len(sizes) - 1)))
            n, room = n - part, room - part
            if not room:
                at, room = at + 1, packing.CAPACITY
    assert spread([(n, s) for _, _, n, s, _ in out]) < spread(plain)
    assert len(out) - len(lengths) < 0.1 * len(lengths)


def test_odd_documents(spark, tokenizer):
    rows = [(1, None), (2, ""), (None, "one two three"), (None, "one two three"), (3, " \n\t"), (4, "word " * 30_000), (5, "y" * 100_000), (6, "a é   <|endoftext|>"), (6, "b")]
    frame = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(1).sortWithinPartitions("n")
    frame = frame.withColumns({c: F.lit(1) for c in ("ids", "start", "length", "offset", "sequence_id")})
    for window in (1, 512):
        out = packing.pack_documents(frame, PACKING_VOCABULARY, window=window).collect()
        got = Counter(r.doc_id for r in out if r.start == 0)
        assert got == Counter(i for i, _ in rows)
        single = [r for r in out if r.doc_id not in (None, 6)]
        want = {i: ids_of(tokenizer, t) for i, t in rows}
        parts = defaultdict(list)
        for r in single:
            parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert {i: [x for _, p in sorted(v) for x in p] for i, v in parts.items()} == {i: w for i, w in want.items() if i not in (None, 6)}
        sizes = Counter()
        for r in out:
            sizes[r.sequence_id] += r.length
        assert all(power_of_two(s) and s <= packing.CAPACITY for s in sizes.values())
        assert sum(sizes.values()) == sum(len(ids_of(tokenizer, t)) for _, t in rows)
    assert packing.pack_documents(frame.limit(0), PACKING_VOCABULARY).collect() == []
