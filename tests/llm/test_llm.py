"""Operators of haulstat.llm against brute force, held-out accuracy and odd input."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulstat.llm import (components, decontaminate, language, lattice, mixing, passages, quality, simhash, suffixes, toxicity,
                          trees, urls)
from haulstat.llm.queries import LLM_QUERIES, VOCABULARY

WORD = r"[^\x20\x09-\x0D]+"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside must not disturb them.
CLASHES = ["fp", "h", "n", "key", "root", "size", "target", "_key", "place", "oid", "block", "score", "a", "b"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and extra columns."""
    long_text = "alpha beta gamma delta. " * 30_000
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t", "en", None, 3), (None, "one two three", "en", "b", 13),
            (4, "one two three", "de", "b", None), (4, "one two three", "de", "b", None), (5, long_text, "en", "a", len(long_text)),
            (6, "x" * 200_000, "en", None, 200_000), (7, "ONE two three", "fr", "b", 13), (8, "é ñ ß \u2028 \x85 ok", "es", "c", 9)]
    frame = spark.createDataFrame(rows, SHAPE)
    return frame.withColumns({c: F.lit(1) for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def groups_of(pairs, names):
    up = {n: n for n in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_url_rules_and_model(spark):
    rows = [(1, "http://WWW.Example.com/en/1?x"), (2, "https://a.example.com/en/1"), (3, "https://b.net/es/#t"), (4, "x.com/en/"), (5, None),
            (6, "http://shop.org"), (7, "http://spam-farm.example.org/en/2"), (7, "http://spam-farm.example.org/en/2"), (None, "a://c.com"),
            (8, "http://u.com/" + "p" * 100_000), (9, "https://music.example.org/en/5")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("score", F.lit(2))
    out = [tuple(r)[:4] + (r.verdict,) for r in urls.filter_urls(pages, urls.labelled_urls(spark), urls.RULES).collect()]
    assert (1, "www.example.com", "/en/1", "www.example.com/en/", "allow") in out
    assert (2, "a.example.com", "/en/1", "example.com/en/", "block") in out
    assert (3, "b.net", "/es/", "net/es/", "block") in out
    assert {r[1:4] for r in out if r[0] in (4, 5)} == {("", "", None)}
    assert (6, "shop.org", "", None) in [r[:4] for r in out] and (None, "c.com", "", None) in [r[:4] for r in out]
    assert out.count((7, "spam-farm.example.org", "/en/2", None, "block")) == 2
    assert (9, "music.example.org", "/en/5", None, "allow") in out and len(out) == len(rows)
    empty = spark.createDataFrame([], "url string, bad int")
    assert {r.verdict for r in urls.filter_urls(pages, empty, []).collect()} == {"allow"}


def test_simhash_is_exact(docs, texts):
    import xxhash
    prints = {}
    for i, text in texts.items():
        words = re.findall(WORD, lowered(text))
        shingles = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[k:k + 3]) for k in range(len(words) - 2)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = groups_of(close, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (format(prints[i], "016x"), root[i]) for i in ids}


def test_bit_planes_find_every_close_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = np.unique(np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), False))) for b in base for _ in range(15)]))
    for radius in (0, 1, 3, 5):
        got = set(zip(*(x.tolist() for x in simhash.close_pairs(prints, radius))))
        assert got == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= radius}


def test_hot_bucket_in_blocks(spark):
    rows = [(k << 40,) for k in range(300)]
    nodes = spark.createDataFrame(rows, "fp long")
    links = [tuple(r) for r in simhash.linked_fingerprints(nodes, block=32).collect()]
    names = [r[0] for r in rows]
    close = [(a, b) for k, a in enumerate(names) for b in names[k + 1:] if (a ^ b).bit_count() <= 3]
    assert groups_of(links, names) == groups_of(close, names)


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}


def test_passages_against_brute_force(docs, texts):
    found = {(i, k): words for i, t in texts.items() for k, (_, _, words) in enumerate(passages.units(t.encode())) if len(words) >= 6}
    sets = {u: frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) for u, w in found.items()}
    index = defaultdict(list)
    for u, s in sets.items():
        for g in s:
            index[g].append(u)
    pairs = []
    for u, s in sets.items():
        for o, both in Counter(o for g in s for o in index[g] if o > u).items():
            if both >= 0.8 * (len(s) + len(sets[o]) - both) - 1e-9:
                pairs.append((u, o))
    root = groups_of(pairs, list(found))
    size = Counter(root.values())
    want = {(*u, u != r, r[0], size[r]) for u, r in root.items() if size[r] > 1}
    got = {(r.doc_id, r.unit, r.removed, r.keeper_doc_id, r.component_size) for r in passages.repeated_units(docs).collect()}
    assert got == want and got
    assert {tuple(r) for r in passages.repeated_units(docs, most_hashes=0).collect()} == {tuple(r) for r in passages.repeated_units(docs).collect()}


def test_near_equal_sentence_is_cut(spark):
    first = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old green tree near town"
    rows = [(1, f"Intro here. {first}. End one two."), (2, f"Other words. {first} today. More of it."), (3, "Nothing in common with the others at all here.")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SHAPE)
    out = {r.doc_id: (r.text, r.n_chars) for r in passages.without_repeats(frame, SHAPE.replace(" long", "").replace(" string", "").split(", ")).collect()}
    assert out[1][0] == rows[0][1] and out[3][0] == rows[2][1]
    assert out[2] == ("Other words. More of it.", 24)
    assert b"".join(b"a b. c\nd"[a:b] for a, b, _ in passages.units(b"a b. c\nd")) == b"a b. c\nd"


def test_language_held_out(docs):
    rows = language.identify_language(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    out = [r for r in rows if r.held_out and r.n > 100]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def base_counts(text):
    words = re.findall(WORD, text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + s for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for s in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_verdict(spark, sf_dir, docs, texts):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.judge_quality(docs, labels).collect()
    for r in rows:
        want = base_counts(texts[r.doc_id])
        assert tuple(r)[1:6] == want and r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    judged = [r for r in rows if r.doc_id in marks and not r.base_failed]
    assert sum(r.kept == bool(marks[r.doc_id]) for r in judged) >= 0.85 * len(judged)


def test_trees_are_monotonic():
    rng = np.random.default_rng(5)
    x = rng.random((600, 2))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * x[:, 1]) > 0.6).astype(float)
    model = trees.fit_trees(x, y, [1, -1], trees=40)
    grid = np.linspace(0, 1, 50)
    for v in (0.1, 0.5, 0.9):
        assert (np.diff(model.probability(np.stack([grid, np.full(50, v)], 1))) >= -1e-12).all()
        assert (np.diff(model.probability(np.stack([np.full(50, v), grid], 1))) <= 1e-12).all()
    assert ((model.probability(x) > 0.5) == y).mean() > 0.85


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)


def test_swapped_identity_terms_move_little(spark):
    rows = [(i, f"{who} people came here today number {i}" + (" you stupid idiot" if bad else " and ate bread"), bad)
            for i, (who, bad) in enumerate([("muslim", 1), ("christian", 0)] * 60 + [("young", 0), ("young", 1)] * 20)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], SHAPE)
    labels = spark.createDataFrame([(i, 1, bad) for i, _, bad in rows], "doc_id long, quality int, toxic int")
    free, tied = (toxicity.train_toxicity(docs, labels, pair_weight=w) for w in (0.0, 30.0))
    gap = lambda m: abs(m.score("muslim people ate bread") - m.score("christian people ate bread"))
    assert gap(tied) < 0.05 < gap(free) and tied.score("you stupid idiot people") > 0.5


def test_lattice_sums_all_segmentations():
    model = lattice.Lattice(VOCABULARY)

    def total(text):
        if not text:
            return 1.0
        one = math.exp(model.byte * len(text[0].encode())) * total(text[1:]) if text[0] not in model.log else 0.0
        return one + sum(math.exp(model.log[text[:k]]) * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in model.log)

    for word in ("the", "tion", "ñandú", "x1", "\u4e00a"):
        assert model.word(word) == pytest.approx(math.log10(total("▁" + word)))
    assert math.isfinite(model.word("q" * 5000))


def test_base_score_is_exact(docs, texts):
    tokens = {i: re.findall(WORD, lowered(t)) + [""] for i, t in texts.items()}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    rows = lattice.score_documents(docs, VOCABULARY).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.score < 0


def test_suffix_array_in_two_stages():
    rng = np.random.default_rng(2)
    for k in range(120):
        text = rng.choice(np.frombuffer(b"ab\xffc" if k % 2 else b"a", np.uint8), rng.integers(1, 300))
        data, order = text.tobytes(), suffixes.suffix_array(text)
        heads = [data[i:i + 50] for i in order]
        assert sorted(order) == list(range(len(text))) and heads == sorted(heads)
        shared = suffixes.common_prefixes(text, order)
        assert shared.tolist()[1:] == [next((m for m, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q))) for p, q in zip(heads, heads[1:])]


def bytes_left(texts):
    seen, out = {}, {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if seen.setdefault(data[p:p + 50], i) < i:
                gone[p:p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_is_exact(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_bytes(docs).collect()}
    assert got == bytes_left(texts)


def test_leaks_match_exact_and_reparameterised(spark, docs, texts, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = {(i, b.item_id) for i, t in texts.items() for b in benchmark.collect() if b.text in t}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} >= want
    item = "Tom has 5 apples and Ann gives Tom 7 more apples so how many apples are there now in the bowl of Tom"
    other = "so: {} has 8 apples and Eve gives {} 9 more apples so how many apples are there now in the bowl of {}"
    asked = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one")], "item_id long, text string")
    told = spark.createDataFrame([(1, other.format("Max", "Max", "Max")), (2, other.format("Max", "Bob", "Max")), (3, None), (None, item), (None, item)],
                                 "doc_id long, text string").withColumn("h", F.lit(0)).withColumn("item_id", F.lit(9))
    for most in (0, 1000):
        out = {(r.doc_id, r.item_id, r.reparameterised) for r in decontaminate.contaminated(told, asked, most_hashes=most).collect()}
        assert out == {(1, 1, True), (None, 1, False)}


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", ["big", "big", "big", "small", None][i % 5], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SHAPE).withColumn("target", F.lit("x")).withColumn("size", F.lit("x"))
    out = mixing.mix_sources(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in out:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 0.5 and target[s] <= 3 * size[s] for s in target)


def test_odd_rows_everywhere(spark, odd, nothing, sf_dir):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (5, None, None), (4, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    no_labels = labels.limit(0)
    n = odd.count()
    groups = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(odd).collect()}
    assert groups[(2, "0" * 16)] == groups[(3, "0" * 16)] == 1
    assert {v for (i, _), v in groups.items() if i in (4, 7, None)} == {4}
    assert passages.repeated_units(odd).count() == 0
    scored = {r.doc_id: r for r in lattice.score_documents(odd, VOCABULARY).collect()}
    assert scored[1].n_tokens == 1 and scored[8].n_tokens == 7 and lattice.score_documents(odd, VOCABULARY).count() == n
    left = {r.doc_id: r for r in suffixes.repeated_bytes(odd).collect()}
    assert left[1].n_bytes == 0 and left[1].kept_sha256 == hashlib.sha256(b"").hexdigest() and left[6].n_removed == 0
    assert suffixes.repeated_bytes(odd).count() == n
    lang = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_language(odd).collect()}
    assert lang[1] == lang[2] == lang[3] == ("und", 0.0) and len(lang) == 9
    judged = quality.judge_quality(odd, labels).collect()
    assert len(judged) == n and not any(r.kept for r in judged if r.n_words < 50)
    assert len({r.score for r in toxicity.score_toxicity(odd, no_labels).collect()}) == 1 and toxicity.score_toxicity(odd, labels).count() == n
    mixed = mixing.mix_sources(odd).collect()
    assert len(mixed) == n and {r.taken for r in mixed if r.size == 0} == {0}
    assert decontaminate.contaminated(odd, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for frame in (simhash.simhash_components(nothing), passages.repeated_units(nothing), language.identify_language(nothing),
                  quality.judge_quality(nothing, labels), toxicity.score_toxicity(nothing, labels), lattice.score_documents(nothing, VOCABULARY),
                  suffixes.repeated_bytes(nothing), decontaminate.contaminated(nothing, benchmark), mixing.mix_sources(nothing)):
        assert frame.count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from haulstat.llm.common import cut_lineage
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, cut_lineage(stage(spark, frame, sf_dir))
        if name != "source_mixing":
            assert frame.columns == corpus_pipeline.COLUMNS
        assert 0 < frame.count() <= before.count()
    assert frame.where("taken <= 0 or taken > 3 * size").count() == 0
    assert set(LLM_QUERIES) >= {"pipeline"} and len(LLM_QUERIES) == 14
