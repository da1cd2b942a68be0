"""Whole-job tests: stages and operators against brute force where they used to fall short."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from haulstat.llm import decontaminate, near, passages, runs

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs_by_id(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def kept_of_near_copies(rows):
    """Brute force over (id, text): indexes of the rows that stay."""
    sets = []
    for _, text in rows:
        w = re.findall(WORD, lowered(text))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for o, both in Counter(o for g in s for o in index[g]).items():
            if both >= 0.8 * (len(s) + len(sets[o]) - both) - 1e-9:
                up[find(i)] = find(o)
        for g in s:
            index[g].append(i)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        place = (doc_id is None, doc_id or 0, i)
        first[find(i)] = min(first.get(find(i), place), place)
    return {p[2] for p in first.values()}


def test_near_copies_against_brute_force(spark, sf_dir):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(4000)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for k in range(60):  # copies whose similarity lies on both sides of 0.8, in chains
        text = list(rng.choice(words, int(rng.integers(20, 900))))
        for _ in range(4):
            rows.append((10_000 + len(rows) if k % 5 else None, " ".join(text)))
            text = list(text)
            for at in rng.choice(len(text), max(1, int(len(text) * rng.uniform(0.0, 0.05))), replace=False):
                text[at] = "new%d" % rng.integers(1 << 30)
    rows += [(5, "same id other text here now"), (5, "and a second text of id five"), (None, None), (9_999, ""), (7_777, "a b"), (7_778, "A  b")]
    frame = spark.createDataFrame([(i, t, str(n), "s", 0) for n, (i, t) in enumerate(rows)], SHAPE)  # lang tells the row
    got = {int(r.lang) for r in corpus_pipeline.one_of_each(spark, frame, sf_dir).collect()}
    want = kept_of_near_copies(rows)
    # Of rows with the same id and set, which one stays is not told.
    assert Counter(rows[k] for k in got) == Counter(rows[k] for k in want)
    assert len(want) < len(rows) - 60


def test_large_bucket_of_near_copies_in_blocks(spark):
    base = [f"b{k}" for k in range(100)]
    rows = [(k, " ".join(base[:k % 90] + [f"x{k}"] + base[k % 90 + 1:])) for k in range(90)] + [(1000 + k, f"alone {k} one two three four five") for k in range(5)]
    frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    rows_ = frame.withColumnRenamed("doc_id", "_row")
    from haulstat.llm.common import cut_lineage, map_rows
    prints = cut_lineage(map_rows(rows_, near._sketches, "_row long, h long, keys array<long>"))
    name = {r.h: r._row for r in prints.collect()}
    for block in (8, 512):
        links = [(name[a], name[b]) for a, b in near.similar_sets(rows_, prints, block=block).collect()]
        assert {x for p in links for x in p} >= set(range(90)) or len(links) >= 89


def leaks(spark, items, told):
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    out = {}
    for most in (0, 1000):
        rows = decontaminate.contaminated(docs, asked, most_hashes=most).collect()
        got = {(r.doc_id, r.item_id): r.reparameterised for r in rows}
        assert not out or got == out
        out = got
    return out


def test_verbatim_part_of_a_disagreeing_alignment_is_a_leak(spark):
    item = ("the farmer sold 5 baskets of red apples at the market near the old stone bridge and then the farmer walked slowly back home along "
            "the river to feed the hungry brown horses before the sun went down and then he counted all 5 baskets again in the empty barn at night")
    late = item.replace("all 5", "all 7")
    plain = "it was said that " + item.replace("sold 5", "sold 6").replace("all 5", "all 7")
    assert leaks(spark, [item], [late, plain]) == {(0, 0): False, (1, 0): False}


def test_two_item_values_may_become_one(spark):
    item = "a boy has 3 green pears and his sister has 5 green pears so how many green pears have the two of them"
    assert leaks(spark, [item], [item.replace("3", "4").replace("5", "4")]) == {(0, 0): True}


def test_verbatim_copies_of_items_without_literal_windows(spark):
    items = ["Compute 12 times 7", "WHO WROTE THE GREAT RUSSIAN NOVEL WAR AND PEACE", "Alle Kinder der Stadt essen am Sonntag Kuchen mit Sahne",
             "Is Alice Brown or Carl Dean or Eva Ford or Gina Hall the Queen"]
    told = [f"Here we go. {t} Next." for t in items] + [t.lower() for t in items] + [f"so {t.upper()} ok" for t in items] + ["Compute 13 times 7"]
    got = leaks(spark, items, told)
    assert {(k, k % 4) for k in range(12)} <= set(got) and (12, 0) not in got and not any(got[k, k % 4] for k in range(12))


def stretches_of(texts):
    """Brute force over texts in order: words covered by 50-word windows that stand at an earlier place without overlap."""
    signs = [t.encode().translate(passages._WORDS).split() for t in texts]
    seen, out = {}, []
    for i, w in enumerate(signs):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 49):
            j, q = seen.setdefault(tuple(w[p:p + 50]), (i, p))
            if j < i or q + 50 <= p:
                gone[p:p + 50] = True
        out.append([k for k, g in enumerate(gone) if g])
    return out


def test_runs_against_brute_force(spark, docs_by_id):
    ids = sorted(docs_by_id)
    frame = spark.createDataFrame([(i, docs_by_id[i]) for i in ids], "_row long, text string")
    got = defaultdict(set)
    for r in runs.repeated_runs(frame, passages._WORDS).collect():
        got[r._row] |= set(range(r.from_word, r.from_word + r.n_words))
        assert r.keeper_row <= r._row
    want = {i: set(s) for i, s in zip(ids, stretches_of([docs_by_id[i] for i in ids])) if s}
    assert dict(got) == want and want


def passage_rows():
    long = " ".join(f"word{k * 7919 % 1000}" for k in range(56))
    verse = "\n".join(f"line {k} sings of sea{k}" for k in range(14))
    a = [f"{n}{k}" for n in "pq" for k in range(30)]
    return long, verse, [(1, f"Start of it.\n{long}\n{verse}\nEnd of the first."), (2, " ".join(a[:30]) + f" {long} " + " ".join(a[30:])),
                         (3, "Some own words first\n" + verse + "\nand some own words last"), *((None, f"{long} " + " ".join(f"{n}{k}" for k in range(30))) for n in "xy")]


def test_passages_inside_lines_and_made_of_short_lines_are_cut(spark):
    long, verse, rows = passage_rows()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SHAPE)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.cut_repeats(spark, frame, "").collect()]
    left = dict(out)
    assert (1, rows[0][1]) in out
    assert left[2].split() == rows[1][1].replace(long, "").split()
    assert left[3] == "Some own words first\nand some own words last"
    assert sorted(t for i, t in out if i is None) == [" ".join(f"{n}{k}" for k in range(30)) for n in "xy"]
    found = {(r.doc_id, r.from_word, r.n_words, r.keeper_doc_id) for r in passages.repeats(frame).collect() if r.from_word is not None}
    assert {(2, 30, 56, 1), (3, 4, 70, 1), (None, 0, 56, 1)} <= found


def test_rows_that_share_an_id_leak_one_by_one(spark, sf_dir):
    item = "the old mill near Max grinds 8 sacks of rye and 9 sacks of oats each day so how many sacks of grain does it grind"
    told = [item.replace("8", "6").replace("9", "4"), item.replace("8", "3").replace("9", "7")]
    asked = spark.createDataFrame([(0, item)], "item_id long, text string")
    for ids in ((4, 5), (4, 4), (None, None)):
        docs = spark.createDataFrame([(i, t) for i, t in zip(ids, told)] + [(4, "nothing of the kind"), (None, "nor here")], "doc_id long, text string")
        got = decontaminate.contaminated(docs, asked).collect()
        assert {(r.doc_id, r.reparameterised) for r in got} == {(i, True) for i in ids}


def test_stages_drop_the_tables_of_the_stage_before(spark, sf_dir):
    import os

    from haulstat.llm.common import cut_lineage
    from haulstat.session import written_tables
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (_, first), (_, second), (_, third) = corpus_pipeline.STAGES[:3]
    kept = cut_lineage(first(spark, frame, sf_dir))
    lazy = second(spark, kept, sf_dir)  # not written: the next stage reads its tables
    own = list(corpus_pipeline._LEFT)
    assert own and all(os.path.exists(p) for p in own)
    out = cut_lineage(third(spark, lazy, sf_dir))
    assert out.count() and all(os.path.exists(p) for p in own)
    mine = list(corpus_pipeline._LEFT)
    again = cut_lineage(second(spark, kept, sf_dir))
    assert again.count() and not any(os.path.exists(p) or p in written_tables() for p in mine)


def test_samples_do_not_grow_with_repeated_ids(spark, docs_by_id):
    from haulstat.llm import language, quality
    rows = [(i, t, "en" if i % 2 else "de") for i, t in sorted(docs_by_id.items())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    twice = frame.unionByName(frame).unionByName(spark.createDataFrame([(rows[1][0], f"{rows[1][1]} and more {k}", rows[1][2]) for k in range(300)], frame.schema))
    one, other = language.train_language(frame), language.train_language(twice)
    assert one.languages == other.languages and np.array_equal(one.weights, other.weights)
    labels = spark.createDataFrame([(i, i % 3 % 2) for i, _, _ in rows], "doc_id long, quality int")
    assert quality.labelled_features(twice, labels, 50).count() == quality.labelled_features(frame, labels, 50).count() == 50


def test_quality_trees_are_right_about_held_out_labels(spark):
    from haulstat.llm import quality
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.where("doc_id % 4 = 0 and quality is not null").select("doc_id", "quality")
    model = quality.train_quality(docs, labels.where("doc_id % 4 <> 0"))
    rows = docs.join(held, "doc_id").collect()
    scores = model.probability(np.array([quality.statistics(r.text)[1] for r in rows]))
    y = np.array([r.quality for r in rows])
    right = ((scores >= 0.5) == (y == 1)).mean()
    assert len(rows) > 100 and right > max(y.mean(), 1 - y.mean()) + 0.02, (right, y.mean())


def test_near_copies_meet_by_simhash_too(spark):
    """The named method proposes: with no band at all, texts a few bits apart are still compared and the exact Jaccard decides."""
    from pyspark.sql import functions as F
    from haulstat.llm import near
    from haulstat.llm.common import cut_lineage, map_rows
    base = " ".join(f"word{i * 7919 % 1009}" for i in range(900))
    texts = [base, base + " end", "start " + base, " ".join(f"other{i}" for i in range(900))]
    rows = cut_lineage(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row long, text string"))
    prints = cut_lineage(map_rows(rows, near._prints, "_row long, h long, keys array<long>, fp long"))
    name = {r["_row"]: r.h for r in prints.collect()}
    alone = prints.withColumn("keys", F.array(F.xxhash64("h")))  # a band of its own for each set
    links = {frozenset(r) for r in near.similar_sets(rows, alone).collect()}
    near_ones = {name[0], name[1], name[2]}
    assert len(links) == 2 and set().union(*links) == near_ones
