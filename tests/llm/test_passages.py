"""op3 reads every text twice, and an anchor that all rows share is sent once for a block of rows."""
import random
from collections import defaultdict

from haulstat.llm import passages, runs


def test_texts_are_read_twice_and_the_first_reading_goes(spark, sf_dir, monkeypatch):
    from haulstat.session import cut_lineage, written_tables
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    for module in (passages, runs):
        monkeypatch.setattr(module, "cut_lineage", noted)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = set(written_tables())
    assert passages.repeats(docs).count() > 0
    # Not the first plan: it puts the rows in the order of their ids.
    assert sum(line.count("text:string") for plan in plans[1:] for line in plan.splitlines() if "ReadSchema" in line) == 2
    left = [set(spark.read.parquet(path).columns) for path in written_tables() if path not in before]
    assert left and not any({"anchors", "keys", "shingles"} & columns for columns in left)


def test_unit_sizes_are_those_of_the_units():
    draw = random.Random(3)
    texts = ["", " ", ".", ". ", " .", "\n", "a", "? \n. ", "Dr. A went.\n\nB stayed! "]
    texts += ["".join(draw.choice("ab .!?\n\t\r#é'  x") for _ in range(draw.randrange(400))) for _ in range(500)]
    texts += [" ".join(draw.choice(["ab", "c#d", "--", "e'f", "zz.", "é"]) for _ in range(draw.randrange(60, 300))) for _ in range(200)]
    for text in texts:
        data = text.encode()
        assert passages.unit_sizes(data, data.translate(passages._WORDS)).tolist() == [len(words) for _, _, words in passages.units(data)]


def test_shared_hashes_against_brute_force(spark):
    import numpy as np
    draw = random.Random(5)
    hot = (1 << 64) - 5
    rows = [(k % 7, [hot] + [draw.randrange(60) * 0x51ED2701F3A5C7 for _ in range(3)] + [draw.randrange(1 << 64)]) for k in range(400)]
    rows += [(9, [11, 11, 12]), (9, [13]), (8, [14]), (8, [14])]
    told = spark.createDataFrame([(n, bytearray(np.array(h, np.uint64).tobytes())) for n, h in rows], "name long, hashes binary")
    names, times = defaultdict(set), defaultdict(int)
    for name, hashes in rows:
        for h in hashes:
            names[h].add(name)
            times[h] += 1
    for counted in (False, True):
        got = {(r.hash % (1 << 64), r.name) for r in runs.shared_hashes(told, 2000, counted).collect()}
        assert got == {(h, n) for h, own in names.items() if len(own) > 1 or counted and times[h] > 1 for n in own}
    deal = runs._Deal(64, True)
    sent = [row for block in [*deal((n, np.array(h, np.uint64).tobytes()) for n, h in rows), *deal.finish()] for row in zip(*block)]
    assert sum((runs._from_planes(h, np.uint64) == np.uint64(hot)).sum() for _, h, _ in sent) == 7
