"""Source divergence against its SQL statement and a dense count in Python."""
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from haulstat.llm import divergence
from haulstat.llm.queries import LLM_ORACLES, LLM_QUERIES

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs=3, top=200):
    """Rows (lang, source, text) -> the set of result rows, densely over the whole vocabulary."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", [lowered(t) for t in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        sources = [s for l, s in counts if l == lang]
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top}
    return out


def result(frame, **options):
    rows = [tuple(r) for r in divergence.divergence(frame, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_sql_and_brute_force(spark, sf_dir):
    from compare import compare, duck_connection
    state, note, _ = compare(spark, duck_connection(sf_dir), sf_dir, "op13_divergence", LLM_QUERIES, LLM_ORACLES)
    assert state == "ok", note
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text").collect()]
    assert {tuple(r) for r in LLM_QUERIES["op13_divergence"](spark, sf_dir).collect()} == brute(rows)


def test_odd_rows(spark):
    words = "Über STRASSE straße naïve a-b c3d élan ELAN Elan 中文 ﬁn x " * 3
    rows = [("en", "a", words), ("en", "a", words), ("en", None, words), ("en", "b", None), ("en", "c", ""), (None, "a", "one two"), (None, None, "one one"),
            ("", "", "one \x01two"), ("de", "a", "nur einmal"), ("de", "b", "123 456"), ("fr", "a", "seul"), ("en", "d", "elan " * 200_000), ("en", "d", "y" * 100_000),
            ("es", "A", "k k k"), ("es", "a", "k k"), ("es", "á", "k"), ("es", "z", "k")]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    frame = frame.withColumns({c: F.lit(1) for c in ("term", "n", "docs", "p", "q", "item", "value", "rank", "part", "kept", "doc_id")})
    got = result(frame)
    assert got == brute(rows) and {r[:2] for r in got} >= {("", ""), ("en", "b"), ("en", "c"), ("de", "a")}
    assert {r[4] for r in got if r[0] == "de"} == {0}
    assert result(frame, min_docs=1, top=2) == brute(rows, 1, 2)
    assert result(frame.limit(0)) == set() and result(spark.createDataFrame([("en", "a", None)], frame.schema[:3])) == set()


def test_terms_handed_on_early_are_added_up(spark, monkeypatch):
    import random
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de"]), f"s{rng.randrange(5)}", " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + int(rng.random() ** 3 * 26))}" for _ in range(40))) for _ in range(300)]
    monkeypatch.setattr(divergence, "HELD", 50)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2].encode() for r in rows])], ["lang", "source", "text"])
    parts = [row for out in divergence.count_terms([batch]) for row in zip(*[c.to_pylist() for c in out.columns])]
    assert len(parts) > len({row[:3] for row in parts})
    sums = Counter()
    for lang, source, term, n, _ in parts:
        if term is not None:
            sums[lang, source, term.decode()] += n
    assert sums == Counter((a, b, t) for a, b, c in rows for t in c.split())
    assert result(spark.createDataFrame(rows, "lang string, source string, text string")) == brute(rows)


def test_counts_side_by_side_are_not_sent_to_the_tasks(spark, monkeypatch):
    """A term in many sources makes far more pairs than its row's file tells."""
    import random
    rng = random.Random(7)
    rows = [("en", f"s{k}", " ".join(f"w{chr(97 + w // 26)}{chr(97 + w % 26)} " * rng.randrange(1, 60) for w in range(200))) for k in range(80)]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    wanted = brute(rows)
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64m")
    try:
        assert result(frame) == wanted
        monkeypatch.setattr(divergence, "SENT", 0)
        assert result(frame) == wanted
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)
