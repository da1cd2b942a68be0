"""URL filter: host rules first, then logistic regression on hashed character n-grams."""
from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_table
from .linear import SparseRows, fit_logistic, sigmoid

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
MOST_LABELLED = 20_000

# The small labelled table (1: block), kinds of addresses a text corpus does or does not want.
LABELLED_URLS = [
    ("http://cheap-pills.example.com/en/12", 1), ("https://www.cheap-pills.example.org/de/4.html", 1),
    ("http://best-pills-online.example.net/fr/88", 1), ("https://buy-cheap-meds.example.com/en/7", 1),
    ("https://casino-win.example.com/en/90", 1), ("http://m.casino-win.example.net/es/3", 1),
    ("https://online-casino.example.org/en/44#top", 1), ("http://win-big-casino.example.com/de/901", 1),
    ("https://spam-farm.example.org/en/72", 1), ("http://blog.spam-farm.example.com/fr/5?page=2&ref=x", 1),
    ("https://link-farm.example.net/en/61", 1), ("http://seo-farm.example.org/en/8.html", 1),
    ("https://adult-chat.example.com/en/3", 1), ("http://www.adult-video.example.net/de/21", 1),
    ("https://free-xxx.example.org/en/1", 1), ("http://hot-xxx-cams.example.com/es/54", 1),
    ("https://payday-loan.example.com/en/19", 1), ("http://fast-loan-now.example.net/fr/2", 1),
    ("https://replica-watch.example.org/en/311", 1), ("http://fake-watch-shop.example.com/de/6", 1),
    ("http://poker-bonus.example.net/en/17", 1), ("https://bet-bonus.example.org/es/29/", 1),
    ("http://www.weather.example.com/en/12", 0), ("https://news.example.org/de/4.html", 0),
    ("http://blog.garden.example.net/fr/88", 0), ("https://m.library.example.com/en/7", 0),
    ("https://school.example.com/en/90", 0), ("http://m.history.example.net/es/3", 0),
    ("https://www.music.example.org/en/44#top", 0), ("http://travel.example.com/de/901", 0),
    ("https://museum.example.org/en/72", 0), ("http://blog.recipes.example.com/fr/5?page=2&ref=x", 0),
    ("https://science.example.net/en/61", 0), ("http://www.town.example.org/en/8.html", 0),
    ("https://there.example.com/en/3", 0), ("http://www.nation.example.net/de/21", 0),
    ("https://other.example.org/en/1", 0), ("http://blog.than.example.com/es/54", 0),
    ("https://m.station.example.com/en/19", 0), ("http://theory.example.net/fr/2", 0),
    ("https://www.thing.example.org/en/311", 0), ("http://letter.example.com/de/6", 0),
    ("http://m.thesis.example.net/en/17", 0), ("https://blog.river.example.org/es/29/", 0),
]

# The rules of the registered query as (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, shape, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))
    return ascii_lower(host), path


def ngram_buckets(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path, digits folded to one sign."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        folded = "".join("0" if c.isdigit() else c for c in text).encode()
        for n in SIZES:
            seed = crc32(f"{mark}{n}".encode())
            found.update(crc32(folded[i:i + n], seed) % BUCKETS for i in range(len(folded) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def _row(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Each row has unit length, so a long path does not outweigh its host."""
    found = ngram_buckets(host, path)
    return found, np.full(len(found), 1.0 / max(1.0, len(found)) ** 0.5)


def train_url_model(labelled: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, float]:
    """Weights and intercept from (url, bad). At most ``most`` rows, taken in hash order, reach the driver."""
    host, path = host_and_path(F.col("url"))
    rows = (labelled.where(F.col("bad").isNotNull())
            .select(host.alias("host"), path.alias("path"), F.col("bad").cast("double").alias("bad"))
            .orderBy(F.xxhash64("host", "path"), "bad").limit(most).collect())
    x = SparseRows([_row(r.host, r.path) for r in rows], BUCKETS)
    return fit_logistic(x, np.array([r.bad for r in rows]), l2=1e-4)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule string, its verdict) of the longest fitting rule, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, lead, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(lead)
        rule = F.when(fits, F.lit(name + lead)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], cut: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, score, verdict) for every page; other columns are not read.

    The longest rule that fits decides; else the model blocks at ``score >= cut``.
    A null or malformed url has empty host and path and is judged by the model
    like any other; repeated rows are each judged; an empty label table gives a
    model that allows everything; an empty table gives an empty result. The
    rule list is part of the plan, so keep it to some hundreds. No shuffle.
    """
    weights, bias = train_url_model(labelled)

    @F.pandas_udf("double")
    def bad_score(host: pd.Series, path: pd.Series) -> pd.Series:
        scores = []
        for h, p in zip(host, path):
            index, value = _row(h, p)
            scores.append(float(weights[index] @ value) + bias)
        return pd.Series(sigmoid(np.array(scores, dtype=float)))

    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_column(F.col("host"), F.col("path"), rules)
    judged = split.withColumn("rule", rule).withColumn("_says", says).withColumn("score", bad_score("host", "path"))
    own = F.when(F.col("score") >= cut, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", "score", F.coalesce("_says", own).alias("verdict"))


def labelled_urls(spark) -> DataFrame:
    return small_table(spark, LABELLED_URLS, ["url", "bad"])
