"""Benchmark decontamination on templates.

Numbers, units and names become typed placeholders, so a question whose slots
were filled anew keeps its template. Windows of template words are joined by
hash, and a match counts only if each item value stands for one document value.
Beside them stand case-folded windows that keep their slot values, so a
verbatim copy matches whatever its words are and however it is capitalised.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut_lineage, map_rows

WINDOW = 13
LEAST_LITERALS = 5  # a template window of placeholders alone says nothing
VERBATIM = np.uint64(0x94D049BB133111EB)  # keeps hashes of verbatim windows apart from those of template windows
MOST_HASHES = 2_000_000  # benchmark windows up to this number (16 MB) are sent to the tasks as a filter

# Units of measure that count as a placeholder behind a number.
UNITS = set("""mm cm m km inch inches foot feet ft yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces oz pound pounds lb lbs
ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years
percent dollar dollars euro euros cent cents usd eur mph kmh hz khz mhz ghz kb mb gb tb kwh watt watts volt volts degree degrees celsius""".split())
_TRIM = re.compile(r"^[\"'(\[{<«„“‘¿¡*_#]+|[\"')\]}>»”’.,;:!?*_#]+$")
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?$")
_JOINED = re.compile(r"([$€£]?[+-]?\d[\d.,]*)([a-zA-Z]+)$")
SLOTS = {"n": 0x9E3779B97F4A7C15, "u": 0xC2B2AE3D27D4EB4F, "p": 0x165667B19E3779F9}  # number, unit, proper name
BASE = np.uint64(0xD6E8FEB86659FD93)


KINDS = "-nup"  # of a form: literal, number, unit, name
KNOWN = 500_000  # word forms a task remembers


def digest(value: str) -> int:
    return xxh64_intdigest(value.encode("utf-8", "surrogatepass"))


def forms_of(word: str) -> list[tuple[int, str]]:
    """(kind, value) of a word without its outer signs: none, one, or a number and the unit joined to it."""
    if not word:
        return []
    if _NUMBER.match(word):
        return [(1, word.rstrip(".,"))]
    if (m := _JOINED.match(word)) and m[2].lower() in UNITS:
        return [(1, m[1]), (2, m[2].lower())]
    return [(0, word.lower())]


class Reader(dict):
    """Turns a text into template hashes and slot values.

    Every distinct raw word is looked at once, up to a bound, and kept as a row of arrays; a text is then a
    gather of rows and a few array operations that find sentence starts, names and units.
    """

    def __init__(self):
        super().__init__()
        self.table = np.zeros((0, 10), np.uint64)  # ends, forms, capital, unit, then kind, hash and own hash of either form
        self.grown = self.table  # what the table is a part of
        self.fresh: list[tuple] = []  # rows of the table that the text at hand has brought
        self.raws: list[str] = []

    def __missing__(self, raw: str) -> int:
        k = self[raw] = len(self.raws)
        self.raws.append(raw)
        last = raw[-1]
        ends = last in ".!?" or (len(raw) > 1 and raw[-2] in ".!?")
        word = raw if raw.isalpha() else raw[:-1] if last in ".,;:!?" and raw[:-1].isalpha() else _TRIM.sub("", raw)
        if word.isalpha():
            low = word.lower()
            h = digest(low)
            self.fresh.append((ends, 1, word[0].isupper(), low in UNITS, 0, h, h, 0, 0, 0))
            return k
        found = forms_of(word)
        literal = found and found[0][0] == 0
        row = [ends, len(found), bool(literal) and word[0].isupper(), bool(literal) and found[0][1] in UNITS]
        for kind, value in found:
            own = digest(value)
            row += [kind, SLOTS[KINDS[kind]] if kind else own, own]
        self.fresh.append((*row, *[0] * (10 - len(row))))
        return k

    def read(self, text: str | None, first_is_name: bool = False) -> "Reading":
        """A capitalised word inside a sentence is a name. ``first_is_name`` reads
        the first word as one too, as it looks when quoted inside a sentence.
        """
        if len(self) > KNOWN:
            self.clear()
            self.table, self.raws = self.table[:0], []
        words = (text or "").split()
        m = len(words)
        rows = np.fromiter(map(self.__getitem__, words), np.int64, m)
        if self.fresh:
            held = len(self.raws)
            if held > len(self.grown):
                self.grown = np.zeros((max(2 * held, 4096), 10), np.uint64)
                self.grown[:len(self.table)] = self.table
            self.grown[held - len(self.fresh):held] = np.array(self.fresh, np.uint64)
            self.table, self.fresh = self.grown[:held], []
        facts = self.table[rows]
        ends, forms = facts[:, 0] > 0, facts[:, 1].astype(np.int64)
        ended = np.concatenate([[0], np.cumsum(ends)])  # sentence ends before each raw word
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(forms > 0, np.arange(m), -1))])[:m]
        starts = np.where(last >= 0, ended[:m] > ended[np.maximum(last, 0)], (ended[:m] > 0) | (not first_is_name))
        of = np.repeat(np.arange(m), forms)
        second = np.arange(len(of)) - np.repeat(np.cumsum(forms) - forms, forms)
        form, at = facts[of], np.arange(len(of))
        kind, hashes, own = form[at, 4 + 3 * second], form[at, 5 + 3 * second], form[at, 6 + 3 * second]
        name = (kind == 0) & (form[:, 2] > 0) & ~starts[of]
        unit = (kind == 0) & ~name & (form[:, 3] > 0) & np.concatenate([[False], kind == 1])[:len(kind)]
        kind = np.where(name, 3, np.where(unit, 2, kind)).astype(np.int64)
        hashes = np.where(name, np.uint64(SLOTS["p"]), np.where(unit, np.uint64(SLOTS["u"]), hashes))
        return Reading(hashes, own, np.flatnonzero(kind), kind, rows[of], second, self.raws)


class Reading:
    """Template hashes, hashes of the case-folded words, and the positions of slots; their typed values on demand."""

    def __init__(self, hashes, folded, at, kind, row, second, raws):
        self.hashes, self.folded, self.at = hashes, folded, at
        self.kind, self.row, self.second, self.raws = kind, row, second, raws

    def slots(self, a: int, b: int) -> list[str]:
        """Typed values of the slots from the a-th up to the b-th."""
        return [f"{KINDS[self.kind[p]]}:{forms_of(_TRIM.sub('', self.raws[self.row[p]]))[self.second[p]][1]}" for p in self.at[a:b].tolist()]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse modulo 2 ** 64, kept for the next text."""
    global _POWERS
    if len(_POWERS[0]) < n:
        many = max(n, 4096)
        _POWERS = tuple(np.cumprod(np.append(np.uint64(1), np.full(many - 1, x, np.uint64)), dtype=np.uint64)
                        for x in (int(BASE), pow(int(BASE), -1, 1 << 64)))
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS: tuple = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... hashes times their power of BASE: windows of every width are differences of them."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes))[0], dtype=np.uint64, out=total[1:])
    return total


def window_hashes(total: np.ndarray, width: int) -> np.ndarray:
    """One hash for every ``width`` neighbours from their prefix sums, shifted back to power 0."""
    n = len(total) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    own = total[width:] - total[:n]
    own *= powers(len(total) - 1)[1][:n]
    own += np.uint64(width)
    return own


def windows(reader: Reader, text: str | None, width: int, first_is_name: bool = False):
    """(position, signed hash, slot values, verbatim, filled, words in all) of every window.

    Template windows need enough literal words. Verbatim windows need nothing
    and carry no slot values; ``filled`` tells whether a window holds a slot.
    """
    told = reader.read(text, first_is_name)
    many = len(told.hashes)
    width = min(width, many)
    if not width:
        return
    own = window_hashes(prefix_sums(told.hashes), width).view(np.int64).tolist()
    same = (window_hashes(prefix_sums(told.folded), width) ^ VERBATIM).view(np.int64).tolist()
    for p in range(len(own)):
        a, b = np.searchsorted(told.at, [p, p + width]).tolist()
        if width - (b - a) >= min(LEAST_LITERALS, width):
            yield p, own[p], told.slots(a, b), False, b > a, width, many
        yield p, same[p], [], True, b > a, width, many


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, h, item_pos, item_slots, verbatim, filled, width, item_words); an item shorter than the window is one window."""
    def work(rows):
        reader = Reader()
        for item_id, text in rows:
            told = set()
            for first in (False, True):
                for p, h, *rest in windows(reader, text, width, first):
                    if (p, h) not in told:
                        told.add((p, h))
                        yield item_id, h, p, *rest

    return map_rows(benchmark.select("item_id", "text"), work, "item_id long, h long, item_pos int, item_slots array<string>, "
                    "verbatim boolean, filled boolean, width int, item_words int")


def document_windows(docs: DataFrame, widths: list[int], wanted: np.ndarray | None) -> DataFrame:
    """(_row, doc_id, h, doc_pos, doc_slots) of all windows of the given widths, or of those whose hash is ``wanted``."""
    bitmap = None
    if wanted is not None:
        wanted = np.sort(wanted)
        bits = 22
        bitmap = np.zeros(1 << bits, bool)
        bitmap[wanted.view(np.uint64) >> np.uint64(64 - bits)] = True

    def make():
        reader = Reader()

        def work(rows):
            for row, doc_id, text in rows:
                told = reader.read(text)
                sums = {False: prefix_sums(told.hashes), True: prefix_sums(told.folded)}
                for width in widths:
                    for verbatim, total in sums.items():
                        own = window_hashes(total, width)
                        if verbatim:
                            own ^= VERBATIM
                        if wanted is None:
                            hit = np.arange(len(own))
                        else:
                            hit = np.nonzero(bitmap[own >> np.uint64(64 - bits)])[0]
                            asked = own[hit].view(np.int64)
                            hit = hit[wanted[np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)] == asked] if len(hit) else hit
                        low, high = (hit, hit) if verbatim else (np.searchsorted(told.at, hit), np.searchsorted(told.at, hit + width))
                        for p, a, b in zip(hit.tolist(), low.tolist(), high.tolist()):
                            yield row, doc_id, int(own[p].view(np.int64)), p, told.slots(a, b) if b > a and not verbatim else []

        return work

    make.per_task = True
    return map_rows(docs.select("_row", "doc_id", "text"), make,
                    f"_row {docs.schema['_row'].dataType.simpleString()}, doc_id long, h long, doc_pos int, doc_slots array<string>")


def one_value_each(pairs):
    """Whether each item value of an array of (item value, document value) pairs stands for one document value."""
    return F.size(F.array_distinct(F.transform(pairs, lambda p: p["item_slots"]))) == F.size(F.array_distinct(pairs))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most_hashes: int = MOST_HASHES) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots, reparameterised, item_words): one row for each document id and item it leaks.

    Every row of ``docs`` is matched on its own (``leaking_rows``); of rows that share an id, null included,
    the most windows and slots are told, and it is reparameterised if all of them are.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    return leaking_rows(keyed, benchmark, width, most_hashes).groupBy("doc_id", "item_id", "item_words").agg(
        F.max("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"), F.min("reparameterised").alias("reparameterised"))


def leaking_rows(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most_hashes: int = MOST_HASHES) -> DataFrame:
    """(_row, doc_id, item_id, item_words, n_windows, n_slots, reparameterised): one row for each row of ``docs`` and item it leaks.

    Needs _row (a key of the row), doc_id and text, item_id and text; other columns are not read. Null,
    empty and blank texts have no windows; a null id and repeated rows
    are matched like any other; an empty table on either side gives an empty result. Windows on
    the same alignment must agree on what each slot stands for, so equal
    sentences around unrelated values do not match. Where they do not agree,
    what the document has verbatim still counts, unless it is a single window
    without a slot: that says the same in every filling of the template.

    The hashes of the benchmark go to the tasks as a filter while there are at
    most ``most_hashes``; beyond that every window is joined. Both give the same rows.
    """
    items = cut_lineage(benchmark_windows(benchmark, width))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most ``width`` values
    distinct = items.select("h").distinct()
    small = distinct.limit(most_hashes + 1).count() <= most_hashes
    wanted = np.array([r.h for r in distinct.collect()], np.int64) if small else None
    found = document_windows(docs, widths, wanted)
    pairs = F.arrays_zip("item_slots", "doc_slots")
    same = F.col("verbatim") | ~F.exists("pairs", lambda p: p["item_slots"] != p["doc_slots"])
    met = (found.join(items, "h").where(F.size("item_slots") == F.size("doc_slots"))
           .select("_row", "doc_id", "item_id", "item_words", (F.col("doc_pos") - F.col("item_pos")).alias("offset"), "item_pos", "verbatim", "filled",
                   pairs.alias("pairs"))
           .withColumn("same", same).where(one_value_each(F.col("pairs"))))
    lined = met.groupBy("_row", "doc_id", "item_id", "item_words", "offset").agg(
        F.countDistinct("item_pos").alias("n_all"), F.countDistinct(F.when(F.col("same"), F.col("item_pos"))).alias("n_same"),
        F.max(F.col("same") & F.col("filled")).alias("quoted"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    lined = lined.withColumn("agrees", one_value_each(F.col("pairs"))).where("agrees or quoted or n_same > 1")
    pairs = F.when(F.col("agrees"), F.col("pairs")).otherwise(F.filter("pairs", lambda p: p["item_slots"] == p["doc_slots"]))
    lined = lined.withColumn("pairs", pairs).withColumn("n_windows", F.when(F.col("agrees"), F.col("n_all")).otherwise(F.col("n_same")))
    changed = F.exists("pairs", lambda p: p["item_slots"] != p["doc_slots"])
    return lined.groupBy("_row", "doc_id", "item_id", "item_words").agg(
        F.max("n_windows").alias("n_windows"), F.max(F.size("pairs")).alias("n_slots"), F.min(changed).alias("reparameterised"))
