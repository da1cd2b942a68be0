"""Streams over several files: order, late rows, expiry."""
import datetime as dt


from haulstat.streaming import jobs as J

START = dt.datetime(2024, 1, 1)


def stream_of(spark, folder, files, schema):
    """A stream that reads one file after the other."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{folder}/in")


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_plans_complete_in_any_order_and_overdue_ones_later(spark, tmp_path):
    plan = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("never", 5), ("none", 0), ("slow", 2)], "unit string, planned long")
    files = [[("a", 3, at(2)), ("a", 1, at(1)), ("b", 1, at(1)), ("c", 9, at(1)), ("none", 1, at(1)), ("slow", 1, at(2))],
             [("a", 3, at(3)), ("a", 2, at(0.5)), ("never", 1, at(3)), ("b", 1, at(3))],
             [("other", 1, at(40))], [("c", 8, at(41)), ("b", None, at(41))], [("b", 2, at(80)), ("a", 7, at(80)), ("slow", 4, at(80))]]
    reads = stream_of(spark, tmp_path, files, "unit string, read_id long, ts timestamp")
    plan = plan.unionByName(spark.createDataFrame([("other", 1)], plan.schema))
    got = [(r.unit, r.reads, r.planned, r.complete) for r in J.drain(J.tracked_plans(reads, plan, "12 hours", "1 hour")).collect()]
    done = sorted(g for g in got if g[3])
    assert done == [("a", 3, 3, True), ("b", 2, 2, True), ("c", 2, 2, True), ("other", 1, 1, True), ("slow", 2, 2, True)]
    # Units that hear anything before the watermark passes them are not overdue; slow is, and completes all the same.
    assert sorted(g for g in got if not g[3]) == [("never", 1, 5, False), ("slow", 1, 2, False)]


class Calls:
    """State of one unit in memory that counts what is asked of it."""

    def __init__(self):
        self.map, self.value, self.asked = {}, None, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        value = Calls()
        value.get, value.exists = lambda: value.value, lambda: value.value is not None
        value.update = lambda v: setattr(value, "value", v)
        return value

    def count(self, answer):
        self.asked += 1
        return answer

    def containsKey(self, key):
        return self.count(key in self.map)

    def getValue(self, key):
        return self.count(self.map.get(key))

    def updateValue(self, key, value):
        self.count(self.map.__setitem__(key, value))

    def clear(self):
        self.count(self.map.clear())

    registerTimer = deleteTimer = lambda self, at: None


def test_a_batch_asks_the_state_for_parts_not_reads(spark):
    """Each read used to cost two calls of the state store."""
    def told(planned, *batches):
        state, out, asked = Calls(), [], []
        tracker = J.PlanTracker(1000)
        tracker.init(state)
        for ids in batches:
            before = state.asked
            out.append([(r["reads"], r["complete"]) for r in tracker.handleInputRows(("u",), iter([{"planned": planned, "read_id": i, "ts": at(1)} for i in ids]), None)])
            asked.append(state.asked - before)
        return out, asked

    assert told(1000, range(1000)) == ([[(1000, True)]], [0])
    out, asked = told(1001, [*range(1000), 5, None], [3, 999], [1000, -7], [2000])
    assert out == [[], [], [(1002, True)], []]
    assert asked[0] == 4 and asked[1] <= 2 and asked[2] <= 3 and asked[3] == 0


def test_first_of_hash_over_files_reads_only_its_prefixes(spark, tmp_path, monkeypatch):
    opened = []
    real = J.stored_hashes

    def watch(*args):
        out = real(*args)
        opened.append((args[3], out.inputFiles(), [r.phash for r in out.collect()]))
        return out

    monkeypatch.setattr(J, "stored_hashes", watch)
    files = [[(1, "aa1"), (2, "bb1"), (3, "aa1"), (4, None), (5, "")], [(0, "aa1"), (6, "aa2"), (7, None)], [(8, "cc1"), (9, "bb1"), (10, "")]]
    photos = stream_of(spark, tmp_path, files, "id long, phash string")
    got = {(r.id, r.phash) for r in J.land_first_of_hash(photos, "id").collect()}
    assert got == {(1, "aa1"), (2, "bb1"), (4, None), (5, ""), (6, "aa2"), (8, "cc1")}
    assert [sorted(p) for p, _, _ in opened] == [["p", "paa"], ["p", "pbb", "pcc"]]
    assert set(opened[0][2]) == {"aa1", None, ""} and set(opened[1][2]) == {"bb1", None, ""}


def test_hashes_expire_with_the_watermark(spark, tmp_path):
    files = [[("x", at(0)), ("x", at(1)), ("y", at(2))], [("x", at(3)), ("z", at(60))], [("x", at(61)), ("z", at(62))], [("x", at(62)), ("late", at(1))]]
    photos = stream_of(spark, tmp_path, files, "phash string, ts timestamp")
    got = sorted(r.phash for r in J.drain(J.first_photos(photos, "24 hours")).collect())
    assert got == ["x", "x", "y", "z"]  # x again once its first is a day behind the watermark, the late row not at all


def test_empty_stream(spark, tmp_path):
    photos = stream_of(spark, tmp_path, [[]], "id long, phash string")
    assert J.land_first_of_hash(photos, "id").count() == 0
