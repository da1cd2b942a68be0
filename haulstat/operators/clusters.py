"""Order-dependent folds: small groups in order inside a task, larger ones as parallel rounds."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

MOST_ROWS = 65_536  # rows of a group that one task folds; larger groups take the rounds


def split_by_size(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups up to ``most`` rows, rows of the larger groups or None if there are none)."""
    large = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n"))
    if large.isEmpty():
        return df, None
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    met = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(large.select(*names), met, "left_anti"), df.join(large.select(*names), met, "left_semi")


def frozen(value):
    """A value of a struct column as a tuple, others as they are."""
    return tuple(frozen(v) for v in value.values()) if isinstance(value, dict) else value


def fold_in_order(df: DataFrame, keys: list[str], order: list, read: list[str], start: Callable, out: str, kind: T.DataType) -> DataFrame:
    """``df`` with the column ``out``: what a group's step says of its rows, taken in ``order``.

    ``start()`` makes the step of a group, which is called with the ``read``
    columns of one row after another and may keep what it has seen.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        shape = to_arrow_schema(schema)
        group = step = None
        for batch in batches:
            said = []
            groups = zip(*[batch.column(k).to_pylist() for k in keys])
            for key, row in zip(groups, zip(*[batch.column(c).to_pylist() for c in read])):
                if step is None or key != group:
                    group, step = key, start()
                said.append(step(*row))
            columns = [c.cast(f.type) for c, f in zip(batch.columns, shape)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, shape.field(out).type)], schema=shape)

    # By a hash of the keys: Spark drops a repartition by columns that a union below claims to have already.
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fold_groups(df: DataFrame, keys: list[str], order: list[str], read: list[str], start: Callable, fields: list[T.StructField]) -> DataFrame:
    """``keys`` and ``fields`` of the rows that each group's state hands on at its end.

    ``start()`` makes the state of a group, whose ``take`` is called with the ``read`` columns of one row after another, in ``order``.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], *fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        shape = to_arrow_schema(schema)

        def handed(rows):
            columns = list(zip(*rows)) if rows else [()] * len(shape)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape)], schema=shape)

        group = state = None
        for batch in batches:
            rows = []
            groups = zip(*[batch.column(k).to_pylist() for k in keys])
            for key, row in zip(groups, zip(*[batch.column(c).to_pylist() for c in read])):
                if state is None or key != group:
                    if state is not None:
                        rows.extend((*group, *r) for r in state.finish())
                    group, state = key, start()
                state.take(*row)
            yield handed(rows)
        if state is not None:
            yield handed([(*group, *r) for r in state.finish()])

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def leaders(nodes: DataFrame, edges: DataFrame, node: list[str], later: dict[str, str]) -> DataFrame:
    """Which nodes start a cluster when items are taken in order.

    An item starts a cluster unless an earlier starter is similar to it.
    ``edges`` point from the earlier node (columns ``node``) to the later one
    (columns ``later[c]``). An item whose earlier neighbours are all decided
    can be decided at once, so every round settles all such items together.
    Returns ``node`` columns and ``is_leader``.
    """
    links = edges.select(*node, *later.values())
    state = cut_lineage(nodes.select(*node).distinct().withColumn("state", F.lit("open")))
    while True:
        seen = (links.join(state, node).groupBy(*later.values())
                .agg(F.bool_or(F.col("state") == "leader").alias("_covered"), F.bool_or(F.col("state") == "open").alias("_waits")))
        seen = seen.select(*[F.col(later[c]).alias(c) for c in node], "_covered", "_waits")
        decided = (F.when(F.col("state") != "open", F.col("state"))
                   .when(F.coalesce("_covered", F.lit(False)), "member")
                   .when(~F.coalesce("_waits", F.lit(False)), "leader").otherwise("open"))
        state = cut_lineage(state.join(seen, node, "left").select(*node, decided.alias("state")))
        if state.where("state = 'open'").isEmpty():
            return state.select(*node, (F.col("state") == "leader").alias("is_leader"))


def mutual_best(candidates: DataFrame, left: list[str], right: list[str], order: list[str], most: int = MOST_ROWS) -> DataFrame:
    """One-to-one matching, greedy by ``order`` (columns, ascending, total together with both ids).

    A group of pairs that both sides' ids share is gone through in order. In a large one, pairs that are
    each other's best are exactly those the greedy pass would
    take before touching either side, so all of them are taken per round.
    """
    pairs = cut_lineage(ranked(candidates, order, left, right))
    gate = [c for c in left if c in right]
    if not gate:
        return best_in_rounds(pairs, left, right)
    small, large = split_by_size(pairs, gate, most)
    own_l, own_r = [c for c in left if c not in gate], [c for c in right if c not in gate]

    def start():
        used_l, used_r = set(), set()

        def step(*row):
            a, b = tuple(map(frozen, row[:len(own_l)])), tuple(map(frozen, row[len(own_l):]))
            if a in used_l or b in used_r:
                return False
            used_l.add(a), used_r.add(b)
            return True

        return step

    taken = fold_in_order(small, gate, ["_rank"], own_l + own_r, start, "_taken", T.BooleanType()).where("_taken").drop("_taken", "_rank")
    return taken if large is None else taken.unionByName(best_in_rounds(cut_lineage(large), left, right))


def ranked(candidates: DataFrame, order: list[str], left: list[str], right: list[str]) -> DataFrame:
    """Pairs with the place they are taken in (``_rank``)."""
    return candidates.withColumn("_rank", F.struct(*dict.fromkeys([*order, *left, *right])))


def best_in_rounds(open_pairs: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """The greedy match of pairs with a ``_rank``, all mutually best pairs a round."""
    matched = None
    while not open_pairs.isEmpty():
        best_l = open_pairs.groupBy(*left).agg(F.min("_rank").alias("_rank"))
        best_r = open_pairs.groupBy(*right).agg(F.min("_rank").alias("_rank"))
        taken = open_pairs.join(best_l, left + ["_rank"], "left_semi").join(best_r, right + ["_rank"], "left_semi")
        taken = cut_lineage(taken)
        matched = taken if matched is None else matched.unionByName(taken)
        open_pairs = cut_lineage(open_pairs.join(taken.select(*left), left, "left_anti").join(taken.select(*right), right, "left_anti"))
    return (matched if matched is not None else open_pairs).drop("_rank")


def components(nodes: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    """Connected components per group: ``id`` -> smallest id reachable (``component``).

    ``edges`` has ``group``, ``a``, ``b``. Every round hooks each label to the
    smallest neighbouring label and then jumps labels to their label's label,
    so long chains halve each round.
    """
    both = edges.select(*group, F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        edges.select(*group, F.col("b").alias("id"), F.col("a").alias("other")))
    both = cut_lineage(both.distinct())
    label = cut_lineage(nodes.select(*group, "id", F.col("id").alias("component")))
    while True:
        other = label.select(*group, F.col("id").alias("other"), F.col("component").alias("_c"))
        near = both.join(other, group + ["other"]).groupBy(*group, "id").agg(F.min("_c").alias("_near"))
        hooked = label.join(near, group + ["id"], "left").withColumn("_new", F.least("component", F.coalesce("_near", "component")))
        # A label adopts the smallest label any of its members found.
        per_label = hooked.groupBy(*group, "component").agg(F.min("_new").alias("_best"))
        nxt = cut_lineage(hooked.join(per_label, group + ["component"]).select(
            *group, "id", F.col("component").alias("_was"), F.least("_new", "_best").alias("component")))
        if nxt.where("component <> _was").isEmpty():
            return nxt.drop("_was")
        label = nxt.drop("_was")
