"""Repeated findings: clusters, support, merged levels, bounded revisions, consensus of reads."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import condition as C
from ..functions import text as T
from . import clusters as K
from . import similarity as S

LEVELS = range(4)


def cluster_sightings(df: DataFrame, unit: list[str], gate: list[str], text: str, order: list[str], threshold: float,
                      assign: str = "best", cross_gate: tuple[str, float] | None = None, most: int = K.MOST_ROWS) -> DataFrame:
    """Every row with the text of its cluster's first sighting (``leader``, a struct of ``order``).

    Rows are taken in ``order`` inside (unit, gate). A row joins an earlier
    starter it overlaps with: the best one (``best``; the later of equals) or
    the first one (``first``); without any it starts a cluster.
    ``cross_gate`` = (column, threshold) asks for a higher overlap when that
    column differs. A blank text is always a cluster of its own. Groups up to ``most`` rows
    are gone through in order inside a task, the others settled in rounds.
    """
    keys = unit + gate
    small, large = K.split_by_size(df, keys, most)
    read = ["words", "_wording", "_place", *([cross_gate[0]] if cross_gate else [])]

    lowest = min(threshold, cross_gate[1]) if cross_gate else threshold

    def start():
        leaders, places = S.HeldTexts(), []  # in order, with (column of cross_gate, place)

        def step(words, wording, place, own=None):
            mine, best, at = (frozenset(words), wording), 0.0, None
            for i, score in zip(*map(S.plain, leaders.overlaps(*mine, lowest))):
                other, leader = places[i]
                if score >= (threshold if own == other else cross_gate[1]) and score >= best:
                    best, at = score, leader
                    if assign == "first":
                        return at
            if at is None:
                leaders.add(*mine)
                places.append((own, place))
            return at or place

        return step

    ready = S.with_text_key(small, text).withColumns({"_wording": F.when(F.size("words") == 0, T.folded(F.col(text))), "_place": F.struct(*order)}).drop("text_key")
    rows = K.fold_in_order(ready, keys, order, read, start, "leader", ready.schema["_place"].dataType).drop("words", "_wording", "_place")
    if large is None:
        return rows
    blank = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
    rows = rows.unionByName(large.where(blank).withColumn("leader", F.struct(*order)))
    return rows.unionByName(clusters_in_rounds(large.where(~blank), unit, gate, text, order, threshold, assign, cross_gate))


def clusters_in_rounds(df: DataFrame, unit: list[str], gate: list[str], text: str, order: list[str], threshold: float,
                       assign: str, cross_gate: tuple[str, float] | None) -> DataFrame:
    """``cluster_sightings`` for groups of any size, whose texts are not blank."""
    keys = unit + gate
    inner = [cross_gate[0]] if cross_gate else []
    nodes = S.text_nodes(df, keys + inner, text, order)
    nodes = S.cut_lineage(nodes.withColumn("node", F.struct(*inner, "text_key")))
    pairs = S.overlapping(nodes, nodes, keys, "node", "node", threshold, same_table=True)
    if inner:
        column, high = cross_gate
        same = pairs["node"][column] == pairs["node_later"][column]
        pairs = pairs.where(same | (F.col("score") >= high))
    pairs = S.cut_lineage(pairs)
    node = keys + ["node"]
    state = K.leaders(nodes, pairs, node, {**{k: k for k in keys}, "node": "node_later"})
    starters = state.where("is_leader").join(nodes.select(*node, "first"), node).select(*node, F.col("first").alias("leader"))
    tagged = S.with_text_key(df, text).withColumn("node", F.struct(*inner, "text_key")).drop("words", "text_key")
    if assign == "first":
        # The earliest similar starter is the same for every row of one wording.
        joined = pairs.join(starters, node).groupBy(*keys, F.col("node_later").alias("node")).agg(F.min("leader").alias("leader"))
        members = state.where("not is_leader").join(joined, node).select(*node, "leader")
        return tagged.join(starters.unionByName(members), node).drop("node")
    # The best one may have started after a wording first occurred, so each row picks among those before it.
    back = pairs.select(*keys, F.col("node_later").alias("node"), F.col("node").alias("node_later"), "score")
    offers = pairs.select(*node, "node_later", "score").unionByName(back).join(starters, node)
    ranked = offers.groupBy(*keys, F.col("node_later").alias("node")).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("score", "leader")))).alias("_offers"))
    own = starters.select(*node, F.col("leader").alias("_own"))
    rows = tagged.join(own, node, "left").join(ranked, node, "left")
    before = F.filter("_offers", lambda o: o["leader"] < F.struct(*order))
    return rows.withColumn("leader", F.coalesce("_own", F.try_element_at(before, F.lit(1))["leader"])).drop("node", "_own", "_offers")


def level_counts(column: str, scale: list[str], where: Column | None = None) -> list[Column]:
    rank = C.rank_of(scale, F.col(column))
    return [F.count_if((rank == i) & (F.lit(True) if where is None else where)).alias(f"_{column}_{i}") for i in LEVELS]


def lower_median(column: str) -> Column:
    """Lower middle of ranks given as counts per level."""
    counts = [F.col(f"_{column}_{i}") for i in LEVELS]
    total = sum(counts)
    target = F.floor((total - 1) / 2)
    out, upto = F.lit(None).cast("int"), F.lit(0)
    steps = []
    for i in LEVELS:
        upto = upto + counts[i]
        steps.append((upto > target, i))
    expr = F.when(steps[0][0], steps[0][1])
    for cond, i in steps[1:]:
        expr = expr.when(cond, i)
    return F.when(total > 0, expr).otherwise(out)


def lowest(column: str) -> Column:
    return F.coalesce(*[F.when(F.col(f"_{column}_{i}") > 0, i) for i in LEVELS])


def corroborated(column: str) -> Column:
    """Highest level that two sightings support; a single sighting keeps its own."""
    counts = [F.col(f"_{column}_{i}") for i in LEVELS]
    total = sum(counts)
    single = F.coalesce(*[F.when(counts[i] > 0, i) for i in reversed(LEVELS)])
    supported = F.coalesce(*[F.when(sum(counts[i:]) >= 2, i) for i in reversed(LEVELS)])
    return F.when(total == 1, single).otherwise(supported)


def merged_confidence(share: float = 0.35, ceiling: float = 0.95) -> Column:
    """Discounted noisy-or over a group, from two partial aggregates."""
    c = F.when(F.isnan("confidence"), None).otherwise(F.col("confidence"))
    top = F.max(c)
    miss = F.exp(F.sum(F.log(1 - share * c))) / (1 - share * top) * (1 - top)
    return F.coalesce(F.least(F.lit(ceiling), F.round(1 - miss, 3)), F.lit(0.0))


def merge_findings(df: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """Findings of one vehicle folded across photos: levels two frames support, raised confidence.

    Same component merges at 0.42, another component of the family at 0.50.
    """
    tagged = df.withColumn("family", C.family_of(F.col("component")))
    rows = cluster_sightings(tagged, unit, ["family"], "observation", order, T.SAME_DEFECT, "first", ("component", T.SAME_DEFECT_CROSS_ID))
    graded = ~F.col("ungraded")
    own = F.struct(*order) == F.col("leader")
    base = rows.groupBy(*unit, "family", "leader").agg(
        F.count("*").alias("n_sightings"), merged_confidence().alias("confidence"),
        F.bool_and("ungraded").alias("ungraded"), F.min(F.when(own, F.col("photo_id"))).alias("photo_id"),
        F.min(F.when(own, F.col("severity"))).alias("_own_severity"), F.min(F.when(own, F.col("price_impact"))).alias("_own_impact"),
        *level_counts("severity", C.SEVERITIES, graded), *level_counts("price_impact", C.IMPACTS, graded))
    photos = rows.select(*unit, "family", "leader", "photo_id").distinct().groupBy(*unit, "family", "leader").agg(F.count("*").alias("_photos"))
    out = base.join(photos, unit + ["family", "leader"])
    alone = F.col("n_sightings") == 1
    level = lambda scale, column, own_level: F.when(alone, F.col(own_level)).otherwise(
        F.coalesce(C.level_of(scale, corroborated(column)), F.col(own_level)))
    return out.select(*unit, "family", "leader", "photo_id", "n_sightings", "confidence", "ungraded",
                      level(C.SEVERITIES, "severity", "_own_severity").alias("severity"),
                      level(C.IMPACTS, "price_impact", "_own_impact").alias("price_impact"),
                      (F.col("_photos") - 1).alias("n_also_seen"))


def also_seen(rows: DataFrame, unit: list[str]) -> DataFrame:
    """(cluster, photo) pairs other than the photo a cluster cites, one row each."""
    cited = rows.withColumn("_cited", F.col("leader.photo_id"))
    return cited.where("photo_id <> _cited").select(*unit, "family", "leader", "photo_id").distinct()


def apply_revisions(findings: DataFrame, revisions: DataFrame, key: list[str], order: str) -> DataFrame:
    """Bounded re-grading: lowering is free, a raise is one level, the top needs two kinds of support.

    ``findings``: key, severity, price_impact, corroborated, seen_elsewhere.
    The first decision per finding counts. A severity outside the scale stays
    as it is. Adds the granted levels and the reasons for refusals.
    """
    first = revisions.groupBy(*key).agg(F.min_by(F.struct(F.col("severity").alias("want_s"), F.col("price_impact").alias("want_i")), order).alias("_r"))
    df = findings.join(first, key, "left").select(*findings.columns, "_r.want_s", "_r.want_i")
    s0, i0 = C.rank_of(C.SEVERITIES, F.col("severity")), C.rank_of(C.IMPACTS, F.col("price_impact"))
    sw, iw = C.rank_of(C.SEVERITIES, F.col("want_s")), C.rank_of(C.IMPACTS, F.col("want_i"))
    top = len(C.SEVERITIES) - 1
    too_far = sw > s0 + 1
    lone_read, lone_photo = (sw == top) & ~F.col("corroborated"), (sw == top) & ~F.col("seen_elsewhere")
    s1 = (F.when(sw.isNull(), s0).when(sw <= s0, sw).when(too_far, s0 + 1)
          .when(lone_read | lone_photo, F.least(s0 + 1, F.lit(top - 1))).otherwise(sw))
    s_why = F.when(sw > s0, F.when(too_far, "more_than_one_level").when(lone_read, "one_read_only").when(lone_photo, "one_photo_only"))
    df = df.withColumns({"_s0": s0, "_i0": i0, "_s1": s1, "_s_why": s_why, "_iw": iw, "_sw": sw})
    granted = F.when(F.col("_iw") <= F.col("_i0"), F.col("_iw")).otherwise(F.least(F.col("_iw"), F.col("_i0") + 1))
    behind = F.col("_i0") + F.greatest(F.lit(0), F.col("_s1") - F.col("_s0"))
    limited = F.col("_sw").isNotNull() & (granted > F.col("_i0"))
    i1 = F.when(F.col("_iw").isNull(), F.col("_i0")).when(limited, F.least(granted, behind)).otherwise(granted)
    i_why = F.when(limited & (granted > behind), "outran_severity").when(~limited & (F.col("_iw") > F.col("_i0") + 1), "more_than_one_level")
    out = df.withColumns({"new_severity": F.when(F.col("_s0").isNull(), F.col("severity")).otherwise(C.level_of(C.SEVERITIES, F.col("_s1"))), "new_impact": C.level_of(C.IMPACTS, i1),
                          "severity_refusal": F.col("_s_why"), "impact_refusal": i_why,
                          "decided": F.col("want_s").isNotNull() | F.col("want_i").isNotNull()})
    return out.drop("_s0", "_i0", "_s1", "_s_why", "_iw", "_sw")


def revision_audit(revised: DataFrame, key: list[str]) -> DataFrame:
    """Audit rows: one for a refused raise, one for a change."""
    before, after = F.concat_ws("/", "severity", "price_impact"), F.concat_ws("/", "new_severity", "new_impact")
    refused = revised.where("severity_refusal is not null or impact_refusal is not null").select(
        *key, F.lit("severity_raise_clamped").alias("kind"), before.alias("before"), after.alias("after"))
    changed = revised.where(before != after).select(*key, F.lit("severity_calibrated").alias("kind"), before.alias("before"), after.alias("after"))
    return refused.unionByName(changed)


def reads_in_rounds(tagged: DataFrame, home: list[str], threshold: float) -> DataFrame:
    """Rows of reads with the first row of their cluster (``leader``), one read after another."""
    nodes = tagged.groupBy(*home, "text_key").agg(F.any_value("words").alias("words"))
    pairs = S.by_rare_words(nodes, nodes, home, "text_key", "text_key", threshold)
    pairs = S.cut_lineage(pairs.select(*home, "text_key", F.col("text_key_other").alias("leader_key")))
    assigned = None
    samples = sorted(r[0] for r in tagged.select("sample").distinct().collect())  # as many as a photo has reads
    for sample in samples:
        rows = tagged.where(F.col("sample") == sample)
        if assigned is not None:
            starts = assigned.where("row = leader").select(*home, F.col("text_key").alias("leader_key"), "leader")
            offers = rows.join(pairs, home + ["text_key"]).join(starts, home + ["leader_key"]).select(*home, "row", "leader")
            matched = K.mutual_best(offers, home + ["row"], home + ["leader"], ["row", "leader"]).select(*home, "row", "leader")
            rows = rows.join(matched, home + ["row"], "left").withColumn("leader", F.coalesce("leader", "row"))
        else:
            rows = rows.withColumn("leader", F.col("row"))
        rows = S.cut_lineage(rows)
        assigned = rows if assigned is None else assigned.unionByName(rows)
    return assigned


def consensus_of_reads(df: DataFrame, unit: list[str], k: int, quorum: int, threshold: float = T.SAME_DEFECT, most: int = K.MOST_ROWS) -> DataFrame:
    """k reads of one photo into findings: one sighting per read and cluster.

    Reads are taken one after another (a photo has few), whatever their numbers. Inside a read the earliest
    row takes its first free cluster of the reads before; in groups above ``most`` rows that is a
    one-to-one match by (position, cluster age), so each read is a handful of matching rounds.
    """
    home = unit + ["component"]
    tagged = S.with_text_key(df, "observation").withColumns({
        "row": F.struct("sample", "pos"), "_wording": F.when(F.size("words") == 0, T.folded(F.col("observation")))})
    keep = [*home, "sample", "pos", "row", "confidence", "severity", "price_impact"]
    small, large = K.split_by_size(tagged, home, most)

    def start():
        leaders, read = [], {"sample": None, "had": 0, "taken": set()}

        def step(words, wording, row):
            if read["sample"] != row["sample"]:
                read.update(sample=row["sample"], had=len(leaders), taken=set())
            mine = (frozenset(words), wording)
            for i in range(read["had"]):  # clusters that earlier reads started
                if i not in read["taken"] and T.overlap_of(mine, leaders[i][0]) >= threshold:
                    read["taken"].add(i)
                    return leaders[i][1]
            leaders.append((mine, row))
            return row

        return step

    ready = small.select(*keep, "words", "_wording")
    assigned = K.fold_in_order(ready, home, ["sample", "pos"], ["words", "_wording", "row"], start, "leader", ready.schema["row"].dataType).select(*keep, "leader")
    if large is not None:
        assigned = assigned.unionByName(reads_in_rounds(S.cut_lineage(large.drop("_wording")), home, threshold).select(*keep, "leader"))
    g = assigned.groupBy(*home, "leader").agg(
        F.count("*").alias("agreed"), F.avg("confidence").alias("self_confidence"), F.count_distinct("severity").alias("_levels"),
        *level_counts("severity", C.SEVERITIES), *level_counts("price_impact", C.IMPACTS))
    full = F.col("agreed") >= k
    sev = F.when(full, lower_median("severity")).otherwise(lowest("severity"))
    imp = F.when(full, lower_median("price_impact")).otherwise(lowest("price_impact"))
    ok = F.col("agreed") >= quorum
    top = len(C.SEVERITIES) - 1
    kept = F.when(~ok & (sev == top), top - 1).otherwise(sev)
    return g.select(*home, "leader", "agreed", F.round(F.col("agreed") / k, 3).alias("confidence"),
                    F.round("self_confidence", 3).alias("self_confidence"), ok.alias("corroborated"),
                    C.level_of(C.SEVERITIES, kept).alias("severity"), C.level_of(C.IMPACTS, imp).alias("price_impact"),
                    F.when(~ok, "uncorroborated_finding").when(F.col("_levels") > 1, "sample_disagreement").alias("correction"))
