"""Pairing records of two tables with the nearest in time of the same entity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Partition edges per block of the prefix scan.
SCAN_BLOCK = 256
#: Rows of a range partition, about, where that makes more of them than the session's shuffle partitions.
ROWS_A_PARTITION = 2_000_000
ROW = "pid int, edge boolean, e0 string, e1 string, id bigint, t bigint, pt bigint, pid_ bigint, nt bigint, nid bigint"


def _scan(batches: Iterator[pa.RecordBatch], tolerance: int | None) -> Iterator[pa.RecordBatch]:
    """Scan one range partition, sorted by (e0, e1, t, side, id); right records (side 0) come before left ones of the same time.

    Gives each left record its last right record before (the lowest id of that time) and first one after within this partition, and the edge:
    the partition's first right record (as nt, nid of e0, e1) and its last (as pt, pid_, with entity in a second edge row), or one edge row with neither if it holds only left records.
    """
    import numpy as np
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("pid", pa.int32()), ("edge", pa.bool_()), ("e0", pa.string()), ("e1", pa.string()), ("id", pa.int64()), ("t", pa.int64()), ("pt", pa.int64()), ("pid_", pa.int64()), ("nt", pa.int64()), ("nid", pa.int64())])
    first = last = None  # right records: (e0, e1, t, id)
    open_: pa.Table | None = None  # rows that wait for the next right record, led by the last right record before them
    later: list[pa.Table] = []  # batches without a right record that came after them: looked at once one comes

    def rows(tab: pa.Table, upto: int, prev, nxt) -> pa.RecordBatch | None:
        side, t, id_ = (tab[c].to_numpy() for c in ("side", "t", "id"))
        at = np.flatnonzero(side[:upto] == 1)
        if not len(at):
            return None
        p, n = prev[at], nxt[at]
        take = lambda v, i: pa.array(np.where(i >= 0, v[np.maximum(i, 0)], 0), mask=i < 0)
        e = [pc.take(tab[c].combine_chunks(), pa.array(at)) for c in ("e0", "e1")]
        k = len(at)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, part, np.int32)), pa.array(np.zeros(k, bool)), *e, pa.array(id_[at]), pa.array(t[at]), take(t, p), take(id_, p), take(t, n), take(id_, n)], schema=schema)

    def handle(tab: pa.Table, final: bool):
        """Rows of `tab` whose next right record is known, and the rest of it."""
        n = tab.num_rows
        side, t = tab["side"].to_numpy(), tab["t"].to_numpy()
        change = np.ones(n, bool)
        if n > 1:
            c0, c1 = tab["e0"].combine_chunks(), tab["e1"].combine_chunks()
            ne = lambda c: pc.not_equal(pc.fill_null(c[1:], "\0"), pc.fill_null(c[:-1], "\0")).to_numpy(zero_copy_only=False)
            change[1:] = ne(c0) | ne(c1)
        group = np.cumsum(change)
        i = np.arange(n)
        right = side == 0
        # the first of right records with the same entity and time stands for all of them
        again = np.zeros(n, bool)
        again[1:] = right[1:] & right[:-1] & ~change[1:] & (t[1:] == t[:-1])
        lead = right & ~again
        prev = np.maximum.accumulate(np.where(lead, i, -1))
        prev = np.where((prev >= 0) & (group[np.maximum(prev, 0)] == group), prev, -1)
        nxt = np.minimum.accumulate(np.where(lead, i, n)[::-1])[::-1]
        found = (nxt < n) & (group[np.minimum(nxt, n - 1)] == group)
        nxt = np.where(found, nxt, -1)
        if final:
            return rows(tab, n, prev, nxt), None
        # the last entity's rows after its last right record wait, with that record before them
        tail = np.flatnonzero((group == group[-1]) & right)
        keep = int(prev[tail[-1]]) if len(tail) else int(np.flatnonzero(group == group[-1])[0])
        rest = tab.slice(keep)
        if tolerance is not None:  # nothing that comes later is near enough to rows that lie further back
            cut = int(np.flatnonzero((group == group[-1]) & (t >= t[-1] - tolerance))[0])
            if cut > keep:
                keep, lead_at = cut, int(prev[cut])
                rest = tab.slice(cut)
                if 0 <= lead_at < cut:  # the right record before the rows that wait goes with them
                    rest = pa.concat_tables([tab.slice(lead_at, 1), rest])
        return rows(tab, keep, prev, nxt), rest

    for batch in batches:
        if not batch.num_rows:
            continue
        tab = pa.Table.from_batches([batch])
        r = np.flatnonzero(tab["side"].to_numpy() == 0)
        if len(r):
            pick = lambda k: tuple(tab[c][int(k)].as_py() for c in ("e0", "e1", "t", "id"))  # noqa: B023, E731
            first = first or pick(r[0])
            end = pick(r[-1])
            t = tab["t"].to_numpy()
            e = pc.and_(pc.equal(pc.fill_null(tab["e0"], "\0"), pa.scalar(end[0] if end[0] is not None else "\0")), pc.equal(pc.fill_null(tab["e1"], "\0"), pa.scalar(end[1] if end[1] is not None else "\0"))).to_numpy()
            low = int(tab["id"].to_numpy()[r][e[r] & (t[r] == end[2])].min())
            last = (*end[:3], min(low, last[3]) if last and last[:3] == end[:3] else low)
        if tolerance is None and not len(r):
            later.append(tab)
            continue
        if open_ is not None or later:
            tab = pa.concat_tables([*([open_] if open_ is not None else []), *later, tab])
            later = []
        out, open_ = handle(tab, False)
        if out is not None:
            yield out
    if later:
        open_ = pa.concat_tables([*([open_] if open_ is not None else []), *later])
    if open_ is not None:
        out, _ = handle(open_, True)
        if out is not None:
            yield out
    if open_ is not None and not first:  # rows, but no right record: the carries go over this partition, and it gets its own
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, True, *[None] * 8), schema)], schema=schema)
    if first:
        edge = [(part, True, first[0], first[1], None, None, None, None, first[2], first[3]), (part, True, last[0], last[1], None, None, last[2], last[3], None, None)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*edge), schema)], schema=schema)


def _carries(edges: DataFrame) -> DataFrame:
    """(cp, p, n): for each partition that holds rows the last right record of those before it and the first of those after it.

    A prefix scan in two levels: within blocks of SCAN_BLOCK partitions, all blocks at once, and over the blocks' totals.
    """
    lasts = edges.where("pt IS NOT NULL").select("pid", F.struct("e0", "e1", F.col("pt").alias("t"), F.col("pid_").alias("id")).alias("l"))
    firsts = edges.where("nt IS NOT NULL").select(F.col("pid").alias("fp"), F.struct("e0", "e1", F.col("nt").alias("t"), F.col("nid").alias("id")).alias("f"))
    # a time whose right records lie on both sides of an edge is led by the lowest id
    low = Window.partitionBy("l.e0", "l.e1", "l.t")
    lasts = lasts.withColumn("id", F.min("l.id").over(low)).select("pid", F.struct("l.e0", "l.e1", "l.t", "id").alias("l"))
    lasts = lasts.withColumnRenamed("pid", "lp")
    both = edges.select("pid").distinct().join(lasts, F.col("pid") == F.col("lp"), "left").join(firsts, F.col("pid") == F.col("fp"), "left").select("pid", "l", "f").withColumn("b", F.expr(f"pid div {SCAN_BLOCK}"))
    within = Window.partitionBy("b").orderBy("pid")
    both = both.withColumns({"p": F.last("l", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)), "n": F.last("f", ignorenulls=True).over(Window.partitionBy("b").orderBy(F.desc("pid")).rowsBetween(Window.unboundedPreceding, -1))})
    totals = both.groupBy("b").agg(F.max_by("l", F.expr("if(l IS NOT NULL, pid, NULL)")).alias("l"), F.min_by("f", F.expr("if(f IS NOT NULL, pid, NULL)")).alias("f")).withColumn("top", F.expr(f"b div {SCAN_BLOCK}"))
    up, down = Window.partitionBy("top").orderBy("b"), Window.partitionBy("top").orderBy(F.desc("b"))
    totals = totals.select(F.col("b").alias("tb"), F.last("l", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("bp"), F.last("f", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("bn"))
    return both.join(totals, F.col("b") == F.col("tb")).select(F.col("pid").alias("cp"), F.coalesce("p", "bp").alias("p"), F.coalesce("n", "bn").alias("n"))


def nearest(left: DataFrame, right: DataFrame, by: tuple[str, str], left_time: str, right_time: str, left_id: str, right_id: str, tolerance: int | None = None, partitions: int | None = None) -> DataFrame:
    """(left_id, right_id, distance): for each left record the right record of the same entity `by` (two string columns) at the least absolute distance in time.

    Times and ids are bigint. At most `tolerance` apart, if given; of right records of one time the lowest id; of one before and one
    after at the same distance the one before. Left records without a time, an entity or a partner give no row; right records without a time take no
    part; null entities match nothing. Repeated records each count. Other columns are dropped. Empty tables give no rows.

    Both tables are range-partitioned together by (entity, time, id), so an entity of any size spreads over as many
    tasks as it fills. Each partition is scanned once, in Arrow batches, holding only the rows that wait for a right record
    (with a tolerance, only those within it; without one a stretch of left records between two right ones is held at once).
    The scan's result and one or two edge rows per partition that holds rows are written to the shared folder; a prefix scan over the edges carries the last and first right
    records over partitions without any. Partition ids are in the written rows, so nothing depends on a range split being made twice alike.
    Up to SCAN_BLOCK^2 partitions are scanned in two levels.
    """
    e0, e1 = by
    side = lambda df, k, t, i: df.where(F.col(t).isNotNull() & F.col(e0).isNotNull() & F.col(e1).isNotNull()).select(F.col(e0).alias("e0"), F.col(e1).alias("e1"), F.col(t).cast("bigint").alias("t"), F.lit(k).cast("int").alias("side"), F.col(i).cast("bigint").alias("id"))
    spark = left.sparkSession
    # written first: the range split reads its rows twice, and times may be dear to parse
    both = written(side(left, 1, left_time, left_id).unionByName(side(right, 0, right_time, right_id)), "nearest-rows")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), both.count() // ROWS_A_PARTITION + 1)
    if n > SCAN_BLOCK**2:
        raise ValueError(f"more than {SCAN_BLOCK**2} range partitions")
    order = ["e0", "e1", "t", "side", "id"]
    scanned = both.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lambda batches: _scan(batches, tolerance), ROW)
    scanned = written(scanned, "nearest-scan")
    carries = _carries(scanned.where("edge"))
    rows = scanned.where("NOT edge").join(F.broadcast(carries), F.col("pid") == F.col("cp"), "left")  # one row per partition: at most SCAN_BLOCK^2
    same = lambda s: (F.col(f"{s}.e0") == F.col("e0")) & (F.col(f"{s}.e1") == F.col("e1"))
    # the carried record replaces none, or the same time found here (its records began in an earlier partition)
    use_p = same("p") & (F.col("pt").isNull() | (F.col("pt") == F.col("p.t")))
    use_n = same("n") & F.col("nt").isNull()
    p = F.when(use_p, F.struct(F.col("p.t").alias("t"), F.least(F.col("p.id"), F.col("pid_")).alias("i"))).when(F.col("pt").isNotNull(), F.struct(F.col("pt").alias("t"), F.col("pid_").alias("i")))
    q = F.when(use_n, F.struct(F.col("n.t").alias("t"), F.col("n.id").alias("i"))).when(F.col("nt").isNotNull(), F.struct(F.col("nt").alias("t"), F.col("nid").alias("i")))
    rows = rows.select("id", "t", p.alias("p_"), q.alias("q_"))
    dp, dq = F.col("t") - F.col("p_.t"), F.col("q_.t") - F.col("t")
    back = F.coalesce(dp <= dq, F.col("p_").isNotNull())
    out = rows.select(F.col("id").alias(left_id), F.when(back, F.col("p_.i")).otherwise(F.col("q_.i")).alias(right_id), F.when(back, dp).otherwise(dq).alias("distance")).where(F.col(right_id).isNotNull())
    return out if tolerance is None else out.where(F.col("distance") <= tolerance)
