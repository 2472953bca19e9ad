"""Mixing sources to target shares of the tokens."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .bpe import count_tokens

#: Labelled records the classifier is fitted on, at most, and its hashed features.
SAMPLE, FEATURES = 20_000, 2048
#: Posteriors are told apart in steps of 1 / this: records of one source and like posterior (a cell) share one rate.
STEPS = 8
#: Rounds of projected gradient, those of them in which the labels alone count, and the largest miss (of the total) at which they end.
ROUNDS, LAST, ENOUGH = 14, 5, 1e-4
#: Weight of the expected (posterior) totals against the labelled ones.
SOFT = 0.5
#: Records of one source and size that are rounded in one task, about.
PART_ROWS = 1_000_000
#: Single records added or left out per source, at most, to make up for the rounding.
TOUCHES = 8


def fit_classifier(records: DataFrame, labels: list[str], label: str, text: str):
    """(model, number of sampled records by label index): hashed logistic regression on at most SAMPLE labelled records (hash-chosen, of all sources alike); model None with fewer than two labels met."""
    index = F.create_map(*(x for i, s in enumerate(labels) for x in (F.lit(s), F.lit(float(i)))))
    df = records.where(F.col(label).isin(labels)).select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"), index[F.col(label)].alias("_label"))
    n = df.count()
    sample = df if n <= SAMPLE else df.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(1e6 * SAMPLE / n))
    met = {int(r["_label"]): r["count"] for r in sample.groupBy("_label").count().collect()}
    if len(met) < 2:
        return None, met
    steps = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=1),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=FEATURES, binary=True),
        LogisticRegression(featuresCol="_tf", labelCol="_label", probabilityCol="_p", maxIter=15, regParam=0.01, family="multinomial"),
    ]
    return Pipeline(stages=steps).fit(sample.select("_text", "_label").repartition(8)), met


def posteriors(df: DataFrame, model, labels: list[str], label: str, text: str) -> DataFrame:
    """`df` without its text and with `post`, the classifier's posterior of each of `labels`; without a model the own label has it all."""
    k = len(labels)
    if model is None:
        own = F.array(*(F.when(F.col(label) == s, 1.0).otherwise(0.0) for s in labels))
        return df.withColumn("post", own).drop(text)
    out = model.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    # the fitted model has as many classes as the highest label met
    post = F.slice(F.concat(vector_to_array("_p"), F.array_repeat(F.lit(0.0), k)), 1, k)
    return out.withColumn("post", post).select(*(c for c in df.columns if c != text), "post")


def cells(members: DataFrame) -> DataFrame:
    """(source, cell, tokens, expected): token sums of the records of one source and like posterior, and of tokens times posterior."""
    sums = members.select("source", "cell", "tokens", F.posexplode("post").alias("i", "p")).groupBy("source", "cell", "i").agg(F.sum(F.col("tokens") * F.col("p")).alias("e"), F.sum("tokens").alias("t"))
    return sums.groupBy("source", "cell").agg(F.first("t").cast("double").alias("tokens"), F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda x: x["e"]).alias("expected"))


def _numbers(pdf, labels: list[str]):
    """(tokens, membership, cap index) of cells: membership is the label's one-hot vector beside SOFT times the mean posterior."""
    import numpy as np

    at = {s: i for i, s in enumerate(labels)}
    t = pdf["tokens"].to_numpy(float)
    own = np.array([at[s] for s in pdf["source"]], int)
    m = np.zeros((len(t), 2 * len(labels)))
    m[np.arange(len(t)), own] = 1.0
    if len(t):
        e = np.array(pdf["expected"].tolist(), float)
        m[:, len(labels):] = SOFT * np.divide(e, t[:, None], out=np.zeros_like(e), where=t[:, None] > 0)
    return t, m, own


def _rates(m, own, caps, steps):
    """Rates of cells after the given steps: each moves a rate against the gradient along its membership and projects it on [0, cap]."""
    import numpy as np

    cap = np.asarray(caps)[own]
    r = np.minimum(1.0, cap)
    for step in steps:
        r = np.clip(r - m @ np.asarray(step), 0.0, cap)
    return r


def fit_rates(cell: DataFrame, labels: list[str], goals: list[float], caps: list[float]) -> tuple[list[list[float]], list[float]]:
    """(steps, expected tokens of each label). Projected-gradient least squares: steps after which each label's tokens, and each label's expected tokens by posterior, come nearest to its goal.

    Each round is one pass over the cells, on all tasks, of which 4 sums a label come back (and once their Gram matrix, by which steps are scaled). A rate is the
    steps replayed, so no state of cells is stored. In the LAST rounds labels alone count: a bounded correction where both cannot be met.
    """
    import numpy as np

    k, steps = len(labels), []

    def passed(steps, gram: bool):
        def run(batches):
            import pandas as pd

            for b in batches:
                t, m, own = _numbers(b, labels)
                r = _rates(m, own, caps, steps)
                rows = [(i, -1, float(v)) for i, v in enumerate(m.T @ (t * r))]
                rows += [(i, j, float(v)) for j, free in ((-2, r < np.asarray(caps)[own]), (-3, r > 0)) for i, v in enumerate(m.T[:k] @ (t * free))]
                if gram:
                    g = m.T @ (m * t[:, None])
                    rows += [(i, j, float(g[i, j])) for i in range(2 * k) for j in range(2 * k) if g[i, j]]
                yield pd.DataFrame(rows, columns=["i", "j", "v"])

        out = cell.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        got, free, g = np.zeros(2 * k), np.zeros((2, k)), np.zeros((2 * k, 2 * k))
        for r in out.collect():  # 4 k sums, and once (2 k)^2
            if r.j == -1:
                got[r.i] = r.v
            elif r.j < 0:
                free[-2 - r.j, r.i] = r.v
            else:
                g[r.i, r.j] = r.v
        return got, free, g

    goal = np.concatenate([goals, SOFT * np.asarray(goals)])
    total = max(sum(goals), 1e-9)
    hard = np.arange(2 * k) < k
    gram = None
    for n in range(ROUNDS):
        got, free, g = passed(steps, gram is None)
        gram = g if gram is None else gram
        miss = got - goal
        last = n >= ROUNDS - LAST or np.abs(miss).max() <= ENOUGH * total
        if last and np.abs(miss[hard]).max(initial=0.0) <= ENOUGH * total:
            break
        if last:  # labels do not meet in one record: each is scaled by the tokens whose rate can still move its way
            room = np.where(miss[:k] < 0, free[0], free[1])
            step = np.concatenate([np.divide(miss[:k], room, out=np.zeros(k), where=room > 0), np.zeros(k)])
        else:  # memberships of a record sum to 1 twice over: the matrix is singular by that, which the pseudo-inverse leaves alone
            step = np.linalg.pinv(gram, rcond=1e-6, hermitian=True) @ miss
        steps.append(step.tolist())
    else:
        got = passed(steps, False)[0]
    return steps, (got[k:] / SOFT).tolist()


def choose_total(shares: list[float], limits: list[float], least: list[float]) -> float:
    """The total whose shares are nearest to the targets by least squares, of equal ones the largest.

    A source can give up to its limit (tokens times max_repeats); a source's tokens cannot be met nearer than half its smallest record, which weighs the
    more the smaller the total. One number per source, tried at 400 totals.
    """
    use = [(h, c, m) for h, c, m in zip(shares, limits, least) if h > 0 and c > 0]
    if not use:
        return 0.0
    exact, most = min(c / h for h, c, _ in use), sum(c for _, c, _ in use)

    def off(total: float) -> float:
        got = [min(total * h, c) for h, c, _ in use]
        s = sum(got)
        return sum((g / s - h) ** 2 + (0.5 * m / s) ** 2 / 4 for g, (h, _, m) in zip(got, use))

    tried = [exact * math.exp(math.log(max(most / exact, 1.0) * 2) * i / 399) for i in range(400)]
    return min(tried, key=lambda x: (round(off(x), 7), -x))


def round_repeats(rated: DataFrame, goals: dict[str, float], cap: Column) -> DataFrame:
    """doc_id, source, tokens, repeats: whole numbers for the rates of `rated` (doc_id, source, tokens, rate), so that used and left-out records are alike in size and a source's tokens come near its goal.

    Running sums of rates over a source's records in order of size are rounded; their offsets come from one row per size (and part of PART_ROWS records of one size). At any
    size the count is off by less than one, so a source's tokens are off by at most its largest record. Then single records are added or left out, at most TOUCHES a source, each
    the one whose size is nearest to what is amiss: one aggregate over the sizes each, no record is looked at twice.
    """
    n = rated.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("_n")).select(F.col("source").alias("_ls"), F.col("tokens").alias("_lt"), F.ceil(F.col("_n") / PART_ROWS).cast("int").alias("_p"))
    df = rated.join(n, (F.col("source") == F.col("_ls")) & (F.col("tokens") == F.col("_lt"))).drop("_ls", "_lt")
    df = df.withColumns({"_part": F.pmod(F.xxhash64("doc_id"), F.col("_p")).cast("int"), "_w": F.when(F.col("tokens") > 0, F.col("rate")).otherwise(0.0)}).drop("_p")
    level = df.groupBy("source", "tokens", "_part").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy("source").orderBy("tokens", "_part").rowsBetween(Window.unboundedPreceding, -1)
    level = level.select(F.col("source").alias("_ls"), F.col("tokens").alias("_lt"), F.col("_part").alias("_lp"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_off"))
    df = df.join(level, (F.col("source") == F.col("_ls")) & (F.col("tokens") == F.col("_lt")) & (F.col("_part") == F.col("_lp"))).drop("_ls", "_lt", "_lp")
    run = Window.partitionBy("source", "tokens", "_part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_to", F.col("_off") + F.sum("_w").over(run))
    whole = F.floor(F.round("_to", 6) + 0.5) - F.floor(F.round(F.col("_to") - F.col("_w"), 6) + 0.5)
    df = written(df.select("doc_id", "source", "tokens", F.least(whole, F.ceil(cap)).cast("int").alias("repeats")), "mix-rounded")
    room = F.when((F.col("tokens") > 0) & (F.col("repeats") + 1 <= cap), F.col("doc_id"))
    sizes = df.groupBy("source", "tokens").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.min(room).alias("up"), F.min(F.when(F.col("repeats") > 0, F.col("doc_id"))).alias("down")).where("tokens > 0")
    # one row per size: of each size one record can be added and one left out
    touched = _touches(written(sizes, "mix-sizes"), goals)
    if not touched:
        return df
    change = F.create_map(*(x for d, v in touched.items() for x in (F.lit(d), F.lit(v))))
    return df.withColumn("repeats", (F.col("repeats") + F.coalesce(change[F.col("doc_id")], F.lit(0))).cast("int"))


def _touches(sizes: DataFrame, goals: dict[str, float]) -> dict[int, int]:
    """{doc_id: +1 or -1}, at most TOUCHES for each source."""
    miss = {r.source: goals.get(r.source, 0.0) - (r.t or 0) for r in sizes.groupBy("source").agg(F.sum("used").alias("t")).collect()}
    done: dict[int, int] = {}
    for _ in range(TOUCHES):
        need = {s: m for s, m in miss.items() if abs(m) >= 1}
        if not need:
            break
        want = F.create_map(*(x for s, m in need.items() for x in (F.lit(s), F.lit(float(m)))))[F.col("source")]
        pick = F.when(want > 0, F.col("up")).otherwise(F.col("down"))
        left = F.abs(F.abs(want) - F.col("tokens"))
        near = sizes.where(want.isNotNull() & pick.isNotNull() & ~pick.isin(list(done)) & (left < F.abs(want)))
        got = near.groupBy("source").agg(F.min_by(F.struct(pick.alias("d"), "tokens"), F.struct(left, "tokens")).alias("x")).collect()
        if not got:
            break
        for r in got:
            sign = 1 if need[r.source] > 0 else -1
            done[r.x.d] = sign
            miss[r.source] -= sign * r.x.tokens
    return done


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, report): how often each record is used, and each source's share of the tokens.

    docs: doc_id (unique, bigint), source, text; targets: source, target_share, max_repeats (clean, one row per source; few: the fit keeps a matrix of twice their number). Records of
    a source without a target (also of none) are not used. `total` tokens are aimed at; by default `choose_total`. A target without records stays empty and the others
    keep their proportions; where max_repeats does not allow a source's share of the total, it is used as often as it may be.

    Method: a labelled-table classifier gives each record's posterior of the domains; nonnegative rates (at most max_repeats) are fitted by projected-gradient least squares so
    that both the tokens of each source and its expected tokens by posterior come nearest to the target, the labelled ones first: of a source's records those are taken more often
    that look like the domains the mix is short of. Rates are rounded to whole repeats.

    plan: doc_id, source, tokens, repeats (0 for a record left out); report: source, target_share, max_repeats, records, available_tokens, used_tokens, actual_share, and
    expected_share, what the fit reached by posterior (before rounding). Null and empty texts have no tokens and are used 0 times; an empty table gives shares of null.
    """
    goal = [r.asDict() for r in targets.select("source", "target_share", "max_repeats").orderBy("source").collect()]  # one row per target source
    labels = [g["source"] for g in goal]
    caps = [float(g["max_repeats"]) for g in goal]
    records = docs.where(F.col("source").isin(labels)).select("doc_id", "source", "text")
    model, met = fit_classifier(records, labels, "source", "text")
    want = [float(g["target_share"]) for g in goal]
    there = sum(want[i] for i in met) or 1.0
    shares = [w / there if i in met else 0.0 for i, w in enumerate(want)]
    # tokens and posterior in one reading of the texts
    df = posteriors(count_tokens(records.withColumn("_t", F.col("text")), ["doc_id", "source", "text"], text="_t"), model, labels, "source", "text")
    df = written(df.withColumn("cell", F.xxhash64(F.transform("post", lambda p: F.round(p * STEPS).cast("int")))), "mix-members")
    have = {r.source: r for r in df.groupBy("source").agg(F.sum("tokens").alias("t"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least")).collect()}
    limits = [float(have[s].t or 0) * c if s in have else 0.0 for s, c in zip(labels, caps)]
    if total is None:
        total = choose_total(shares, limits, [float(have[s].least or 0) if s in have else 0.0 for s in labels])
    goals = [min(total * h, c) for h, c in zip(shares, limits)]
    cell = written(cells(df), "mix-cells")
    steps, expected = fit_rates(cell, labels, goals, caps)

    def rates(batches):
        for b in batches:
            _, m, own = _numbers(b, labels)
            b["rate"] = _rates(m, own, caps, steps)
            yield b[["source", "cell", "rate"]]

    of_cell = cell.mapInPandas(rates, "source string, cell bigint, rate double").select(F.col("source").alias("_cs"), F.col("cell").alias("_cc"), "rate")
    rated = df.drop("post").join(of_cell, (F.col("source") == F.col("_cs")) & (F.col("cell") == F.col("_cc"))).drop("_cs", "_cc", "cell")
    cap = F.create_map(*(x for s, c in zip(labels, caps) for x in (F.lit(s), F.lit(c))))[F.col("source")] if labels else F.lit(0.0)
    plan = round_repeats(rated, dict(zip(labels, goals)), cap)
    used = plan.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("available_tokens"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"))
    report = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").na.fill(0, ["records", "available_tokens", "used_tokens"])
    share = F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(Window.partitionBy()), F.lit(0))  # one row per target source
    by_label = F.create_map(*(x for s, e in zip(labels, expected) for x in (F.lit(s), F.lit(e / (sum(expected) or 1.0)))))[F.col("source")] if labels else F.lit(0.0)
    return plan, report.withColumns({"actual_share": share, "expected_share": F.round(by_label, 6)})
