"""Texts cut by a field's limit or in transfer."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Intact texts the classifier is fitted on, at most (hash-chosen), and its hashed features.
SAMPLE, FEATURES = 20_000, 4096
THRESHOLD = 0.5
#: A length is a source's limit if it has this many texts and so many times the texts of its neighbours (10 lengths to each side).
LIMIT_LEAST, LIMIT_TIMES, AROUND = 8, 6.0, 10
#: Cuts at a word's end fall short of a limit by up to this many characters.
SHORT_BY = 12
#: Weight of an artificially cut text against an intact one in the fit: cuts are rarer in a corpus than among the training rows.
CUT_WEIGHT = 0.2
N_KEYS = 6
#: A closing sentence of up to OPENING words that so many other texts (equal ones of a source count once) end with, and of all in which it occurs this share, is a set phrase.
PHRASE_TEXTS, PHRASE_SHARE = 2, 0.9
#: Openings of a sentence of up to so many words have a key of their own.
OPENING = 5
#: Closing words kept of a text (one more than OPENING, to see where a sentence opened).
TAIL = 6

# Marks that end a sentence, with closing quotes and brackets; decorations that follow a finished text; remarks and
# grades (in brackets, in quotes, n/m) that follow a finished sentence.
ENDS = r"[.!?。！？…][\"'”»’)\]]*$"
DECOR = r"(\s+([:;8=]-?[()DP]+|[*…]+|[\p{So}\p{Sk}\x{1F3FB}-\x{1F3FF}\x{FE0F}\x{200D}]+))+\s*$"
REMARK = r"""([.!?。！？…]["'”»’)\]]*)(\s+(\([^()]{1,30}\)|"[^"]{1,30}"|“[^“”]{1,30}”|«[^«»]{1,30}»|\d{1,3}/\d{1,3}))+\s*$"""
TAIL_MARK = r"[^\p{L}\p{N}]+$"


def _clean(text: Column) -> Column:
    """Text without tags, decorations and closing remarks, numbers written 0, ideographs and kana as words of their own."""
    t = F.regexp_replace(text, r"<[^<>]{0,20}>", " ")
    t = F.regexp_replace(F.rtrim(t), DECOR, "")
    t = F.regexp_replace(t, REMARK, "$1")
    t = F.regexp_replace(t, r"\d+([.,:]\d+)*[A-Za-z]?", "0")
    t = F.regexp_replace(t, r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー])", " $1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r" ([。！？、」])", "$1"))


def _words(text: Column) -> Column:
    return F.filter(F.split(_clean(text), " "), lambda w: w != "")


def _core(w: Column) -> Column:
    return F.regexp_replace(w, TAIL_MARK, "")


def _spelled(df: DataFrame, words: str) -> DataFrame:
    """Add `low`, `core` (low without closing marks) and `ends` (which words end a sentence) of the word array, each pattern run once a word."""
    df = df.withColumn("low", F.transform(words, F.lower))
    return df.withColumns({"core": F.transform("low", _core), "ends": F.transform(words, lambda w: w.rlike(ENDS))})


def _keys(i: Column) -> Column:
    """Hashed keys of the place of word i (from 0) of a row of `_spelled`: its last one, two and three words, the last without its marks; the two words before any
    one word and before any two; and, up to OPENING words into a sentence, all of the sentence so far (null further in)."""
    at = lambda d: F.coalesce(F.get("low", i - d), F.lit(""))
    w = F.get("core", i)
    opening = F.coalesce(*(F.when((i == d) | F.coalesce(F.get("ends", i - d - 1), F.lit(False)), F.xxhash64(F.lit(6), w, *(at(x) for x in range(1, d + 1)))) for d in range(OPENING)))
    return F.array(F.xxhash64(F.lit(1), w), F.xxhash64(F.lit(2), at(1), w), F.xxhash64(F.lit(3), at(2), at(1), w), F.xxhash64(F.lit(4), at(2), at(1)), F.xxhash64(F.lit(5), at(3), at(2)), opening)


def once_per_source(words: DataFrame) -> DataFrame:
    """Rows but those whose source has the same text under a lower doc_id. Copies are found by key alone; only keys that repeat meet the texts."""
    again = words.groupBy("source", "text_key").agg(F.min("doc_id").alias("_low"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = again.select(F.col("source").alias("_s"), F.col("text_key").alias("_k"), "_low")
    return words.join(again, (F.col("source") == F.col("_s")) & (F.col("text_key") == F.col("_k")), "left").where("_low IS NULL OR doc_id = _low").drop("_s", "_k", "_low")


def ending_counts(words: DataFrame) -> DataFrame:
    """(key, total, ended): of each place (see `_keys`) of the corpus, how often it occurs and how often a sentence or text ends there. Equal texts of one source count once."""
    n = F.size("words")
    grams = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(_keys(i).alias("k"), (F.get("ends", i) | (i == n - 1)).cast("int").alias("e")))
    rows = _spelled(once_per_source(words.where(n > 0)), "words").select(F.explode(grams).alias("g")).select(F.explode("g.k").alias("key"), F.col("g.e").alias("e")).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.sum("e").alias("ended"))


def length_limits(docs: DataFrame) -> DataFrame:
    """(source, unit, length, soft): lengths (code points, bytes) at which a source's texts pile up; soft: they pile up in the SHORT_BY characters up to the source's longest text. Equal texts count once."""
    sized = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length"), "text_key"), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"), "text_key"))).alias("s"))
    sized = sized.withColumn("text_key", F.col("s.text_key"))
    hist = sized.groupBy("source", "s.unit", "s.length", "text_key").agg(F.lit(1).alias("x")).groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("length")  # one row per length
    around = (F.sum("n").over(w.rangeBetween(-AROUND, AROUND)) - F.col("n")) / (2 * AROUND)
    top = F.max("length").over(Window.partitionBy("source", "unit"))
    near = F.sum("n").over(w.rangeBetween(-SHORT_BY + 1, 0))
    below = F.sum("n").over(w.rangeBetween(-11 * SHORT_BY + 1, -SHORT_BY)) / 10
    hist = hist.withColumns({"a": around, "top": top, "near": near, "below": F.coalesce(below, F.lit(0.0))})
    hard = hist.where((F.col("n") >= LIMIT_LEAST) & (F.col("n") >= LIMIT_TIMES * (F.col("a") + 0.5)) & (F.col("length") >= 40))
    soft = hist.where((F.col("length") == F.col("top")) & (F.col("near") >= LIMIT_LEAST) & (F.col("near") >= LIMIT_TIMES * (F.col("below") + 0.5)) & (F.col("length") >= 40))
    return hard.select("source", "unit", "length", F.lit(False).alias("soft")).unionByName(soft.select("source", "unit", "length", F.lit(True).alias("soft")))


def set_phrase() -> Column:
    """Of a row of `_with_counts`: its closing sentence is a set phrase. A fit on texts with full stops cannot know those, for they come without."""
    total, ended = F.col("s")[5]["total"] - F.col("off_total"), F.col("s")[5]["ended"] - F.col("off_ended")
    return F.coalesce((ended >= PHRASE_TEXTS) & (ended >= PHRASE_SHARE * total), F.lit(False))


def _features(df: DataFrame) -> DataFrame:
    """Rows with tail (up to TAIL words), at_limit (2: at one, 1: shortly before one, 0), off_total, off_ended (what the row itself adds to its counts) and s (counts of its keys) -> `features`."""
    last = F.element_at("tail", -1)
    dense, ratio, log_t = {}, {}, {}
    for i in range(N_KEYS):
        t = F.greatest(F.coalesce(F.col("s")[i]["total"], F.lit(0)) - F.col("off_total"), F.lit(0)).cast("double")
        e = F.least(F.greatest(F.coalesce(F.col("s")[i]["ended"], F.lit(0)) - F.col("off_ended"), F.lit(0)), t)
        ratio[i], log_t[i] = F.log((e + 0.3) / (t - e + 0.3)), F.log1p(t)
    # the most telling place that is known decides: the whole sentence so far, then the last three words, two, one; places without the last word itself (3, 4) only where the last two words are new
    known, met = {5: "6", 2: "3", 1: "2", 0: "1"}, F.lit(False)
    for i, n in known.items():
        here = ~met & (log_t[i] > 0)
        dense |= {f"_r{n}": F.when(here, ratio[i]).otherwise(0.0), f"_c{n}": F.when(here, ratio[i] * log_t[i] / (log_t[i] + 1)).otherwise(0.0), f"_z{n}": (log_t[i] == 0).cast("double")}
        met = met | (log_t[i] > 0)
    new = log_t[1] == 0
    dense |= {f"_g{i}": F.when(new, ratio[i]).otherwise(0.0) for i in (3, 4)}
    dots = last.rlike(r"(\.\.\.|…)[\"'”»’)\]]*$")
    stop = last.rlike(ENDS) & ~dots
    dense |= {"_stop": stop.cast("double"), "_dots": dots.cast("double"), "_comma": last.rlike(r"[,;:(\-–]$").cast("double"), "_limit": (F.col("at_limit") == 2).cast("double"), "_near": (F.col("at_limit") == 1).cast("double"), "_limit_open": ((F.col("at_limit") == 2) & ~last.rlike(ENDS)).cast("double"), "_named": last.rlike(r"[\p{Lu}0_]").cast("double"), "_strange": (dense["_z1"] * (~last.rlike(r"[\p{Lu}0_]")).cast("double"))}
    df = df.withColumns(dense)
    close = F.lower(F.concat_ws(" ", "tail"))
    grams = F.array(*(F.concat(F.lit(f"{n}|"), F.expr(f"right(_close, {n})")) for n in (1, 2)), F.concat(F.lit("p|"), F.regexp_extract(last, TAIL_MARK, 0)))
    df = df.withColumn("_close", close).withColumn("_grams", grams)
    hashed = HashingTF(inputCol="_grams", outputCol="_h", numFeatures=FEATURES, binary=True).transform(df)
    return VectorAssembler(inputCols=[*dense, "_h"], outputCol="features").transform(hashed).drop(*dense, "_h", "_grams", "_close")


def _with_counts(df: DataFrame, counts: DataFrame, id: list[str]) -> DataFrame:
    """Add `s`, the counts of the row's keys. Rows meet the counts by key: nothing is broadcast that grows with the corpus."""
    df = _spelled(df, "tail").withColumn("k", _keys(F.size("tail") - 1)).drop("low", "core", "ends")
    keys = df.select(*id, F.posexplode("k").alias("i", "key"))
    found = keys.join(counts, "key").groupBy(*id).agg(*(F.max(F.when(F.col("i") == j, F.struct("total", "ended"))).alias(f"s{j}") for j in range(N_KEYS)))
    return df.join(found, id, "left").withColumn("s", F.array(*(f"s{j}" for j in range(N_KEYS)))).drop(*(f"s{j}" for j in range(N_KEYS)), "k")


def _unit(seed: int, *by: str) -> Column:
    """A number in [0, 1) that depends on the row's key only."""
    return F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1_000_000)) / 1_000_000


def training_rows(intact: DataFrame, limits: DataFrame) -> DataFrame:
    """Intact texts (doc_id, words, chars, at_limit) -> rows with `label` 1 (artificially cut) and 0 (complete).

    Cut: at a place drawn from the whole text, after or inside a word that does not end a sentence, some with a mark put in place of the rest; off every limit as in
    transfer, and once more, where the text is longer than a limit drawn from those found, as the field with that limit would cut it. Complete: the text as it is, without its
    full stop or with dots for it, and its first sentence alone; all at the distance from their source's limits at which the text really lies.
    """
    m = limits.count()
    numbered = limits.withColumn("_i", F.row_number().over(Window.orderBy("length", "source", "unit", "soft")) - 1).select("_i", F.col("length").alias("_limit"), "soft")  # few rows
    rows = intact.where(F.size("words") >= 2).withColumn("_draw", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(max(m, 1))).cast("int"))
    rows = _spelled(rows.join(numbered, F.col("_draw") == F.col("_i"), "left"), "words")
    w, n = F.col("words"), F.size("words")
    at = lambda s: (F.floor(_unit(s, "doc_id") * (n - 1)) + 1).cast("int")
    head = lambda j: F.slice(w, F.greatest(j - TAIL + 1, F.lit(1)), F.least(j - 1, F.lit(TAIL - 1)))
    row = lambda tail, limit, total, ended, label: F.struct(tail.alias("tail"), limit.cast("int").alias("at_limit"), total.alias("off_total"), F.lit(ended).alias("off_ended"), F.lit(label).alias("label"))
    variants = []
    in_field = F.col("chars") > F.col("_limit")
    for s, there, limit in ((11, F.lit(True), F.lit(0)), (12, in_field, F.when(F.col("soft"), 1).otherwise(2))):
        j = at(s)  # 1-based word, not the last
        word, core = F.element_at(w, j), F.element_at("core", j)
        part = F.substring(word, F.lit(1), F.greatest(F.lit(1), (F.floor(_unit(s + 20, "doc_id") * (F.length(core) - 1)) + 1).cast("int")))
        frag = (F.length(core) > 2) & (_unit(s + 40, "doc_id") < 0.55)
        dots = _unit(s + 60, "doc_id") < 0.25
        closing = F.concat(F.when(frag, part).otherwise(word), F.when(dots & ~frag, F.lit("...")).otherwise(F.lit("")))
        cut = row(F.concat(head(j), F.array(closing)), limit, F.when(frag, 0).otherwise(1), 0, 1.0)
        variants.append(F.when(F.coalesce(there, F.lit(False)) & ~F.element_at("ends", j), cut))
    last, bare = F.element_at(w, -1), _core(F.element_at(w, -1))
    how = _unit(5, "doc_id")
    first = F.array_position("ends", True).cast("int")
    for there, j, closing in ((F.lit(True), n, last), (F.lit(True), n, F.when(how < 0.2, F.concat(bare, F.lit("..."))).otherwise(bare)), (first > 0, first, _core(F.element_at(w, F.greatest(first, F.lit(1)))))):
        variants.append(F.when(there, row(F.concat(head(j), F.array(closing)), F.col("at_limit"), F.lit(1), 1, 0.0)))
    return rows.select("doc_id", F.posexplode(F.array_compact(F.array(*variants))).alias("variant", "v")).select("doc_id", "variant", "v.*")


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, score, cut, tail, at_limit) of every document: the probability that its text was cut before its writer ended it.

    docs: doc_id, source, text. Null, empty and blank texts and those without a letter or digit have score 0. Repeated texts have the same score if their source's limits agree;
    a set phrase (`set_phrase`) off every limit has score 0. Null sources
    form a source of their own. Without intact texts to learn from every score is 0.

    Whole texts are read for the counts of sentence endings and the length limits of each source, over all documents. The classifier is a
    logistic regression over hashed closing characters, punctuation, length to limit and how often the closing words end a
    sentence elsewhere, fitted on at most SAMPLE intact texts (ended by a full stop) and their artificially cut versions.
    """
    df = docs.select("doc_id", "source", F.col("text").alias("_text"))
    words = df.where(F.trim(F.coalesce("_text", F.lit(""))) != "").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.length("_text").alias("chars"), F.octet_length("_text").alias("bytes"), F.xxhash64("_text").alias("text_key"), _words(F.col("_text")).alias("words"))
    words = written(words, "cut-words")
    counts = ending_counts(words)
    found = written(length_limits(words), "cut-limits")
    limits = found.groupBy("source").agg(
        *(F.collect_set(F.when((F.col("unit") == u) & (F.col("soft") == s), F.col("length"))).alias(f"{u}_{'soft' if s else 'hard'}") for u in ("chars", "bytes") for s in (False, True))
    )  # a source's few limits
    sized = words.join(limits.withColumnRenamed("source", "_ls"), F.col("source") == F.col("_ls"), "left").drop("_ls")
    has = lambda c, v: F.coalesce(F.array_contains(c, F.col(v)), F.lit(False))
    close = lambda c, v: F.coalesce(F.exists(c, lambda x: (F.col(v) <= x) & (F.col(v) > x - SHORT_BY)), F.lit(False))
    # UTF-8 cut at a byte limit falls up to three bytes short
    byte_short = F.coalesce(F.exists("bytes_hard", lambda x: (F.col("bytes") <= x) & (F.col("bytes") > x - 4)), F.lit(False))
    at = F.when(has("chars_hard", "chars") | has("bytes_hard", "bytes"), 2).when(byte_short | close("chars_soft", "chars"), 1).otherwise(0)
    sized = written(sized.withColumn("at_limit", at).select("doc_id", "source", "words", "chars", "at_limit"), "cut-sized")
    last = F.get("words", F.size("words") - 1)
    ended = last.rlike(ENDS) & ~last.rlike(r"(\.\.\.|…)$")
    intact = sized.where(ended)
    n = intact.count()
    if not n:
        none = {"score": F.lit(0.0), "cut": F.lit(False), "tail": F.lit(None).cast("array<string>"), "at_limit": F.lit(None).cast("int")}
        return df.select("doc_id", "source", *(c.alias(n) for n, c in none.items()))
    sample = intact if n <= SAMPLE else intact.where(_unit(3, "doc_id") < SAMPLE / n)
    counts = written(counts, "cut-counts")
    made = written(training_rows(sample, found), "cut-train")
    train = _features(_with_counts(made, counts, ["doc_id", "variant"]))
    model = LogisticRegression(maxIter=60, regParam=0.0005, labelCol="label", featuresCol="features", probabilityCol="p", weightCol="weight").fit(train.select("features", "label", F.when(F.col("label") == 1, CUT_WEIGHT).otherwise(1.0).alias("weight")))
    tail = F.slice("words", F.greatest(F.size("words") - TAIL + 1, F.lit(1)), TAIL)
    rows = sized.where(F.exists("words", lambda x: x.rlike(r"[\p{L}\p{N}]"))).select("doc_id", "source", tail.alias("tail"), "at_limit", F.lit(1).alias("off_total"), F.lit(1).alias("off_ended"))
    scored = model.transform(_features(_with_counts(rows, counts, ["doc_id"]).withColumn("_set", set_phrase() & (F.col("at_limit") == 0))))
    scored = scored.select(F.col("doc_id").alias("_d"), F.when(F.col("_set"), 0.0).otherwise(vector_to_array("p")[1]).alias("_s"), "tail", "at_limit")
    out = df.join(scored, F.col("doc_id") == F.col("_d"), "left").withColumn("score", F.coalesce("_s", F.lit(0.0)))
    return out.select("doc_id", "source", "score", (F.col("score") > THRESHOLD).alias("cut"), "tail", "at_limit")


def truncation_rates(scored: DataFrame) -> DataFrame:
    """(source, records, cut_records, rate): how often each source truncates."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("cut").cast("bigint")).alias("cut_records"), F.avg(F.col("cut").cast("double")).alias("rate"))
