"""Token ids, mixing and cut texts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, truncation

TEXTS = [None, "", " ", "Hello world", "<|endoftext|> is text", "a" * 5000, " " * 300, "naïve – 日本語テキスト🙏🏽", "tabs\t\tand\r\nlines  end ", "lowlowlow\x00\x07", "it's we'll I'D 12345 67,8", "​﻿"]


def reference():
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids if x else []


def test_ids(spark):
    ref = reference()
    random.seed(1)
    texts = TEXTS + ["".join(random.choice("ab cde\n  éλ日<|>of12!?'s") for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df).collect()}
    assert got == {i: ref(t) for i, t in enumerate(texts)}
    n = {r.doc_id: r.tokens for r in bpe.count_tokens(df, ["doc_id"]).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert bpe.encode_texts(df.limit(0)).count() == 0


def test_borders_match_merging():
    """Two tokens stay apart exactly if the tokenizer gives them back for their joined bytes."""
    ref = reference()
    e = bpe.Encoder()
    words = [w.decode() for w in list(e.ids) if w.isalpha() and w.isascii()]
    random.seed(4)
    for _ in range(500):
        a, b = random.choice(words), random.choice(words)
        assert e.borders_hold(e.ids[a.encode()], e.ids[b.encode()]) == (ref(a + b) == [e.ids[a.encode()], e.ids[b.encode()]])


def test_every_entry_is_reached():
    """Each entry of the vocabulary comes out of the dynamic programming as itself alone."""
    e = bpe.Encoder()
    assert len(e.ids) > 50_000 and all(e.by_prefixes(raw) == [i] for raw, i in e.ids.items())


def docs(n=400):
    random.seed(9)
    subj, verb, tail = ["The spread", "My broker", "This tool", "The alert panel", "Our desk"], ["held up", "froze", "dropped", "works", "opened three trades"], ["during the London open", "after the last update", "on a demo account", "within an hour", "for no visible reason"]
    line = lambda: f"{random.choice(subj)} {random.choice(verb)} {random.choice(tail)}"
    out = []
    for i in range(n):
        text = ". ".join(line() for _ in range(random.randrange(2, 9))) + random.choice([".", ".", ".", "", "!"])
        out.append([i, text, random.choice(["a", "a", "a", "b"]), False])
    for r in out:
        if r[2] == "b" and len(r[1]) > 120:
            r[1], r[3] = r[1][:120], not r[1][:120].endswith((".", "!"))
    return out


def test_cut(spark):
    rows = docs() + [[9001, None, "a", False], [9002, "", None, False], [9003, "   ", "b", False]]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, source string").withColumn("score", F.lit(1))
    scored = truncation.score_texts(df)
    got = {r.doc_id for r in scored.where("cut").collect()}
    want = {r[0] for r in rows if r[3]}
    # cuts that fall on the end of a full phrase cannot be told from a missing full stop
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got)
    rates = {r.source: r.records for r in truncation.truncation_rates(scored).collect()}
    assert sum(rates.values()) == len(rows)
    assert truncation.score_texts(df.limit(0)).count() == 0


def test_whole_texts_of_odd_endings(spark):
    """Set phrases, lone marks, grades and remarks after a full stop are no cuts; a text of one source counts once however often it is copied."""
    odd = ["-", ".", "Does the job", "Worth every pip"] + [r[1].rstrip(".!") + x for r, x in zip(docs(4), (". 10/10", ". (updated)", '. "enough said"', "."))]
    rows = [(r[0], ["It works. ", "Nice and quick. ", "Good value. ", ""][r[0] % 4] + r[1], r[2]) for r in docs()] + [(5000 + 10 * i + j, t, f"s{j}") for i, t in enumerate(odd) for j in range(8)] + [(8000 + i, "My terminal bui", "a") for i in range(30)]
    cut = {r.doc_id for r in truncation.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("cut").collect()}
    assert not {i for i in cut if 5000 <= i < 8000} and {8000, 8029} <= cut


def test_mix(spark):
    rows = [r[:3] for r in docs(600)] + [[9001, None, "b", ], [9002, "", "a"], [9003, "not wanted", "z"]]
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    plan, report = mixing.mix(df, targets)
    r = {x.source: x for x in report.collect()}
    assert abs(r["a"].actual_share - 0.5 / 0.9) < 0.02 and abs(r["b"].actual_share - 0.4 / 0.9) < 0.02 and r["gone"].used_tokens == 0
    p = {x.doc_id: x for x in plan.collect()}
    assert 9003 not in p and p[9001].repeats == 0 and max(x.repeats for x in p.values() if x.source == "b") <= 3 and max(x.repeats for x in p.values() if x.source == "a") <= 1


def test_mix_shares_follow_tokens(spark):
    """A source of a few records is met by tokens; records without source are not used; the whole is exact to 0.01 where it can be."""
    rows = [tuple(r[:3]) for r in docs(900)] + [(9100 + i, "short one of the few " * (i + 1), "tiny") for i in range(4)] + [(9200, "no source", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.58, 1), ("b", 0.4, 3), ("tiny", 0.02, 5)], "source string, target_share double, max_repeats int")
    plan, report = mixing.mix(df, targets)
    for r in report.collect():
        assert abs(r.actual_share - r.target_share) < 0.01, r
    tokens = {r.doc_id: r.tokens for r in bpe.count_tokens(df, ["doc_id"]).collect()}
    got = plan.collect()
    assert sum(r.repeats * tokens[r.doc_id] for r in got) == sum(r.used_tokens for r in report.collect())
    assert 9200 not in {r.doc_id for r in got} and all(0 <= r.repeats <= {"a": 1, "b": 3, "tiny": 5}[r.source] for r in got)
    none = mixing.mix(df.limit(0), targets)[1].collect()
    assert [r.used_tokens for r in none] == [0, 0, 0] and all(r.actual_share is None for r in none)


def test_posteriors_decide_the_mix(spark, monkeypatch):
    """Within a source the fit takes more of the records that look like the domain the mix is short of; with flat posteriors the plan is another."""
    random.seed(3)
    gold, oil = ["gold", "silver", "metal", "ounce"], ["oil", "barrel", "crude", "tanker"]
    line = lambda w: " ".join(random.choice(w) for _ in range(random.randrange(8, 16)))
    rows = [(i, line(gold if i % 5 else oil), "gold") for i in range(300)] + [(1000 + i, line(oil), "oil") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("gold", 0.5, 1), ("oil", 0.5, 1)], "source string, target_share double, max_repeats int")
    used = lambda: {r.doc_id: r.repeats for r in mixing.mix(df, targets)[0].collect()}
    told = used()
    share = lambda p, odd: sum(p[i] for i in range(300) if (i % 5 == 0) == odd) / sum((i % 5 == 0) == odd for i in range(300))
    assert share(told, True) > 1.5 * share(told, False)
    flat = mixing.posteriors
    monkeypatch.setattr(mixing, "posteriors", lambda *a: flat(*a).withColumn("post", F.array(F.lit(0.5), F.lit(0.5))))
    assert used() != told and abs(share(used(), True) - share(used(), False)) < 0.1
