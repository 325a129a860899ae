"""The job automaton, batch and stream; trees of any depth; syllables of phrases."""

import json
import random

from pyspark.sql import functions as F

from passagekit.functions import cjk as H
from passagekit.functions.citations import tree_paths
from passagekit.streaming import jobs as J
from passagekit.streaming.citations import drain

EVENT = "job_id long, at long, event_id long, status string"


def test_steps():
    walk = ["queued", "downloading", "downloading", "queued", "transcribing", "transcribing", None, "failed", "processing", "queued", "processing", "processing", "done", "done", "queued", "odd"]
    state, told = ("", 0, 0), []
    for status in walk:
        ok, state = J.step(state, status)
        told.append((ok, state[1], state[2]))
    assert told == [
        (True, 0, 0), (True, 10, 0), (True, 10, 0), (False, 10, 0), (True, 25, 0), (True, 30, 0), (False, 30, 0), (True, 0, 0), (False, 0, 0), (True, 0, 1), (True, 40, 1), (True, 80, 1), (True, 100, 1),
        (False, 100, 1), (False, 100, 1), (False, 100, 1),
    ]


def test_batch_and_stream_are_one(spark, tmp_path):
    rng = random.Random(2)
    states = [*filter(None, J.NEXT), None, "odd"]
    rows = [(rng.randrange(12), at, at % 7, rng.choice(states)) for at in range(900)] + [(99, at, at, rng.choice(states)) for at in range(2000)]
    df = spark.createDataFrame(rows, EVENT)
    want = []
    for job in {r[0] for r in rows}:
        state = ("", 0, 0)
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: r[1:3]):
            ok, state = J.step(state, r[3])
            want.append((*r, ok, *state))
    got = J.transitions(df.union(spark.createDataFrame([(None, 1, 1, "queued")], EVENT)).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    for lo in range(0, 2000, 700):
        df.where(F.col("at").between(lo, lo + 699)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, drain(J.stream_transitions(stream), str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    assert J.transitions(df.limit(0)).count() == 0


def test_trees(spark):
    deep = '{"label":"x","children":[' * 500 + '{"label":"end"}' + "]}" * 500
    wide = json.dumps({"label": "r", "children": [{"label": str(i)} for i in range(3000)]})
    odd = '{"children":[{"label":null,"children":null},7,"no",{"label":3,"children":{}},[]]}'
    rows = [(1, deep), (2, wide), (3, odd), (4, None), (5, "no json"), (6, "[]"), (7, "{}"), (8, "[" * 200_000), (1, '{"label":"again"}')]
    got = tree_paths(spark.createDataFrame(rows, "id long, tree string"), "id", "tree").collect()
    own = lambda i: [(r.path, r.parent, r.label) for r in got if r.id == i]
    assert len(own(1)) == 502 and max(p.count(".") for p, _, _ in own(1)) == 500 and len(own(2)) == 3001
    assert own(3) == [("0", None, None), ("0.0", "0", None), ("0.3", "0", "3")]
    assert own(4) == own(5) == own(6) == own(8) == [] and own(7) == [("0", None, None)]


def test_the_longest_phrase_is_said_first(spark):
    one = F.create_map(*(F.lit(x) for x in ("重", "zhong", "庆", "qing", "要", "yao", "长", "chang")))
    phrases = F.create_map(F.lit("重庆"), F.array(F.lit("chong"), F.lit("qing")), F.lit("重庆长"), F.array(F.lit("chong"), F.lit("qing"), F.lit("zhang")))
    said = lambda t: spark.range(1).select(H.syllables_of(F.lit(t), one, phrases, 3).alias("x")).first().x
    assert said("重要") == ["zhong", "yao"] and said("重庆") == ["chong", "qing"] and said("重庆长要") == ["chong", "qing", "zhang", "yao"] and said("要重庆人") == ["yao", "chong", "qing", "人"]
    tokens = spark.range(1).select(H.syllable_tokens(F.lit("a 重 庆长 b 要"), one, phrases, 3).alias("x")).first().x
    assert tokens == ["chongqing", "qingzhang"]
