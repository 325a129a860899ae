"""Streams of citations: messages that share a group's state."""

from pyspark.sql import functions as F

from passagekit.streaming import citations as C


def test_neighbouring_messages_share_a_group(spark, tmp_path):
    """Groups are few, and each message keeps its own order, ends, repeats and null id; nulls come back as one message."""
    said = "as [1] and (2, 9) x"
    parts = [said[i : i + 4] for i in range(0, len(said), 4)]
    rows = [(m, p, d, p == len(parts) - 1, [1, 2]) for m in [*range(300), -1, None] for p, d in enumerate(parts)]
    late = [r for r in reversed(rows)] + rows[:200]
    df = spark.createDataFrame(late, "message_id long, pos long, delta string, last boolean, known array<int>")
    for lo in range(0, len(late), 600):
        spark.createDataFrame(late[lo : lo + 600], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = C.drain(C.parse_stream(stream), str(tmp_path))
    told = out.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "content"))).alias("e")).collect()
    assert len(told) == 302
    for r in told:
        assert [x.ord for x in r.e] == list(range(len(r.e)))
        assert [x.content for x in r.e if x.kind == "citation"] == ["1", "2"]
        assert "".join(x.content for x in r.e if x.kind == "text") == "as  and 9 x"
    states = spark.read.format("statestore").load(f"{tmp_path}/checkpoint")
    assert states.count() == 5  # before: one for each message
    assert C.kept_messages(spark, f"{tmp_path}/checkpoint").distinct().count() == 302
