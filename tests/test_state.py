"""Conversations replayed in shuffled batches, over a restart, give the batch's result."""

from pyspark.sql import functions as F

from orrery.streaming import conversations


def test_shuffled_batches_and_a_restart(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").limit(120).withColumn("k", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)))
    turns = spark.createDataFrame(turns.collect(), turns.schema)
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))

    def arrive(*parts):
        for k in parts:
            turns.filter(F.col("k") == k).drop("k").coalesce(1).write.mode("append").json(src)

    def run():
        stream = spark.readStream.schema("conv_id long, turn long, role string, text string").option("maxFilesPerTrigger", 1).json(src)
        conversations.replay(stream, out, mark)

    arrive(0, 1)
    run()
    arrive(2, 3, 1)  # the second part arrives again
    run()
    run()  # nothing is new
    got = {r.conv_id: (r.n_turns, r.n_chars, r.first_turn, r.last_turn, r.roles) for r in conversations.latest(spark.read.parquet(out)).collect()}
    want = turns.groupBy("conv_id").agg(F.countDistinct("turn"), F.sum(F.length("text")), F.min("turn"), F.max("turn"), F.array_join(F.array_sort(F.collect_set("role")), ","))
    assert got == {r[0]: tuple(r)[1:] for r in want.collect()} and len(got) > 5
    batches = {r.batch for r in spark.read.parquet(out).select("batch").distinct().collect()}
    assert len(batches) >= 3


def test_idle_conversations_close(spark, tmp_path):
    import time

    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(1, 0, "user", "abc"), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 1, None, None)], schema).coalesce(1).write.json(src)
    stream = conversations.started(spark.readStream.schema(schema).json(src), out, mark, idle=500, processingTime="500 milliseconds")
    rows, until = [], time.time() + 60
    while len(rows) < 4 and time.time() < until:
        time.sleep(1)
        rows = sorted((r.conv_id, r.closed, r.n_turns, r.n_chars, r.roles) for r in spark.read.schema(f"{conversations.RESULT}, batch long").parquet(out).collect())
    stream.stop()
    assert rows == [(1, False, 1, 3, "user"), (1, True, 1, 3, "user"), (3, False, 1, 0, ""), (3, True, 1, 0, "")]
