"""Reviews in any order against the plain fold of each key's history."""

import random

WAITS = [600_000, *(d * 86_400_000 for d in (1, 3, 7, 16, 35, 90))]


def fold(reviews):
    out = {}
    for user, entry, at, _, right in sorted(reviews, key=lambda r: r[2:4]):
        r, w, box, _ = out.get((user, entry), (0, 0, 0, 0))
        box = min(6, box + 1) if right else 0
        out[user, entry] = (r + right, w + (not right), box, at + WAITS[box])
    return out


def sample(n=3000, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(9), rng.choice("ab"), (1 + rng.randrange(500)) * 1000, i, rng.random() < 0.8) for i in range(n)]


SCHEMA = "user long, entry string, at long, event_id long, right boolean"


def test_states_merge_in_any_order(spark):
    from almanack.streaming.progress import boxes, merge_review_states, review_states

    reviews = sample()
    random.Random(2).shuffle(reviews)
    parts = [spark.createDataFrame(reviews[i::4], SCHEMA) for i in range(4)]
    states = [review_states(p) for p in parts]
    want = fold(reviews)
    pairs = merge_review_states(merge_review_states(states[3], states[1]), merge_review_states(states[0], states[2]))
    for merged in (merge_review_states(*states), pairs, review_states(spark.createDataFrame(reviews, SCHEMA))):
        assert {(r.user, r.entry): (r.right_n, r.wrong_n, r.box, r.due) for r in boxes(merged).collect()} == want


def test_a_late_wrong_answer_keeps_the_rights_after_it(spark):
    from almanack.streaming.progress import boxes, merge_review_states, review_states

    early = [(1, "a", t, t, True) for t in (10, 30, 40)]
    late = [(1, "a", 20, 20, False)]
    state = lambda rows: review_states(spark.createDataFrame(rows, SCHEMA))
    assert [r.box for r in boxes(merge_review_states(state(early), state(late))).collect()] == [2]
    assert boxes(state([])).count() == 0


def test_stream_over_shuffled_files_and_timers(spark, tmp_path):
    from almanack.streaming.progress import boxes, review_notices, stream_reviews
    from pyspark.sql import functions as F

    reviews = sample(400, 3)
    random.Random(4).shuffle(reviews)
    for i in range(4):
        spark.createDataFrame(reviews[i::4], SCHEMA).withColumn("ts", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = SCHEMA + ", ts timestamp"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_reviews(read().drop("ts"), f"{tmp_path}/states", f"{tmp_path}/a").awaitTermination()
    got = boxes(spark.read.parquet(f"{tmp_path}/states/3"))
    assert {(r.user, r.entry): (r.right_n, r.wrong_n, r.box, r.due) for r in got.collect()} == fold(reviews)

    clock = [(-1, "clock", 0, -1, True)]
    spark.createDataFrame(clock, SCHEMA).withColumn("ts", F.timestamp_millis(F.lit(100 * 86_400_000 + 500_000))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        review_notices(read()).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/b").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(setting)
    due = [((r.user, r.entry), (r.right_n, r.wrong_n, r.box, r.due)) for r in spark.read.parquet(f"{tmp_path}/out").where("what = 'due' AND user >= 0").collect()]
    want = {k: v for k, v in fold(reviews).items() if v[3] <= 40 * 86_400_000 + 500_000}
    assert len(due) == len(dict(due)) and dict(due) == want and 0 < len(want)
