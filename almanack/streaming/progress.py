"""Per-user progress: spaced repetition as a fold, and last-writer-wins merging."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed list: the wait in each box, in milliseconds: 10 minutes, then 1, 3, 7, 16, 35 and 90 days.
WAITS = [600_000, *(d * 86_400_000 for d in (1, 3, 7, 16, 35, 90))]


def fold_reviews(reviews: DataFrame) -> DataFrame:
    """(user, entry, right_n, wrong_n, box, at, due) after all reviews (user, entry, at, event_id, right), in order.

    A right answer moves up a box, to the last at most; a wrong one to box 0. Since the last wrong
    answer decides, it is two sums: no history of a key is gathered.
    """
    key = ["user", "entry"]
    order = F.struct("at", "event_id")
    wrong = reviews.where(~F.col("right")).groupBy(*key).agg(F.max(order).alias("_last"))
    marked = reviews.join(wrong, key, "left").withColumn("_since", F.col("right") & (F.col("_last").isNull() | (order > F.col("_last"))))
    state = marked.groupBy(*key).agg(
        F.count_if("right").alias("right_n"), F.count_if(~F.col("right")).alias("wrong_n"), F.least(F.lit(6), F.count_if("_since")).cast("int").alias("box"), F.max("at").alias("at")
    )
    return state.withColumn("due", F.col("at") + F.element_at(F.array(*[F.lit(w) for w in WAITS]), F.col("box") + 1))


def merge_latest(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(key, at, side): the later record of each key; on a tie the local one stays."""
    both = local.select("key", F.col("at").alias("_l")).join(remote.select("key", F.col("at").alias("_r")), "key", "full")
    wins = F.col("_r") > F.coalesce("_l", F.lit(-1))
    return both.select("key", F.when(wins, F.col("_r")).otherwise(F.col("_l")).alias("at"), F.when(wins, "remote").otherwise("local").alias("side"))


#: Rights after the last wrong answer beyond this many change nothing: the last box is the sixth.
TOP = len(WAITS) - 1


def review_states(reviews: DataFrame) -> DataFrame:
    """Mergeable states (user, entry, right_n, wrong_n, wrong, rights, at) of reviews (user, entry, at, event_id, right).

    wrong is the last wrong answer, rights the six latest right ones, each as (at, event_id). That is all a box
    depends on, in whatever order reviews come to be known: a right answer older than six others can't count,
    and one that a late wrong answer cancels is still there to be compared. Top-k windows are cut in each task.
    """
    key, order = ["user", "entry"], F.struct("at", "event_id")
    latest = Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("event_id"))
    rights = reviews.where("right").withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= TOP).groupBy(*key).agg(F.collect_list(order).alias("rights"))
    sums = reviews.groupBy(*key).agg(F.count_if("right").alias("right_n"), F.count_if(~F.col("right")).alias("wrong_n"), F.max(F.when(~F.col("right"), order)).alias("wrong"), F.max("at").alias("at"))
    none = F.array().cast(dict(rights.dtypes)["rights"])
    return sums.join(rights, key, "left").select(*key, "right_n", "wrong_n", "wrong", F.coalesce("rights", none).alias("rights"), "at")


def merge_review_states(*states: DataFrame) -> DataFrame:
    """The states of all reviews that went into any of states, each review into one of them; order and number don't matter."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("user", "entry").agg(
        F.sum("right_n").alias("right_n"), F.sum("wrong_n").alias("wrong_n"), F.max("wrong").alias("wrong"),
        F.slice(F.sort_array(F.flatten(F.collect_list("rights")), False), 1, TOP).alias("rights"), F.max("at").alias("at"),
    )


def boxes(states: DataFrame) -> DataFrame:
    """(user, entry, right_n, wrong_n, box, at, due) of mergeable states: as many boxes up as rights came after the last wrong answer."""
    since = F.when(F.col("wrong").isNull(), F.size("rights")).otherwise(F.size(F.filter("rights", lambda r: r > F.col("wrong"))))
    out = states.withColumn("box", since.cast("int"))
    return out.select("user", "entry", "right_n", "wrong_n", "box", "at", (F.col("at") + F.element_at(F.array(*map(F.lit, WAITS)), F.col("box") + 1)).alias("due"))


def stream_reviews(reviews: DataFrame, path: str, checkpoint: str):
    """Start a stream that folds review batches (user, entry, at, event_id, right) into mergeable states under path/<batch>.

    Reviews may come in any order and however late: see review_states. Each batch is folded by itself and merged with the
    states of the batch before, so its cost is that of the states and of its own reviews, however many there were. A batch
    that is run again reads the same states and writes its folder again, with the same result. Two states before the last
    are deleted.
    """
    from almanack.sources.store import delete, exists

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = review_states(batch)
        if number and exists(spark, f"{path}/{number - 1}"):
            state = merge_review_states(spark.read.parquet(f"{path}/{number - 1}"), state)
        state.write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            delete(spark, f"{path}/{number - 2}")

    return reviews.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_NOTICE = Row("user", "entry", "what", "right_n", "wrong_n", "box", "at", "due")


def _box(line: list) -> int:
    return sum(r > line[2] for r in line[3])


def _notice(key: tuple, entry, what: str, line: list) -> Row:
    return _NOTICE(*key, entry, what, line[0], line[1], _box(line), line[4], line[5])


class _Reviewer(StatefulProcessor):
    """Keyed state of one user, with a line for each entry: counts, the last wrong answer, the six latest rights, when it is due and for which time
    a notice was sent; one timer, at the first due time without a notice. Each call to the state store costs as much as folding
    many reviews, so all that a batch brings for a user is one read and one write."""

    def __init__(self, entry: str) -> None:
        self.schema = f"entries array<struct<entry: {entry}, right_n: long, wrong_n: long, wrong_at: long, wrong_id: long, rights: array<struct<at: long, id: long>>, at: long, due: long, sent: long>>, timer long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        lines, timer = self._read()
        met = {}
        for r in rows:
            line = met.get(r.entry)
            if line is None:
                line = met[r.entry] = lines.setdefault(r.entry, [0, 0, (-1, -1), [], -1, -1, -1])
            time = (r.at, r.event_id)
            line[4] = max(line[4], r.at)
            if not r.right:
                line[1], line[2] = line[1] + 1, max(line[2], time)
                continue
            line[0] += 1
            line[3].append(time)
            if len(line[3]) > 4 * TOP:
                line[3] = heapq.nlargest(TOP, line[3])
        for line in met.values():
            line[3] = heapq.nlargest(TOP, line[3])
            line[5] = line[4] + WAITS[_box(line)]
        self._write(lines, timer)
        for entry, line in met.items():
            yield _notice(key, entry, "answered", line)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        lines, timer = self._read()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        passed = {entry: line for entry, line in lines.items() if line[6] != line[5] <= now}
        for line in passed.values():
            line[6] = line[5]
        self._write(lines, None)  # the timer at hand goes by itself
        for entry, line in passed.items():
            yield _notice(key, entry, "due", line)

    def _read(self):
        kept = self.state.get()
        if not kept:
            return {}, None
        return {e: [right_n, wrong_n, (a, i), [tuple(r) for r in rights], at, due, sent] for e, right_n, wrong_n, a, i, rights, at, due, sent in kept[0]}, kept[1]

    def _write(self, lines, timer) -> None:
        first = min((line[5] for line in lines.values() if line[5] != line[6]), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.state.update(([(e, right_n, wrong_n, *wrong, rights, at, due, sent) for e, (right_n, wrong_n, wrong, rights, at, due, sent) in lines.items()], first))

    def close(self) -> None:
        pass


def review_notices(reviews: DataFrame, late: str = "60 days") -> DataFrame:
    """A stream of notices (user, entry, what, right_n, wrong_n, box, at, due) of a stream of reviews (user, entry, at, event_id, right, ts).

    `answered`: the state after what a batch brought for a key, in any order of arrival up to `late` behind the latest ts.
    `due`: event time has passed the key's due time, and nothing has moved it meanwhile; sent once for that time. State is
    bounded for each user and entry. Needs the RocksDB state store.
    """
    kinds = dict(reviews.dtypes)
    schema = f"user {kinds['user']}, entry {kinds['entry']}, what string, right_n long, wrong_n long, box int, at long, due long"
    return reviews.withWatermark("ts", late).groupBy("user").transformWithState(_Reviewer(kinds["entry"]), schema, "Append", "eventTime")


def merge_records(local: DataFrame, remote: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, to push) of records (id, at, topics) of two sides: the later of each id wins, a tie stays local, topics are those of
    both, in order of the winner's first; ids move along aliases (src, dst). To push: what the other side hasn't, or has older."""
    from almanack.operators.lookup import rewrite_keys

    moved = rewrite_keys(remote, aliases, "id", F.desc("at"))
    r = moved.select("id", F.col("at").alias("_at"), F.col("topics").alias("_topics"))
    both = local.join(r, "id", "full")
    wins = F.col("at").isNull() | (F.col("_at") > F.col("at"))
    none = F.array().cast(dict(local.dtypes)["topics"])
    mine, theirs = F.coalesce("topics", none), F.coalesce("_topics", none)
    merged = both.select("id", F.when(wins, F.col("_at")).otherwise(F.col("at")).alias("at"), F.when(wins, F.array_union(theirs, mine)).otherwise(mine).alias("topics"), "_at")
    return merged.drop("_at"), merged.where(F.col("_at").isNull() | (F.col("at") > F.col("_at"))).drop("_at")


# jobs --------------------------------------------------------------------------------------------------------


def unfinished(jobs: DataFrame, log: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """jobs (id, ...) that no log of done ones has, and that were never refused."""
    out = jobs.join(log.select("id").distinct(), "id", "left_anti")
    return out if refused is None else out.join(refused.select("id").distinct(), "id", "left_anti")


def stale_caches(caches: DataFrame, files: DataFrame) -> DataFrame:
    """(name, stale) of caches (name, newest, n_files) against the files (name, modified) they were made from: a newer file, or another number."""
    now = files.groupBy("name").agg(F.max("modified").alias("m"), F.count("*").alias("c"))
    joined = caches.join(now, "name", "left")
    return joined.select("name", (~F.coalesce((F.col("m") == F.col("newest")) & (F.col("c") == F.col("n_files")), F.lit(False))).alias("stale"))


def push_pages(rows: DataFrame, send, size: int = 500) -> DataFrame:
    """(id, sent) of rows after pages of at most `size` of them were given to send(list of ids); a page that fails is asked for again once, and
    its rows come back unsent for the next time."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                ids = pdf["id"].iloc[at : at + size].tolist()
                ok = bool(send(ids)) or bool(send(ids))
                yield pd.DataFrame({"id": ids, "sent": [ok] * len(ids)})

    return rows.select("id").mapInPandas(run, f"id {kind}, sent boolean")
