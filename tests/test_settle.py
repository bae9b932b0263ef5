import datetime as d

import pytest
from pyspark.sql import functions as F

from loomgraph.streaming import settle


def at(ms):
    return d.datetime(2026, 1, 1, tzinfo=d.timezone.utc) + d.timedelta(milliseconds=ms)


class Stream:
    """Batches of events, one after another, and all that has come out."""

    def __init__(self, spark, folder, **how):
        (folder / "in" / "b0").mkdir(parents=True)
        self.spark, self.folder, self.n, self.name = spark, folder, 0, "o" + folder.name.replace("-", "_")
        events = spark.readStream.schema(settle.EVENTS).option("maxFilesPerTrigger", 1).json(f"{folder}/in/*")
        out = settle.settling(events, **how)
        self.query = out.writeStream.format("memory").queryName(self.name).option("checkpointLocation", f"{folder}/cp").start()

    def put(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), settle.EVENTS).coalesce(1).write.json(f"{self.folder}/in/b{self.n}")
        self.query.processAllAvailable()
        return self.out()

    def out(self):
        return {(r["project"], r["event"], r["epoch"], tuple(r["paths"])) for r in self.spark.table(self.name).collect()}

    def count(self):
        return self.spark.table(self.name).count()


def change(project, path, ms):
    return (project, "change", path, None, at(ms))


def built(project, epoch, ms):
    return (project, "built", None, epoch, at(ms))


@pytest.fixture
def stream(spark, tmp_path):
    open_ = []

    def start(**how):
        open_.append(Stream(spark, tmp_path, **how))
        return open_[-1]

    yield start
    for s in open_:
        s.query.stop()


def test_one_candidate_after_quiet_and_stability(spark, stream):
    s = stream(delay="100 milliseconds")
    s.put(change("p", "a", 0), change("p", "b", 100), change("q", "x", 0))
    # late, but within the watermark, and overlapping
    assert s.put(change("p", "c", 90), change("p", "a", 200)) == set()
    # 449 ms of the stream's time: p has been quiet since 200 for less than 250
    assert not any(r[0] == "p" for r in s.put(change("z", "t", 549)))
    # beyond quiet and stability of both: once each, with the last change
    want = {("p", "settled", 4, ("a", "b", "c")), ("q", "settled", 1, ("x",))}
    assert want <= s.put(change("z", "t", 2000)) and want <= s.put(change("z", "t", 4000))
    rows = s.spark.table(s.name).where("project = 'p'").collect()
    assert len(rows) == 1
    first, last = spark.table(s.name).where("project = 'p'").select(F.unix_millis("first"), F.unix_millis("last")).first()
    assert last - first == 200


def test_a_build_of_an_old_epoch_is_dropped(stream):
    s = stream(delay="0 milliseconds")
    s.put(change("p", "a", 0))
    s.put(change("z", "t", 5000))
    assert ("p", "settled", 1, ("a",)) in s.put(change("z", "t", 6000))
    # a change comes while epoch 1 is being built: its build is stale, and both paths wait
    assert ("p", "stale", 1, ()) in s.put(change("p", "b", 6100), built("p", 1, 6100))
    s.put(change("z", "t", 8000))
    assert ("p", "settled", 2, ("a", "b")) in s.put(change("z", "t", 9000))
    out = s.put(built("p", 2, 9100))
    assert ("p", "published", 2, ("a", "b")) in out
    # what is published waits no more
    s.put(change("p", "c", 9200))
    s.put(change("z", "t", 11000))
    assert ("p", "settled", 3, ("c",)) in s.put(change("z", "t", 12000))
    assert ("p", "stale", 2, ()) in s.put(built("p", 2, 12100))


def test_a_change_within_the_stability_time_starts_anew(stream):
    s = stream(delay="0 milliseconds", quiet=250, stability=1000)
    s.put(change("p", "a", 0))
    s.put(change("z", "t", 300))  # quiet is over, stability is not
    s.put(change("p", "b", 310))
    assert not any(r[0] == "p" for r in s.put(change("z", "t", 1300)))
    s.put(change("z", "t", 2000))
    assert ("p", "settled", 2, ("a", "b")) in s.put(change("z", "t", 4000))


def test_by_the_clock(stream):
    import time

    s = stream(by_clock=True, quiet=50, stability=0)
    # batches go on by themselves, since timers may fire at any time: never wait for all of them
    s.spark.createDataFrame([change("p", "a", 0)], settle.EVENTS).coalesce(1).write.json(f"{s.folder}/in/b1")
    end = time.time() + 90
    while not s.out() and time.time() < end:
        time.sleep(0.5)
    assert s.out() == {("p", "settled", 1, ("a",))}
