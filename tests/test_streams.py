"""Streams with restarts, late events, expiry and batches that are run again."""

import itertools
import json
import random
from datetime import datetime, timedelta


from cadenza.streaming import joblog, store

BEGIN = datetime(2024, 1, 1)
EVENTS = "job long, at long, kind string, path string, state string, ts timestamp"


def event(job, at, kind="file", path="p", state="queued", minute=None):
    return job, at, kind, path, state, None if minute is None else BEGIN + timedelta(minutes=minute)


class Source:
    """A folder that a stream reads, a file a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, itertools.count()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/{next(self.n)}")

    def read(self):
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.folder)


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_log_survives_restarts(spark, tmp_path):
    """Every batch is a new run of the query from its checkpoint; numbers, files and closing go on."""
    source, log = Source(spark, tmp_path / "in", EVENTS), str(tmp_path / "log")
    batches = [
        [event(1, 0, path="a", minute=0), event(1, 1, path="a", state="done", minute=0), event(2, 0, path="x", minute=0)],
        [event(1, 2, path="a", state="error", minute=1), event(1, 3, path="b", state="done", minute=1), event(1, 4, path=None, state=None, minute=1), event(2, 1, path="x", state="cached")],
        [event(1, 6, kind="done", path=None, state="ok", minute=2), event(1, 5, path="c", state="skipped", minute=2)],
        [event(1, 7, path="d", state="done", minute=3), event(2, 2, path="y", state="done", minute=3)],
    ]
    for rows in batches:
        source.add(rows)
        drain(joblog.publish(joblog.fold(source.read()), log, str(tmp_path / "cp")))
    got = sorted((r.job, r.event_id, r.kind, r.path, r.finished, r.closed) for r in spark.read.schema(joblog.FOLDED).parquet(log).collect())
    assert got == [
        (1, 1, "file", "a", 0, False), (1, 2, "file", "a", 1, False), (1, 3, "file", "a", 1, False), (1, 4, "file", "b", 2, False), (1, 5, "file", None, 2, False),
        (1, 6, "file", "c", 3, False), (1, 7, "done", None, 3, True), (2, 1, "file", "x", 0, False), (2, 2, "file", "x", 1, False), (2, 3, "file", "y", 2, False),
    ]


def test_late_events_idle_jobs_and_expiry(spark, tmp_path):
    """Events behind the watermark are dropped; silent jobs are interrupted; closed ones are forgotten and may begin anew."""
    source, log = Source(spark, tmp_path / "in", EVENTS), str(tmp_path / "log")
    batches = [
        [event(1, 0, minute=0), event(2, 0, minute=0), event(2, 1, kind="done", minute=1)],
        [event(3, 0, minute=30)],  # the watermark is at 20: job 1 was silent for more than 10 minutes
        [event(1, 1, minute=31), event(2, 2, minute=31), event(4, 0, minute=5)],  # closed by its timer; closed; too late
        [event(3, 1, minute=200)],
        [event(3, 2, minute=201), event(2, 3, minute=201)],  # job 2 is long forgotten
    ]
    for rows in batches:
        source.add(rows)
        drain(joblog.publish(joblog.fold(source.read(), keep=3600, idle=600), log, str(tmp_path / "cp")))
    got = {}
    for r in spark.read.schema(joblog.FOLDED).parquet(log).collect():
        got.setdefault(r.job, []).append((r.event_id, r.kind, r.state))
    assert sorted(got[1]) == [(1, "file", "queued"), (2, "done", "interrupted")]
    assert sorted(got[2]) == [(1, "file", "queued"), (1, "file", "queued"), (2, "done", "queued")]
    assert 4 not in got and sorted(got[3])[0] == (1, "file", "queued")


def test_followers_get_each_event_once(spark, tmp_path):
    """What is stored comes first, what is published later after it, from each reader's own cursor, over restarts and a batch run twice."""
    source, log, out = Source(spark, tmp_path / "in", EVENTS), str(tmp_path / "log"), str(tmp_path / "out")
    cursors = spark.createDataFrame([("a", 1, 0), ("b", 1, 3), ("a", 2, 1)], "reader string, job long, cursor long")
    plan = [[event(j, k, path=f"p{k}", minute=0) for j in (1, 2, 3) for k in range(2)], [event(1, 2 + k, minute=1) for k in range(3)], [event(1, 9, kind="done", minute=2), event(2, 9, minute=2)]]
    for k, rows in enumerate(plan):
        source.add(rows)
        drain(joblog.publish(joblog.fold(source.read()), log, str(tmp_path / "cp1")))
        if k != 1:
            drain(joblog.follow(spark, log, cursors, out, str(tmp_path / "cp2")))
    # the last batch was sent, but its commit is lost: it is run again
    commits = sorted((tmp_path / "cp2" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for path in (commits[-1], commits[-1].parent / f".{commits[-1].name}.crc"):
        path.unlink(missing_ok=True)
    drain(joblog.follow(spark, log, cursors, out, str(tmp_path / "cp2")))
    frames = spark.read.parquet(out).collect()
    got = sorted((r.reader, r.job, r.event_id) for r in frames)
    assert got == [("a", 1, k) for k in range(1, 7)] + [("a", 2, k) for k in (2, 3)] + [("b", 1, k) for k in (4, 5, 6)]
    first = min((r for r in frames if r.reader == "b"), key=lambda r: r.event_id).frame
    assert first.startswith("id: 4\ndata: {") and first.endswith("}\n\n")
    assert json.loads(first.split("data: ")[1])["kind"] == "file"


SHOT = ["job", "seq", "status", "active", "terminal", "created_at", "updated_at", "completed_at", "latest_event_id", "payload", "items", "events"]


def shot(job, seq, status="running", terminal=False, files=(), events=(), cursor=0, completed=None, created=None):
    at = BEGIN + timedelta(seconds=seq)
    return job, seq, status, not terminal, terminal, created or at, at, completed, cursor, f"s{seq}", [(p, s, 50) for p, s in files], [(k, at, b) for k, b in events]


def plain_store(shots, most):
    """The store by jobs, one snapshot after the other."""
    out = {}
    for row in shots:
        s = dict(zip(SHOT, row))
        old = out.get(s["job"], {"created_at": None, "completed_at": None, "latest_event_id": 0, "events": {}})
        events = old["events"] | {e[0]: e for e in s["events"]}
        ended = s["terminal"]
        out[s["job"]] = s | {
            "created_at": old["created_at"] or s["created_at"], "completed_at": (s["completed_at"] or old["completed_at"] or s["updated_at"]) if ended else None, "active": s["active"] and not ended,
            "latest_event_id": max(s["latest_event_id"], old["latest_event_id"], *events, 0), "events": dict(sorted(events.items())[-most:]),
        }
    return out


def test_store_of_snapshots(spark, tmp_path):
    """Batches of snapshots by job, one of them run twice and one broken off before its folders were replaced."""
    r = random.Random(3)
    shots = [shot(r.randrange(12), k, r.choice(["running", "ok"]), r.random() < 0.3, [(f"p{i}", r.choice(["done", "queued"])) for i in range(r.randrange(4))], [(r.randrange(1, 40), f"e{k}") for _ in range(r.randrange(5))], r.randrange(30), r.choice([None, None, BEGIN - timedelta(days=k)])) for k in range(90)]
    path = str(tmp_path / "store")
    parts = [shots[:20], shots[20:21], [], shots[21:70], shots[70:]]
    for number, part in enumerate(parts):
        df = spark.createDataFrame(part, store.SNAPSHOT)
        store.save(df, number, path, 4)
        if number == 1:
            store.save(df, number, path, 4)  # run again as a whole
        if number == 3:  # staged, but a folder was not replaced: as after a crash
            victim = next((tmp_path / "store" / "jobs").glob("bucket=*"))
            for f in victim.glob("*"):
                f.unlink()
            store.save(df, number, path, 4)
    want = plain_store(shots, 2000)
    got = {x.job: x for x in store.read(spark, path).collect()}
    assert set(got) == set(want)
    for job, w in want.items():
        g = got[job]
        assert (g.status, g.active, g.terminal, g.created_at, g.updated_at, g.latest_event_id, g.payload) == (w["status"], w["active"], w["terminal"], w["created_at"], w["updated_at"], w["latest_event_id"], w["payload"]), job
        assert [(i.path, i.state) for i in g["items"]] == [(p, s) for p, s, _ in w["items"]]
        assert [(e.event_id, e.body) for e in g.events] == [(e[0], e[2]) for e in w["events"].values()]
        assert g.completed_at == w["completed_at"], job


def test_store_keeps_the_newest_events(spark):
    stored = spark.createDataFrame([shot(1, 0, events=[(k, "old") for k in range(1, 6)])], store.SNAPSHOT).drop("seq")
    new = spark.createDataFrame([shot(1, 1, terminal=True, events=[(5, "new"), (9, "x")], completed=BEGIN), shot(None, 1)][:1], store.SNAPSHOT)
    got = store.merged(stored, new, most_events=3).first()
    assert [(e.event_id, e.body) for e in got.events] == [(4, "old"), (5, "new"), (9, "x")]
    assert got.latest_event_id == 9 and got.completed_at == BEGIN and not got.active
    assert store.merged(spark.createDataFrame([], store.STORED), spark.createDataFrame([], store.SNAPSHOT)).collect() == []


def test_store_as_a_sink(spark, tmp_path):
    """A stream of snapshots that is stopped and goes on from its checkpoint; only touched folders change."""
    source, path = Source(spark, tmp_path / "in", store.SNAPSHOT), str(tmp_path / "store")
    source.add([shot(k, 0) for k in range(20)])
    drain(store.upsert(source.read(), path, str(tmp_path / "cp"), 8))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "jobs").glob("bucket=*/*.parquet")}
    source.add([shot(3, 1, "ok", True)])
    drain(store.upsert(source.read(), path, str(tmp_path / "cp"), 8))
    after = set((tmp_path / "store" / "jobs").glob("bucket=*/*.parquet"))
    assert len({p.parent for p in set(before) - after}) == 1
    got = {x.job: x.status for x in store.read(spark, path).collect()}
    assert got == {k: "ok" if k == 3 else "running" for k in range(20)}


def test_polls_give_entries_once(spark, tmp_path):
    """A poll repeats what the polls before it had; older generations and other operations are left out."""
    schema = "operation string, generation long, log_id long, message string, ts timestamp"
    at = lambda m: BEGIN + timedelta(minutes=m)
    source = Source(spark, tmp_path / "in", schema)
    expected = spark.createDataFrame([("load", 4)], "operation string, baseline long")
    for rows in ([("load", 4, 1, "old", at(0)), ("load", 5, 1, "a", at(0)), ("other", 9, 1, "x", at(0))], [("load", 5, 1, "a", at(1)), ("load", 5, 2, "b", at(1))], [("load", 6, 2, "b", at(2)), ("load", 6, 3, "c", at(2))]):
        source.add(rows)
        drain(joblog.new_entries(source.read(), expected).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
    assert sorted((r.log_id, r.message) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b"), (3, "c")]


