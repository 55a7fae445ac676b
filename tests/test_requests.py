"""The request queue as a stream, against a replay of the log."""

import datetime as dt


from tessera.plans import QUERIES
from tessera.streaming import requests, runs

MIN = dt.timedelta(minutes=1)


def replay(events, end):
    """(queue, request, asked, outcome, at) of (queue, request, kind, time), until the watermark ``end``."""
    out, queues = [], {}
    for queue, request, kind, at in sorted(events, key=lambda e: (e[3], e[1])):
        q = queues.setdefault(queue, {"table": [], "last": None})
        late(q, queue, at, out)
        live = [r for r in q["table"] if r["status"] in ("pending", "running")]
        if kind == "request":
            if q["last"] is not None and q["last"] > at - 10 * MIN:
                out.append((queue, request, at, "rate_limited", at))
            elif live:
                out.append((queue, request, at, "already_running", at))
            else:
                q["table"].append({"id": request, "asked": at, "status": "pending", "since": at})
                q["last"] = at
        elif kind == "claim":
            fresh = [r for r in live if r["status"] == "pending" and r["asked"] > at - 15 * MIN]
            if fresh:
                fresh[0].update(status="running", since=at)
        else:
            for r in live:
                if r["status"] == "running":
                    r["status"] = "done"
                    out.append((queue, r["id"], r["asked"], "completed", at))
    for queue, q in queues.items():
        late(q, queue, end + dt.timedelta(microseconds=1), out)
    return sorted(out)


def late(q, queue, now, out):
    for r in q["table"]:
        limit = {"pending": 20 * MIN, "running": 180 * MIN}.get(r["status"])
        if limit and r["since"] + limit < now:
            out.append((queue, r["id"], r["asked"], f"expired_{r['status']}", r["since"] + limit))
            r["status"] = "failed"


def test_request_states_equal_a_replay(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").collect()
    kinds = {"click": "request", "signup": "request", "view": "claim"}
    events = [(r.user_id % 2, r.event_id, kinds.get(r.event_type, "complete"), r.ts) for r in rows]
    got = sorted((r.queue, r.request_id, r.requested_at, r.outcome, r.at) for r in QUERIES["request_states"](spark, sf).collect())
    assert got == replay(events, max(e[3] for e in events) - dt.timedelta(hours=1))
    assert {"expired_pending", "completed", "already_running"} <= {g[3] for g in got}


def test_several_batches_and_dropped_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    batches = [
        [(1, 1, "request", 0), (1, 2, "request", 5), (2, 9, "request", 1), (1, 3, "claim", 6)],
        [(1, 4, "request", 12), (1, 5, "complete", 30), (1, 6, "request", 31), (1, 7, "claim", 47), (3, 10, "request", 40), (3, 11, "claim", 41)],
        [(2, 12, "request", 600), (9, 13, "request", 2000)],
    ]
    schema, done = "queue int, request_id long, kind string, ts timestamp", []
    for i, batch in enumerate(batches):
        done += [(q, r, k, start + m * MIN) for q, r, k, m in batch]
        spark.createDataFrame([(q, r, k, start + m * MIN) for q, r, k, m in batch], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = sorted((r.queue, r.request_id, r.requested_at, r.outcome, r.at) for r in runs.drain(requests.request_states(stream, "0 seconds"), "append").collect())
    assert got == replay(done, start + 2000 * MIN)
    assert [(g[1], g[3]) for g in got] == [(1, "completed"), (2, "rate_limited"), (4, "already_running"), (6, "expired_pending"), (9, "expired_pending"), (12, "expired_pending"), (10, "expired_running")]


def test_state_is_no_larger_than_the_open_requests():
    state, accepted, ended = requests.step(None, None, "request", 1, 0)
    assert (state, accepted, ended) == (("pending", 1, 0, 0), 0, [])
    assert requests.step(state, accepted, "complete", 2, 1) == (state, 0, [])
    hour = 3600 * 10**6
    assert requests.step(state, accepted, "claim", 2, hour) == (None, 0, [(1, 0, "expired_pending", 20 * 60 * 10**6)])
