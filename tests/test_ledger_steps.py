"""The ledger over stored tables."""

import json

from pyspark.sql import functions as F

from eventloom.operators.ledger import load_results
from eventloom.streaming import ledger_steps as steps
from eventloom.streaming import pipelines as P

NOW = "2024-01-31 00:00:00"


def statuses(out, name, key):
    return {r[key]: r.status for r in out.table(name).read().collect()}


def test_events_go_through_batches_to_their_results(spark, tmp_path):
    out = P.Outputs(spark, str(tmp_path))
    events = out.table("sync_events")
    rows = spark.range(7).selectExpr(
        "'k' || id AS dedupe_key", "'s' AS stream_name", "timestamp_ntz '2024-01-30 00:00:00' + make_dt_interval(0, 0, 0, id) AS observed_at",
        "CASE WHEN id <> 6 THEN '{\"n\":' || id || '}' END AS payload", "'pending' AS status", "0 AS attempt_count",
        "timestamp_ntz '2024-01-30 00:00:00' AS updated_at",
    )
    events.append_new(P.typed(rows, events), ["observed_at"])
    options = {"max_rows": 2, "claim_limit": 4}
    steps.ledger_step(out, NOW, ["s"], **options)
    assert sorted(statuses(out, "sync_events", "dedupe_key").values()) == ["batched"] * 4 + ["pending"] * 3
    steps.ledger_step(out, NOW, ["s"], **options)  # again at the same time: the rest, in batches of their own
    steps.ledger_step(out, NOW, ["s"], **options)
    assert set(statuses(out, "sync_events", "dedupe_key").values()) == {"batched"}
    batches = {r.batch_id: r for r in out.table("sync_batches").read().collect()}
    members = {r.dedupe_key: r.batch_id for r in steps.members_table(out).read().collect()}
    assert len(batches) == 4 and set(members.values()) == set(batches)
    # the payload of a batch is the array of its events; k6 has none, so its batch cannot go out
    assert sorted(b.row_count for b in batches.values()) == [1, 2, 2, 2]
    assert batches[members["k6"]].status == "pending" and "no stored payload" in batches[members["k6"]].last_error
    sent = [json.loads(r.value) for r in out.sent("sync.load").collect()]
    assert {w["batch_id"] for w in sent} == set(batches) - {members["k6"]} and all(w["payload_ref"] for w in sent)
    assert statuses(out, "sync_jobs", "job_id") == {sent[0]["job_id"]: "running"}

    def results(*outcomes):
        loads = [("j", b, "proxy.events", "p", 2, text, kind) for b, text, kind in outcomes]
        df = spark.createDataFrame(loads, "job_id string, batch_id string, target string, payload string, row_count int, error_text string, error_class string")
        steps.apply_results(out, load_results(df, NOW), NOW)

    good, bad, again = members["k0"], members["k2"], members["k4"]
    results((good, None, None), (bad, "no", "permanent"), (again, "later", "retryable"))
    found = statuses(out, "sync_events", "dedupe_key")
    assert found == {"k0": "completed", "k1": "completed", "k2": "failed", "k3": "failed", "k4": "batched", "k5": "batched", "k6": "batched"}
    assert statuses(out, "sync_batches", "batch_id")[again] == "pending"
    assert out.table("sync_events").read().filter(F.col("last_error") == "no").count() == 2
    assert set(statuses(out, "sync_jobs", "job_id").values()) == {"running"}  # two batches are open
    steps.ledger_step(out, NOW, ["s"], **options)  # hands the retryable one out again
    results((again, None, None), (members["k6"], "gone", "permanent"))
    assert set(statuses(out, "sync_jobs", "job_id").values()) == {"failed"}
    assert set(statuses(out, "sync_events", "dedupe_key").values()) == {"completed", "failed"}
