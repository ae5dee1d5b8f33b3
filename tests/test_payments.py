import datetime
import random

from lexforge.operators import ledger
from lexforge.streaming import payments


def test_decisions_equal_those_of_the_table(spark, tmp_path):
    """Events in four parts, each late by less than the delay, some doubled, and a query that starts anew for every part."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r, start = random.Random(4), datetime.datetime(2024, 1, 1)
    events = []
    for k in range(30):
        first = r.randint(0, 600)
        for _ in range(r.randint(1, 5)):
            status = r.choice(["PENDING", "PENDING", "SUCCESSFUL", "FAILED"] if k % 4 else ["PENDING"])
            events.append((f"p{k}", status, start + datetime.timedelta(minutes=first + r.randint(0, 40))))
    events += r.sample(events, 25)
    # in the order of arrival: up to 50 minutes after they happened
    events.sort(key=lambda e: (e[2] + datetime.timedelta(minutes=r.randint(0, 50)), e))
    schema = "reference string, status string, at timestamp"
    n = len(events) // 3 + 1
    end = [("end", "FAILED", start + datetime.timedelta(days=5))]
    for part in (events[:n], events[n : 2 * n], events[2 * n :], end, [("end", "FAILED", start + datetime.timedelta(days=9))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = payments.payment_decisions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(90) and query.exception() is None
    want = {x.reference: x.status for x in ledger.payment_states(spark.createDataFrame(events, schema)).collect()}
    got = [(x.reference, x.status) for x in spark.read.parquet(str(tmp_path / "out")).where("reference <> 'end'").collect()]
    assert len(got) == len(dict(got)) and dict(got) == want
    assert set(want.values()) == {"PENDING", "SUCCESSFUL", "FAILED"}
