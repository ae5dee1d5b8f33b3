import datetime
import itertools
import random

import pytest

from lexforge.functions.json_stream import Reader, partial_value
from lexforge.streaming import replies

REPLY = '{"x": "\\"", "reponse" : "Ab \\"c\\" \\u00e9\\ud83d\\ude42\\n\\ud83d. d\\\\", "citations": ["reponse"]}'
SHOWN = 'Ab "c" é🙂\n\ufffd. d\\'


def test_all_cuts_in_two_and_three():
    n = len(REPLY)
    for i, j in itertools.combinations(range(n + 1), 2):
        reader = Reader()
        assert "".join(reader.read(p) for p in (REPLY[:i], REPLY[i:j], REPLY[j:])) == SHOWN
    reader, longest, text = Reader(), 0, ""
    for c in REPLY:
        text += reader.read(c)
        longest = max(longest, len(reader.open))
    assert text == SHOWN and longest <= 11
    for i in range(n + 1):
        assert SHOWN.startswith(partial_value(REPLY[:i]))


@pytest.mark.parametrize("raw", ['{"reponse": null, "y": {"reponse": "z"}}', '{"reponse": 5}', '{"autre": "x"}', "", '"repons"e": "x"'])
def test_nothing_to_show(raw):
    assert partial_value(raw) == "" == "".join(map(Reader().read, raw))


def test_shown_texts_in_one_pass(spark):
    r = random.Random(1)
    rows = []
    for k in range(20):
        cuts = sorted(r.sample(range(1, len(REPLY)), 8))
        rows += [(k, s, REPLY[a:b]) for s, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(REPLY)]))]
    r.shuffle(rows)
    got = {}
    for x in replies.shown_texts(spark.createDataFrame(rows, "reply_id int, seq int, fragment string")).orderBy("reply_id", "seq").collect():
        got[x.reply_id] = got.get(x.reply_id, "") + x.text
    assert got == dict.fromkeys(range(20), SHOWN)


def test_stream_with_restarts(spark, tmp_path):
    """Fragments late, doubled, in any order, and a query that ends and starts again between any of them."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(2)
    rows, want, at = [], {}, datetime.datetime(2024, 1, 1)
    for k in range(8):
        cuts = sorted(r.sample(range(1, len(REPLY)), 9))
        parts = [REPLY[a:b] for a, b in zip([0, *cuts], [*cuts, len(REPLY)])]
        status = "failed" if k == 3 else "done"
        if k == 4:
            parts = ['{"autre":', "1}"]
        if k == 5:
            parts = parts[:-1]  # falls silent
        rows += [(k, s, p, status if s == len(parts) - 1 and k != 5 else None, at) for s, p in enumerate(parts)]
        want[k] = ("", "error") if k == 4 else (SHOWN, "error" if k == 3 else "end")
    want[5] = (SHOWN[: len(partial_value("".join(p for k, _, p, *_ in rows if k == 5)))], "error")
    rows += r.sample(rows, 30)
    r.shuffle(rows)
    schema = "reply_id long, seq long, fragment string, status string, at timestamp"
    later = [(99, 0, '{"reponse": "x"}', "done", at + datetime.timedelta(hours=1))]
    for part in (rows[0::2], rows[1::2], later, later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = replies.reply_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        assert query.exception() is None
    got, want[99] = {}, ("x", "end")
    for x in spark.read.parquet(str(tmp_path / "out")).orderBy("reply_id", "seq", "kind").collect():
        text, end = got.get(x.reply_id, ("", []))
        got[x.reply_id] = (text + (x.text or ""), end + [x.kind] * (x.kind != "text"))
    assert {k: (t, *e) for k, (t, e) in got.items()} == want
