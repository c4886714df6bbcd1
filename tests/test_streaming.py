import datetime as dt
import json

from logloom.sources.store import Store
from logloom.streaming.follow import LINES_DDL, follow, stream_lines


def line(uuid, text="hi"):
    return json.dumps({"type": "user", "uuid": uuid, "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": text}})


def test_follow_appends_each_uuid_once(spark, tmp_path):
    store, src, t = Store(spark, str(tmp_path / "store")), str(tmp_path / "lines"), dt.datetime(2024, 1, 1)

    def ship(*rows):
        spark.createDataFrame([("claude_code", "/f", i, x, t) for i, x in rows], LINES_DDL).coalesce(1).write.mode("append").parquet(src)
        follow(store, stream_lines(spark, src), str(tmp_path / "cp"), once=True).awaitTermination()

    ship((1, line("a")), (2, line("b")), (3, "{broken"), (4, line("blank", " ")))
    ship((5, line("b", "again")), (6, line("c")))
    ship((7, line("a", "again")))
    got = sorted(tuple(r) for r in store.read("messages").select("seq", "uuid", "content").collect())
    assert got == [(1, "a", "hi"), (2, "b", "hi"), (3, "c", "hi")]
