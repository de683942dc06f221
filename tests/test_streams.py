import datetime
import os

from quarryline.streaming import ingest


def test_windows_keep_late_rows(spark, tmp_path):
    # every file spans all days and a batch takes one file, so that later batches hold rows of days long past
    folder = tmp_path / "events.parquet"
    days = [datetime.datetime(2024, 1, d, 12) for d in range(1, 31)]
    for i in range(3):
        spark.createDataFrame([(day, "a" if i else "b") for day in days], "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(folder))
    parts = sorted(folder.glob("*.parquet"))
    for i, part in enumerate(parts):
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
    got = ingest.windowed(ingest.read(spark, str(tmp_path), "events", files_per_batch=1), "ts", "event_type").collect()
    assert len(parts) == 3 and len(got) == 60 and sum(r.n for r in got) == 90
