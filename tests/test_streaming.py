"""The upload watcher analyses every file that lands and persists its tables."""

import os

from tidewatch.plans.pipeline import catalog, table
from tidewatch.streaming.uploads import watch_uploads


def test_watch_uploads_once(spark, scratch):
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    with open(os.path.join(landing, "auth.csv"), "w") as f:
        f.write("timestamp,source_ip,status,username\n")
        for i in range(30):
            f.write(f"2024-01-01T10:00:{i:02d}Z,45.1.2.3,FAILED,alice\n")
    q = watch_uploads(spark, landing, os.path.join(scratch, "lake"), os.path.join(scratch, "ckpt"), once=True)
    q.awaitTermination(300)
    cat = catalog(spark, os.path.join(scratch, "lake")).collect()
    assert [r["dataset_id"] for r in cat] == ["auth"] and cat[0]["row_count"] == 30
    det = table(spark, os.path.join(scratch, "lake"), "detections", "auth")
    assert det is not None and "brute_force" in {r["detection_type"] for r in det.collect()}
