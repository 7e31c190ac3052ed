"""What the stages of an action read and wrote, by Spark's own counters."""

import time


def _stages(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, *(getattr(store, f"stageList$default${k}")() for k in range(2, 6)))
    return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}


def shuffled(spark, action):
    """What ``action`` returns, and the rows that it shuffled."""
    before = set(_stages(spark))
    out = action()
    time.sleep(1)  # counters arrive behind the result
    return out, sum(s.shuffleWriteRecords() for k, s in _stages(spark).items() if k not in before)
