"""Cut tables: in the folder the session names, readable after the source is gone, removed on request."""

import os

from quarry.session import cut, discard, release, shared_dir


def test_cut_and_release(spark):
    release(spark)
    a, b = cut(spark.range(5), "t"), cut(spark.range(3), "t")
    folder = shared_dir(spark).removeprefix("file://")
    assert folder == spark.conf.get("spark.checkpoint.dir").removeprefix("file://") and a.count() == 5
    discard(b)
    assert not os.path.exists(b._quarry_path.removeprefix("file://"))
    assert release(spark) == 1 and not os.path.exists(a._quarry_path.removeprefix("file://"))
