import os
import threading

from kinfold import checkpoints


def folder(spark):
    path = checkpoints.shared_dir(spark).removeprefix("file://") + "/kinfold"
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_scopes_delete_all_but_what_is_kept(spark):
    before = folder(spark)
    with checkpoints.scope() as outer:
        checkpoints.materialize(spark.range(3), "gone")
        with checkpoints.scope() as inner:
            checkpoints.materialize(spark.range(4), "gone")
            stays = checkpoints.materialize(spark.range(5), "stays")
            inner.append(stays)
        assert len(folder(spark) - before) == 2
        other = []
        t = threading.Thread(target=lambda: other.append(checkpoints.materialize(spark.range(6), "other")))
        t.start()
        t.join()
        outer.append(stays)
    assert stays.count() == 5 and other[0].count() == 6 and len(folder(spark) - before) == 2
    checkpoints.discard(stays, other[0])
    assert folder(spark) == before


def test_only_counted_tables_are_broadcast(spark, monkeypatch):
    rows = checkpoints.materialize(spark.range(100), "ids")
    monkeypatch.setattr(checkpoints, "SMALL", 99)
    assert checkpoints.broadcast_if_small(rows) is rows
    monkeypatch.setattr(checkpoints, "SMALL", 100)
    assert checkpoints.broadcast_if_small(rows) is not rows
    checkpoints.discard(rows)
