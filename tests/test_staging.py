import threading
from pathlib import Path

import pytest

from skirmish.sources.staging import cut, owned, staging_dir


def tables(spark):
    folder = Path(staging_dir(spark).removeprefix("file:")) / "skirmish"
    return set(folder.glob("owned-*"))


def test_tables_of_another_thread_stay(spark):
    """A stream's batch owns its tables on a thread of its own, beside the queries of the main thread."""
    inside, done = threading.Event(), threading.Event()

    def batch():
        with owned(spark):
            cut(spark.range(2), "owned")
            inside.set()
            done.wait(60)

    thread = threading.Thread(target=batch)
    thread.start()
    assert inside.wait(60)
    kept = cut(spark.range(5), "owned")
    done.set()
    thread.join()
    assert kept.count() == 5


def test_tables_go_with_their_job(spark):
    before = tables(spark)
    with owned(spark):
        assert cut(spark.range(3), "owned").count() == 3
        with pytest.raises(ZeroDivisionError), owned(spark):
            cut(spark.range(2), "owned")
            raise ZeroDivisionError
        assert len(tables(spark) - before) == 1
    assert tables(spark) == before
    assert cut(spark.range(3), "owned").count() == 3
    assert len(tables(spark) - before) == 1
