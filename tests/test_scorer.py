"""The scorer hook: bounds, failures, restarts."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from proselens.operators import scorer as SC


class Recorder:
    """Notes every request that it is asked in a folder."""

    def __init__(self, folder: str, bad: tuple[str, ...] = (), die_at: str | None = None) -> None:
        self.folder, self.bad, self.die_at = folder, bad, die_at

    def __call__(self, texts):
        if self.die_at in texts:
            os._exit(1)  # the worker dies, as an executor might
        for t in texts:
            if t in self.bad:
                raise RuntimeError("bad " + t)
        for t in texts:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return [None if t == "silent" else t.upper() for t in texts]


def asked(folder):
    return sorted(open(os.path.join(folder, n)).read() for n in os.listdir(folder))


@pytest.fixture()
def places(tmp_path):
    (tmp_path / "asked").mkdir()
    (tmp_path / "journal").mkdir()
    return str(tmp_path / "asked"), str(tmp_path / "journal")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "candidate_ord long, request string")


def test_replies_failures_and_silence(spark, places):
    folder, journal = places
    df = frame(spark, [f"r{i}" for i in range(60)] + ["silent", None, "oops"])
    got = {r["candidate_ord"]: tuple(r)[1:] for r in SC.score_requests(
        df, lambda: Recorder(folder, ("oops",)), journal, batch_rows=7, part_rows=20).collect()}
    assert len(got) == 63 and got[5] == ("ok", "R5", None) and got[60] == ("no_reply", None, None)
    assert got[61] == ("ok", "", None) and got[62] == ("failed", None, "RuntimeError: bad oops")
    assert len(asked(folder)) == 62  # the neighbours of the failing one were asked once


def test_a_second_run_asks_nobody_twice(spark, places):
    folder, journal = places
    first = frame(spark, [f"r{i}" for i in range(30)])
    SC.score_requests(first, lambda: Recorder(folder), journal, part_rows=10)
    more = frame(spark, [f"r{i}" for i in range(30)] + ["new"])
    got = SC.score_requests(more, lambda: Recorder(folder), journal, part_rows=3)  # parts stay those of the journal
    assert got.count() == 31 and asked(folder) == sorted([f"r{i}" for i in range(30)] + ["new"])
    assert SC.score_requests(first, lambda: 1 / 0, journal).count() == 30  # nothing left to load a scorer for


def test_failures_are_asked_again_on_request(spark, places):
    folder, journal = places
    df = frame(spark, ["a", "oops", "b"])
    SC.score_requests(df, lambda: Recorder(folder, ("oops",)), journal)
    again = SC.score_requests(df, lambda: Recorder(folder), journal, retry_failed=True)
    assert {r["raw"] for r in again.collect()} == {"A", "OOPS", "B"} and asked(folder) == ["a", "b", "oops"]


def test_finished_batches_outlive_a_dead_worker(spark, places):
    folder, journal = places
    df = frame(spark, [f"r{i:02d}" for i in range(40)]).repartition(1).sortWithinPartitions("candidate_ord")
    with pytest.raises(Exception):  # noqa: B017
        SC.score_requests(df, lambda: Recorder(folder, die_at="r25"), journal, batch_rows=5, part_rows=1000)
    before = asked(folder)
    assert 0 < len(before) < 40
    got = SC.score_requests(df, lambda: Recorder(folder), journal, batch_rows=5, part_rows=1000)
    assert got.filter(F.col("status") == "ok").count() == 40
    assert asked(folder) == [f"r{i:02d}" for i in range(40)]


def test_batches_keep_both_bounds():
    rows = [(str(i), "x" * n) for i, n in enumerate([10, 10, 50, 1, 1, 1, 1, 200, 5])]
    got = [[len(t) for _, t in b] for b in SC.batches_of(rows, 3, 60)]
    assert got == [[10, 10], [50, 1, 1], [1, 1], [200], [5]]


def test_a_scorer_that_miscounts_fails_alone():
    out = SC.call(lambda texts: ["x"] * (len(texts) - 1) if "b" in texts else ["y"] * len(texts),
                  [("1", "a"), ("2", "b"), ("3", "c")])
    assert [r[1] for r in out] == ["ok", "failed", "ok"] and out[1][3] == "ValueError: 0 replies to 1 requests"


def test_empty_table(spark, places):
    assert SC.score_requests(frame(spark, ["x"]).limit(0), lambda: 1 / 0, places[1]).count() == 0
