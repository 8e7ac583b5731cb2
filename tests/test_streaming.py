import datetime as dt

import pytest

from terrachron.sources.payloads import SCHEMA, append, latest, read_table
from terrachron.streaming import controller as K
from terrachron.streaming import payloads as S


def test_ingest_and_windows(spark, tmp_path):
    drop, table = str(tmp_path / "drop"), str(tmp_path / "table")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(bytearray(k), bytearray(v), t0 + dt.timedelta(minutes=m)) for k, v, m in ((b"a", b"1", 0), (b"a", b"22", 5), (b"b", b"3", 12))]
    append(spark.createDataFrame(rows, SCHEMA), drop)
    S.ingest(S.read(spark, drop), table, str(tmp_path / "check")).awaitTermination()
    assert {bytes(r.key): bytes(r.body) for r in latest(read_table(spark, table)).collect()} == {b"a": b"22", b"b": b"3"}
    q = S.arrivals(S.read(spark, drop)).writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.bytes) for r in spark.table("arrivals").collect()) == [(1, 1), (2, 3)]
    q = S.deduplicated(S.read(spark, drop)).writeStream.format("memory").queryName("unique_keys").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("unique_keys").count() == 2


def settle(throughput):
    s = K.start(tuple(throughput))
    for _ in range(20):
        if s.settled:
            break
        s = K.observe(s, K.Observation(throughput[s.workers]))
    return s


def test_calibration_stops_where_gains_end():
    assert settle({1: 10, 2: 19, 4: 30, 8: 31}).workers == 4
    assert settle({1: 10, 2: 10}).workers == 1
    assert settle({1: 10, 2: 20}).workers == 2


def test_latency_and_unusable_answers_veto():
    s = K.start((1, 2))
    for _ in range(2):
        s = K.observe(s, K.Observation(10, (1.0,)))
    for _ in range(2):
        s = K.observe(s, K.Observation(20, (2.0,)))
    assert s.settled and s.workers == 1
    s = K.start((1, 2))
    for _ in range(2):
        s = K.observe(s, K.Observation(10))
    assert K.observe(s, K.Observation(99, acceptable=False)).workers == 1


def test_an_unusable_batch_steps_back_at_once():
    s = settle({1: 10, 2: 20, 4: 40})
    s = K.observe(s, K.Observation(40, acceptable=False))
    assert s.workers == 2 and s.baseline == 0
    s = K.observe(s, K.Observation(15))
    assert s.workers == 2 and s.baseline == 15


def test_backs_off_recovers_and_expires():
    s = settle({1: 10, 2: 20, 4: 40})
    for _ in range(3):
        s = K.observe(s, K.Observation(10), 100.0)
    assert s.workers == 2
    for _ in range(8):
        s = K.observe(s, K.Observation(12), 200.0)
    assert s.workers == 4
    assert K.observe(s, K.Observation(12), 200.0 + K.STATE_TTL_S + 1).workers == 1
    with pytest.raises(ValueError):
        K.start((2, 1))
    assert K.p95(tuple(range(1, 21))) == 19 and K.median([1, 2, 3, 4]) == 2.5
