"""Shared helpers."""

import re
from pathlib import Path

import pytest

from quillmill.llm.common import release_driver, remove, written
from quillmill.llm.pii import train


def held(spark):
    """MB that the driver's JVM holds."""
    at = Path(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    if not at.exists():
        pytest.skip("needs Linux")
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", at.read_text()))) / 1024


def fragmented(spark):
    """Free about 100 MB of the JVM's native memory below a piece that stays, and return that."""
    new = spark._jvm.java.util.zip.Deflater
    many = [new() for _ in range(500)]
    last = new()
    for x in many:
        x.end()
    return last


def test_the_driver_gives_freed_native_memory_back(spark):
    last = fragmented(spark)
    before = held(spark)
    release_driver(spark)
    assert before - held(spark) > 50
    last.end()


def test_the_driver_does_so_after_each_table_and_training(spark, odd, monkeypatch):
    calls = []
    monkeypatch.setattr("quillmill.llm.common.release_driver", lambda s: calls.append("table"))
    monkeypatch.setattr("quillmill.llm.pii.release_driver", lambda s: calls.append("training"))
    remove(written(spark.range(10), "any"))
    train(odd)
    assert calls == ["table", "training"]


def test_a_jvm_that_cannot_is_left_as_it_is(spark, monkeypatch):
    monkeypatch.setattr("quillmill.llm.common._TRIM", "noSuchCommand")
    release_driver(spark)
