import ctypes
import re
from pathlib import Path

from spanforge.llm import common


def native_mb(pid):
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_driver_gives_memory_back(spark):
    """What a step leaves idle on the driver, in the Python process and in the JVM, goes back to the system."""
    jvm_pid = spark.sparkContext._jvm.ProcessHandle.current().pid()
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    held = [libc.malloc(60_000) for _ in range(4000)]
    for p in held:
        ctypes.memset(p, 1, 60_000)
    for p in held[:-1]:  # the last one keeps the top of the heap
        libc.free(p)
    before = native_mb("self")
    common._relieved = float("-inf")
    common.written(spark.range(10), "relief")
    assert native_mb("self") < before - 150
    libc.free(held[-1])
    assert common._trim_jvm(spark)
    assert native_mb(jvm_pid) > 0


def test_driver_relief_is_rare(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_trim_jvm", calls.append)
    monkeypatch.setattr(common, "_relieved", float("-inf"))
    monkeypatch.setattr(common, "RELIEF_S", 3600)
    for _ in range(3):
        common.cut(spark.range(3))
    assert len(calls) == 1
    common.relieve_driver(spark, now=True)
    assert len(calls) == 2
