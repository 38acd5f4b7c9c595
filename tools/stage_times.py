"""Slowest stages from a Spark event log (as written by ``BENCH_EVENT_LOG=1 python bench.py``).

    python tools/stage_times.py <event-log-dir> [top_n]

Reads the (optionally zstd-compressed) event files and prints stage id,
duration, task count and name of the slowest stages, plus the total.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as f:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(f), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            yield from f


def stage_times(log_dir: str) -> list[tuple[int, float, int, str]]:
    files = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus")]
    out = []
    for p in files:
        for line in _lines(p):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if e.get("Event") == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                dur = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
                out.append((si["Stage ID"], dur, si["Number of Tasks"], si["Stage Name"][:80]))
    return out


def main() -> None:
    d = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    st = stage_times(d)
    for sid, dur, n, name in sorted(st, key=lambda s: -s[1])[:top]:
        print(f"{sid:6d} {dur:8.2f}s {n:6d} tasks  {name}")
    print(f"{len(st)} stages, {sum(s[1] for s in st):.1f}s summed stage time")


if __name__ == "__main__":
    main()
