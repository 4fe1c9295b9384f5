"""Summarise stage durations from a Spark event log folder (written with BENCH_EVENT_LOG=<dir>).

Usage: python tests/stage_times.py <event log dir> [top_n]
"""

import glob
import json
import os
import sys


def events(path: str):
    for f in glob.glob(os.path.join(path, "**", "events_*"), recursive=True) + glob.glob(
        os.path.join(path, "**", "local-*"), recursive=True
    ):
        with open(f, "rb") as fh:
            raw = fh.read()
        if f.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(__import__("io").BytesIO(raw)).read()
        for line in raw.decode("utf-8", "ignore").splitlines():
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if isinstance(e, dict):
                yield e


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages = []
    for e in events(path):
        if e.get("Event") == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            dur = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
            stages.append((round(dur, 2), si["Number of Tasks"], si["Stage ID"], si["Stage Name"][:70]))
    print(f"stages: {len(stages)}, total stage seconds: {sum(s[0] for s in stages):.1f}")
    for s in sorted(stages, reverse=True)[:top]:
        print(f"{s[0]:7.2f}s  tasks={s[1]:<4} stage={s[2]:<5} {s[3]}")


if __name__ == "__main__":
    main()
