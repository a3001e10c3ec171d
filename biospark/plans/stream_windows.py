"""Job: window features of recording files as they arrive in a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from biospark.contracts import CONTRACT
from biospark.operators.windows import WindowOptions
from biospark.session import build_session
from biospark.streaming import live


def run(
    spark: SparkSession, folder: str, output: str, checkpoint: str, window_sec: int = 60, hop_sec: int = 30, delay: str = "10s",
    max_gap: str = "5s", idle: str = "1h", file_format: str = "parquet", features: str = "ordered", once: bool = True,
    files_per_trigger: int | None = None, checked: tuple[str, ...] = ("hr", "eda_scl", "temp", "acc_mag"),
) -> StreamingQuery:
    """Start the stream; ``features`` is ``moments`` or ``ordered`` (all of them)."""
    samples = live.read_recordings(spark, folder, CONTRACT, file_format, files_per_trigger)
    if features == "moments":
        return live.start_moments(
            samples, output, checkpoint, once, window=f"{window_sec}s", hop=f"{hop_sec}s", delay=delay, size=window_sec
        )
    if features != "ordered":
        raise ValueError(f"features must be 'moments' or 'ordered', not {features!r}")
    options = live.LiveOptions(WindowOptions(window_sec, hop_sec, ratio_columns=checked), max_gap=max_gap, delay=delay, idle=idle)
    return live.start_ordered_features(samples, output, checkpoint, options, once)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True, help="folder that recording files arrive in")
    parser.add_argument("--output", required=True)
    parser.add_argument("--checkpoint", required=True, help="folder that remembers what has been read")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--features", default="ordered", choices=["moments", "ordered"])
    parser.add_argument("--window-sec", type=int, default=60)
    parser.add_argument("--hop-sec", type=int, default=30)
    parser.add_argument("--delay", default="10s")
    parser.add_argument("--max-gap", default="5s")
    parser.add_argument("--idle", default="1h")
    parser.add_argument("--once", action="store_true", help="read what is there and end")
    args = parser.parse_args()
    query = run(
        build_session("stream-windows"), args.input, args.output, args.checkpoint, args.window_sec, args.hop_sec, args.delay,
        args.max_gap, args.idle, args.format, args.features, args.once,
    )
    query.awaitTermination()


if __name__ == "__main__":
    main()
