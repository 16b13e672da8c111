"""Run one step or a whole job: ``spark-submit tidemark_job.py batch --base ... --raw ...``.

A failed step raises, so the process ends with an error and a scheduler does not go on.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tidemark.config import DEPTH, LEARNING_RATE, MIN_ROWS, ROUNDS, SEED, TEST_SIZE, JobConfig, ModelParams
from tidemark.operators.events import encode_events, generate_events
from tidemark.plans.batch import build_gold, build_model, build_silver, run_batch
from tidemark.plans.stream import StreamConfig, run_stream
from tidemark.session import run_scratch, scale_conf
from tidemark.sources.streams import (
    FILES_PER_BATCH,
    OFFSETS_PER_BATCH,
    StreamSource,
    kafka_source,
    text_source,
)

LOGIN_CONF = "spark.tidemark.login"


def arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemark")
    steps = parser.add_subparsers(dest="step", required=True)
    for step in ("silver", "gold", "train", "batch"):
        sub = steps.add_parser(step)
        sub.add_argument("--base", required=True, help="folder of the layers")
        sub.add_argument("--raw", default="", help="raw customer file or folder")
        sub.add_argument("--format", default="parquet")
        sub.add_argument("--infer-schema", action="store_true", help="guess the raw columns' types")
        sub.add_argument("--prefer-complete", action="store_true", help="of copies, one with a charge")
        sub.add_argument("--min-rows", type=int, default=MIN_ROWS)
        sub.add_argument("--rounds", type=int, default=ROUNDS)
        sub.add_argument("--depth", type=int, default=DEPTH)
        sub.add_argument("--learning-rate", type=float, default=LEARNING_RATE)
        sub.add_argument("--test-share", type=float, default=TEST_SIZE)
        sub.add_argument("--seed", type=int, default=SEED)
        sub.add_argument("--input-bytes", type=int, default=None, help="size of the raw data, to fit the settings to")
    stream = steps.add_parser("stream")
    place = stream.add_mutually_exclusive_group(required=True)
    place.add_argument("--source", help="folder of text files, one message per line")
    place.add_argument("--topic", help="topic to read from --servers")
    stream.add_argument("--servers", help="host:port of the topic's servers")
    stream.add_argument("--login-file", help=f"file with the login text; else it is in {LOGIN_CONF}")
    stream.add_argument("--path", required=True)
    stream.add_argument("--checkpoint", required=True)
    stream.add_argument("--format", default="parquet")
    stream.add_argument("--files-per-batch", type=int, default=FILES_PER_BATCH)
    stream.add_argument("--bytes-per-batch", type=int, default=None, help="instead of a number of files")
    stream.add_argument("--max-offsets", type=int, default=OFFSETS_PER_BATCH)
    stream.add_argument("--min-partitions", type=int, default=None)
    stream.add_argument("--keep-corrupt-rows", action="store_true", help="bad messages as rows with nulls")
    stream.add_argument("--timeout", type=float, default=None)
    events = steps.add_parser("events")
    events.add_argument("--path", required=True, help="folder the messages are added to")
    events.add_argument("--count", type=int, default=100)
    events.add_argument("--first", type=int, default=0)
    events.add_argument("--seed", type=int, default=SEED)
    args = parser.parse_args(argv)
    if args.step == "stream" and args.topic and not args.servers:
        parser.error("--topic needs --servers")
    return args


def stream_source(spark: SparkSession, args: argparse.Namespace) -> StreamSource:
    """The folder or topic that was asked for, with bounded batches."""
    if args.topic:
        login = spark.conf.get(LOGIN_CONF, None)
        if args.login_file:
            with open(args.login_file) as file:
                login = file.read().strip()
        if not login:
            raise ValueError(f"a topic needs --login-file or {LOGIN_CONF}")
        return kafka_source(args.servers, args.topic, login, args.min_partitions, args.max_offsets)
    if args.bytes_per_batch is not None:
        return text_source(args.source, bytes_per_batch=args.bytes_per_batch)
    return text_source(args.source, files_per_batch=args.files_per_batch)


def job_config(args: argparse.Namespace) -> JobConfig:
    return JobConfig.under(
        args.base,
        args.raw,
        table_format=args.format,
        min_rows=args.min_rows,
        infer_schema=args.infer_schema,
        prefer_complete=args.prefer_complete,
        model=ModelParams(
            rounds=args.rounds,
            learning_rate=args.learning_rate,
            depth=args.depth,
            seed=args.seed,
            test_size=args.test_share,
        ),
    )


def main(argv: Sequence[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName(f"tidemark-{args.step}").getOrCreate()
    if args.step == "events":
        ids = spark.range(args.first, args.first + args.count)
        encode_events(generate_events(ids, "id", args.seed)).write.mode("append").text(args.path)
        return
    if args.step == "stream":
        config = StreamConfig(
            stream_source(spark, args),
            args.path,
            args.checkpoint,
            separate_corrupt=not args.keep_corrupt_rows,
            table_format=args.format,
            timeout=args.timeout,
        )
        run_stream(spark, config)
        return
    if args.input_bytes is not None:
        for key, value in scale_conf(args.input_bytes, spark.sparkContext.defaultParallelism).items():
            spark.conf.set(key, value)
    steps = {"silver": build_silver, "gold": build_gold, "train": build_model, "batch": run_batch}
    with run_scratch(spark):
        steps[args.step](spark, job_config(args))


if __name__ == "__main__":
    main()
