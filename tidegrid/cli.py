"""Command line: python -m tidegrid.cli encode | decode | describe | chop."""

from __future__ import annotations

import argparse
import logging
import sys

from tidegrid.operators.store import SignalStore, compress, decompress
from tidegrid.plans.config import CodecConfig
from tidegrid.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidegrid", description="Compress and read multichannel signals.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text, description=text)
        p.add_argument("-nc", "--no-check", action="store_true", help="don't check the result")
        p.add_argument("-v", "--debug", action="store_true", help="log more, and show whole errors")
        p.add_argument("-p", "--parallelism", type=int, help="tasks to run at once")
        return p

    p = command("encode", "Compress a flat binary or NPY file.")
    p.add_argument("path")
    p.add_argument("out", nargs="?")
    p.add_argument("outmeta", nargs="?")
    p.add_argument("-d", "--dtype", type=str.strip)
    p.add_argument("-s", "--sample-rate", type=float)
    p.add_argument("-n", "--n-channels", type=int)
    p.add_argument("-c", "--chunk", type=float, help="seconds of a chunk")
    p.add_argument("--overwrite", "-f", action="store_true")
    p.add_argument("--set-default", action="store_true", help="keep the given settings as defaults")
    p = command("decode", "Write a compressed file as a flat binary file.")
    p.add_argument("cdata")
    p.add_argument("cmeta", nargs="?")
    p.add_argument("-o", "--out")
    p.add_argument("--overwrite", "-f", action="store_true")
    p = command("describe", "Describe a compressed file.")
    p.add_argument("cdata")
    p.add_argument("cmeta", nargs="?")
    p = command("chop", "Keep the first chunks of a compressed file.")
    p.add_argument("cdata")
    p.add_argument("-n", "--n-chunks", type=int, required=True)
    p.add_argument("-o", "--out")
    return top


def session(parallelism: int | None):
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(f"local[{parallelism or '*'}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(parallelism or 8)).getOrCreate()


def run(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO)
    try:
        spark = spark or session(args.parallelism)
        _run(args, spark)
    except Exception as e:
        if args.debug:
            raise
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


def _run(args, spark) -> None:
    check = False if args.no_check else None
    if args.command == "encode":
        given = {"dtype": args.dtype, "sample_rate": args.sample_rate, "n_channels": args.n_channels, "chunk_duration": args.chunk, "check_after_compress": check}
        if args.set_default:
            CodecConfig.store(**given)
        figures = compress(spark, args.path, args.out, args.outmeta, args.sample_rate, args.n_channels, args.dtype, overwrite=args.overwrite, chunk_duration=args.chunk, check_after_compress=check)
        print(f"{figures['out']}: {figures['bytes']} bytes, {100 * (1 - figures['ratio']):.1f} % saved")
    elif args.command == "decode":
        decompress(spark, args.cdata, args.cmeta, args.out, write_output=True, overwrite=args.overwrite, check_after_decompress=check)
    elif args.command == "describe":
        for k, v in SignalStore.open_cbin(spark, args.cdata, args.cmeta).describe().first().asDict().items():
            print(f"{k:<15} {v}")
    else:
        out = args.out or files.with_suffix(args.cdata, ".chopped.cbin")
        kept = SignalStore.open_cbin(spark, args.cdata).chop(args.n_chunks)
        if kept is not None:
            kept.write_cbin(out)


if __name__ == "__main__":
    sys.exit(run())
