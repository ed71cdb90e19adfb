"""python -m inkplan.cli IMAGE...: encode PBM, PGM, PPM, PAM or PNG files.

Exit codes: 0 done, 1 no input, 2 something failed.
"""

from __future__ import annotations

import argparse
import sys

from inkplan.plans.options import Binarization, Encoding


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkplan", description=__doc__, add_help=False)
    p.add_argument("images", nargs="*")
    p.add_argument("-h", "--help", action="store_true")
    p.add_argument("-v", "--version", action="store_true")
    p.add_argument("-o", "--output", help="write one stream to this file")
    p.add_argument("-s", "--symbol-mode", action="store_true", help="lossy: share similar shapes")
    p.add_argument("-t", "--threshold", type=float, default=0.92, help="correlation that makes shapes one")
    p.add_argument("-w", "--weight", type=float, default=0.5)
    p.add_argument("-a", "--auto-threshold", action="store_true", help="merge equivalent symbols")
    p.add_argument("--no-hash", action="store_true", help="compare all symbols when merging")
    p.add_argument("-d", "--duplicate-line-removal", action="store_true")
    p.add_argument("-p", "--pdf", action="store_true", help="streams for a PDF")
    p.add_argument("-b", "--basename", default="output")
    p.add_argument("-T", "--bw-threshold", type=int, default=-1)
    p.add_argument("-G", "--global", dest="whole", action="store_true", help="no background cleaning")
    p.add_argument("-2", dest="two", action="store_true", help="upsample twice")
    p.add_argument("-4", dest="four", action="store_true", help="upsample four times")
    p.add_argument("-D", "--dpi", type=int, default=0)
    return p


def run(arguments: list[str]) -> int:
    options = parser().parse_args(arguments)
    if options.version or options.help:
        print("inkplan 0.1" if options.version else parser().format_help())
        return 0
    if not options.images:
        print(parser().format_usage(), file=sys.stderr)
        return 1
    try:
        _encode(options)
    except Exception as e:  # noqa: BLE001 - any failure is exit code 2
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


def _encode(options: argparse.Namespace) -> None:
    from functools import reduce

    from pyspark.sql import DataFrame, SparkSession
    from pyspark.sql import functions as F

    from inkplan.plans import document
    from inkplan.sources import rasters

    lossy = options.symbol_mode
    if not lossy and len(options.images) > 1:
        raise ValueError("without -s, one image at a time")
    encoding = Encoding("lossy" if lossy else "lossless", "embedded" if options.pdf else "standalone", options.duplicate_line_removal, options.dpi, options.threshold, options.weight, options.auto_threshold, not options.no_hash)
    binarization = Binarization("global" if options.whole else "adaptive", options.bw_threshold, 4 if options.four else 2 if options.two else 1)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    read = reduce(DataFrame.unionByName, (rasters.read_images(spark, path).withColumn("page_no", F.lit(i)) for i, path in enumerate(options.images)))
    row = document.encode(rasters.to_pages(read.withColumn("doc_id", F.lit(0).cast("long")), binarization), encoding).first()
    head, pages = bytes(row.globals) if row.globals is not None else None, [bytes(p) for p in row.pages]
    if options.pdf and (lossy or not options.output):
        parts = rasters.parts_of(options.basename, "split", head, pages, row.output)
    else:
        parts = [(options.output, rasters.parts_of("", "file", head, pages, row.output)[0][1])]
    for name, data in parts:
        if name:
            with open(name, "wb") as f:
                f.write(data)
        else:
            sys.stdout.buffer.write(data)


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
