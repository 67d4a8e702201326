"""Command line: ``python -m tidelane CAPTURE --feature cic tls --output FOLDER``, or ``--list``."""

from __future__ import annotations

import argparse
import sys

from .operators import registry


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelane", description="Features of the flows of a capture, or of a folder of them.")
    parser.add_argument("capture", nargs="?", help="file or folder")
    parser.add_argument("--feature", nargs="+", default=list(registry.DEFAULT_BATCH), help="kinds to extract")
    parser.add_argument("--output", help="folder for the results (default: the capture's)")
    parser.add_argument("--n-packets", type=int, default=0, help="packets of a flow at most (0: all)")
    parser.add_argument("--pattern", help="names of files in a folder, like *.pcap")
    parser.add_argument("--list", action="store_true", help="names all kinds")
    options = parser.parse_args(arguments)
    if options.list:
        print("\n".join(f"{s.name}\t{s.output}\t{' '.join(s.aliases)}".rstrip() for s in registry.list_features()))
        return 0
    if not options.capture:
        parser.error("a capture is needed")
    from pyspark.sql import SparkSession

    try:
        found = registry.extract_all(SparkSession.builder.getOrCreate(), options.capture, tuple(options.feature), options.output, options.n_packets, options.pattern)
    except ValueError as e:
        parser.error(str(e))
    for s in found.values():
        print(f"{s.feature}\tflows={s.flows}\tpackets={s.packets}\tseconds={s.elapsed_sec:.3f}\t{s.output or '-'}\t{s.message}")
    return 0 if all(s.message == "ok" for s in found.values()) else 1


if __name__ == "__main__":
    sys.exit(main())
