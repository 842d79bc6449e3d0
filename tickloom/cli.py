"""python -m tickloom.cli --pcap PATH --feed mbo --ports 18001=mktdata,... [--report FOLDER] [--strict]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import Settings, check
from .operators.findings import by_status, exit_code
from .sources.captures import port_map, read_pcap
from .sources.reports import write_report


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Checks a capture of a feed and counts findings by rule.")
    p.add_argument("--pcap", required=True)
    p.add_argument("--feed", default="mbo", choices=["tob", "midpoint", "mbo", "mbp"])
    p.add_argument("--ports", required=True)
    p.add_argument("--report")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--window", type=int, default=8)
    for name in ("manifest-cadence", "definition-cycle", "heartbeat"):
        p.add_argument(f"--expect-{name}", type=float, default=0, help="seconds")
    p.add_argument("--confirm-cycles", type=int, default=2)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tickloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ns = lambda s: int(s * 1e9)
    settings = Settings(a.window, ns(a.expect_manifest_cadence), ns(a.expect_definition_cycle), ns(a.expect_heartbeat), a.confirm_cycles, ports=tuple(sorted(set(port_map(a.ports).values()))))
    found = check(read_pcap(spark, a.pcap, a.ports), a.feed, settings).cache()
    by_status(found).orderBy("rule_id", "status").show(500, truncate=False)
    if a.report:
        write_report(found, a.report, a.feed)
    return exit_code(found, a.strict).first()[0]


if __name__ == "__main__":
    sys.exit(main())
