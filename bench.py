"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores
(default 8). BENCH_QUERIES: comma separated names, or "all".
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from billwright.plans import QUERIES
from billwright.session import local_session

HEADLINE = [
    "process_invoices",
    "extract_invoices",
    "validate_invoices",
    "validation_finding_counts",
    "resolve_vendors",
    "upsert_vendors",
    "vendor_duplicate_pairs",
    "customer_duplicate_pairs",
    "duplicate_invoices",
    "dedupe_files",
    "duplicate_line_items",
    "vendor_statistics",
    "customer_statistics",
    "invoice_totals",
    "payment_totals",
    "list_invoices",
    "invoice_documents",
    "processing_status",
    "text_profile",
    "contact_coverage",
    "assemble_ocr_text",
    "pick_orientation",
    "rate_limit_windows",
    "lockouts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
