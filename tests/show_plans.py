"""Write the physical plans of key queries (explain "formatted", tree part) to PLANS.md.

Usage: python tests/show_plans.py [sf_dir]
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEY = ["F3_metadata_filter", "F9_regex_lines", "J3_missing_version", "J6_version_diffs", "W1_latest_result",
       "S8_insert_if_absent", "J1_ids_with_feature_value", "S4_scan_prints"]


KEEP = ("Scan parquet", "Exchange", "HashAggregate", "SortAggregate", "Join", "Window", "Generate")


def tree(df) -> str:
    """Tree part plus the detail blocks of scans (pushed filters, read schema), exchanges, aggregates, joins."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = text.split("\n\n")
    head = blocks[0]
    blocks = [b.strip() for b in blocks]
    details = [b for b in blocks[1:] if b.startswith("(") and any(k in b.split("\n")[0] for k in KEEP)]
    details = [re.sub(r"\nInput \[\d+\]:.*", "", b) for b in details]
    return re.sub(r"#\d+L?", "", head + "\n\n" + "\n\n".join(details))


def main() -> None:
    from vellum.plans import REGISTRY
    from vellum.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    out = ["# Physical plans of key queries", "",
           f"`explain(\"formatted\")` tree part, data `{sf}`, before adaptive re-planning. Small tables are broadcast "
           "here by Spark's own size estimate; at scale the same joins plan as sort-merge joins with AQE skew "
           "splitting. Regenerate with `python tests/show_plans.py`.", ""]
    for name in KEY:
        out += [f"## {name}", "", "```", tree(REGISTRY[name].build(spark, sf)).strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
