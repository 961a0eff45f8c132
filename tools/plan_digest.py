"""Write PLANS.md: the physical plan tree, scan schemas and pushed filters of key queries.

    python tools/plan_digest.py [/root/testdata/sf0.01]

Queries whose building runs jobs (crawl levels, writes) are shown through their final plan.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NAMES = ["page_paragraphs", "links_resolved", "links_admitted", "lang_gate", "lang_classify",
         "corpus_stats", "seed_requests", "keyword_dequeue", "serp_links", "redirect_decode",
         "url_blacklist", "visited_from_lines", "crawl_bfs"]


def digest(df) -> str:
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    tree, details = text.split("\n\n", 1) if "\n\n" in text else (text, "")
    keep = [ln for ln in details.splitlines()
            if re.match(r"^\(\d+\) ", ln) or ln.startswith(("ReadSchema", "PushedFilters", "Join type", "Keys:"))]
    return tree.rstrip() + "\n\n" + "\n".join(keep)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from trawl.plans import queries as Q
    from trawl.session import ensure_checkpoint_dir, local_session

    spark = local_session()
    ensure_checkpoint_dir(spark)
    out = ["# PLANS\n", f"Physical plans of key queries at `{sf_dir}` (adaptive plans before execution; "
           "generated by `tools/plan_digest.py`). Look for: `ReadSchema` listing only needed columns, "
           "`PushedFilters`, one `MapInPandas` (the HTML pass) per query, `BroadcastHashJoin` only on "
           "size-checked sides, `HashAggregate` pairs (partial + final) around each `Exchange`.\n"]
    for name in NAMES:
        df = Q.QUERIES[name](spark, sf_dir)
        out.append(f"## {name}\n\n```\n{digest(df)}\n```\n")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
