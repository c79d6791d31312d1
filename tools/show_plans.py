"""Print the executed physical plans of the headline operators.

    python tools/show_plans.py [sf_dir] > PLANS.md
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from bayeslake import fit, predict  # noqa: E402
from bayeslake.operators.fit import prepare_frame, shared_scan_stats, summary_stats  # noqa: E402
from bayeslake.plans import catalog as C  # noqa: E402
from bayeslake.plans.dag import Network  # noqa: E402
from bayeslake.session import get_spark  # noqa: E402
from bayeslake.sources.tables import split_key  # noqa: E402


def executed(df, action=lambda d: d.collect()):
    action(df)
    text = df._jdf.queryExecution().executedPlan().toString()
    text = re.sub(r"#\d+L?", "", text)
    keep = []
    for line in text.split("\n"):
        if line.startswith("+- == Initial Plan =="):
            break
        keep.append(line[:160])
    return "\n".join(keep)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", 16)
    li = C.lineitem_coded(spark, sf)
    train, test = split_key(li, "l_orderkey")
    cols, edges, out = C.G2
    X = train.select(*cols)
    net = Network.from_schema(X.schema, edges)
    stats, where = shared_scan_stats(prepare_frame(X, net), net)
    print(f"# Executed plans ({os.path.basename(sf)}, local[8])\n")
    print("Generated by `python tools/show_plans.py`. Expression ids removed; long lines cut.\n")
    print(f"## Fit of G2: {len(where)} parameter groupings in one shared scan\n")
    print("```\n" + executed(stats, lambda d: d.collect()) + "\n```\n")
    m = fit(X, edges)
    print("## Predict of G2 (hybrid fan-in, 3 classes; flat per-candidate columns)\n")
    print("```\n" + executed(predict(m, test, out).select("l_orderkey", "prediction", "score")) + "\n```\n")
    emb = C.embeddings_wide(spark, sf)
    tr6, te6 = split_key(emb, "vec_id")
    X6 = tr6.select(*C.G6[0])
    net6 = Network.from_schema(X6.schema, C.G6[1])
    lst, _ = summary_stats(X6, net6)
    print("## Fit of G6: mergeable summaries of 64 features (one pass, one row per task and group)\n")
    print("```\n" + executed(lst) + "\n```\n")
    m6 = fit(X6, C.G6[1])
    print("## Predict of G6 (64 continuous parents, 10 classes; vectorised class densities)\n")
    print("```\n" + executed(predict(m6, te6, "label").select("vec_id", "prediction")) + "\n```\n")
    spark.stop()
    _ = F


if __name__ == "__main__":
    main()
