"""Properties from the survey: partition-count invariance and heavy skew."""

import json


from tests.conftest import SF01
from tuneframe.operators import normalize as N
from tuneframe.operators import profile as P
from tuneframe.operators import repair as R
from tuneframe.operators import validate as V
from tuneframe.plans import fixtures as X
from tuneframe.sources.readers import records_from_lines


def rows(df):
    return sorted(json.dumps([None if v is None else (round(v, 9) if isinstance(v, float) else str(v)) for v in r]) for r in df.collect())


def test_results_invariant_to_partition_count(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    outs = []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            base = N.fold_turns(X.dirty_conversations(spark, SF01).repartition(int(n)))
            outs.append(
                (
                    rows(V.validation_report(V.flag_records(base))),
                    rows(P.profile(base).drop("role_counts", "token_histogram", "turn_histogram")),
                    rows(R.repair_summary(base, R.RepairOptions(split_oversized=2))),
                )
            )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert outs[0] == outs[1]


def test_hot_duplicate_hash(spark):
    """A third of all records are one text: duplicates, dedupe and profile stay exact."""
    n = 3000
    recs = []
    for i in range(n):
        if i % 3 == 0:
            recs.append({"instruction": "same question", "output": "same answer"})
        else:
            recs.append({"instruction": f"question {i}", "output": f"answer {i}"})
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "idx long, value string").repartition(8)
    m = N.to_messages(records_from_lines(lines), "alpaca")
    flags = V.flag_records(m)
    rep = {r.category: (r["count"], r.sample_indices) for r in V.validation_report(flags).collect()}
    assert rep["duplicate_samples"] == (n // 3 - 1, "3,6,9,12,15")
    kept = R.repair(m).collect()
    assert len(kept) == n - (n // 3 - 1)
    assert min(r.idx for r in kept if r.messages[0].content == "same question") == 0
    prof = P.profile(m).collect()[0]
    assert prof.duplicate_examples == n // 3 - 1
    assert prof.num_examples == n
