"""The near-dedup stage against all pairs at 80 %."""

import random

from test_pipeline import ids, plain_kept as kept

import corpus_pipeline
from quillspark.llm import near_dedup


def test_pairs_on_both_sides_of_80_percent(spark):
    rng = random.Random(8)
    rows = []
    for i in range(0, 80, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        # 200 shingles; k replaced words far from each other change 5 k of them.
        k = 3 + i // 2 % 3  # similarities 0.86, 0.818 and 0.778
        other = [f"{w}!" if j % 20 == 10 and j // 20 < k else w for j, w in enumerate(words)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(kept(rows, 80)) < len(kept(rows, 85))
    assert ids(corpus_pipeline.near_duplicates(spark, df, "")) == kept(rows, 80)
    assert ids(near_dedup.deduplicated(df)) == kept(rows, 85)
