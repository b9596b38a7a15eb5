"""Topic trees are built from all entries, whatever their number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import topics


def test_no_entry_is_left_out(spark):
    rows = spark.range(10_050).select(F.format_string("m%05d", "id").alias("id"), F.lit(3).alias("layer"), (F.col("id") % 7 / 7).alias("importance"), F.array(F.lit(1.0), F.col("id") % 5).alias("embedding"), F.array(F.lit("t")).alias("tags"))
    found = topics.entries(rows)
    assert found.agg(F.count_distinct("id"), F.min("idx"), F.max("idx")).first() == (10_050, 0, 10_049)
    members = topics.topic_tree(found)[1]
    assert members.count() == members.select("memory_id").distinct().count() == 10_050


@pytest.mark.parametrize("held", [1, 60, 1 << 22])
def test_products_of_many_entries_at_once_change_no_leaf(monkeypatch, held):
    monkeypatch.setattr(topics, "HELD", held)
    x = np.random.default_rng(2).standard_normal((300, 6))
    x = np.concatenate([x, x[:40] * 2])
    b, own = topics.Builder(x, [set() for _ in x]), []
    for i, v in enumerate(b.x):
        s = [float(leaf.centroid @ v) for leaf in own]
        k = int(np.argmax(s)) if own else -1
        if own and s[k] >= b.t.topic_assign and (len(own[k].members) < 3 or s[k] >= 0.8 * own[k].avg_sim):
            n = len(own[k].members)
            own[k] = topics.Leaf([*own[k].members, i], topics.unit((own[k].centroid * n + v) / (n + 1)), (own[k].avg_sim * n + s[k]) / (n + 1))
        else:
            own.append(topics.Leaf([i], v.copy()))
    b.insert_all()
    assert [leaf.members for leaf in b.leaves] == [leaf.members for leaf in own] and len(own) > 20
    b.absorb()
    assert sorted(m for leaf in b.leaves for m in leaf.members) == list(range(len(x)))
