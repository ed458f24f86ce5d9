"""Keys of wide fingerprints against plain numbers, the size of their plan, and joins of fingerprints."""

import numpy as np

from mistveil.llm.simhash import LONGS, WIDE, Ring, similar_prints


def rows_of(spark, n: int):
    longs = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, (n, LONGS), dtype=np.int64)
    frame = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(longs)], "node long, " + ", ".join(f"f{k} long" for k in range(LONGS)))
    return longs, frame


def test_keys_are_turned_fingerprints(spark):
    longs, frame = rows_of(spark, 5)
    for ring in (Ring(8, 13, 0.15), Ring(20, 16, 0.15), Ring(9, 1, 0.15)):
        got = {(r.node, r.key >> ring.bits): r for r in ring.keyed(frame, "node").collect()}
        assert len(got) == 5 * ring.places
        for node, f in enumerate(longs):
            whole, keys = sum((int(x) & (1 << 64) - 1) << 64 * (LONGS - 1 - k) for k, x in enumerate(f)), []
            for place in range(ring.places):
                by = place * WIDE // ring.places
                turned = (whole << by | whole >> (WIDE - by)) & (1 << WIDE) - 1
                row = got[node, place]
                assert [getattr(row, f"r{k}") & (1 << 64) - 1 for k in range(LONGS)] == [turned >> 64 * (LONGS - 1 - k) & (1 << 64) - 1 for k in range(LONGS)]
                assert row.earlier == keys
                keys.append(place << ring.bits | turned >> WIDE - ring.bits)
                assert row.key == keys[-1]


def test_plan_does_not_grow_with_places(spark):
    _, frame = rows_of(spark, 1)
    size = lambda places: len(Ring(8, places, 0.15).keyed(frame, "node")._jdf.queryExecution().optimizedPlan().toJSON())
    assert size(400) < 1.1 * size(4)


def test_index_of_fingerprints_is_not_broadcast(spark):
    prints = spark.range(40).selectExpr("id AS fp")
    for hot_bucket in (1 << 15, 4):
        plan = similar_prints(prints, hot_bucket)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [key" in plan and "bit_count" in plan
        assert not [line for line in plan.splitlines() if "Broadcast" in line and "bit_count" in line]
