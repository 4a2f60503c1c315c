"""The last step of the near-copy join: pairs of nodes of different components."""

import numpy as np
import pytest

from trackspark.llm import jaccard


@pytest.mark.parametrize("bucket", [7, 1 << 11])
def test_pairs_of_different_components_that_may_link(spark, monkeypatch, bucket):
    """As all pairs of a token's nodes, one by one; also where a bucket is dealt to pieces. Pairs are no rows before they may link."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    rng, rows, want = np.random.default_rng(5), [], set()
    for token, members in ((1, 2), (2, 40), (3, 23), (4, 5)):
        base, own = rng.integers(0, 2, 1024), []
        for k in range(members):
            bits = base.copy()
            bits[rng.choice(1024, rng.integers(0, 25), replace=False)] ^= 1
            wide = np.packbits(bits.astype(bool), bitorder="little").view("<i8")
            own.append((int(rng.integers(-(1 << 62), 1 << 62)), int(rng.integers(0, 4)), int(rng.integers(180, 220)), int(rng.integers(0, 14)), wide))
        rows += [(token, members, 0, label, node, n, at, *map(int, wide)) for node, label, n, at, wide in own]
        for k, (a, la, na, pa, wa) in enumerate(own):
            for b, lb, nb, pb, wb in own[:k]:
                both = -(-90 * (na + nb) // 190)
                away = int(np.bitwise_count((wa ^ wb).view("<u8")).sum())
                if la != lb and 100 * min(na, nb) >= 90 * max(na, nb) and pa <= na - both and pb <= nb - both and away <= na + nb - 2 * both:
                    want.add((min(a, b), max(a, b), min(la, lb), max(la, lb), away))
    words = ", ".join(f"{c} long" for c in jaccard.WIDE)
    frame = spark.createDataFrame(rows, f"token long, members long, main long, label long, node long, n int, at int, {words}")
    found = jaccard.cross_pairs(frame, 90)
    got = [tuple(r) for r in found.select("a", "b", "low", "high", "away").collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
