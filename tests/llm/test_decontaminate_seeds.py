"""Seeds find every pattern of substitutions that the rule allows."""

import random
from itertools import combinations

import numpy as np
import pytest

from netweir.llm import decontaminate

from .helpers import frame


@pytest.mark.parametrize("n,percent", [*((n, 80) for n in range(5, 14)), *((n, p) for n in (6, 9, 13, 20) for p in (70, 90, 100))])
def test_a_mask_fits_between_all_substitutions(n, percent):
    masks = decontaminate.masks_of(n, percent)
    for gone in combinations(range(n), n * (100 - percent) // 100):
        assert any(all(mask[j] == "0" or o + j not in gone for j in range(len(mask))) for mask in masks for o in range(n - len(mask) + 1)), gone


def test_short_items_with_substitutions_are_found(spark):
    rng = random.Random(31)
    items, rows, want = [], [], set()
    for n in range(5, 14):
        words = [f"i{n}x{j}" for j in range(n)]
        items.append((n, " ".join(words)))
        for k in range(n * 20 // 100 + 2):  # one more than allowed stays clean
            patterns = list(combinations(range(n), k))
            for gone in patterns if k <= n * 20 // 100 else rng.sample(patterns, 5):
                text = " ".join("zz" if j in gone else w for j, w in enumerate(words))
                rows.append((len(rows), f"before it {text} behind it", "s", 1))
                if k <= n * 20 // 100:
                    want.add(len(rows) - 1)
    got = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in got if r.contaminated} == want
    assert len(want) > 250 and len(rows) - len(want) == 45
    assert np.all([r.n_items == r.contaminated for r in got])
