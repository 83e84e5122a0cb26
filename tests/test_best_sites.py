import math

import numpy as np

from terravane.plans import surveys
from terravane.plans.surveys import QUERIES

TYPES = "survey_id string, i bigint, j bigint, score double"


def greedy(rows):
    chosen = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if len(chosen) < 5 and all(math.hypot(r[1] - c[1], r[2] - c[2]) * 2.5 >= 25 for c in chosen):
            chosen.append(r)
    return {(r[0], f"SITE-{chr(65 + n)}", *r[1:]) for n, r in enumerate(chosen)}


def test_sites_equal_greedy_choice_over_all_cells(spark, monkeypatch):
    rng = np.random.default_rng(1)
    # the block next to the best cell has its own best within 25 m of it and its second best outside
    rows = [("near", 0, 4, 100.0), ("near", 0, 13, 99.0), ("near", 0, 14, 98.0), ("near", 30, 0, 50.0)]
    rows += [("many", i, j, float(s)) for i in range(40) for j, s in enumerate(np.round(rng.uniform(0, 9, 40), 1))]
    monkeypatch.setattr(surveys, "i04", lambda spark, d: spark.createDataFrame(rows, TYPES))
    found = {(r.survey_id, r.site, r.i, r.j, r.score) for r in QUERIES["i06_best_sites"](spark, "").collect()}
    assert found == greedy(rows[:4]) | greedy(rows[4:])
