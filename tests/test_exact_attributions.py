import numpy as np
import pytest

from cohortspark.plans import attribution, backmapping
from cohortspark.runtime import cut


def test_exact_attributions_do_not_mix_rows(spark, monkeypatch):
    """a forest's values come from its leaves; they equal those of all coalitions, for repeated and null keys too."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)).round(1)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] + x[:, 2] > 1)
    rows = [(None if i < 2 else i // 2, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))]
    frame = cut(spark.createDataFrame(rows, "id long, a double, b double, c double, d double, cluster_label int"))
    model = backmapping.train(frame, ["a", "b", "c", "d"], trees=4)
    placed, background, _, _ = attribution._background(model, frame, "id", "cluster_label", 7, 42)
    want = {(r["id"], r["truth"], r["class"]): r for r in attribution._by_coalitions(model, placed, background, "id").collect()}
    scored = []
    whole = model.probabilities
    monkeypatch.setattr(model, "probabilities", lambda df, *a, **b: scored.append(df.count()) or whole(df, *a, **b))
    got = attribution.exact_attributions(model, frame, "id", n_background=7).collect()
    assert max(scored) == 7 and len(got) == 4 * len(want)
    for r in got:
        assert r["phi"] == pytest.approx(want[r["id"], r["cluster"], r["class"]][f"_{'abcd'.index(r['feature'])}"], abs=1e-9)
