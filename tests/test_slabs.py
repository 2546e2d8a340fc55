"""Boosting in slabs against a plain single-machine version."""

import numpy as np
import pandas as pd
import pytest
from conftest import hourly, to_spark

from voltloom.operators import slabs
from voltloom.operators.boosting import BoostConfig, best_round

CONFIG = BoostConfig(
    max_depth=3, n_estimators=60, learning_rate=0.3, min_train_size=60, val_size=40, step=40, patience=4, min_child_weight=4, subsample=1.0, colsample=1.0, min_val_rows=12
)


def table(rows=(160, 140), seed=0):
    rng = np.random.default_rng(seed)
    parts = []
    for z, n in enumerate(rows):
        f = pd.DataFrame({"zone": f"z{z}", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "u": rng.normal(size=n), "v": rng.integers(0, 5, n).astype(float)})
        f["price"] = 3 * np.sign(f.u) + f.v + rng.normal(0, 0.5, n)
        parts.append(f)
    return pd.concat(parts, ignore_index=True)


def soft(g):
    return np.sign(g) * max(abs(g) - slabs.ALPHA, 0)


def plain_tree(x, left, config, depth):
    """Nested (input, cut, low side, high side), or a leaf's weight."""
    g, h = left.sum(), len(left)
    weight = config.learning_rate * soft(g) / (h + slabs.LAMBDA)
    best = (1e-9, None)
    worth = lambda s: soft(s.sum()) ** 2 / (len(s) + slabs.LAMBDA)
    for f in range(x.shape[1]):
        for b in range(int(x[:, f].max())) if depth else ():
            low = x[:, f] <= b
            if min(low.sum(), (~low).sum()) >= config.min_child_weight:
                gain = worth(left[low]) + worth(left[~low]) - worth(left)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, b, low))
    if best[1] is None:
        return weight
    f, b, low = best[1]
    return f, b, plain_tree(x[low], left[low], config, depth - 1), plain_tree(x[~low], left[~low], config, depth - 1)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_boost(x, y, other, rounds, config):
    """Predictions for ``other`` after each round."""
    past, out = np.full(len(y), y.mean()), [np.full(len(other), y.mean())]
    for _ in range(rounds):
        tree = plain_tree(x, y - past, config, config.max_depth)
        past = past + np.array([plain_value(tree, r) for r in x])
        out.append(out[-1] + np.array([plain_value(tree, r) for r in other]))
    return out


def test_slabs_against_a_plain_version(spark):
    frame = table()
    got = slabs.tune_and_fit(to_spark(spark, frame).repartition(3), ["u", "v"], CONFIG, slab=3)
    cuts = got.model.cuts
    assert cuts[1].tolist() == [0, 1, 2, 3] and len(cuts[0]) <= slabs.CUTS
    x = slabs.binned(frame[["u", "v"]].to_numpy(), cuts).astype(int)
    y, pos, total = frame.price.to_numpy(), frame.groupby("zone").cumcount().to_numpy(), frame.groupby("zone").zone.transform("size").to_numpy()
    limit = total - np.maximum((total * 0.1).astype(int), CONFIG.val_size)
    best = []
    for r in got.folds.orderBy("fold").collect():
        train, val = (pos < limit) & (pos < r.train_end), (pos < limit) & (pos >= r.train_end) & (pos < r.train_end + CONFIG.val_size)
        losses = [((y[val] - p) ** 2).mean() for p in plain_boost(x[train], y[train], x[val], r.rounds_grown, CONFIG)[1:]]
        k = best_round(losses, CONFIG.patience)
        assert (r.val_rows, r.best_round) == (val.sum(), k) and r.loss == pytest.approx(losses[k])
        assert r.best_round + CONFIG.patience < r.rounds_grown <= min(60, r.best_round + CONFIG.patience + 3) or r.rounds_grown == 60
        best.append(k)
    assert len(best) >= 2 and got.rounds == int(np.mean(best)) + 5 == len(got.model.trees)
    train = pos < limit
    want = plain_boost(x[train], y[train], x, got.rounds, CONFIG)[-1]
    scored = got.model.score(to_spark(spark, frame)).toPandas().sort_values(["zone", "ts"])
    np.testing.assert_allclose(scored.y_pred, want, rtol=1e-9)
    held = got.held.toPandas()
    assert len(held) == (~train).sum() and ((held.price - held.y_pred) ** 2).mean() < 1.0


def test_slab_length_makes_no_difference_and_reruns_agree(spark):
    df = to_spark(spark, table(seed=2)).coalesce(2)
    config = BoostConfig(**{**CONFIG.__dict__, "subsample": 0.7, "colsample": 0.5, "n_estimators": 9, "patience": 50})
    cuts = slabs.cut_points(df, ["u", "v"])
    runs = [slabs.tune_and_fit(df, ["u", "v"], config, cuts=cuts, slab=n, together=t) for n, t in ((2, 16), (9, 16))]
    a, b = (r.folds.toPandas() for r in runs)
    pd.testing.assert_frame_equal(a, b)
    assert (a.rounds_grown == 9).all()


def test_missing_inputs_and_too_few_rows(spark):
    frame = table((90,))
    model = slabs.fit_rounds(to_spark(spark, frame), ["u", "v"], CONFIG, 3)
    odd = to_spark(spark, frame.assign(u=frame.u.where(frame.index % 2 == 0)))
    got = model.score(odd).toPandas()
    assert got.y_pred.isna().tolist() == got.u.isna().tolist()
    with pytest.raises(ValueError, match="more rows"):
        slabs.tune_and_fit(to_spark(spark, table((50,))), ["u", "v"], CONFIG)


def test_price_series(spark):
    frame = hourly(200, ("A", "B"))
    frame["lag"] = frame.groupby("zone").price.shift(24)
    got = slabs.tune_and_fit(to_spark(spark, frame), ["lag", "load", "gen_solar"], BoostConfig(**{**CONFIG.__dict__, "n_estimators": 20}))
    held = got.held.toPandas()
    assert abs(held.price - held.y_pred).mean() < abs(held.price - frame.price.mean()).mean() / 2
