import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.functions import vectors
from trapline.operators import inference, memory, metrics, probe, scoring


def pairs(spark, x1, x2, batch=0):
    rows = [(batch, i, list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(zip(x1, x2))]
    return spark.createDataFrame(rows, "batch_id bigint, pos bigint, x1 array<double>, x2 array<double>")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values])


@pytest.mark.parametrize("a, b, want", [((1, 0), (0, 1), 0.5), ((1, 0), (1, 0), 0.0), ((0, 0), (1, 0), 0.5)])
def test_cosine_distance(spark, a, b, want):
    assert one(spark, vectors.cosine_distance(vec(*a), vec(*b))) == pytest.approx(want)


def test_normalize_and_softmax(spark):
    assert one(spark, vectors.l2_normalize(vec(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.l2_normalize(vec(0, 0))) == [0.0, 0.0]
    weights = one(spark, scoring.softmax_weights(vec(1000, 1000, 999), 0.5))
    assert weights == pytest.approx((np.exp([0, 0, -2]) / np.exp([0, 0, -2]).sum()).tolist())


def test_alignment_of_equal_views(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0], [3.0, 1.0], [3.0, 1.0])], "p1 array<double>, z2 array<double>, p2 array<double>, z1 array<double>")
    assert scoring.alignment_score(rows).first().loss == pytest.approx(-1.0)


def test_contrastive_loss_by_hand(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=(3, 4)), rng.normal(size=(3, 4))
    x = np.vstack([x1, x2])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T / 0.5
    losses = [math.log(sum(math.exp(s[i, j]) for j in range(6) if j != i)) - s[i, (i + 3) % 6] for i in range(6)]
    row = scoring.nt_xent_score(pairs(spark, x1, x2)).first()
    assert row.n_pairs == 3 and row.loss == pytest.approx(np.mean(losses))


def test_contrastive_loss_of_a_single_pair(spark):
    """First row: its own score is 1/T and is the target. Second row: the masked self leaves no loss."""
    row = scoring.nt_xent_score(pairs(spark, [[1, 0]], [[0, 1]])).first()
    want = (math.log(math.exp(2) + math.exp(0)) - 2) / 2
    assert row.loss == pytest.approx(want)


def test_triplet_hinge_by_hand(spark):
    """d+ = 0; the negative decides: at distance 0.5 no loss, at 0.1 a loss of 0.2."""
    far = math.acos(1 - 2 * 0.1)
    for angle, want in ((math.pi / 2, 0.0), (far, 0.2)):
        hinge = F.greatest(F.lit(0.3) - vectors.cosine_distance(vec(1, 0), vec(math.cos(angle), math.sin(angle))), F.lit(0.0))
        assert one(spark, hinge) == pytest.approx(want)


def test_triplet_masks_the_anchor_but_counts_it(spark):
    rows = pairs(spark, np.eye(4), np.eye(4))
    drawn = {r.pos: r for r in scoring.negative_random(rows).collect()}
    want = []
    for pos, r in drawn.items():
        if r.is_anchor:
            want.append(0.0)
        else:
            want.append(max(0.3 - (0.0 if r.neg_at % 4 == pos else 0.5), 0.0))
    assert scoring.triplet_score(rows).first().loss == pytest.approx(np.mean(want))
    masked = scoring.triplet_score(rows, mask_positive=True).first().loss
    assert masked == pytest.approx(0.0)


def test_hard_negatives_leave_out_self_even_with_duplicates(spark):
    x = [[1, 0], [1, 0], [0.9, 0.1], [0, 1]]
    rows = pairs(spark, x, x)
    top = {(r.pos, r.rank): r.other_pos for r in scoring.topk_similar(rows).collect()}
    assert top[0, 0] == 1 and top[1, 0] == 0 and top[0, 1] == 2 and len(top) == 8
    picked = scoring.negative_hard(rows).collect()
    assert len(picked) == 4 and all(r.pos != r.neg_pos for r in picked)
    assert scoring.topk_similar(pairs(spark, x[:1], x[:1])).count() == 0
    assert scoring.triplet_hard_score(pairs(spark, x[:1], x[:1])).first().loss is None


def test_batches_are_full_and_dense(spark):
    rows = scoring.make_batches(spark.range(1000), "id", 64)
    sizes = {r.batch_id: (r.n, r.lo, r.hi) for r in rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()}
    assert [sizes[b][0] for b in range(16)] == [64] * 15 + [40]
    assert all(lo == 0 and hi == n - 1 for n, lo, hi in sizes.values())


def reference_memory(updates, start=None):
    state = dict(start or {})
    for key, _, x in sorted(updates, key=lambda u: (u[0], u[1])):
        x = np.array(x) / np.linalg.norm(x)
        v = 0.9 * np.array(state.get(key, np.zeros(len(x)))) + 0.1 * x
        state[key] = v / np.linalg.norm(v)
    return state


def test_memory(spark):
    rng = np.random.default_rng(5)
    updates = [(int(k), s, rng.normal(size=3).tolist()) for k in range(40) for s in range(int(rng.integers(1, 9)))]
    updates += [(99, s, rng.normal(size=3).tolist()) for s in range(500)]
    rng.shuffle(updates)
    updates = [(int(k), int(s), [float(v) for v in x]) for k, s, x in updates]
    table = spark.createDataFrame(updates, "id bigint, step int, emb array<double>")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "7"):  # a key's updates also continue over batch borders
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = {r.id: r.emb for r in memory.ema_memory(table).collect()}
            want = reference_memory(updates)
            assert found.keys() == want.keys()
            assert all(found[k] == pytest.approx(want[k].tolist()) for k in want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    first = spark.createDataFrame([(1, 0, [3.0, 4.0])], "id bigint, step int, emb array<double>")
    assert memory.ema_memory(first).first().emb == pytest.approx([0.6, 0.8])
    initial = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, emb array<double>")
    moved = {r.id: r.emb for r in memory.ema_memory(first, initial=initial).collect()}
    want = reference_memory([(1, 0, [3.0, 4.0])], {1: [1.0, 0.0], 2: [0.0, 1.0]})
    assert moved[1] == pytest.approx(want[1].tolist()) and moved[2] == [0.0, 1.0]


def test_meters_and_accuracy(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 1), ("a", 2, 4.0, 2)], "name string, step int, val double, n int")
    assert metrics.weighted_meter(rows).first().avg == 3.0
    assert [r.avg for r in metrics.running_weighted_meter(rows).orderBy("step").collect()] == [1.0, 3.0]
    guesses = spark.createDataFrame([(0, 0), (0, 0), (0, 0), (1, 0)], "y_true int, y_pred int")
    assert metrics.accuracy(guesses).first()[0] == 75.0 and metrics.balanced_accuracy(guesses).first()[0] == 50.0


def test_projection_head_with_normalization(spark):
    rng = np.random.default_rng(1)
    norm = inference.BatchNorm(*(rng.random(5) + 0.5 for _ in range(4)))
    head = inference.Head(rng.normal(size=(5, 3)), rng.normal(size=5), rng.normal(size=(2, 5)), rng.normal(size=2), norm)
    x = rng.normal(size=(700, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    found = {r.id: r.emb for r in inference.projection_head(rows, head, "v", ["id"]).collect()}
    hidden = x @ head.w1.T + head.b1
    hidden = (hidden - norm.mean) / np.sqrt(norm.var + 1e-5) * norm.gamma + norm.beta
    want = np.maximum(hidden, 0) @ head.w2.T + head.b2
    assert np.allclose([found[i] for i in range(700)], want, atol=1e-4)


def test_a_model_of_the_wrong_width_is_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, v array<double>")
    with pytest.raises(Exception, match="expected"):
        inference.extract_features(rows, lambda x: x, 3, "v", ["id"]).collect()


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(7)
    centres = np.eye(3, 6) * 4
    rows = [(i, (centres[i % 3] + rng.normal(size=6)).tolist(), f"c{i % 3}", f"l{i % 2}", i % 4 == 0, i % 60 < 3, i % 10 < 3) for i in range(360)]
    table = spark.createDataFrame(rows, "id bigint, features array<double>, label string, location string, test boolean, p1 boolean, p10 boolean").cache()
    return table.where(~F.col("test")), table.where("test")


def test_probe_learns_a_separable_table(separable):
    scores = probe.linear_probe(*separable)
    assert scores["test_acc"] > 95 and scores["test_acc_bal"] > 95


def plain_fit(x, y, classes, c, rounds=6000):
    """The weights and intercepts that minimize c * sum(loss) + |w|^2 / 2, by plain gradient steps."""
    w, b, step = np.zeros((classes, x.shape[1])), np.zeros(classes), 0.5 / (1 + c * len(x) * 0.5)
    for _ in range(rounds):
        p = np.exp(x @ w.T + b)
        p /= p.sum(axis=1, keepdims=True)
        gap = p - np.eye(classes)[y]
        w -= step * (c * gap.T @ x + w)
        b -= step * c * gap.sum(axis=0)
    return w, b


def prepared(train, test):
    """Standardized unit rows and codes of both tables, sorted by id, and the ids of the training rows."""
    train, test = (sorted(t.collect(), key=lambda r: r.id) for t in (train, test))
    raw = [np.array([r.features for r in t]) for t in (train, test)]
    scaled = [(r - raw[0].mean(axis=0)) / raw[0].std(axis=0, ddof=1) for r in raw]
    x = [s / np.linalg.norm(s, axis=1, keepdims=True) for s in scaled]
    return x, [np.array([int(r.label[1:]) for r in t]) for t in (train, test)], [r.id for r in train]


def test_probe_matches_a_direct_minimization(separable):
    """The fitted weights minimize C * sum(loss) + 0.5 * ||w||^2 over the scaled rows."""
    fits, _, _ = probe.fit_probes(*separable, "id", [probe.Task("label")], c=0.1)
    (x, _), (y, _), _ = prepared(*separable)
    w, b = plain_fit(x, y, 3, 0.1)
    assert fits[0].converged and np.allclose(fits[0].weights[:, :-1], w, atol=5e-3)
    assert np.allclose(np.diff(fits[0].weights[:, -1]), np.diff(b), atol=5e-3)


def noisy(spark):
    """Classes that overlap, so that strengths differ in their fold accuracies."""
    rng = np.random.default_rng(11)
    centres = np.eye(3, 8) * 1.2
    rows = [(i, (centres[i % 3] + rng.normal(size=8)).tolist(), f"c{i % 3}", f"l{i % 2}", i % 5 == 0, i % 3 != 1 or i < 150) for i in range(300)]
    table = spark.createDataFrame(rows, "id bigint, features array<double>, label string, location string, test boolean, p1 boolean").cache()
    return table.where(~F.col("test")), table.where("test")


def test_grid_and_accuracies_as_plain_fits(spark):
    """Fold means, the chosen strength, and both accuracies, against plain fits of every fold."""
    train, test = noisy(spark)
    grid, folds = (0.01, 0.3, 10.0), 3
    fits, results, means = probe.fit_probes(train, test, "id", [probe.Task("label")], grid=grid, folds=folds)
    (x, held), (y, truth), ids = prepared(train, test)
    dealt = {r.id: r.fold for r in probe.stratified_folds(train, "id", "label", folds).collect()}
    fold = np.array([dealt[i] for i in ids])
    want = {}
    for c in grid:
        scores = []
        for f in range(folds):
            w, b = plain_fit(x[fold != f], y[fold != f], 3, c)
            scores.append(((x[fold == f] @ w.T + b).argmax(axis=1) == y[fold == f]).mean() * 100)
        want[c] = np.mean(scores)
    assert means[0] == pytest.approx(want)
    best = max(grid, key=lambda c: want[c])
    assert fits[0].c == results[0]["c"] == best
    w, b = plain_fit(x, y, 3, best)
    hit = (held @ w.T + b).argmax(axis=1) == truth
    assert results[0]["test_acc"] == pytest.approx(hit.mean() * 100)
    assert results[0]["test_acc_bal"] == pytest.approx(np.mean([hit[truth == k].mean() for k in range(3)]) * 100)


def test_side_by_side_as_one_by_one(spark, monkeypatch):
    """Several targets and budgets in one go give what each gives alone, also in many passes and many blocks."""
    from trapline.operators import blocked_fit

    train, test = noisy(spark)
    tasks = [probe.Task("label"), probe.Task("label", "p1"), probe.Task("location", "p1")]
    grid = (0.1, 1.0)
    _, alone, _ = zip(*[probe.fit_probes(train, test, "id", [t], grid=grid, folds=3) for t in tasks])
    monkeypatch.setattr(blocked_fit, "BLOCK_BYTES", 700)
    monkeypatch.setattr(blocked_fit, "PASS_BYTES", 300)
    monkeypatch.setattr(blocked_fit, "SHARES", 2)
    _, together, _ = probe.fit_probes(train.repartition(5), test, "id", tasks, grid=grid, folds=3)
    assert together == [r[0] for r in alone]
    assert together[1]["n_train"] == train.where("p1").count() and together[0]["n_train"] == train.count()


def test_classes_that_a_sample_lacks(spark):
    """A class only in the test rows is never predicted, one of a single row is learned where it is; null labels stay out."""
    rows = [(i, [float(i % 2), 1.0 - i % 2, 0.1 * i], f"c{i % 2}", i < 20) for i in range(24)]
    rows += [(30, [5.0, 5.0, 1.0], "only", False), (31, [-3.0, -3.0, 0.0], "single", True), (32, [0.0, 0.0, 0.0], None, True)]
    table = spark.createDataFrame(rows, "id bigint, features array<double>, label string, train boolean")
    got = probe.linear_probe(table.where("train"), table.where(~F.col("train")), grid_search=True)
    assert (got["n_train"], got["n_test"], got["n_classes"]) == (21, 5, 4)
    assert got["test_acc"] == pytest.approx(80.0) and got["test_acc_bal"] == pytest.approx(200 / 3)
    one = table.where("id = 31")
    assert probe.linear_probe(one, table.where(~F.col("train")), grid_search=True)["c"] == probe.C_GRID[0]


def test_evaluation_joins_by_key_and_writes_results(spark, tmp_path, separable):
    """The plan takes a dataset's splits, the sample flags and features by key, list parts once."""
    from trapline.plans import evaluation

    rows = separable[0].unionByName(separable[1])
    context = rows.select(
        F.concat(F.lit("p"), "id").alias("img_path"), F.when(F.col("test"), "test").otherwise("train").alias("img_set"),
        F.col("label").alias("species"), "location", F.col("p1").alias("is_in_train_1perc"), F.col("p10").alias("is_in_train_10perc"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("list_part"),
    ).unionByName(spark.createDataFrame([("none", "train", "c0", "l0", True, True, 0)], "img_path string, img_set string, species string, location string, is_in_train_1perc boolean, is_in_train_10perc boolean, list_part int"))
    features = rows.select(F.concat(F.lit("p"), "id").alias("img_path"), "features")
    path = str(tmp_path / "results")
    found = evaluation.evaluate(context, features, "serengeti", path=path, settings={"run": 1}, grid_search=False)
    got = {(r.target, r.split_pct, r.metric): r.value for r in found.collect()}
    train = separable[0]
    assert got["species", 1, "n_train"] == train.where("p1").count() and got["location", 10, "n_train"] == train.where("p10").count()
    assert got["species", 100, "n_train"] == 270 and got["species", 100, "test_acc"] > 95
    written = spark.read.json(path)
    assert written.count() == found.count() and '"run": 1' in written.first().settings


def test_standardized_training_rows(separable):
    from pyspark.ml.functions import vector_to_array

    train, _ = probe.standardize(*separable)
    z = np.array([r.z for r in train.select(vector_to_array("scaled").alias("z")).collect()])
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9) and np.allclose(z.std(axis=0, ddof=1), 1)


def test_grid_folds_and_budgets(separable):
    train, test = separable
    folds = probe.stratified_folds(train, "id", "label").groupBy("label", "fold").count().collect()
    assert len(folds) == 15 and {r["count"] for r in folds} == {18}
    result = probe.probe_by_target(
        train, test, ["label", "location"], budgets={1: "p1", 10: "p10", 100: None}, max_iter=20
    ).collect()
    values = {(r.target, r.split_pct, r.metric): r.value for r in result}
    assert len(values) == 2 * 3 * 7 and values["label", 100, "test_acc"] > 95 and values["location", 100, "test_acc"] < 75


def test_grid_search_picks_the_first_best(separable):
    train, _ = separable
    best, means = probe.probe_grid_search(train, "id", grid=(0.01, 1.0), folds=3, max_iter=30)
    assert set(means) == {0.01, 1.0} and best == max((0.01, 1.0), key=means.get)


def test_registered_target_probe_searches(spark, separable, monkeypatch):
    """Every fit of the query takes the strength with the greatest mean of its folds."""
    from trapline.checks import vector_checks

    seen, fit = [], probe.fit_probes

    def watched(*args, **options):
        out = fit(*args, **options)
        seen.append((options["grid"], [f.c for f in out[0]], out[2]))
        return out

    names = {"p1": "is_in_train_1perc", "p10": "is_in_train_10perc", "id": "img_path", "label": "species", "location": "region"}
    parts = tuple(part.withColumnsRenamed(names) for part in separable)
    monkeypatch.setattr(vector_checks.evaluation, "probe_rows", lambda *_: parts)
    monkeypatch.setattr(vector_checks, "labelled_crops", lambda *_: None)
    monkeypatch.setattr(vector_checks, "crop_features", lambda *_: None)
    monkeypatch.setattr(probe, "fit_probes", watched)
    rows = vector_checks.probe_targets(spark, "").collect()
    (grid, chosen, means), = seen
    assert grid == probe.C_GRID and chosen == [max(grid, key=m.get) for m in means] and len(chosen) == 6
    assert {r.metric for r in rows} == {"n_train", "n_test", "n_classes", "converged", "test_acc", "test_acc_bal"}


def test_large_problems_begin_on_a_share_of_their_rows(spark, monkeypatch):
    """They end at the same optimum, after fewer passes over all rows, and a small problem reads a table of its own."""
    from trapline.operators import blocked_fit

    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 4))
    label = (x @ rng.normal(size=(4, 3)) + rng.gumbel(size=(4000, 3))).argmax(axis=1)
    rows = [(i, v.tolist(), f"c{k}", i % 10 == 0) for i, (v, k) in enumerate(zip(x, label))]
    train = spark.createDataFrame(rows, "id bigint, features array<double>, label string, few boolean").repartition(4).cache()
    passes = []

    def counted(blocks, asked, plain=blocked_fit.gradients):
        found = plain(blocks, asked)
        passes.append((max(seen for *_, seen in found), len(asked)))
        return found

    monkeypatch.setattr(blocked_fit, "gradients", counted)
    tasks = [probe.Task("label"), probe.Task("label", "few")]
    want, scores, _ = probe.fit_probes(train, train, "id", tasks)
    plain = sum(n for seen, n in passes if seen == 4000)
    passes.clear()
    monkeypatch.setattr(blocked_fit, "LEAST_ROWS", 50)
    found, same, _ = probe.fit_probes(train, train, "id", tasks)
    assert sum(n for seen, n in passes if seen == 4000) < plain / 2
    assert all(n == 1 for _, n in passes)  # the small problem is not in the passes of the large one
    for a, b in zip(found, want):
        assert a.converged and np.abs(a.weights[:, :-1] - b.weights[:, :-1]).max() < 2e-3
    assert [s["n_train"] for s in same] == [s["n_train"] for s in scores] == [4000, 400]
    train.unpersist()


def test_a_task_holds_few_blocks(spark, monkeypatch):
    """Blocks of one file lie in row groups of a few blocks each, and so do those of a share of the rows."""
    import pyarrow.parquet as pq

    from trapline import session
    from trapline.operators import blocked_fit

    monkeypatch.setitem(session.LARGE_ROWS, "parquet.block.size", "20000")
    monkeypatch.setattr(blocked_fit, "BLOCK_BYTES", 8_000)
    rows = spark.range(5_000).select(F.array(*[F.col("id") * 1.0 + k for k in range(4)]).alias("x"), F.array(F.lit(0)).alias("y"), F.array(F.lit(1)).alias("fold"))
    blocks = blocked_fit.packed(rows.coalesce(1), "x", 4, 1, 1)
    for own in (blocks, blocked_fit.thinned(blocks, 2, 0)):
        groups = sum(pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in own.table.inputFiles())
        assert groups >= own.table.count() // 8 > 0
