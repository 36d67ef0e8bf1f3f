"""Queries and SQL for vectors, batch scores, the memory, metrics and the linear probe."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trapline.checks import fixtures as fx
from trapline.checks.context_checks import SAMPLE_SQL
from trapline.checks.curation_checks import near, whole
from trapline.checks.fixtures import CROPS_SQL
from trapline.functions import vectors
from trapline.operators import encoding, features, inference, memory, metrics, probe, sampling, scoring
from trapline.operators.positives import RUN_SEED
from trapline.plans import evaluation

DIM = 64
EMA_KEYS = 100
HIDDEN, OUT, CLASSES = 16, 8, 10
CATEGORIES = 25


def embeddings(spark, d):
    return fx.table(spark, d, "embeddings")


def spread(column):
    """Every entry of a vector as a column."""
    return [near(F.col(column)[i], f"v{i}") for i in range(DIM)]


def spread_sql(expr: str) -> str:
    return ", ".join(f"floor(({expr}[{i + 1}]) * 1e6 + 0.5e0) / 1e6 as v{i}" for i in range(DIM))


def unit_rows(spark, d):
    tripled = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda v: v * 3).alias("e"))
    return tripled.select("vec_id", vectors.l2_normalize(F.col("e")).alias("e")).select("vec_id", *spread("e"))


def distances(spark, d):
    return fx.pairs(spark, d).select(
        "batch_id", "pos", near(vectors.cosine_distance(F.col("x1"), F.col("x2")), "distance")
    )


def entries(rows, column):
    """Every entry of a matrix, with its row and column."""
    long = rows.select("batch_id", "pos", F.posexplode(column).alias("other", "v"))
    return long.select("batch_id", "pos", whole("other"), near(F.col("v"), "v"))


def cosine_rows(spark, d):
    return entries(scoring.pairwise_cosine(fx.pairs(spark, d)), "cosines")


def softmax_rows(spark, d):
    rows = scoring.pairwise_cosine(fx.pairs(spark, d))
    return entries(rows.withColumn("w", scoring.softmax_weights(F.col("cosines"), scoring.TEMPERATURE)), "w")


def class_logits(spark, d):
    """Ten logits per vector, its first ten entries, and its label; a label of every 50th row is missing."""
    return embeddings(spark, d).select(
        F.floor(F.col("vec_id") / fx.BATCH).alias("batch_id"), F.slice(F.col("embedding").cast("array<double>"), 1, CLASSES).alias("logits"),
        F.when(F.col("vec_id") % 50 != 7, F.pmod(F.col("vec_id"), F.lit(CLASSES))).alias("label"),
    )


def cross_entropy(spark, d):
    return scoring.cross_entropy_score(class_logits(spark, d)).select("batch_id", whole("n_rows"), near(F.col("loss"), "loss"))


def context_rows(spark, d):
    items = encoding.location_encode(features.time_normalize(features.year_scale(fx.items(spark, d))))
    cyclic = [
        p for s in ("day", "hour", "minute", "second") for p in features.cyclic_encode(F.col(f"{s}_share"))
    ]
    return items.select(
        F.floor(F.col("vec_id") / fx.BATCH).alias("batch_id"), (F.col("vec_id") % fx.BATCH).alias("pos"),
        F.array("year_scaled", *cyclic).alias("con_time"), "loc_id",
    )


def context_distances(spark, d):
    return entries(scoring.pairwise_context_distance(context_rows(spark, d)), "distances")


def per_batch(scores):
    return scores.select("batch_id", whole("n_pairs"), near(F.col("loss"), "loss"))


def alignment(spark, d):
    p, z = F.col("x1"), F.col("x2")
    views = fx.pairs(spark, d).select(p.alias("p1"), z.alias("z2"), F.reverse(p).alias("p2"), z.alias("z1"))
    return scoring.alignment_score(views).select(near(F.col("loss"), "loss"), whole("n_pairs"))


def ema(spark, d):
    updates = embeddings(spark, d).select(
        (F.col("vec_id") % EMA_KEYS).alias("id"), F.floor(F.col("vec_id") / EMA_KEYS).alias("step"),
        F.col("embedding").alias("emb"),
    )
    return memory.ema_memory(updates).select("id", *spread("emb"))


def predictions(spark, d):
    guess = F.when(F.col("l_quantity") > 20, F.col("l_partkey")).otherwise(F.col("l_suppkey"))
    return fx.table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 25).alias("y_true"), (guess % 25).alias("y_pred")
    )


def meter_values(spark, d):
    """Whole cents, so that sums are exact in any order."""
    return fx.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("step"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("double").alias("val"),
        (F.col("o_orderkey") % 7 + 1).alias("n"),
    )


def head_weights(norm=None):
    """A rule instead of trained weights: w[i, j] = sin(i + 2 j) / 8."""

    def w(n, m):
        return np.sin(np.arange(n)[:, None] + 2.0 * np.arange(m)[None, :]) / 8.0

    return inference.Head(w(HIDDEN, DIM), np.zeros(HIDDEN), w(OUT, HIDDEN), np.zeros(OUT), norm)


def norm_layer():
    """Hidden unit i: mean i / 100, variance 1 + i, scale 2, shift (i - 8) / 10."""
    i = np.arange(HIDDEN, dtype=float)
    return inference.BatchNorm(i / 100, 1 + i, np.full(HIDDEN, 2.0), (i - 8) / 10)


def projected(spark, d, norm=None):
    out = inference.projection_head(embeddings(spark, d), head_weights(norm), "embedding", ["vec_id"])
    return out.select("vec_id", *[near(F.col("emb")[i].cast("double"), f"v{i}", 4) for i in range(OUT)])


def extracted(spark, d):
    """A model that sums neighbouring entries."""
    halves = inference.extract_features(
        embeddings(spark, d), lambda x: x[:, 0::2] + x[:, 1::2], DIM // 2, "embedding", ["vec_id", "label"]
    )
    return halves.select(
        "vec_id", "label", *[near(F.col("features")[i].cast("double"), f"v{i}", 4) for i in range(DIM // 2)]
    )


def split_features(spark, d):
    """Train and test rows by the number."""
    rows = fx.items(spark, d).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label", "location", (F.col("vec_id") % 10 < 2).alias("in_test"),
    )
    return rows.where(~F.col("in_test")), rows.where(F.col("in_test"))


def standardized(spark, d):
    from pyspark.ml.functions import vector_to_array

    train, test = probe.standardize(*split_features(spark, d))
    return train.unionByName(test).withColumn("z", vector_to_array("scaled")).select("id", *spread("z"))


def folds(spark, d):
    rows = embeddings(spark, d)
    return probe.stratified_folds(rows, "vec_id", "label").select("vec_id", whole("fold"))


def labelled_crops(spark, d):
    """Crops with sample flags, and with the region of their nation as a second label."""
    regions = fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("category_id"), F.concat(F.lit("r"), "n_regionkey").alias("region"))
    flagged = sampling.stratified_sample(fx.crops(spark, d))
    return fx.stored(spark, d, "labelled", lambda *_: flagged.join(regions, "category_id"))


def crop_features(spark, d):
    """The embedding that has the number of the crop's category; of every 7th test crop or so, that of the next category."""
    crops = fx.crops(spark, d)
    swapped = (F.conv(F.substring(F.md5("img_path"), 1, 4), 16, 10).cast("bigint") % 7 == 3) & F.col("img_set").endswith("test_images")
    shown = F.when(swapped, (F.col("category_id") + 1) % CATEGORIES).otherwise(F.col("category_id"))
    vectors = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("shown"), F.col("embedding").alias("features"))
    return crops.select("img_path", shown.alias("shown")).join(vectors, "shown").drop("shown")


def comparable(scores):
    """Without the strength that was chosen, and without the accuracies of the smallest budget, whose folds lack classes:
    both depend on the fit, and the tests compare them with plain ones."""
    known = (F.col("metric") != "c") & ((F.col("split_pct") > 1) | ~F.col("metric").startswith("test_acc"))
    return scores.where(known).withColumns({"value": near(F.col("value"), "value"), "split_pct": F.col("split_pct").cast("bigint")})


def probe_once(spark, d):
    train, test = evaluation.probe_rows(labelled_crops(spark, d), crop_features(spark, d), "cct20", ["species"])
    scores = probe.linear_probe(train, test, "img_path", "species")
    rows = [(100, name, float(value)) for name, value in scores.items()]
    return comparable(spark.createDataFrame(rows, "split_pct int, metric string, value double"))


def probe_grid(spark, d):
    train, _ = evaluation.probe_rows(labelled_crops(spark, d), crop_features(spark, d), "cct20", ["species"])
    best, means = probe.probe_grid_search(train.where("is_in_train_10perc"), "img_path", "species")
    rows = [(c, mean, c == best) for c, mean in means.items()]
    return spark.createDataFrame(rows, "c double, mean double, is_best boolean").groupBy().agg(
        F.count("*").alias("n_tried"), F.min("c").alias("least"), F.max("c").alias("most"), F.max("mean").alias("best_mean"),
        F.min(F.when(F.col("mean") == F.lit(max(means.values())), F.col("c"))).alias("first_best"),
        F.min(F.when(F.col("is_best"), F.col("c"))).alias("chosen"),
    ).select("n_tried", "least", "most", "best_mean", (F.col("chosen") == F.col("first_best")).alias("is_first"))


def probe_budgets(spark, d):
    train, test = evaluation.probe_rows(labelled_crops(spark, d), crop_features(spark, d), "cct20", ["species"])
    return comparable(probe.probe_by_label_budget(train, test, "img_path", "species", grid_search=True))


def probe_targets(spark, d):
    return comparable(evaluation.evaluate(labelled_crops(spark, d), crop_features(spark, d), "cct20", ["species", "region"]))


def probe_sql(targets: list[str], budgets: dict[int, str]) -> str:
    """Counts and accuracies by the labels of the vectors that the rows show: rows that show the same vector are alike, so
    a probe that has seen its label predicts the label of the category whose vector a row shows."""
    parts = []
    for target in targets:
        for percent, rule in budgets.items():
            parts.append(f"""
            select * from (
            with tr as (select {target} as y from probed where is_train and {rule}),
            te as (select p.{target} as y, s.{target} as shows, s.{target} in (select y from tr) as seen
                   from probed p join shown s on s.category_id = p.shows where is_test),
            n as (select (select count(*) from tr) as n_train, (select count(*) from te) as n_test,
                    (select count(*) from (select y from tr union select y from te)) as n_classes,
                    (select avg(case when seen and y = shows then 1e0 else 0e0 end) * 100 from te) as acc,
                    (select avg(r) * 100 from (select avg(case when seen and y = shows then 1e0 else 0e0 end) as r from te group by y)) as bal)
            select {percent}::bigint as split_pct, '{target}' as target, unnest(['n_train', 'n_test', 'n_classes', 'converged', 'test_acc', 'test_acc_bal']) as metric,
              floor(unnest([n_train::double, n_test::double, n_classes::double, 1e0, acc, bal]) * 1e6 + 0.5e0) / 1e6 as value from n)
            where {percent} > 1 or metric not in ('test_acc', 'test_acc_bal')""")
    return " union all ".join(parts)


PROBED_SQL = f"""{CROPS_SQL}, {SAMPLE_SQL},
shown as (select n.n_nationkey as category_id, c.name as species, concat('r', n.n_regionkey::varchar) as region
          from nation n join categories c on c.id = n.n_nationkey),
probed as (select c.species, s.region, coalesce(p.p1, false) as p1, coalesce(p.p10, false) as p10,
             img_set = 'train_images' as is_train, img_set like '%test_images' as is_test,
             case when ('0x' || substr(md5(img_path), 1, 4))::bigint % 7 = 3 and img_set like '%test_images'
                  then (c.category_id + 1) % {CATEGORIES} else c.category_id end as shows
           from crops c join shown s on s.category_id = c.category_id left join picked p on p.file_name = c.file_name)"""

PROBE_BUDGETS = {1: "p1", 10: "p10", 100: "true"}


_COS = "list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 1e-8)"


def cos(a: str, b: str) -> str:
    return _COS.format(a=a, b=b)


_MATRIX = f"""{fx.PAIRS_SQL}, cells as (
  select a.batch_id, a.pos, b.pos as other, {cos('a.x1', 'b.x1')} as v from pairs a join pairs b on a.batch_id = b.batch_id)"""

_ENTRIES = "select batch_id, pos, other, floor(v * 1e6 + 0.5e0) / 1e6 as v"

_CONTEXT = f"""{fx.ITEMS_SQL}, ends as (select min(year(datetime)) as lo, max(year(datetime)) as hi from items),
locs as (select location, row_number() over (order by location) - 1 as loc_id from (select distinct location from items)),
raw as (select vec_id // {fx.BATCH} as batch_id, vec_id % {fx.BATCH} as pos, loc_id,
  case when hi = lo then 0e0 else (year(datetime) - lo) / (hi - lo)::double end as y,
  (dayofyear(make_date(2020, month(datetime), day(datetime))) - 1) / 366e0 as d, hour(datetime) / 23e0 as h,
  minute(datetime) / 59e0 as m, floor(second(datetime)) / 59e0 as s from items join locs using (location), ends),
cells as (select a.batch_id, a.pos, b.pos as other, sqrt(pow(a.y - b.y, 2) + pow(sin(pi() * (a.d - b.d)), 2) + pow(sin(pi() * (a.h - b.h)), 2)
  + pow(sin(pi() * (a.m - b.m)), 2) + pow(sin(pi() * (a.s - b.s)), 2)
  + case when a.loc_id <> b.loc_id then 2 else 0 end) as v from raw a join raw b on a.batch_id = b.batch_id)"""

_LOSS = "floor(({0}) * 1e6 + 0.5e0) / 1e6 as loss"

_NT_XENT = f"""{fx.PAIRS_SQL}, sized as (select *, count(*) over (partition by batch_id) as n from pairs),
views as (select batch_id, pos as i, pos + n as goal, x1 as x from sized union all select batch_id, pos + n, pos, x2 from sized),
logits as (select a.batch_id, a.i, {cos('a.x', 'b.x')} / 0.5e0 as v, a.goal = b.i as is_goal
           from views a join views b on a.batch_id = b.batch_id and a.i <> b.i),
losses as (select batch_id, i, ln(sum(exp(v))) - max(case when is_goal then v end) as l from logits group by batch_id, i)
select batch_id, count(*) // 2 as n_pairs, {_LOSS.format('avg(l)')} from losses group by batch_id"""


def _triplet_sql(distance) -> str:
    luck = fx.draw_sql(f"'{RUN_SEED}'", "'negative'", "batch_id::varchar", "pos::varchar")
    hinge = f"greatest(0.3e0 + {distance('t.x1', 't.x2')} - {distance('t.x1', 'v.x')}, 0e0)"
    return f"""{fx.PAIRS_SQL}, sized as (select *, count(*) over (partition by batch_id) as n from pairs),
    views as (select batch_id, pos as i, x1 as x from sized union all select batch_id, pos + n, x2 from sized),
    drawn as (select *, floor({luck} * (n * 2))::bigint as neg from sized),
    losses as (select t.batch_id, case when neg = t.pos then 0e0 else {hinge} end as l
               from drawn t join views v on v.batch_id = t.batch_id and v.i = t.neg)
    select batch_id, count(*) as n_pairs, {_LOSS.format('avg(l)')} from losses group by batch_id"""


_TOPK = f"""{_MATRIX}, ranked as (
  select batch_id, pos, other, v, row_number() over (partition by batch_id, pos order by v desc, other) - 1 as rank
  from cells where pos <> other)"""
_HARD_LUCK = fx.draw_sql(f"'{RUN_SEED}'", "'hard'", "batch_id::varchar", "pos::varchar")
_HARD = f"""{_TOPK}, hard as (select batch_id, pos, other as neg_pos from ranked
  where rank = floor({_HARD_LUCK} * 2)::bigint)"""

_w = lambda i, j: f"sin({i} + 2e0 * {j}) / 8e0"

CHECKS = {
    "l2_normalize": (
        unit_rows,
        f"""with e as (select vec_id, list_transform(embedding, lambda v: v::double * 3) as x from embeddings),
        n as (select vec_id, x, greatest(sqrt(list_dot_product(x, x)), 1e-12) as len from e),
        u as (select vec_id, list_transform(range(1, {DIM + 1}), lambda k: x[k] / len) as x from n)
        select vec_id, {spread_sql('x')} from u""",
    ),
    "cosine_distance": (
        distances,
        f"""{fx.PAIRS_SQL} select batch_id, pos, floor(((1 - {cos('x1', 'x2')}) / 2) * 1e6 + 0.5e0) / 1e6 as distance from pairs""",
    ),
    "pairwise_cosine": (cosine_rows, f"{_MATRIX} {_ENTRIES} from cells"),
    "softmax_weights": (
        softmax_rows,
        f"""{_MATRIX}, soft as (select batch_id, pos, other, exp(v / 0.5e0) / sum(exp(v / 0.5e0)) over (partition by batch_id, pos) as v from cells)
        {_ENTRIES} from soft""",
    ),
    "pairwise_context_distance": (context_distances, f"{_CONTEXT} {_ENTRIES} from cells"),
    "cross_entropy_score": (
        cross_entropy,
        f"""with r as (select vec_id // {fx.BATCH} as batch_id, vec_id, case when vec_id % 50 <> 7 then vec_id % {CLASSES} end as label,
            (embedding::double[])[1:{CLASSES}] as logits from embeddings),
        e as (select batch_id, vec_id, label, generate_subscripts(logits, 1) - 1 as k, unnest(logits) as v from r),
        l as (select batch_id, vec_id, ln(sum(exp(v))) - max(case when k = label then v end) as loss from e group by batch_id, vec_id)
        select batch_id, count(*) as n_rows, floor(avg(loss) * 1e6 + 0.5e0) / 1e6 as loss from l group by batch_id""",
    ),
    "ema_memory": (
        ema,
        f"""with recursive u as (select vec_id % {EMA_KEYS} as id, vec_id // {EMA_KEYS} as step, embedding::double[] as x from embeddings),
        unit as (select id, step, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) as x from u),
        fold as (
          select id, step, x as e from unit where step = 0
          union all
          select id, step, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) as e from (
            select f.id, n.step, list_transform(range(1, {DIM + 1}), lambda k: 0.9e0 * f.e[k] + 0.1e0 * n.x[k]) as e
            from fold f join unit n on n.id = f.id and n.step = f.step + 1))
        select id, {spread_sql('e')} from (select id, arg_max(e, step) as e from fold group by id)""",
    ),
    "nt_xent_score_tiled": (lambda s, d: per_batch(scoring.nt_xent_score(fx.pairs(s, d), tile=48)), _NT_XENT),
    "topk_similar_tiled": (
        lambda s, d: scoring.topk_similar(fx.pairs(s, d), tile=48).select(
            "batch_id", "pos", "rank", "other_pos", near(F.col("cosine"), "cosine")
        ),
        f"""{_TOPK} select batch_id, pos, rank, other as other_pos, floor(v * 1e6 + 0.5e0) / 1e6 as cosine from ranked where rank < 2""",
    ),
    "nt_xent_score": (lambda s, d: per_batch(scoring.nt_xent_score(fx.pairs(s, d))), _NT_XENT),
    "triplet_score": (
        lambda s, d: per_batch(scoring.triplet_score(fx.pairs(s, d))),
        _triplet_sql(lambda a, b: f"((1 - {cos(a, b)}) / 2)"),
    ),
    "triplet_score_l2": (
        lambda s, d: per_batch(scoring.triplet_score(fx.pairs(s, d), dist_type="l2")),
        _triplet_sql(lambda a, b: f"sqrt(list_sum(list_transform(range(1, {DIM + 1}), lambda k: pow({a}[k] - {b}[k] + 1e-6, 2))))"),
    ),
    "topk_similar": (
        lambda s, d: scoring.topk_similar(fx.pairs(s, d)).select(
            "batch_id", "pos", "rank", "other_pos", near(F.col("cosine"), "cosine")
        ),
        f"""{_TOPK} select batch_id, pos, rank, other as other_pos, floor(v * 1e6 + 0.5e0) / 1e6 as cosine from ranked where rank < 2""",
    ),
    "negative_hard": (
        lambda s, d: scoring.negative_hard(fx.pairs(s, d)), f"{_HARD} select batch_id, pos, neg_pos from hard",
    ),
    "triplet_hard_score": (
        lambda s, d: per_batch(scoring.triplet_hard_score(fx.pairs(s, d))),
        f"""{_HARD}, losses as (
          select a.batch_id, greatest(0.3e0 + (1 - {cos('a.x1', 'a.x2')}) / 2 - (1 - {cos('a.x1', 'n.x1')}) / 2, 0e0) as l
          from hard h join pairs a on a.batch_id = h.batch_id and a.pos = h.pos
          join pairs n on n.batch_id = h.batch_id and n.pos = h.neg_pos)
        select batch_id, count(*) as n_pairs, {_LOSS.format('avg(l)')} from losses group by batch_id""",
    ),
    "alignment_score": (
        alignment,
        f"""{fx.PAIRS_SQL}, v as (select x1 as p1, x2 as z2, list_reverse(x1) as p2, x2 as z1 from pairs)
        select {_LOSS.format(f"-avg({cos('p1', 'z2')}) / 2 - avg({cos('p2', 'z1')}) / 2")}, count(*) as n_pairs from v""",
    ),
    "make_batches": (
        lambda s, d: scoring.make_batches(embeddings(s, d).select("vec_id"), "vec_id", 100).select("vec_id", whole("batch_id"), whole("pos")),
        f"""with o as (select vec_id, row_number() over (order by md5(concat_ws('|', '{RUN_SEED}', vec_id::varchar)), vec_id) - 1 as at_row from embeddings)
        select vec_id, at_row // 100 as batch_id, at_row % 100 as pos from o""",
    ),
    "projection_head": (
        projected,
        f"""with hid as (select vec_id, list_transform(range({HIDDEN}), lambda i: greatest(0e0, list_sum(list_transform(range({DIM}),
            lambda j: {_w('i', 'j')} * embedding[j + 1]::double)))) as h from embeddings),
        outs as (select vec_id, list_transform(range({OUT}), lambda i: list_sum(list_transform(range({HIDDEN}),
            lambda j: {_w('i', 'j')} * h[j + 1]))) as e from hid)
        select vec_id, {', '.join(f"floor((e[{i + 1}]::float::double) * 1e4 + 0.5e0) / 1e4 as v{i}" for i in range(OUT))} from outs""",
    ),
    "projection_head_normalized": (
        lambda s, d: projected(s, d, norm_layer()),
        f"""with hid as (select vec_id, list_transform(range({HIDDEN}), lambda i: greatest(0e0, (list_sum(list_transform(range({DIM}),
            lambda j: {_w('i', 'j')} * embedding[j + 1]::double)) - i / 100e0) / sqrt(1e0 + i + 1e-5) * 2e0 + (i - 8) / 10e0)) as h from embeddings),
        outs as (select vec_id, list_transform(range({OUT}), lambda i: list_sum(list_transform(range({HIDDEN}),
            lambda j: {_w('i', 'j')} * h[j + 1]))) as e from hid)
        select vec_id, {', '.join(f"floor((e[{i + 1}]::float::double) * 1e4 + 0.5e0) / 1e4 as v{i}" for i in range(OUT))} from outs""",
    ),
    "extract_features": (
        extracted,
        f"""select vec_id, label, {', '.join(
            f"floor(((embedding[{2 * i + 1}]::double + embedding[{2 * i + 2}]::double)::float::double) * 1e4 + 0.5e0) / 1e4 as v{i}"
            for i in range(DIM // 2))} from embeddings""",
    ),
    "standardize": (
        standardized,
        f"""with long as (select vec_id, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as v from embeddings),
        stats as (select k, avg(v) as mu, stddev_samp(v) as sd from long where vec_id % 10 >= 2 group by k),
        z as (select vec_id, list((v - mu) / sd order by k) as x from long join stats using (k) group by vec_id)
        select vec_id as id, {spread_sql('x')} from z""",
    ),
    "stratified_folds": (
        folds,
        """select vec_id, (row_number() over (partition by label order by md5(concat_ws('|', '0', vec_id::varchar)), vec_id) - 1) % 5 as fold
        from embeddings""",
    ),
    "accuracy": (
        lambda s, d: metrics.accuracy(predictions(s, d)).select(near(F.col("accuracy"), "accuracy")),
        """with p as (select l_partkey % 25 as t, (case when l_quantity > 20 then l_partkey else l_suppkey end) % 25 as g from lineitem)
        select floor((avg(case when t = g then 1e0 else 0e0 end) * 100) * 1e6 + 0.5e0) / 1e6 as accuracy from p""",
    ),
    "balanced_accuracy": (
        lambda s, d: metrics.balanced_accuracy(predictions(s, d)).select(near(F.col("balanced_accuracy"), "balanced_accuracy")),
        """with p as (select l_partkey % 25 as t, (case when l_quantity > 20 then l_partkey else l_suppkey end) % 25 as g from lineitem),
        r as (select t, avg(case when t = g then 1e0 else 0e0 end) as recall from p group by t)
        select floor((avg(recall) * 100) * 1e6 + 0.5e0) / 1e6 as balanced_accuracy from r""",
    ),
    "weighted_meter": (
        lambda s, d: metrics.weighted_meter(meter_values(s, d)).select("name", near(F.col("avg"), "avg"), whole("count")),
        """with m as (select o_orderpriority as name, floor(o_totalprice * 100 + 0.5e0) as val, o_orderkey % 7 + 1 as n from orders)
        select name, floor((sum(val * n) / sum(n)) * 1e6 + 0.5e0) / 1e6 as avg, sum(n)::bigint as count from m group by name""",
    ),
    "running_weighted_meter": (
        lambda s, d: metrics.running_weighted_meter(meter_values(s, d)).select("name", "step", near(F.col("avg"), "avg"), whole("count")),
        """with m as (select o_orderpriority as name, o_orderkey as step, floor(o_totalprice * 100 + 0.5e0) as val, o_orderkey % 7 + 1 as n from orders),
        w as (select name, step, sum(val * n) over p as total, sum(n) over p as count from m
              window p as (partition by name order by step rows unbounded preceding))
        select name, step, floor((total / count) * 1e6 + 0.5e0) / 1e6 as avg, count::bigint as count from w""",
    ),
    "linear_probe": (probe_once, f"{PROBED_SQL} select split_pct, metric, value from ({probe_sql(['species'], {100: 'true'})})"),
    "probe_grid_search": (
        probe_grid,
        f"""{PROBED_SQL} select {len(probe.C_GRID)}::bigint as n_tried, {min(probe.C_GRID)}::double as least, {max(probe.C_GRID)}::double as most,
        (select avg(case when p.species = s.species then 1e0 else 0e0 end) * 100 from probed p join shown s on s.category_id = p.shows
         where is_train and p10) as best_mean, true as is_first""",
    ),
    "probe_by_label_budget": (probe_budgets, f"{PROBED_SQL} select split_pct, metric, value from ({probe_sql(['species'], PROBE_BUDGETS)})"),
    "probe_by_target": (probe_targets, f"{PROBED_SQL} select * from ({probe_sql(['species', 'region'], PROBE_BUDGETS)})"),
}
