"""Queries and SQL for partner draws. The SQL looks at every candidate with the same hashed numbers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trapline.checks import fixtures as fx
from trapline.checks.context_checks import COUNTS_SQL, neighbours_sql, stored_sizes
from trapline.checks.curation_checks import near, whole
from trapline.functions.capture_time import DAY_SPAN, HOUR_SPAN, MINUTE_SPAN, SECOND_SPAN
from trapline.operators import draws, encoding, positives, scoring
from trapline.operators.positives import RUN_SEED

NOISE = 0.2
ATTEMPTS = 4 + 16 + 64 + 256  # all proposals before the race, which no row of the test tables needs
CONTEXT_ATTEMPTS = 2 + 8 + 32
COMBINED_ATTEMPTS = 8 + 32 + 128 + 512


def burst_draws(spark, d):
    crops = fx.crops(spark, d)
    return positives.positive_burst(crops, stored_sizes(spark, d))


def class_draws(spark, d, **options):
    return positives.positive_class(fx.crops(spark, d), noise=NOISE, **options)


def agreement(spark, d):
    found = positives.positive_class_agreement(class_draws(spark, d), fx.crops(spark, d))
    return found.select(near(F.col("class_agreement"), "class_agreement"), near(F.col("self_share"), "self_share"), whole("n_draws"))


def resolved(spark, d):
    """Positions drawn uniformly over the table, turned into paths."""
    index = encoding.row_ids(fx.crops(spark, d).select("img_path"), ["img_path"])
    n = fx.crops(spark, d).agg(F.count("*")).scalar()
    drawn = index.select(
        "img_path", F.floor(positives.unit_draw(RUN_SEED, "any", F.col("img_path")) * n).alias("partner_id")
    )
    return positives.resolve_positive(drawn, index).select("img_path", "partner")


def embedding_draws(spark, d):
    return draws.positive_embedding(fx.table(spark, d, "embeddings"), "vec_id", "embedding")


def context_draws(spark, d):
    return draws.positive_context(fx.crops(spark, d), "img_path")


def combined_draws(spark, d):
    return draws.positive_combined(fx.items(spark, d), "vec_id", "embedding")


def u(*parts: str) -> str:
    return fx.draw_sql(f"'{RUN_SEED}'", "'0'", *parts)


_PLACED = "placed as (select img_id, img_path, row_number() over (partition by img_id order by md5(img_path), img_path) - 1 as pos from crops)"


def class_sql(scope: str) -> str:
    by = f"partition by {scope}" if scope else ""
    keys = f"category_id, {scope}" if scope else "category_id"
    use = f"using ({scope})" if scope else "on true"
    tot = f"select {scope}, count(*) as scope_n from base group by {scope}" if scope else "select count(*) as scope_n from base"
    match = f"i.{scope} = t.{scope} and " if scope else ""
    return f"""{fx.CROPS_SQL}, base as (select img_path, category_id, location from crops),
    laid as (select *, row_number() over ({by} order by category_id, md5(img_path), img_path) - 1 as slot from base),
    cls as (select {keys}, count(*) as n, min(slot) as first_slot from laid group by {keys}),
    tot as ({tot}),
    rolled as (select b.*, n, first_slot, scope_n, {u("'noise'", "img_path")} < {NOISE} as other,
                 {u("'pick'", "img_path")} as luck
               from base b join cls using ({keys}) join tot {use}),
    target as (select *, case when not other then first_slot + floor(luck * n)::bigint
                 when scope_n = n then null
                 when floor(luck * (scope_n - n))::bigint < first_slot then floor(luck * (scope_n - n))::bigint
                 else floor(luck * (scope_n - n))::bigint + n end as slot from rolled),
    drawn as (select t.img_path, t.category_id, i.img_path as partner, i.category_id as partner_category
              from target t left join laid i on {match} i.slot = t.slot)"""


_EMBEDDING_SQL = f"""with idx as (
  select vec_id, embedding::double[] as e, row_number() over (order by md5(vec_id::varchar), vec_id) - 1 as gid from embeddings),
tries as (select vec_id, e, attempt, floor({u("'candidate'", "vec_id::varchar", "attempt::varchar")} * (select count(*) from idx))::bigint as gid,
            {u("'accept'", "vec_id::varchar", "attempt::varchar")} as luck
          from idx, range({ATTEMPTS}) r(attempt)),
accepted as (select t.vec_id, t.attempt, i.vec_id as partner from tries t join idx i on i.gid = t.gid
             where luck < exp((list_dot_product(t.e, i.e) - 1e0) / {draws.EMBEDDING_TEMPERATURE}e0))
select vec_id, arg_min(partner, attempt) as partner from accepted group by vec_id"""


def context_sql(start: str, key: str, attempts: int, text: str) -> str:
    """Attempts of the context draw, by plain running sums over the cells of every location.

    `start` defines `base(key, loc, datetime)`; `accepted` holds every accepted attempt.
    """
    temp = f"{draws.CONTEXT_TEMPERATURE}e0"
    root2 = math.sqrt(2.0)

    def chord2(a, b, span):
        return f"pow(sin(pi() * (({a}) - ({b})) / {span}e0), 2)"

    def clock2(a, b):
        return " + ".join(
            [
                chord2(f"{a} // 3600", f"{b} // 3600", HOUR_SPAN),
                chord2(f"({a} // 60) % 60", f"({b} // 60) % 60", MINUTE_SPAN),
                chord2(f"{a} % 60", f"{b} % 60", SECOND_SPAN),
            ]
        )

    slow = f"(pow(p.year - i.year, 2) + {chord2('p.day', 'i.day', DAY_SPAN)})"
    return f"""{start},
    ends as (select min(year(datetime)) as lo, max(year(datetime)) as hi from base),
    timed as (select {key}, loc, case when hi = lo then 0e0 else (year(datetime) - lo) / (hi - lo)::double end as year,
                hour(datetime) * 3600 + minute(datetime) * 60 + floor(second(datetime))::bigint as cell,
                dayofyear(make_date(2020, month(datetime), day(datetime))) - 1 as day from base, ends),
    idx as (select *, row_number() over (order by md5(loc), loc, cell, day, year, md5({text}), {text}) - 1 as gid from timed),
    cells as (select loc, cell, count(*) as n, min(gid) as first_gid from idx group by loc, cell),
    gaps as (select a.loc, a.cell, b.cell as other, b.n, b.first_gid, sqrt({clock2('a.cell', 'b.cell')}) as gap
             from cells a join cells b on a.loc = b.loc),
    upto as (select *, sum(n * exp(-gap / {temp})) over (partition by loc, cell order by other) as hi,
               sum(n * exp(-gap / {temp})) over (partition by loc, cell) as total from gaps),
    steps as (select *, coalesce(lag(hi) over (partition by loc, cell order by other), 0) as lo from upto),
    sizes as (select distinct loc, cell, total from steps),
    size as (select count(*) as n_rows from idx),
    tries as (select p.*, attempt, total, n_rows * exp(-{root2}e0 / {temp}) as elsewhere, n_rows,
                {u("'cell'", text, "attempt::varchar")} as u_cell, {u("'member'", text, "attempt::varchar")} as u_member,
                {u("'accept'", text, "attempt::varchar")} as luck
              from idx p join sizes using (loc, cell), size, range({attempts}) r(attempt)),
    marked as (select *, u_cell * (total + elsewhere) as mark from tries),
    picked as (
      select m.* exclude (gid), s.gap as bound, false as away, s.first_gid + floor(u_member * s.n)::bigint as gid
      from marked m join steps s on m.loc = s.loc and m.cell = s.cell and m.mark >= s.lo and m.mark < s.hi
      union all
      select m.* exclude (gid), 0e0, true, floor(u_member * n_rows)::bigint from marked m where mark >= total),
    accepted as (
      select p.{key}, attempt, i.{key} as partner from picked p join idx i on i.gid = p.gid
      where case when away then p.loc <> i.loc and luck < exp(-(sqrt({clock2('p.cell', 'i.cell')} + {slow} + 2) - {root2}e0) / {temp})
                 else luck < exp(-(sqrt(pow(bound, 2) + {slow}) - bound) / {temp}) end)"""


def normalizers(spark, d):
    found = draws.context_log_normalizers(fx.items(spark, d), "vec_id", tolerance=1e-9)
    return found.select("vec_id", near(F.col("log_z"), "log_z", 5))


def normalizer_sql() -> str:
    """The sum over all pairs of rows."""
    turn = lambda a, span: f"pow(sin(pi() * (p.{a} - i.{a}) / {span}e0), 2)"
    square = " + ".join([turn("day", DAY_SPAN), turn("hour", HOUR_SPAN), turn("minute", MINUTE_SPAN), turn("second", SECOND_SPAN)])
    return f"""{fx.ITEMS_SQL}, ends as (select min(year(datetime)) as lo, max(year(datetime)) as hi from items),
    timed as (select vec_id, location, case when hi = lo then 0e0 else (year(datetime) - lo) / (hi - lo)::double end as year,
      dayofyear(make_date(2020, month(datetime), day(datetime))) - 1 as day, hour(datetime) as hour, minute(datetime) as minute,
      floor(second(datetime)) as second from items, ends),
    gaps as (select p.vec_id, sqrt({square} + pow(p.year - i.year, 2) + case when p.location = i.location then 0e0 else 2e0 end) as d
             from timed p, timed i)
    select vec_id, floor(ln(sum(exp(-d / {draws.CONTEXT_TEMPERATURE}e0))) * 1e5 + 0.5e0) / 1e5 as log_z from gaps group by vec_id"""


CHECKS = {
    "context_log_normalizers": (normalizers, normalizer_sql()),
    "positive_self": (
        lambda s, d: positives.positive_self(fx.crops(s, d)),
        f"{fx.CROPS_SQL} select img_path, img_path as partner from crops",
    ),
    "positive_burst": (
        burst_draws,
        f"""{fx.CROPS_SQL}, {neighbours_sql(60)}, {COUNTS_SQL}, {_PLACED},
        sized as (select c.img_path, n.*, a.boxes_per_img_id as n0, coalesce(p.boxes_per_img_id, 0) as n1,
                    coalesce(x.boxes_per_img_id, 0) as n2, {u("c.img_path")} as luck
                  from crops c join near n on n.img_id = c.img_id join counts a on a.img_id = n.img_id
                  left join counts p on p.img_id = n.prev_img left join counts x on x.img_id = n.next_img),
        rolled as (select *, floor(luck * (n0 + n1 + n2))::bigint as i from sized),
        target as (select img_path, case when i < n0 then img_id when i < n0 + n1 then prev_img else next_img end as img,
                     case when i < n0 then i when i < n0 + n1 then i - n0 else i - n0 - n1 end as pos from rolled)
        select t.img_path, p.img_path as partner from target t join placed p on p.img_id = t.img and p.pos = t.pos""",
    ),
    "positive_class": (class_draws, f"{class_sql('')} select img_path, partner from drawn"),
    "positive_class_same_location": (
        lambda s, d: class_draws(s, d, same_location=True),
        f"{class_sql('location')} select img_path, partner from drawn",
    ),
    "positive_class_agreement": (
        agreement,
        f"""{class_sql('')} select
        floor((avg(case when category_id = partner_category then 1e0 else 0e0 end)) * 1e6 + 0.5e0) / 1e6 as class_agreement,
        floor((avg(case when img_path = partner then 1e0 else 0e0 end)) * 1e6 + 0.5e0) / 1e6 as self_share,
        count(*) as n_draws from drawn""",
    ),
    "resolve_positive": (
        resolved,
        f"""{fx.CROPS_SQL}, idx as (select img_path, row_number() over (order by img_path) - 1 as im_id from crops),
        size as (select count(*) as n from crops),
        drawn as (select img_path, floor({fx.draw_sql(f"'{RUN_SEED}'", "'any'", 'img_path')} * n)::bigint as im_id from idx, size)
        select a.img_path, b.img_path as partner from drawn a join idx b on b.im_id = a.im_id""",
    ),
    "positive_embedding": (embedding_draws, _EMBEDDING_SQL),
    "positive_context": (
        context_draws,
        f"""{context_sql(f"{fx.CROPS_SQL}, base as (select img_path, location as loc, datetime from crops)", "img_path", CONTEXT_ATTEMPTS, "img_path")}
        select img_path, arg_min(partner, attempt) as partner from accepted group by img_path""",
    ),
    "positive_combined": (
        combined_draws,
        f"""{context_sql(f"{fx.ITEMS_SQL}, base as (select vec_id, location as loc, datetime from items)", "vec_id", COMBINED_ATTEMPTS, "vec_id::varchar")},
        agreed as (select a.vec_id, a.attempt, a.partner from accepted a join items i on i.vec_id = a.vec_id
                 join items j on j.vec_id = a.partner
                 where {u("'similar'", "a.vec_id::varchar", "a.attempt::varchar")}
                     < exp((list_dot_product(i.embedding::double[], j.embedding::double[]) - 1e0) / {draws.EMBEDDING_TEMPERATURE}e0))
        select vec_id, arg_min(partner, attempt) as partner from agreed group by vec_id""",
    ),
    "negative_random": (
        lambda s, d: scoring.negative_random(fx.pairs(s, d)).select("batch_id", "pos", whole("neg_at"), "is_anchor"),
        f"""{fx.PAIRS_SQL}, sized as (select *, count(*) over (partition by batch_id) as n from pairs),
        drawn as (select batch_id, pos, floor({fx.draw_sql(f"'{RUN_SEED}'", "'negative'", "batch_id::varchar", "pos::varchar")} * (n * 2))::bigint as neg_at
                  from sized) select batch_id, pos, neg_at, neg_at = pos as is_anchor from drawn""",
    ),
}
