"""Pictures: each vector as an 8 by 8 picture in colours, edited by the raster kernels; the SQL works on a row a pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pictures
from ..plans.views import table

QUERIES, ORACLE = {}, {}

SIDE = 8
#: A pixel of place i takes its colours from the vector's components i, 7 i and 13 i (modulo 64).
_STEPS = (1, 7, 13)

_PX = """px as (select vec_id, i % 8 x, i // 8 y, l[i + 1] r, l[(i * 7) % 64 + 1] g, l[(i * 13) % 64 + 1] b, 255 a
  from (select vec_id, unnest(range(0, 64)) i, list_transform(embedding[:64], lambda v: coalesce(least(255, greatest(0, floor(v::double * 256 + 128))), 0)::int) l
        from embeddings where len(embedding) >= 64))"""
_SHA = """select vec_id picture_id, (max(x) + 1)::int width, (max(y) + 1)::int height,
  sha256(unhex(string_agg(printf('%02X%02X%02X%02X', r::int, g::int, b::int, a::int), '' order by y, x))) pixels_sha256 from p group by vec_id"""


def _each(f: str) -> str:
    """A picture whose colours v are each changed by the SQL term ``f``."""
    one = lambda c: f"least(255, greatest(0, floor(({f.replace('@', c)}) + 0.5)))::int {c}"
    return f"p as (select vec_id, x, y, {one('r')}, {one('g')}, {one('b')}, a from px)"


def rasters(spark, sf):
    """picture_id, width, height, pixels of every vector with at least 64 components."""
    v = F.transform(F.slice("embedding", 1, SIDE * SIDE), lambda v: F.coalesce(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 256 + 128))), F.lit(0)).cast("int"))
    level = table(spark, sf, "embeddings").where(F.size("embedding") >= SIDE * SIDE).select("vec_id", F.transform(v, lambda n: F.lpad(F.hex(n), 2, "0")).alias("v"))
    pixel = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.concat(*(F.get("v", i * k % (SIDE * SIDE)) for k in _STEPS), F.lit("FF")))
    return level.select(F.col("vec_id").alias("picture_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.unhex(F.array_join(pixel, "")).alias("pixels"))


def op(name: str, **params):
    pairs = [x for k, v in params.items() for x in (F.lit(k), (v if not isinstance(v, (int, float, str)) else F.lit(v)).cast("string"))]
    return F.struct(F.lit(name).alias("op"), (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("params"))


def edited(spark, sf, *ops):
    out = pictures.edit(rasters(spark, sf).withColumn("ops", F.array(*ops)))
    return out.select("picture_id", "width", "height", F.sha2("pixels", 256).alias("pixels_sha256"), "expected_width", "expected_height")


def query(name: str, *steps: str, ops, sizes: bool = False):
    """Registers the pictures after ``ops`` (a function of nothing, so that no session is needed yet) beside the SQL's steps."""

    def run(spark, sf):
        out = edited(spark, sf, *ops())
        return out if sizes else out.drop("expected_width", "expected_height")

    QUERIES[name] = run
    more = "select *, width expected_width, height expected_height from (" + _SHA + ")" if sizes else _SHA
    ORACLE[name] = "with recursive " + ",\n".join([_PX, *steps]) + "\n" + more


def _n(k: int, of: str = "picture_id"):
    return F.col(of) % k


_CROP = "{to} as (select vec_id, x - vec_id % 5 as x, y - vec_id % 3 as y, r, g, b, a from {of} where x between vec_id % 5 and vec_id % 5 + 3 and x < 8 and y >= vec_id % 3)"
_TURN = """{to} as (select vec_id, case vec_id % 4 when 0 then x when 1 then h - 1 - y when 2 then w - 1 - x else y end as x,
  case vec_id % 4 when 0 then y when 1 then x when 2 then h - 1 - y else w - 1 - x end as y, r, g, b, a
  from (select *, max(x) over (partition by vec_id) + 1 w, max(y) over (partition by vec_id) + 1 h from {of}))"""
_LUMA = "0.299::double * r + 0.587::double * g + 0.114::double * b"
_WHITE = "{to} as (select vec_id, x, y, c r, c g, c b, a from (select *, case when " + _LUMA + " >= 90 + vec_id % 70 then 255 else 0 end c from {of}))"

query("i02_crop", _CROP.format(to="p", of="px"), ops=lambda: [op("crop", x=_n(5), y=_n(3), width=4)], sizes=True)
query("i03_rotate", _TURN.format(to="p", of="px"), ops=lambda: [op("rotate", degrees=_n(4) * 90)], sizes=True)
query("i04_brightness", _each("@ + (vec_id % 121 - 60) / 100::double * 255"), ops=lambda: [op("brightness", amount=_n(121) - 60)])
query(
    "i05_contrast",
    "am as (select distinct vec_id, least(254, greatest(-255, (vec_id % 161 - 80) / 100::double * 255)) k from px)",
    "pk as (select px.*, 259 * (k + 255) / (255 * (259 - k)) f from px join am using (vec_id))",
    _each("f * (@ - 128) + 128").replace("from px", "from pk"),
    ops=lambda: [op("contrast", amount=_n(161) - 80)],
)
query(
    "i06_levels",
    _each("255 * pow(least(1, greatest(0, (@ - vec_id % 50) / (255 - vec_id % 40 - vec_id % 50)::double)), case when vec_id % 2 = 0 then 0.5 else 1 end)"),
    ops=lambda: [op("levels", black=_n(50), white=255 - _n(40), gamma=2 - _n(2))],
)
query(
    "i07_curves",
    _each("case when @ <= 64 then 1.25 * @ + 16 when @ <= 200 then 0.875 * (@ - 64) + 96 else 0.25 * (least(@, 240) - 200) + 215 end"),
    ops=lambda: [op("curves", points="[[200, 215], [0, 16], [64, 96], [240, 225]]")],
)
query("i08_grayscale", f"p as (select vec_id, x, y, c r, c g, c b, a from (select *, floor({_LUMA} + 0.5)::int c from px))", ops=lambda: [op("grayscale")])
query("i09_threshold", _WHITE.format(to="p", of="px"), ops=lambda: [op("threshold", level=90 + _n(70))])
query(
    "i10_despeckle",
    f"lu as (select *, {_LUMA} v from px)",
    """near as (select s.vec_id, s.x, s.y, count(*) n, count(*) filter (where abs(o.v - s.v) <= 32) agree, median(o.v) mid from lu s join lu o
      on s.vec_id = o.vec_id and abs(s.x - o.x) <= 1 and abs(s.y - o.y) <= 1 and (s.x <> o.x or s.y <> o.y) group by all)""",
    """p as (select vec_id, x, y, case when lone then c else r end r, case when lone then c else g end g, case when lone then c else b end b, a from
      (select lu.*, agree <= 0.2 * n and abs(v - mid) > 64 lone, floor(mid + 0.5)::int c from lu join near using (vec_id, x, y)))""",
    ops=lambda: [op("despeckle")],
)


def _flood(k: int, x: int, y: int, before: str) -> list[str]:
    """The pixels that join corner ``k`` among those that no earlier corner has taken."""
    free = "not exists (select 1 from t{0} t where t.vec_id = {1}.vec_id and t.x = {1}.x and t.y = {1}.y)"
    return [
        f"""like{k} as (select px.vec_id, px.x, px.y from px join px c on c.vec_id = px.vec_id and c.x = {x} and c.y = {y}
          where greatest(abs(px.r - c.r), abs(px.g - c.g), abs(px.b - c.b)) <= 60 + px.vec_id % 60{' and ' + free.format(before, 'px') if before else ''})""",
        f"""grow{k} as (select * from like{k} where x = {x} and y = {y} union
          select l.* from grow{k} g join like{k} l on l.vec_id = g.vec_id and abs(l.x - g.x) + abs(l.y - g.y) = 1)""",
        f"t{k} as (select * from grow{k}{f' union select * from t{before}' if before else ''})",
    ]


query(
    "i11_remove_background",
    *_flood(1, 0, 0, ""), *_flood(2, 7, 0, "1"), *_flood(3, 0, 7, "2"), *_flood(4, 7, 7, "3"),
    "p as (select px.vec_id, px.x, px.y, r, g, b, case when t.vec_id is null then 255 else 0 end a from px left join t4 t on t.vec_id = px.vec_id and t.x = px.x and t.y = px.y)",
    ops=lambda: [op("removeBackground", tolerance=60 + _n(60))],
)
query(
    "i01_edit_pictures",
    _CROP.format(to="p1", of="px"), _TURN.format(to="p2", of="p1"), _WHITE.format(to="p", of="p2"),
    ops=lambda: [op("crop", x=_n(5), y=_n(3), width=4), op("unknown"), op("rotate", degrees=_n(4) * 90), op("threshold", level=90 + _n(70))], sizes=True,
)
