"""Registered queries that change stored tables: applying, merging, expiring; a store is made of the fixtures each time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import archive
from .operators.catalog import KEY
from .plans.commits import Store
from .plans.stage import new_path
from .queries import _IMAGE, _LAID, _M10, _WON, query, walk_sql


def _records(t) -> DataFrame:
    """``diff_record`` by equal keys: a diff holds the change sets after its first and up to its last gid, so no volume's rows meet in one task."""
    held = t.stored("change_meta").select(*KEY, F.explode(F.expr("sequence(b_b + 1, e_b)")).alias("gid"))
    rows = t.stored("change_input").join(held, ["vol_id", "gid"])
    return rows.select(*KEY, F.expr("(gid - b_b) * 4294967296 + lsid").alias("ord"), "addr", "blocks", F.lit(0).cast("long").alias("off"), "rec_type", "token")


def _archive(t) -> Store:
    t.spread()
    states = t.stored("restore_target").selectExpr("vol_id", "false as is_applying", "0L as b_b", "0L as b_e", "cast(null as bigint) as e_b", "cast(null as bigint) as e_e")
    return archive.create(t.spark, new_path(t.spark, "archive"), states, t.stored("change_meta"), _records(t), t.volume_image)


def _everywhere(t, gid: int) -> DataFrame:
    return t.stored("restore_target").select("vol_id", F.lit(gid).cast("long").alias("gid"))


_ZERO = walk_sql("zero").replace("WITH RECURSIVE ", "WITH RECURSIVE zero AS (SELECT vol_id, CAST(0 AS bigint) AS b_b, CAST(0 AS bigint) AS b_e FROM restore_target), ").replace("meta_diff", "change_meta")
_APPLIED = _ZERO + """, reached AS (SELECT z.vol_id, coalesce(max(w.s_b), 0) AS gid, count(w.pos) AS n_applied FROM zero z LEFT JOIN walk w ON w.vol_id = z.vol_id AND w.s_b <= 6 GROUP BY z.vol_id)"""


@query(_APPLIED + """, blk AS (SELECT *, addr + k AS block, row_number() OVER (PARTITION BY vol_id, addr + k ORDER BY gid DESC, lsid DESC) AS rn
  FROM (SELECT c.*, unnest(range(blocks)) AS k FROM change_input c JOIN reached r ON r.vol_id = c.vol_id AND c.gid <= r.gid) x),
win AS (SELECT * FROM blk WHERE rn = 1)
SELECT * FROM (SELECT coalesce(w.vol_id, i.vol_id) AS vol_id, coalesce(w.block, i.addr) AS addr,
  CASE WHEN w.block IS NULL OR w.rec_type = 'Discard' THEN i.content WHEN w.rec_type = 'Normal' THEN concat(token, ':', k) END AS content
FROM volume_image i FULL JOIN win w ON w.vol_id = i.vol_id AND w.block = i.addr) x WHERE content IS NOT NULL""")
def m25_apply_images(t):
    store = _archive(t)
    archive.apply_to_gid(store, _everywhere(t, 6))
    return store.read("image")


@query(_APPLIED + """SELECT vol_id, false AS is_applying, gid AS b_b, gid AS b_e, (SELECT count(*) FROM change_meta d WHERE d.vol_id = r.vol_id AND d.e_b > r.gid) AS n_left FROM reached r""")
def m25_apply_states(t):
    """As the images, but the first run dies after its begin: the second rolls it on."""
    store = _archive(t)
    archive.begin(store, _everywhere(t, 6))
    archive.apply_to_gid(store, _everywhere(t, 0))
    left = store.read("diff").groupBy(F.col("vol_id").alias("v")).agg(F.count("*").alias("n"))
    return store.read("state").join(left, F.col("vol_id") == F.col("v"), "left").select("vol_id", "is_applying", "b_b", "b_e", F.coalesce("n", F.lit(0)).cast("long").alias("n_left"))


_RUNS = _M10.replace("meta_diff", "change_meta").replace("b_b >= 5", "b_b >= 0") + """, k AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM walk x WHERE x.vol_id = w.vol_id AND x.pos <= w.pos AND x.b_b >= 12)),
one AS (SELECT vol_id, arg_min(b_b, pos) AS b_b, arg_max(e_b, pos) AS e_b FROM k GROUP BY vol_id HAVING count(*) >= 2)
"""


@query(_RUNS + """, blk AS (SELECT *, row_number() OVER (PARTITION BY vol_id, addr + k ORDER BY gid DESC, lsid DESC) AS rn
  FROM (SELECT c.*, unnest(range(blocks)) AS k FROM change_input c JOIN one o ON o.vol_id = c.vol_id AND c.gid > o.b_b AND c.gid <= o.e_b) x)
SELECT o.vol_id, o.b_b, o.e_b, (SELECT count(*) FROM blk WHERE blk.vol_id = o.vol_id AND rn = 1 AND rec_type = 'Normal') * 512 AS data_size FROM one o
UNION ALL SELECT d.vol_id, d.b_b, d.e_b, d.data_size FROM change_meta d WHERE NOT EXISTS (SELECT 1 FROM one o JOIN k ON k.vol_id = o.vol_id WHERE k.vol_id = d.vol_id AND k.b_b = d.b_b AND k.e_b = d.e_b)""")
def m24_merged_catalog(t):
    store = _archive(t)
    archive.merge_range(store, 0, 12)
    return store.read("diff").select("vol_id", "b_b", "e_b", "data_size")


@query(_WON + _IMAGE.replace("volume_image", "volume_image WHERE vol_id IN (SELECT vol_id FROM restore_target)") + _LAID)
def m24_scan_after_merge(t):
    store = _archive(t)
    archive.merge_range(store, 0, 12)
    return archive.scan(store, t.stored("restore_target").select("vol_id", F.col("top").alias("gid")))


@query("SELECT 'diff' AS what, vol_id, b_b AS gid_b, e_b AS gid_e FROM change_meta WHERE e_b > 5 UNION ALL SELECT 'image', vol_id, top, top FROM restore_target WHERE vol_id % 4 = 0 AND top >= 5")
def m19_expire_images(t):
    store, targets = _archive(t), t.stored("restore_target")
    archive.restore(store, targets.where("vol_id % 2 = 0").select("vol_id", F.lit(4).cast("long").alias("gid")))
    archive.restore(store, targets.where("vol_id % 4 = 0").select("vol_id", F.col("top").alias("gid")))
    archive.expire_before(store, _everywhere(t, 5))
    diffs = store.read("diff").select(F.lit("diff").alias("what"), "vol_id", F.col("b_b").alias("gid_b"), F.col("e_b").alias("gid_e"))
    return diffs.unionByName(store.read("cold").select(F.lit("image").alias("what"), "vol_id", F.col("gid").alias("gid_b"), F.col("gid").alias("gid_e")))


@query("SELECT vol_id, addr, content FROM volume_image")
def d12_resumed_copy(t):
    """A full copy that stops after six of sixteen buckets; the second run copies the others."""
    source, path = _archive(t), new_path(t.spark, "copy")
    Store(t.spark, path, archive.COPY_LAYOUTS, source.buckets)
    archive.copy_image(source, Store(t.spark, path, archive.COPY_LAYOUTS), "a", 0, 0, most=6)
    target = Store(t.spark, path, archive.COPY_LAYOUTS)
    archive.copy_image(source, target, "a", 0, 0)
    return target.read("image")
