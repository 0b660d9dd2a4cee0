"""Registered queries of the engine's operators on the fixtures, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Inputs, with_fixtures
from .operators import catalog as cat
from .operators import changes as chg
from .operators import extent, image, ledger, log, policy, report
from .plans.chain import applicable_chain
from .plans.doubling import chain_of_all
from .plans.stage import staged
from .sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``Inputs`` under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return add


REC = "vol_id, ev, pack_lsid, lsid, next_lsid, addr, blocks, is_padding, is_discard, token"
DIFF = "vol_id, b_b, b_e, e_b, e_e, is_mergeable, is_comp_diff, data_size"
_DIFF = DIFF.split(", ")



def walk_sql(starts: str = "base_state") -> str:
    """The applicable chain with the snapshot after each diff, from the snapshots (vol_id, b_b, b_e) of ``starts``."""
    return f"""WITH RECURSIVE ptr AS (
  SELECT * FROM (
    SELECT p.g, d.*, row_number() OVER (PARTITION BY p.vol_id, p.g ORDER BY d.e_b DESC, d.b_b DESC, d.e_e, d.b_e) AS rn
    FROM (SELECT vol_id, e_b AS g FROM meta_diff UNION SELECT vol_id, b_b FROM {starts}) p
    JOIN meta_diff d ON d.vol_id = p.vol_id AND p.g < d.e_b
     AND ((NOT d.is_comp_diff AND d.b_b <= p.g) OR (d.is_comp_diff AND d.b_b = p.g))) t WHERE rn = 1),
walk AS (
  SELECT CAST(1 AS bigint) AS pos, p.*, p.e_b AS s_b, CASE WHEN p.b_b = p.b_e AND p.e_b = p.e_e THEN greatest(p.e_b, b.b_e) ELSE p.e_e END AS s_e
  FROM {starts} b JOIN ptr p ON p.vol_id = b.vol_id AND p.g = b.b_b
  UNION ALL
  SELECT w.pos + 1, p.*, p.e_b, CASE WHEN p.b_b = p.b_e AND p.e_b = p.e_e THEN greatest(p.e_b, w.s_e) ELSE p.e_e END
  FROM walk w JOIN ptr p ON p.vol_id = w.vol_id AND p.g = w.s_b)
"""


WALK = walk_sql()
#: The winner of each block, the newest record last.
WIN = """WITH blk AS (
  SELECT *, addr + k AS block, row_number() OVER (PARTITION BY vol_id, addr + k ORDER BY {order} DESC) AS rn
  FROM (SELECT *, unnest(range(blocks)) AS k FROM change_input {where}) t),
win AS (SELECT * FROM blk WHERE rn = 1)
"""
_RUNS = """, cutted AS (SELECT *, block - row_number() OVER (PARTITION BY vol_id, ev, k // {n} ORDER BY block) AS isl FROM win)
SELECT vol_id, min(block) AS addr, count(*) AS blocks, min(k) AS "off", rec_type, token FROM cutted GROUP BY vol_id, ev, k // {n}, isl, rec_type, token"""
_SHOW = ["vol_id", "addr", "blocks", "off", "rec_type", "token"]


_IMAGE = ", img AS (SELECT vol_id, addr, content FROM volume_image)"


def sum_sql(text: str, salt: str = "0") -> str:
    """The additive sum of an ASCII text: little-endian words of four characters, summed with a salt, negated, modulo 2**32."""
    word = " + ".join(f"coalesce(ord(nullif(substring({text}, CAST(i AS int) + {k + 1}, 1), '')), 0) * {256**k}" for k in range(4))
    return f"(4294967296 - (CAST(list_sum(list_transform(range(0, length({text}), 4), lambda i: {word})) AS bigint) + {salt}) % 4294967296) % 4294967296"


def _ordered(t: Inputs) -> DataFrame:
    return t.change_input.withColumn("seq", chg.order_key())


# Logs


@query(f"SELECT {REC} FROM log_record WHERE lsid >= 500 AND lsid < 2000")
def l1_log_scan(t):
    return log.log_scan(t.log_record, 500, 2000).select(*REC.split(", "))


@query("""SELECT vol_id, count(DISTINCT pack_lsid) AS n_packs, min(pack_lsid) AS begin_lsid, max(next_lsid) AS end_lsid,
  CAST(sum(CASE WHEN NOT is_padding AND NOT is_discard THEN blocks ELSE 0 END) AS bigint) AS normal_blocks,
  CAST(sum(CASE WHEN is_discard THEN blocks ELSE 0 END) AS bigint) AS discard_blocks,
  CAST(sum(CASE WHEN is_padding THEN blocks ELSE 0 END) AS bigint) AS padding_pb FROM log_record GROUP BY vol_id""")
def l2_log_stats(t):
    return log.log_stats(t.log_record)


@query("""SELECT vol_id, b AS begin_lsid, pack_lsid AS end_lsid FROM (
  SELECT vol_id, pack_lsid, lag(next_lsid) OVER (PARTITION BY vol_id ORDER BY pack_lsid) AS b FROM log_record_gappy) x WHERE b <> pack_lsid""")
def l4_log_invalid_ranges(t):
    return log.log_invalid_ranges(t.log_record_gappy)


@query("""WITH q AS (SELECT vol_id, pack_lsid + ev % 2 AS lsid FROM log_record)
SELECT vol_id, lsid, EXISTS (SELECT 1 FROM log_record_gappy g WHERE g.vol_id = q.vol_id AND g.pack_lsid = q.lsid) AS found FROM q""")
def l5_log_lookup(t):
    asked = t.log_record.select("vol_id", F.expr("pack_lsid + ev % 2").alias("lsid"))
    return log.log_lookup(t.log_record_gappy, asked)


@query(f"""WITH g AS (SELECT *, lag(next_lsid) OVER (PARTITION BY vol_id ORDER BY pack_lsid) AS p FROM log_record_gappy),
f AS (SELECT vol_id, min(pack_lsid) AS cut FROM g WHERE p <> pack_lsid GROUP BY vol_id)
SELECT {', '.join('g.' + c for c in REC.split(', '))} FROM g LEFT JOIN f ON f.vol_id = g.vol_id WHERE cut IS NULL OR pack_lsid < cut""")
def l6_log_valid_prefix(t):
    return log.log_valid_prefix(t.log_record_gappy).select(*REC.split(", "))


@query("""SELECT vol_id, ev, pack_lsid + 1000 AS pack_lsid, lsid + 1000 AS lsid, next_lsid + 1000 AS next_lsid, addr, blocks,
  is_padding OR addr + blocks > 4000 AS is_padding, is_discard, CASE WHEN is_padding OR addr + blocks > 4000 THEN NULL ELSE token END AS token
FROM log_record WHERE pack_lsid >= 100 AND pack_lsid < 3000 AND NOT (is_discard AND addr + blocks > 4000)""")
def l7_log_rebase(t):
    return log.log_rebase(t.log_record, 1000, 100, 3000, 4000).select(*REC.split(", "))


@query("""WITH f AS (SELECT vol_id, ev // 100 AS file_no, min(pack_lsid) AS begin_lsid, max(next_lsid) AS end_lsid FROM log_record_gappy GROUP BY ALL),
g AS (SELECT *, lag(end_lsid) OVER w AS prev_end, lag(file_no // 7) OVER w AS prev_uuid FROM f WINDOW w AS (PARTITION BY vol_id ORDER BY file_no))
SELECT vol_id, file_no, prev_end, begin_lsid, CASE WHEN prev_uuid <> file_no // 7 THEN 'uuid' ELSE 'lsid' END AS reason FROM g WHERE prev_end <> begin_lsid OR prev_uuid <> file_no // 7""")
def l8_log_continuity(t):
    files = t.log_record_gappy.groupBy("vol_id", F.expr("ev div 100").alias("file_no")).agg(F.min("pack_lsid").alias("begin_lsid"), F.max("next_lsid").alias("end_lsid")).withColumn("uuid", F.expr("file_no div 7"))
    return log.log_continuity(files)


@query("""WITH r AS (SELECT * FROM log_record WHERE NOT is_padding),
w AS (SELECT vol_id, CAST(ceil(sum(blocks) / 8.0) AS bigint) AS written FROM r GROUP BY vol_id),
c AS (SELECT vol_id, count(DISTINCT b) AS changed FROM (SELECT vol_id, unnest(range(addr // 8, (addr + blocks - 1) // 8 + 1)) AS b FROM r) x GROUP BY vol_id)
SELECT w.vol_id, written, changed, (written - changed) / written AS rate FROM w JOIN c ON c.vol_id = w.vol_id""")
def l9_log_overwrite_stats(t):
    return log.log_overwrite_stats(t.log_record, 4096)


@query("""WITH l AS (SELECT vol_id, row_number() OVER (PARTITION BY vol_id ORDER BY lsid, ev) AS ord, addr, blocks, token FROM log_record WHERE NOT is_padding),
j AS (SELECT vol_id, ord, l.addr IS NOT DISTINCT FROM r.addr AS addr_ok, l.blocks IS NOT DISTINCT FROM r.blocks AS blocks_ok, l.token IS NOT DISTINCT FROM r.csum AS csum_ok
      FROM l FULL JOIN io_recipe r USING (vol_id, ord))
SELECT *, addr_ok AND blocks_ok AND csum_ok AS ok FROM j""")
def l10_verify_log_recipe(t):
    return log.verify_log_recipe(t.log_record, t.io_recipe)


@query("SELECT vol_id, pack_lsid, count(*) AS n_padding FROM log_record WHERE is_padding GROUP BY ALL")
def l11_log_padding(t):
    return log.log_padding(t.log_record)


def _with_bytes(df: DataFrame) -> DataFrame:
    return df.withColumn("payload", F.encode(F.expr("repeat(token, cast(blocks as int))"), "UTF-8"))


_DATA = "(SELECT *, repeat(token, CAST(blocks AS int)) AS payload FROM {}) r"


@query(f"""SELECT vol_id, lsid, CASE WHEN ev % 101 <> 5 THEN actual ELSE 0 END AS expected, actual, ev % 101 <> 5 OR actual = 0 AS ok
FROM (SELECT vol_id, lsid, ev, {sum_sql('payload', 'vol_id * 7')} AS actual FROM {_DATA.format('log_record')} WHERE NOT is_padding AND NOT is_discard) x""")
def l3_log_checksum_audit(t):
    from .functions.checksum import block_sum

    rows = _with_bytes(t.log_record).withColumn("salt", F.col("vol_id") * 7)
    rows = rows.withColumn("checksum", F.when(F.col("ev") % 101 != 5, block_sum(F.col("payload"), F.col("salt"))).otherwise(0))
    return log.log_checksum_audit(rows, "checksum", salt="salt").select("vol_id", "lsid", F.col("checksum").alias("expected"), "actual", "ok")


@query(f"""SELECT vol_id, lsid, CAST(k AS bigint) AS k, {sum_sql('part')} AS sum FROM (
  SELECT vol_id, lsid, k, substring(payload, CAST(k * 32 + 1 AS int), 32) AS part FROM (SELECT *, unnest(range((length(payload) + 31) // 32)) AS k FROM {_DATA.format('log_record')} WHERE NOT is_padding AND NOT is_discard) x) y""")
def l12_log_block_checksums(t):
    return log.log_block_checksums(_with_bytes(t.log_record), 32)


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY vol_id ORDER BY lsid, ev) AS ord FROM {_DATA.format('log_record')} WHERE NOT is_padding),
s AS (SELECT vol_id, ord, addr, blocks, NOT is_discard AS has_data, {sum_sql('payload')} AS zero_sum, {sum_sql('payload', 'vol_id * 7')} AS salted_sum, CASE WHEN is_discard OR ev % 101 = 5 THEN 0 ELSE {sum_sql('payload', 'vol_id * 7')} END AS checksum FROM l),
r AS (SELECT vol_id, ord, addr, blocks, {sum_sql('payload')} AS csum FROM (SELECT *, repeat(csum, CAST(blocks AS int)) AS payload FROM io_recipe) x),
j AS (SELECT coalesce(s.vol_id, r.vol_id) AS vol_id, coalesce(s.ord, r.ord) AS ord, zero_sum, salted_sum, has_data AND r.addr IS NOT NULL AS by_sum,
  coalesce(s.addr = r.addr, false) AS addr_ok, coalesce(s.blocks = r.blocks, false) AS blocks_ok, coalesce(csum = zero_sum, false) AS recipe_sum_ok, coalesce(checksum = salted_sum, false) AS record_sum_ok
  FROM s FULL JOIN r ON r.vol_id = s.vol_id AND r.ord = s.ord)
SELECT * EXCLUDE (by_sum), CASE WHEN by_sum THEN recipe_sum_ok AND record_sum_ok ELSE addr_ok AND blocks_ok END AS ok FROM j""")
def l10_verify_log_sums(t):
    from .functions.checksum import block_sum, plain_sum

    rows = _with_bytes(t.log_record).withColumn("salt", F.col("vol_id") * 7)
    rows = rows.withColumn("checksum", F.when(F.col("is_discard") | (F.col("ev") % 101 == 5), 0).otherwise(block_sum(F.col("payload"), F.col("salt"))))
    recipe = t.io_recipe.withColumn("payload", F.encode(F.expr("repeat(csum, cast(blocks as int))"), "UTF-8"))
    return log.verify_log_sums(rows, recipe.select("vol_id", "ord", "addr", "blocks", plain_sum(F.col("payload")).alias("csum")))


_PACKED = """SELECT vol_id, CAST((ord - 1) // 4 AS bigint) * 1000 AS pack_lsid, (ord - 1) % 4 AS rec_idx, blocks, is_padding, is_discard, ev % 9 <> 4 AS ok
FROM (SELECT *, row_number() OVER (PARTITION BY vol_id ORDER BY lsid, ev) AS ord FROM log_record) x"""


@query(f"""WITH p AS ({_PACKED}), k AS (SELECT p.*, rec_idx < coalesce(min(CASE WHEN NOT ok THEN rec_idx END) OVER (PARTITION BY vol_id, pack_lsid), 4) AS stays FROM p),
g AS (SELECT vol_id, pack_lsid, count(*) FILTER (stays) AS n_records, count(*) FILTER (stays AND is_padding) AS n_padding, CAST(coalesce(sum(blocks) FILTER (stays AND NOT is_discard), 0) AS bigint) AS total_io_size FROM k GROUP BY 1, 2)
SELECT *, CASE WHEN n_records > 0 THEN pack_lsid + 1 + total_io_size ELSE pack_lsid END AS next_lsid FROM g""")
def l6_shrink_packs(t):
    return log.shrink_packs(t.sql(_PACKED.replace("//", "div").replace("'", "'")))


# Change sets


@query("SELECT vol_id, ev, addr, blocks, rec_type FROM change_input WHERE addr <= 2000 AND 2000 < addr + blocks")
def c1_changes_at(t):
    return chg.changes_at(t.change_input, 2000).select("vol_id", "ev", "addr", "blocks", "rec_type")


@query("SELECT vol_id, gid, " + ", ".join(f"count(*) FILTER (rec_type = '{k}') AS n_{k.lower()}, CAST(coalesce(sum(blocks) FILTER (rec_type = '{k}'), 0) AS bigint) AS {k.lower()}_blocks" for k in ("Normal", "Allzero", "Discard")) + " FROM change_input GROUP BY vol_id, gid")
def c2_change_stats(t):
    return chg.change_stats(t.change_input, ["vol_id", "gid"])


@query(f"""SELECT vol_id, ev, {sum_sql('payload')} AS actual, ev % 7 <> 3 AS ok FROM {_DATA.format('change_input')} WHERE rec_type = 'Normal'""")
def c3_change_checksum_audit(t):
    from .functions.checksum import block_sum

    rows = _with_bytes(t.change_input).withColumn("checksum", block_sum(F.col("payload"), F.lit(0).cast("long")) + F.expr("if(ev % 7 = 3, 1, 0)"))
    return chg.change_checksum_audit(rows, "checksum").select("vol_id", "ev", "actual", "ok")


@query(WIN.format(order="gid DESC, lsid", where="") + "SELECT vol_id, block, CASE WHEN rec_type = 'Normal' THEN concat(token, ':', k) ELSE '0' END AS content FROM win WHERE block >= 1000 AND block < 1300")
def c4_change_dump(t):
    return chg.merged_dump(t.change_input, 1000, 300)


@query("SELECT vol_id, ev, addr, blocks, CASE WHEN is_discard THEN 'Discard' WHEN token = 'Z' THEN 'Allzero' ELSE 'Normal' END AS rec_type FROM log_record WHERE NOT is_padding")
def c5_log_to_changes(t):
    return chg.log_to_changes(t.log_record).select("vol_id", "ev", "addr", "blocks", "rec_type")


@query('SELECT vol_id, ev, addr + o AS addr, least(4, blocks - o) AS blocks, o AS "off" FROM (SELECT *, unnest(range(0, blocks, 4)) AS o FROM change_input) x')
def c6_split_max(t):
    return chg.split_max(t.change_input, 4).select("vol_id", "ev", "addr", "blocks", "off")


@query("""WITH RECURSIVE s AS (
  SELECT vol_id, ev, addr AS a, blocks AS n, CAST(NULL AS bigint) AS addr, CAST(NULL AS bigint) AS size FROM change_input
  UNION ALL
  SELECT vol_id, ev, a + w, n - w, a, w FROM (
    SELECT vol_id, ev, a, n, CAST(least(CASE WHEN a = 0 THEN 64 ELSE a & -a END, CASE WHEN n >= 64 THEN 64 WHEN n >= 32 THEN 32 WHEN n >= 16 THEN 16 WHEN n >= 8 THEN 8 WHEN n >= 4 THEN 4 WHEN n >= 2 THEN 2 ELSE 1 END, 64) AS bigint) AS w
    FROM s WHERE n > 0) x)
SELECT vol_id, ev, addr, size AS blocks FROM s WHERE size IS NOT NULL""")
def c7_split_aligned(t):
    return extent.split_aligned(t.change_input.select("vol_id", "ev", "addr", "blocks"), 64)


@query("""WITH l AS (SELECT vol_id, ev, addr, unnest(range(blocks)) AS k FROM change_input WHERE ev % 2 = 0),
r AS (SELECT DISTINCT vol_id, addr + k AS block FROM (SELECT *, unnest(range(blocks)) AS k FROM change_input WHERE ev % 2 = 1) x),
f AS (SELECT l.vol_id, l.ev, k, addr + k AS block FROM l ANTI JOIN r ON r.vol_id = l.vol_id AND r.block = l.addr + l.k),
i AS (SELECT *, k - row_number() OVER (PARTITION BY vol_id, ev ORDER BY k) AS isl FROM f)
SELECT vol_id, ev AS seq, min(block) AS addr, count(*) AS blocks, min(k) AS "off" FROM i GROUP BY vol_id, ev, isl""")
def c8_changes_minus(t):
    own = t.change_input.withColumn("seq", F.col("ev"))
    return chg.changes_minus(own.where("ev % 2 = 0"), own.where("ev % 2 = 1")).select("vol_id", "seq", "addr", "blocks", "off")


@query("""SELECT a.vol_id, a.ev AS l_seq, b.ev AS r_seq, greatest(a.addr, b.addr) AS addr, least(a.addr + a.blocks, b.addr + b.blocks) - greatest(a.addr, b.addr) AS blocks
FROM change_input a JOIN change_input b ON a.vol_id = b.vol_id AND a.addr < b.addr + b.blocks AND b.addr < a.addr + a.blocks WHERE a.rec_type = 'Discard'""")
def c9_overlap_join(t):
    own = t.change_input.withColumn("seq", F.col("ev"))
    return extent.overlap_join(own.where("rec_type = 'Discard'"), own)


@query(WIN.format(order="ev", where="") + _RUNS.format(n=8))
def x1_compact_log(t):
    return chg.compact_log(t.log_record, 8).select(*_SHOW)


@query(WIN.replace("WITH blk", "WITH RECURSIVE blk").format(order="ev", where="") + """, isl AS (SELECT *, block - row_number() OVER (PARTITION BY vol_id, ev ORDER BY block) AS isl FROM win),
run AS (SELECT vol_id, ev, min(block) AS addr, count(*) AS blocks, min(k) AS o, rec_type, token FROM isl GROUP BY vol_id, ev, isl, rec_type, token),
s AS (
  SELECT vol_id, ev, rec_type, token, addr - o AS start, addr AS a, blocks AS n, CAST(NULL AS bigint) AS addr, CAST(NULL AS bigint) AS size FROM run
  UNION ALL
  SELECT vol_id, ev, rec_type, token, start, a + w, n - w, a, w FROM (
    SELECT *, CAST(least(CASE WHEN a = 0 THEN 64 ELSE a & -a END, CASE WHEN n >= 64 THEN 64 WHEN n >= 32 THEN 32 WHEN n >= 16 THEN 16 WHEN n >= 8 THEN 8 WHEN n >= 4 THEN 4 WHEN n >= 2 THEN 2 ELSE 1 END, 64) AS bigint) AS w
    FROM s WHERE n > 0) x)
SELECT vol_id, addr, size AS blocks, addr - start AS "off", rec_type, token FROM s WHERE size IS NOT NULL""")
def x1_compact_log_aligned(t):
    return chg.compact_log(t.log_record, 64, "aligned").select(*_SHOW)


@query(WIN.format(order="gid DESC, lsid", where="") + _RUNS.format(n=65535))
def x2_merge_changes(t):
    return chg.merge_changes(t.change_input).select(*_SHOW)


@query("""WITH d AS (SELECT vol_id, pos, CASE WHEN vol_id % 5 = 0 AND pos > 7 THEN 'b' ELSE 'a' END AS uuid FROM (SELECT vol_id, b_b AS pos FROM meta_diff) x)
SELECT vol_id, count(DISTINCT uuid) AS n_uuid, count(DISTINCT uuid) <= 1 AS ok FROM d GROUP BY vol_id""")
def x3_check_uuid(t):
    return chg.check_uuid(_with_uuid(t))


def _with_uuid(t):
    return t.meta_diff.select("vol_id", F.col("b_b").alias("pos"), F.expr("case when vol_id % 5 = 0 and b_b > 7 then 'b' else 'a' end").alias("uuid"))


@query("SELECT vol_id, b_b AS pos, 'a' AS uuid FROM meta_diff WHERE NOT (vol_id % 5 = 0 AND b_b > 7)")
def x3_cut_at_uuid_change(t):
    return chg.cut_at_uuid_change(_with_uuid(t))


@query("""WITH m AS (SELECT *, max(addr + blocks) OVER (PARTITION BY vol_id, gid ORDER BY addr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (SELECT DISTINCT vol_id, gid, addr, max(blocks) OVER (PARTITION BY vol_id, gid, addr) AS blocks FROM change_input) x)
SELECT vol_id, gid, count(*) FILTER (addr < e) AS violations FROM m GROUP BY vol_id, gid""")
def c13_assert_disjoint(t):
    return chg.assert_disjoint(t.change_input.groupBy("vol_id", "gid", "addr").agg(F.max("blocks").alias("blocks")), ["vol_id", "gid"])


@query("""WITH c AS (SELECT DISTINCT addr // 16 AS c FROM image_a), b AS (SELECT c, unnest(range(16)) AS k FROM c)
SELECT c * 16 AS addr, CAST(16 AS bigint) AS blocks, 'Normal' AS rec_type, string_agg(coalesce(content, '0'), ',' ORDER BY k) AS payload
FROM b LEFT JOIN image_a i ON i.addr = c * 16 + k GROUP BY c""")
def c14_image_to_changes(t):
    return chg.image_to_changes(t.image_a, 16)


@query(WIN.format(order="gid DESC, lsid", where="") + """, cutted AS (SELECT *, block - row_number() OVER (PARTITION BY vol_id, ev ORDER BY block) AS isl FROM win),
o AS (SELECT vol_id, count(*) AS out_records, CAST(sum(n) AS bigint) AS out_blocks FROM (SELECT vol_id, count(*) AS n FROM cutted GROUP BY vol_id, ev, isl) x GROUP BY vol_id),
i AS (SELECT vol_id, count(*) AS in_records, CAST(sum(blocks) AS bigint) AS in_blocks FROM change_input GROUP BY vol_id)
SELECT * FROM i JOIN o USING (vol_id)""")
def c15_compaction_gain(t):
    return chg.compaction_gain(t.change_input, chg.merge_changes(t.change_input))


# Images

_WON = WIN.format(order="gid DESC, lsid", where="")


_LAID = """
SELECT vol_id, addr, content FROM (SELECT coalesce(w.vol_id, i.vol_id) AS vol_id, coalesce(w.block, i.addr) AS addr,
  CASE WHEN w.block IS NULL THEN i.content WHEN w.rec_type = 'Normal' THEN concat(token, ':', k) END AS content
FROM img i FULL JOIN win w ON w.vol_id = i.vol_id AND w.block = i.addr) x WHERE content IS NOT NULL"""


@query(WIN.format(order="gid DESC, lsid", where="WHERE rec_type <> 'Discard'") + _IMAGE + _LAID)
def d1_apply_changes(t):
    return image.apply_changes(t.volume_image, _ordered(t), size=1 << 20)


_SCAN = _WON + _IMAGE + _LAID
#: The gids that the catalogue's chain reaches: every fourth, where merged diffs end, and those after the last of these.
_REACHED = "ok AS (SELECT vol_id, gid FROM restore_target WHERE gid >= 0 AND (gid % 4 = 0 OR gid > top - top % 4))"
_AT = f"""WITH {_REACHED},
blk AS (SELECT *, addr + k AS block, row_number() OVER (PARTITION BY vol_id, addr + k ORDER BY gid DESC, lsid DESC) AS rn
  FROM (SELECT c.*, unnest(range(blocks)) AS k FROM change_input c JOIN ok ON ok.vol_id = c.vol_id AND c.gid <= ok.gid) x),
win AS (SELECT * FROM blk WHERE rn = 1),
img AS (SELECT * FROM volume_image WHERE vol_id IN (SELECT vol_id FROM ok)),
scan AS ({_LAID})
"""


def _store(t: Inputs) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The image at gid 0, the catalogue, its base and the records of the change sets."""
    base = t.stored("restore_target").select("vol_id", F.lit(0).cast("long").alias("b_b"), F.lit(0).cast("long").alias("b_e"), F.lit(False).alias("is_applying"), F.lit(None).cast("long").alias("e_b"))
    return t.volume_image, t.stored("change_meta"), base, t.stored("change_input").withColumn("seq", chg.order_key())


@query(_AT + "SELECT * FROM scan")
def d2_image_at(t):
    return image.image_at(*_store(t), t.stored("restore_target"))


@query(_AT + "SELECT scan.vol_id, ok.gid, addr, content FROM scan JOIN ok ON ok.vol_id = scan.vol_id")
def d3_restore(t):
    store, targets = _store(t), t.stored("restore_target")
    fourth = targets.where("vol_id % 2 = 0").select("vol_id", F.lit(4).cast("long").alias("gid"))
    newest = targets.where("vol_id % 4 = 0 and top <> 4").select("vol_id", F.col("top").alias("gid"))  # each restored image once
    cold = staged(image.restore(*store, fourth).unionByName(image.restore(*store, newest)), "cold")
    return image.restore(*store, targets, cold)


@query("""SELECT vol_id, CAST(coalesce(sum(n) FILTER (rec_type = 'Normal'), 0) AS bigint) AS normal_blocks, CAST(coalesce(sum(n) FILTER (rec_type = 'Allzero'), 0) AS bigint) AS allzero_blocks,
  CAST(0 AS bigint) AS discard_blocks, CAST(coalesce(sum(n) FILTER (rec_type = 'Discard'), 0) AS bigint) AS ignored_blocks, CAST(sum(blocks - n) AS bigint) AS clipped_blocks
FROM (SELECT *, greatest(0, least(addr + blocks, 4000) - addr) AS n FROM change_input) x GROUP BY vol_id""")
def d4_redo_counts(t):
    return image.redo_counts(chg.log_to_changes(t.log_record), "ignore", 4000)


@query(_SCAN)
def d4_redo_log(t):
    rows = chg.log_to_changes(t.log_record).withColumn("seq", F.col("ev").cast("long"))
    return image.apply_changes(t.volume_image, rows, "passdown")


@query(_SCAN.replace("FROM (SELECT *, unnest(range(blocks)) AS k FROM change_input ) t", "FROM (SELECT *, unnest(range(blocks)) AS k FROM change_input ) t WHERE addr + k < 4000"))
def d5_redo_changes(t):
    return image.apply_changes(t.volume_image, _ordered(t), "zero", cut=4000)


@query("""SELECT vol_id, count(*) AS n_in, count(*) FILTER (ok) AS n_out, CAST(sum(blocks) AS bigint) AS blocks_in, CAST(coalesce(sum(blocks) FILTER (ok), 0) AS bigint) AS blocks_out
FROM (SELECT *, addr + blocks <= 4000 AND rec_type <> 'Discard' AS ok FROM change_input) x GROUP BY vol_id""")
def d5_redo_io_counts(t):
    return image.redo_io_counts(t.change_input, "ignore", 4000)


_DIFFER = """WITH s AS (SELECT max(l_orderkey) * 8 - 300 AS n FROM lineitem),
d AS (SELECT coalesce(a.addr, b.addr) AS addr, a.content, b.content AS b_content FROM image_a a FULL JOIN image_b b ON a.addr = b.addr)
"""


def _size(t):
    return t.spark.table("lineitem").agg(F.max("l_orderkey") * 8 - 300).first()[0]


@query(_DIFFER + "SELECT * FROM d WHERE addr < (SELECT n FROM s) AND content IS DISTINCT FROM b_content")
def d6_image_diff(t):
    return image.image_diff(t.image_a, t.image_b, _size(t))


@query(_DIFFER + "SELECT count(*) AS n_differ, (SELECT n FROM s) AS n_checked FROM d WHERE addr < (SELECT n FROM s) AND content IS DISTINCT FROM b_content")
def d6_image_diff_counts(t):
    return image.image_diff_counts(t.image_a, t.image_b, _size(t))


@query(_DIFFER + """SELECT addr, array_to_string(list_transform(range(1, greatest(length(x), length(y)) + 1), lambda i: CASE WHEN substring(x, CAST(i AS int), 1) = substring(y, CAST(i AS int), 1) THEN '_' ELSE 'X' END), '') AS mask
FROM (SELECT addr, coalesce(content, '0') AS x, coalesce(b_content, '0') AS y FROM d WHERE addr < (SELECT n FROM s) AND content IS DISTINCT FROM b_content) z""")
def d7_image_diff_mask(t):
    return image.image_diff_mask(image.image_diff(t.image_a, t.image_b, _size(t)))


_OTHER = "SELECT vol_id, addr, CASE WHEN addr % 37 = 5 THEN md5(concat('b', addr)) ELSE content END AS content FROM volume_image WHERE addr % 211 <> 3 UNION ALL SELECT vol_id + 5000, addr, content FROM volume_image WHERE addr % 97 = 1"


@query(f"WITH b AS ({_OTHER}) SELECT coalesce(a.vol_id, b.vol_id) AS vol_id, coalesce(a.addr, b.addr) AS addr, a.content, b.content AS b_content FROM volume_image a FULL JOIN b ON a.vol_id = b.vol_id AND a.addr = b.addr WHERE a.content IS DISTINCT FROM b.content")
def d6_volume_diff(t):
    return image.image_diff(t.volume_image, t.sql(_OTHER), by=["vol_id"])


_VOLUME_CHUNK = "SELECT vol_id, addr // 64 * 64 AS chunk, string_agg(concat(addr, '=', content), ',' ORDER BY addr) AS body FROM {} GROUP BY 1, 2"


@query(f"""WITH other AS ({_OTHER}), a AS ({_VOLUME_CHUNK.format('volume_image')}), b AS ({_VOLUME_CHUNK.format('other')}),
c AS (SELECT coalesce(a.vol_id, b.vol_id) AS v, coalesce(a.chunk, b.chunk) AS chunk FROM a FULL JOIN b ON a.chunk = b.chunk AND a.vol_id = b.vol_id WHERE a.body IS DISTINCT FROM b.body),
d AS (SELECT coalesce(x.vol_id, y.vol_id) AS vol_id, coalesce(x.addr, y.addr) AS addr, x.content FROM volume_image x FULL JOIN other y ON x.addr = y.addr AND x.vol_id = y.vol_id)
SELECT d.* FROM d JOIN c ON c.v = d.vol_id AND c.chunk = addr // 64 * 64""")
def d10_volume_sync(t):
    return image.hash_sync(t.volume_image, t.sql(_OTHER), 64, by=["vol_id"])


_CHUNK = "SELECT addr // 64 * 64 AS chunk, sha256(string_agg(concat(addr, '=', content), ',' ORDER BY addr)) AS digest FROM {} GROUP BY 1"


@query(_CHUNK.format("image_a"))
def d8_chunk_digest(t):
    return image.chunk_digest(t.image_a, 64)


def _folded(rows: str, by: str) -> str:
    """SQL of three levels of digests of digests (by, p, digest)."""
    for q in ("p // 4096", "p // 4096", "0"):
        rows = f"SELECT {by}, q AS p, sha256(string_agg(digest, ',' ORDER BY p)) AS digest FROM (SELECT {by}, p, digest, {q} AS q FROM ({rows}) a) b GROUP BY {by}, q"
    return rows


@query(_AT + ", " + "fold AS (" + _folded("SELECT vol_id, addr // 64 AS p, sha256(string_agg(concat(addr, '=', content), ',' ORDER BY addr)) AS digest FROM scan GROUP BY 1, 2", "vol_id") + ") SELECT vol_id, digest FROM fold")
def d9_image_digest(t):
    return image.image_digest(image.image_at(*_store(t), t.stored("restore_target")), 64, ["vol_id"])


_SYNC = f"""WITH a AS ({_CHUNK.format('image_a')}), b AS ({_CHUNK.format('image_b')}),
c AS (SELECT coalesce(a.chunk, b.chunk) AS chunk FROM a FULL JOIN b ON a.chunk = b.chunk WHERE a.digest IS DISTINCT FROM b.digest),
d AS (SELECT coalesce(x.addr, y.addr) AS addr, x.content FROM image_a x FULL JOIN image_b y ON x.addr = y.addr)
SELECT addr, content%s FROM d WHERE addr // 64 * 64 IN (SELECT chunk FROM c)"""


@query(_SYNC % "")
def d10_hash_sync(t):
    return image.hash_sync(t.image_a, t.image_b, 64)


_SNAPS = "SELECT b.vol_id, b.b_b AS from_b, b.b_e AS from_e, r.gid AS to_b, r.gid + r.vol_id % 2 AS to_e FROM base_state b JOIN remote_snap r ON r.vol_id = b.vol_id"


@query(f"SELECT vol_id, from_b AS b_b, from_e AS b_e, to_b AS e_b, to_e AS e_e, from_b <> from_e AS is_mergeable, false AS is_comp_diff FROM ({_SNAPS}) s")
def d10_sync_meta(t):
    return image.sync_meta(t.sql(_SNAPS))


@query(_SYNC % ", true AS is_comp_diff, true AS is_mergeable")
def d11_hash_replicate(t):
    return image.hash_replicate(t.image_a, t.image_b, 64)


_COPY = "SELECT vol_id, 'u' AS archive_uuid, vol_id % 7 AS gid_b, vol_id % 7 AS gid_e, max(addr) + 1 AS size FROM volume_image GROUP BY vol_id"
_DONE = "SELECT vol_id, CASE WHEN vol_id % 5 = 0 THEN 'x' ELSE 'u' END AS archive_uuid, vol_id % 6 AS gid_b, vol_id % 7 AS gid_e, max(addr) - 20 + vol_id % 40 AS progress FROM volume_image WHERE vol_id % 4 <> 3 GROUP BY vol_id"
_START = f"""WITH c AS ({_COPY}), p AS ({_DONE}), st AS (SELECT c.vol_id, coalesce(p.progress, 0) AS start_block, p.vol_id IS NOT NULL AS resumed
FROM c LEFT JOIN p ON p.vol_id = c.vol_id AND p.archive_uuid = c.archive_uuid AND p.gid_b = c.gid_b AND p.gid_e = c.gid_e AND p.progress <= c.size) """


@query(_START + "SELECT * FROM st")
def d12_copy_start(t):
    return image.copy_start(t.sql(_COPY), t.sql(_DONE))


@query(_START + "SELECT i.vol_id, addr // 64 * 64 AS chunk, count(*) AS n_blocks FROM volume_image i JOIN st ON st.vol_id = i.vol_id AND addr >= start_block GROUP BY 1, 2")
def d12_full_copy(t):
    return image.full_copy(t.volume_image, image.copy_start(t.sql(_COPY), t.sql(_DONE)))


@query("SELECT addr, content FROM image_a")
def d13_resync(t):
    return image.resync(t.image_a, t.image_b, 64)


@query(f"SELECT chunk, {sum_sql('body')} AS sum FROM (SELECT addr // 64 * 64 AS chunk, string_agg(content, '' ORDER BY addr) AS body FROM image_a GROUP BY 1) x")
def d14_bulk_checksum(t):
    return image.bulk_checksum(t.image_a, 64)


@query(_WON + """, line AS (SELECT vol_id, ord, addr + k AS block, CASE WHEN csum <> 'Z' THEN concat(csum, ':', k) END AS want FROM (SELECT *, unnest(range(blocks)) AS k FROM io_recipe) x)
SELECT l.vol_id, ord, bool_and(want IS NOT DISTINCT FROM CASE WHEN w.rec_type = 'Normal' THEN concat(w.token, ':', w.k) END) AS ok
FROM line l LEFT JOIN win w ON w.vol_id = l.vol_id AND w.block = l.block GROUP BY l.vol_id, ord""")
def d15_verify_image_recipe(t):
    written = chg.winners(_ordered(t)).where("rec_type = 'Normal'").withColumn("k", F.explode(F.expr("sequence(off, off + blocks - 1)")))
    blocks = written.select("vol_id", (F.col("addr") + F.col("k") - F.col("off")).alias("addr"), chg.block_content().alias("content"))
    return image.verify_image_recipe(blocks, t.io_recipe)


_SIZES = "SELECT vol_id, max(addr) - vol_id % 50 AS size FROM volume_image GROUP BY vol_id"


@query(f"SELECT i.* FROM volume_image i JOIN ({_SIZES}) s ON s.vol_id = i.vol_id AND addr < size")
def d16_grow_image(t):
    return image.grow_image(t.sql(_SIZES), t.volume_image, 1 << 21)[1].select("vol_id", "addr", "content")


@query(f"SELECT vol_id, greatest(size, 300) AS size, CASE WHEN size > 300 THEN 'shrink' END AS error FROM ({_SIZES}) s")
def d16_grown_sizes(t):
    return image.grow_image(t.sql(_SIZES), t.volume_image, 300)[0]


_TREE = "SELECT concat('root/', o_custkey % 100, '/', o_orderkey) AS path, concat(o_custkey, ':', o_orderpriority) AS content FROM orders"
_ENTRY = "sha256(concat(regexp_extract({0}, '([^/]*)$', 1), '=', digest)) AS digest, row_number() OVER (PARTITION BY regexp_extract({0}, '^(.*)/[^/]*$', 1) ORDER BY regexp_extract({0}, '([^/]*)$', 1)) - 1 AS p"


@query(f"""WITH e AS (SELECT path, sha256(content) AS digest FROM ({_TREE}) x),
f AS ({_folded("SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, " + _ENTRY.format('path') + " FROM e", 'path')}),
r AS ({_folded("SELECT 'root' AS path, " + _ENTRY.format('path') + " FROM f", 'path')})
SELECT path, digest FROM e UNION ALL SELECT path, digest FROM f UNION ALL SELECT path, digest FROM r""")
def d18_tree_digest(t):
    return image.tree_digest(t.sql(_TREE).withColumn("content", F.encode("content", "UTF-8")), depth=2)


@query("""WITH s AS (SELECT vol_id AS range_id, lsid AS ts, CASE WHEN is_discard THEN 'd' WHEN is_padding THEN 'p' ELSE 'n' END AS digest FROM log_record),
l AS (SELECT *, lag(digest) OVER (PARTITION BY range_id ORDER BY ts) AS b FROM s) SELECT range_id, ts, digest FROM l WHERE digest IS DISTINCT FROM b""")
def d17_range_change_events(t):
    kind = F.when(F.col("is_discard"), "d").when(F.col("is_padding"), "p").otherwise("n")
    return image.range_change_events(t.log_record.select(F.col("vol_id").alias("range_id"), F.col("lsid").alias("ts"), kind.alias("digest")))


# Catalogue

_REL = """WITH r AS (SELECT d.*, s.b_b AS s_b, s.b_e AS s_e, CASE WHEN d.e_b <= s.b_b THEN 'TOO_OLD' WHEN d.b_b > s.b_b THEN 'TOO_NEW' WHEN NOT d.is_comp_diff OR d.b_b = s.b_b THEN 'APPLICABLE' ELSE 'NOT_APPLICABLE' END AS relation
FROM meta_diff d JOIN base_state s ON s.vol_id = d.vol_id)
"""


@query(_REL + f"SELECT {DIFF}, relation FROM r")
def m1_relation(t):
    return cat.relation(t.meta_diff, t.base_state).select(*_DIFF, "relation")


@query(_REL + f"SELECT {DIFF}, e_b AS n_b, CASE WHEN b_b = b_e AND e_b = e_e THEN greatest(e_b, s_e) ELSE e_e END AS n_e FROM r WHERE relation = 'APPLICABLE'")
def m2_apply_snap(t):
    return cat.apply_snap(t.meta_diff, t.base_state).select(*_DIFF, "n_b", "n_e")


@query("""WITH l AS (SELECT *, lead(b_b) OVER w AS n_b_b, lead(e_b) OVER w AS n_e_b, lead(is_mergeable) OVER w AS nm, lead(is_comp_diff) OVER w AS nc FROM meta_diff WINDOW w AS (PARTITION BY vol_id ORDER BY b_b, e_b, e_e))
SELECT vol_id, b_b, e_b, n_b_b, n_e_b, nm AND NOT nc AND NOT is_comp_diff AND n_b_b <= e_b AND e_b < n_e_b AS mergeable_pair FROM l WHERE n_b_b IS NOT NULL""")
def m3_can_merge(t):
    return cat.can_merge(t.meta_diff).select("vol_id", "b_b", "e_b", "n_b_b", "n_e_b", "mergeable_pair")


_HEAD = WALK + """, lagged AS (SELECT *, lag(is_comp_diff) OVER (PARTITION BY vol_id ORDER BY pos) AS pc FROM walk),
bad AS (SELECT vol_id, min(pos) AS stop FROM lagged WHERE pos > 1 AND (NOT is_mergeable OR is_comp_diff OR pc) GROUP BY vol_id),
head AS (SELECT l.* FROM lagged l LEFT JOIN bad ON bad.vol_id = l.vol_id WHERE stop IS NULL OR l.pos < stop)
"""


@query(_HEAD.replace(WALK, WALK + """, mg AS (
  SELECT vol_id, pos, b_b AS m_b, b_e AS m_be, is_mergeable AS m_ok, e_b AS m_eb, e_e AS m_ee FROM walk WHERE pos = 1
  UNION ALL
  SELECT w.vol_id, w.pos, m.m_b, m.m_be, m.m_ok, w.e_b, CASE WHEN w.b_b = w.b_e AND w.e_b = w.e_e THEN greatest(w.e_b, m.m_ee) ELSE w.e_e END FROM mg m JOIN walk w ON w.vol_id = m.vol_id AND w.pos = m.pos + 1)
""") + ", top AS (SELECT vol_id, max(pos) AS pos, arg_max(ts, pos) AS ts FROM head GROUP BY vol_id) SELECT mg.vol_id, m_b AS b_b, m_be AS b_e, m_eb AS e_b, m_ee AS e_e, m_ok AS is_mergeable, top.ts, mg.pos AS n FROM mg JOIN top ON top.vol_id = mg.vol_id AND top.pos = mg.pos")
def m3_merge_meta(t):
    return cat.merge_meta(cat.applicable_mergeable_chain(t.meta_diff, t.base_state))


@query("SELECT vol_id, b_b, e_b FROM meta_diff d WHERE EXISTS (SELECT 1 FROM meta_diff x WHERE x.vol_id = d.vol_id AND x.b_b <= d.b_b AND x.e_b >= d.e_b AND (x.b_b < d.b_b OR x.e_b > d.e_b))")
def m4_contained_diffs(t):
    return cat.contained_diffs(t.meta_diff).select("vol_id", "b_b", "e_b")


_BROKEN = """SELECT vol_id, b_b, CASE WHEN vol_id % 7 = 3 AND b_b % 5 = 0 THEN b_b - 1 ELSE b_e END AS b_e, e_b, e_e FROM meta_diff
UNION ALL SELECT vol_id, b_b, b_e, e_b, e_e FROM meta_diff WHERE vol_id % 11 = 2 AND b_b % 4 = 1"""


@query(f"""WITH d AS ({_BROKEN})
SELECT vol_id, CASE WHEN b_b > b_e OR e_b > e_e THEN 'snapshot' ELSE 'progress' END AS what FROM d WHERE b_b > b_e OR e_b > e_e OR b_b >= e_b OR b_e > e_e
UNION ALL SELECT vol_id, 'duplicate' FROM (SELECT DISTINCT vol_id, b_b, b_e, e_b, e_e FROM (SELECT *, count(*) OVER (PARTITION BY vol_id, b_b, b_e, e_b, e_e) AS n FROM d) x WHERE n > 1) y
UNION ALL SELECT vol_id, 'state' FROM base_state WHERE is_applying AND vol_id % 20 = 0""")
def m5_validate_catalog(t):
    states = t.base_state.withColumn("e_b", F.expr("case when vol_id % 20 = 0 then b_b else e_b end"))
    return cat.validate_catalog(t.sql(_BROKEN), states)


@query("SELECT r.vol_id, r.gid, (SELECT count(*) FROM meta_diff d WHERE d.vol_id = r.vol_id AND d.b_b <= r.gid AND r.gid < d.e_b) AS n_diffs FROM remote_snap r")
def m6_diffs_at_gid(t):
    return cat.diffs_at_gid(t.meta_diff, t.remote_snap)


@query("""WITH g AS (SELECT vol_id, b_b AS g FROM meta_diff UNION SELECT vol_id, e_b FROM meta_diff),
r AS (SELECT vol_id, g AS begin_gid, lead(g) OVER (PARTITION BY vol_id ORDER BY g) AS end_gid FROM g)
SELECT *, (SELECT count(*) FROM meta_diff d WHERE d.vol_id = r.vol_id AND d.b_b <= r.begin_gid AND r.begin_gid < d.e_b) AS n_diffs FROM r WHERE end_gid IS NOT NULL""")
def m6_gid_ranges(t):
    return cat.gid_ranges(t.meta_diff)


@query(f"SELECT r.gid, {', '.join('d.' + c for c in _DIFF)} FROM remote_snap r JOIN meta_diff d ON d.vol_id = r.vol_id AND d.b_b <= r.gid AND r.gid < d.e_b")
def m6_diffs_holding(t):
    return cat.diffs_holding(t.meta_diff, t.remote_snap).select("gid", *_DIFF)


@query(f"""WITH g AS (SELECT vol_id, b_b AS g FROM meta_diff UNION SELECT vol_id, e_b FROM meta_diff),
r AS (SELECT vol_id, g AS begin_gid, lead(g) OVER (PARTITION BY vol_id ORDER BY g) AS end_gid FROM g)
SELECT begin_gid, end_gid, {', '.join('d.' + c for c in _DIFF)} FROM r JOIN meta_diff d ON d.vol_id = r.vol_id AND d.b_b <= r.begin_gid AND r.begin_gid < d.e_b WHERE end_gid IS NOT NULL""")
def m6_range_diffs(t):
    return cat.range_diffs(t.meta_diff).select("begin_gid", "end_gid", *_DIFF)


@query("SELECT vol_id, max(e_b) * 0 + arg_max(b_b, e_b * 1000000 + b_b) AS b_b, max(e_b) AS e_b FROM meta_diff GROUP BY vol_id")
def m7_max_progress(t):
    return cat.max_progress(t.meta_diff)


_CH = "vol_id, pos, b_b, b_e, e_b, e_e, s_b, s_e"
_CHL = _CH.split(", ")


@query(WALK + f"SELECT {_CH} FROM walk WHERE s_b <= 12")
def m8_applicable_chain(t):
    return cat.applicable_until(t.meta_diff, t.base_state, max_gid=12).select(*_CHL)


@query(WALK + f", late AS (SELECT vol_id, min(pos) AS stop FROM walk WHERE ts > TIMESTAMP '1997-01-01' OR data_size > 400000 GROUP BY vol_id) SELECT {', '.join('w.' + c for c in _CHL)} FROM walk w LEFT JOIN late ON late.vol_id = w.vol_id WHERE stop IS NULL OR w.pos < stop")
def m8_applicable_chain_until(t):
    return cat.applicable_until(t.meta_diff, t.base_state, max_ts=datetime(1997, 1, 1), pred=F.col("data_size") <= 400_000).select(*_CHL)


@query(WALK + f"SELECT {_CH} FROM walk")
def m8_chain_of_all(t):
    """Volumes of more than 50 diffs by pointer doubling, in slices of 64 gids; the others by a walk."""
    return chain_of_all(t.stored("meta_diff"), t.stored("base_state"), huge=50, width=64).select(*_CHL)


@query(_HEAD + f"SELECT {_CH} FROM head")
def m9_applicable_mergeable_chain(t):
    return cat.applicable_mergeable_chain(t.meta_diff, t.base_state).select(*_CHL)


_M10 = """WITH RECURSIVE f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vol_id ORDER BY b_b, e_b DESC, e_e, b_e) AS rn FROM meta_diff WHERE b_b >= 5) x WHERE rn = 1),
walk AS (
  SELECT CAST(0 AS bigint) AS pos, vol_id, b_b, b_e, e_b, e_e, is_comp_diff, b_b AS h FROM f
  UNION ALL
  SELECT pos, vol_id, b_b, b_e, e_b, e_e, is_comp_diff, h FROM (
    SELECT w.pos + 1 AS pos, d.vol_id, d.b_b, d.b_e, d.e_b, d.e_e, d.is_comp_diff, w.h, row_number() OVER (PARTITION BY w.vol_id ORDER BY d.e_b DESC, d.b_b DESC, d.e_e, d.b_e) AS rn
    FROM walk w JOIN meta_diff d ON d.vol_id = w.vol_id AND d.is_mergeable AND NOT d.is_comp_diff AND d.b_b >= w.h AND d.b_b <= w.e_b AND w.e_b < d.e_b AND NOT w.is_comp_diff) x WHERE rn = 1)
"""


@query(_M10 + "SELECT vol_id, pos, b_b, e_b FROM walk w WHERE NOT EXISTS (SELECT 1 FROM walk x WHERE x.vol_id = w.vol_id AND x.pos <= w.pos AND x.b_b >= 15)")
def m10_mergeable_chain(t):
    return cat.mergeable_chain(t.meta_diff, 5, 15).select("vol_id", "pos", "b_b", "e_b")


@query(WALK + f"SELECT {', '.join('w.' + c for c in _CHL)} FROM walk w JOIN base_state b ON b.vol_id = w.vol_id AND b.is_applying WHERE w.s_b <= b.e_b")
def m11_minimum_chain(t):
    return cat.minimum_chain(t.meta_diff, t.base_state).select(*_CHL)


_LATEST = "SELECT b.vol_id, coalesce(l.s_b, b.b_b) AS gid_b, coalesce(l.s_e, b.b_e) AS gid_e, l.ts FROM base_state b LEFT JOIN (SELECT vol_id, arg_max(s_b, pos) AS s_b, arg_max(s_e, pos) AS s_e, arg_max(ts, pos) AS ts FROM walk GROUP BY vol_id) l ON l.vol_id = b.vol_id"


@query(WALK + _LATEST)
def m12_latest_state(t):
    return cat.latest_state(t.meta_diff, t.base_state)


@query(WALK + """, c AS (SELECT vol_id, CAST(0 AS bigint) AS pos, b_b AS gid FROM base_state WHERE NOT is_applying AND b_b = b_e
  UNION ALL SELECT w.vol_id, w.pos, w.s_b FROM walk w JOIN base_state b ON b.vol_id = w.vol_id WHERE w.s_b = w.s_e AND w.s_b >= coalesce(b.e_b, b.b_b))
SELECT vol_id, arg_min(gid, pos) AS gid FROM c GROUP BY vol_id""")
def m13_oldest_clean_state(t):
    return cat.oldest_clean_state(t.meta_diff, t.base_state)


_REST = WALK + """, st AS (SELECT vol_id, pos, s_b AS gid, s_e AS e, is_mergeable FROM walk UNION ALL SELECT vol_id, 0, b_b, b_e, false FROM base_state WHERE NOT is_applying),
rs AS (SELECT *, NOT coalesce(lead(is_mergeable) OVER (PARTITION BY vol_id ORDER BY pos), false) AS explicit FROM st)
"""


@query(_REST + "SELECT vol_id, pos, gid, explicit FROM rs WHERE gid = e AND (explicit OR pos = 0)")
def m14_restorable(t):
    return cat.restorable(t.meta_diff, t.base_state)


@query(_REST + "SELECT vol_id, pos, gid, explicit FROM rs WHERE gid = e")
def m14_clean_snapshots(t):
    return cat.restorable(t.meta_diff, t.base_state, True)


@query(WALK + f", ok AS (SELECT w.vol_id, w.pos AS upto FROM walk w JOIN remote_snap r ON r.vol_id = w.vol_id AND r.gid = w.s_b WHERE w.s_b = w.s_e) SELECT {', '.join('w.' + c for c in _CHL)} FROM walk w JOIN ok ON ok.vol_id = w.vol_id AND w.pos <= ok.upto")
def m15_plan_restore(t):
    return cat.plan_restore(t.meta_diff, t.base_state, t.remote_snap).select(*_CHL)


@query(WALK + f", n AS (SELECT w.vol_id, max(w.pos) AS need FROM walk w JOIN base_state b ON b.vol_id = w.vol_id AND b.is_applying WHERE w.s_b <= b.e_b GROUP BY 1) SELECT {', '.join('w.' + c for c in _CHL)} FROM walk w LEFT JOIN n ON n.vol_id = w.vol_id WHERE w.s_b <= 20 AND w.pos <= greatest(1, coalesce(need, 0))")
def m15_plan_apply(t):
    return cat.plan_apply(t.meta_diff, t.base_state, 20, 1).select(*_CHL)


_CUT = ", cut AS (SELECT *, sum(data_size) OVER (PARTITION BY vol_id ORDER BY pos) AS upto, row_number() OVER (PARTITION BY vol_id ORDER BY pos) AS rk FROM {}) "


@query(WALK + _CUT.format("walk") + f"SELECT {_CH} FROM cut WHERE rk = 1 OR upto <= 2000000 AND rk <= 9")
def m16_truncate_by_size(t):
    return cat.truncate_by_size(applicable_chain(t.meta_diff, t.base_state), 2_000_000, 9).select(*_CHL)


@query(WALK + f"SELECT {DIFF} FROM meta_diff d WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.vol_id = d.vol_id AND w.b_b = d.b_b AND w.b_e = d.b_e AND w.e_b = d.e_b AND w.e_e = d.e_e)")
def m17_garbage(t):
    return cat.garbage(t.meta_diff, t.base_state).select(*_DIFF)


@query(f"SELECT {DIFF} FROM meta_diff WHERE b_b >= 3 AND e_b <= 9 AND NOT (b_b = 3 AND e_b = 9)")
def m18_gc_range(t):
    return cat.gc_range(t.meta_diff, 3, 9).select(*_DIFF)


@query(f"SELECT {DIFF} FROM meta_diff WHERE e_b <= 10")
def m19_expire_before(t):
    return cat.expire_before(t.meta_diff, 10).select(*_DIFF)


@query("SELECT vol_id, b_b, e_b, false AS is_mergeable FROM meta_diff WHERE b_b = 8 AND is_mergeable")
def m20_set_snapshot(t):
    return cat.set_snapshot(t.meta_diff, 8, True).select("vol_id", "b_b", "e_b", "is_mergeable")


@query("SELECT vol_id, bool_or(b_b = 8) AS found FROM meta_diff GROUP BY vol_id")
def m20_snapshot_found(t):
    return cat.snapshot_found(t.meta_diff, 8)


@query(f"SELECT {DIFF} FROM meta_diff WHERE b_b >= 4 AND b_b < 8")
def m21_list_diffs(t):
    return cat.list_diffs(t.meta_diff, 4, 8).select(*_DIFF)


@query("SELECT vol_id, count(*) AS n_diffs, CAST(sum(data_size) AS bigint) AS total_size, min(b_b) AS min_gid, max(e_b) AS max_gid, max(b_b) AS max_start FROM meta_diff GROUP BY vol_id")
def m21_diff_totals(t):
    return cat.diff_totals(t.meta_diff)


_BEGIN = WALK + ", l AS (SELECT vol_id, arg_max(s_b, pos) AS e_b, arg_max(s_e, pos) AS e_e FROM walk WHERE s_b <= 12 GROUP BY vol_id) SELECT b.vol_id, {} FROM base_state b JOIN l ON l.vol_id = b.vol_id"


@query(_REL + f"SELECT {', '.join('r.' + c for c in _DIFF)}, relation = 'APPLICABLE' AND (NOT b.is_applying OR b.e_b <= r.e_b) AS can_apply FROM r JOIN base_state b ON b.vol_id = r.vol_id")
def m22_can_apply(t):
    return cat.can_apply(t.meta_diff, t.base_state).select(*_DIFF, "can_apply")


_LISTS = "SELECT w.* FROM walk w WHERE s_b <= 12 AND NOT (vol_id % 3 = 1 AND pos = 2)"


@query(WALK + f""", l AS ({_LISTS}), g AS (SELECT l.*, lag(l.e_b) OVER (PARTITION BY l.vol_id ORDER BY pos) AS before FROM l),
k AS (SELECT g.*, b.is_applying, b.e_b AS begun, coalesce(before, b.b_b) AS here FROM g JOIN base_state b ON b.vol_id = g.vol_id)
SELECT vol_id, bool_and(e_b > here AND CASE WHEN is_comp_diff THEN b_b = here ELSE b_b <= here END) AND NOT bool_or(is_applying AND begun > (SELECT max(e_b) FROM l WHERE l.vol_id = k.vol_id)) AS can_apply FROM k GROUP BY vol_id""")
def m22_can_apply_list(t):
    """The chains up to gid 12, some without their second diff."""
    lists = cat.applicable_until(t.meta_diff, t.base_state, max_gid=12).where("not (vol_id % 3 = 1 and pos = 2)")
    return cat.can_apply_list(lists, t.base_state)


@query(_BEGIN.format("true AS is_applying, b.b_b, b.b_e, l.e_b, l.e_e"))
def m22_begin_apply(t):
    return cat.begin_apply(t.base_state, cat.applicable_until(t.meta_diff, t.base_state, max_gid=12))


@query(_BEGIN.format("false AS is_applying, l.e_b AS b_b, l.e_e AS b_e"))
def m22_end_apply(t):
    return cat.end_apply(cat.begin_apply(t.base_state, cat.applicable_until(t.meta_diff, t.base_state, max_gid=12)))


@query("""WITH r AS (SELECT DISTINCT vol_id, 3 + vol_id % 2 AS gid_b, 6 + vol_id % 3 AS gid_e FROM base_state)
SELECT vol_id, gid_b, gid_e, coalesce((SELECT bool_or(d.b_b = r.gid_b) AND bool_or(d.e_b = r.gid_e) AND bool_and(d.b_b = r.gid_b OR d.is_mergeable) AND NOT bool_or(d.is_comp_diff) FROM meta_diff d WHERE d.vol_id = r.vol_id AND d.b_b >= r.gid_b AND d.e_b <= r.gid_e), false) AS ok FROM r""")
def m23_verify_merge_range(t):
    asked = t.base_state.select("vol_id", F.expr("3 + vol_id % 2").alias("gid_b"), F.expr("6 + vol_id % 3").alias("gid_e"))
    return cat.verify_merge_range(t.meta_diff, asked)


@query(_M10 + ", k AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM walk x WHERE x.vol_id = w.vol_id AND x.pos <= w.pos AND x.b_b >= 15)) SELECT vol_id, arg_min(b_b, pos) AS b_b, arg_max(e_b, pos) AS e_b, count(*) AS n FROM k GROUP BY vol_id HAVING count(*) >= 2")
def m24_merge_range(t):
    return cat.merge_range(t.meta_diff, 5, 15).select("vol_id", "b_b", "e_b", "n")


@query(_M10.replace("d.is_comp_diff, w.h,", "d.is_comp_diff, d.data_size, w.h,").replace("e_e, is_comp_diff, b_b AS h FROM f", "e_e, is_comp_diff, data_size, b_b AS h FROM f").replace("e_e, is_comp_diff, h FROM (", "e_e, is_comp_diff, data_size, h FROM (")
       + _CUT.format("walk") + ", k AS (SELECT * FROM cut WHERE rk = 1 OR upto <= 900000) SELECT vol_id, arg_min(b_b, pos) AS b_b, arg_max(e_b, pos) AS e_b, count(*) AS n FROM k GROUP BY vol_id HAVING count(*) >= 2")
def m24_merge_range_by_size(t):
    return cat.merge_range(t.meta_diff, 5, max_size=900_000).select("vol_id", "b_b", "e_b", "n")


@query(WALK + """, g AS (SELECT b.vol_id, coalesce(max(w.s_b), min(b.b_b)) AS gid_b, coalesce(arg_max(w.s_e, w.pos), min(b.b_e)) AS gid_e, count(w.pos) AS n_applied FROM base_state b LEFT JOIN walk w ON w.vol_id = b.vol_id AND w.s_b <= 12 GROUP BY b.vol_id)
SELECT *, (SELECT count(*) FROM meta_diff d WHERE d.vol_id = g.vol_id AND d.e_b <= g.gid_b) AS n_expired FROM g""")
def m25_apply_to_gid(t):
    return cat.apply_to_gid(t.meta_diff, t.base_state, 12)


# Ledger

_PERM = "p AS (SELECT vol_id, max(next_lsid) - 50 AS perm_lsid FROM log_record GROUP BY vol_id)"


def _permanent(t):
    return t.log_record.groupBy("vol_id").agg((F.max("next_lsid") - 50).alias("perm_lsid"))


_WINDOW = f"""WITH {_PERM},
r AS (SELECT l.*, p.perm_lsid, row_number() OVER w AS rn, first(l.lsid) OVER w AS lsid_b, first(l.gid) OVER w AS gid_b, first(l.is_mergeable) OVER w AS is_mergeable_b, first(l.ts) OVER w AS ts_b,
  lag(l.is_mergeable) OVER w AS end_before FROM lsid_gid l JOIN p ON p.vol_id = l.vol_id WINDOW w AS (PARTITION BY l.vol_id ORDER BY l.gid)),
b AS (SELECT vol_id, min(rn) AS stop FROM r WHERE rn > 2 AND NOT (end_before AND lsid - lsid_b <= 200 AND lsid <= perm_lsid) GROUP BY vol_id),
x AS (SELECT r.* FROM r LEFT JOIN b ON b.vol_id = r.vol_id WHERE rn > 1 AND (stop IS NULL OR rn < stop)),
e AS (SELECT vol_id, max(lsid) AS lsid, max(gid) AS gid, arg_max(is_mergeable, gid) AS is_mergeable, arg_max(ts, gid) AS ts, max(perm_lsid) AS perm_lsid, max(lsid_b) AS lsid_b, max(gid_b) AS gid_b,
  bool_or(is_mergeable_b) AS is_mergeable_b, max(ts_b) AS ts_b, count(*) AS n FROM x GROUP BY vol_id),
tw AS (SELECT * EXCLUDE (n), lsid_limit, perm_lsid < lsid_limit AS later FROM (SELECT *, CASE WHEN n = 1 AND gid = gid_b + 1 THEN lsid ELSE least(lsid, lsid_b + 200) END AS lsid_limit FROM e) y)
""".replace("SELECT * EXCLUDE (n), lsid_limit, perm_lsid", "SELECT * EXCLUDE (n), perm_lsid")


@query("""WITH s AS (SELECT *, coalesce(1 + (lsid - lag(lsid) OVER w) // 100, 0) AS step FROM lsid_gid WINDOW w AS (PARTITION BY vol_id ORDER BY lsid, gid))
SELECT vol_id, lsid, CAST(sum(step) OVER (PARTITION BY vol_id ORDER BY lsid, gid) AS bigint) AS new_gid FROM s""")
def g1_take_snapshots(t):
    return ledger.take_snapshots(t.lsid_gid, 100)


@query(_WINDOW + "SELECT * FROM tw")
def g2_transfer_window(t):
    return ledger.transfer_window(t.lsid_gid, 200, _permanent(t))


@query(_WINDOW + "SELECT vol_id, gid_b AS b_b, CASE WHEN lsid_limit < lsid THEN gid_b + 1 ELSE gid END AS e_b, lsid_limit < lsid AS is_partial, is_mergeable_b AS is_mergeable, ts FROM tw")
def g3_transfer_meta(t):
    return ledger.transfer_meta(ledger.transfer_window(t.lsid_gid, 200, _permanent(t)))


@query(_WINDOW + """, d AS (SELECT vol_id, lsid_limit AS lsid, CASE WHEN lsid_limit < lsid THEN gid_b + 1 ELSE gid END AS gid, lsid_limit < lsid OR is_mergeable AS is_mergeable, CASE WHEN lsid_limit < lsid THEN ts_b ELSE ts END AS ts FROM tw)
SELECT * FROM d UNION ALL SELECT l.vol_id, l.lsid, l.gid, l.is_mergeable, l.ts FROM lsid_gid l LEFT JOIN d ON d.vol_id = l.vol_id WHERE d.vol_id IS NULL OR l.lsid > d.lsid OR (l.lsid = d.lsid AND l.gid > d.gid)""")
def g4_finish_transfer(t):
    return ledger.finish_transfer(t.lsid_gid, ledger.transfer_window(t.lsid_gid, 200, _permanent(t)))


@query("""WITH e AS (SELECT vol_id, max(next_lsid) + 9000 AS end_lsid FROM log_record GROUP BY vol_id), l AS (SELECT vol_id, min(lsid) AS lsid_b, count(*) - 1 AS waiting FROM lsid_gid GROUP BY vol_id)
SELECT l.vol_id, waiting, waiting > 0 OR lsid_b < end_lsid AS now, CASE WHEN lsid_b < end_lsid THEN (end_lsid - lsid_b) * 512 // 1048576 + 1 ELSE 0 END AS remaining_mb FROM l JOIN e ON e.vol_id = l.vol_id""")
def g5_transfer_backlog(t):
    return ledger.transfer_backlog(t.lsid_gid, t.log_record.groupBy("vol_id").agg((F.max("next_lsid") + 9000).alias("end_lsid")))


_ENDS = "SELECT vol_id, CAST(min(next_lsid) + vol_id % 3 * 3000 AS bigint) AS permanent_lsid, max(next_lsid) + 9000 AS latest_lsid FROM log_record GROUP BY vol_id"


@query(f"""WITH e AS ({_ENDS}), l AS (SELECT vol_id, min(lsid) AS b, count(*) - 1 AS waiting FROM lsid_gid GROUP BY vol_id)
SELECT l.vol_id, waiting, waiting > 0 OR b < permanent_lsid AS now, CASE WHEN b < permanent_lsid THEN (permanent_lsid - b) * 512 // 1048576 + 1 ELSE 0 END AS remaining_mb,
  waiting > 0 OR b < latest_lsid AS later, CASE WHEN b < latest_lsid THEN (latest_lsid - b) * 512 // 1048576 + 1 ELSE 0 END AS later_mb FROM l JOIN e ON e.vol_id = l.vol_id""")
def g5_transfer_needed(t):
    return ledger.transfer_needed(t.lsid_gid, t.sql(_ENDS))


@query("SELECT vol_id, min(gid) AS gid_b, max(gid) AS gid_e, arg_max(lsid, gid) AS latest_lsid FROM lsid_gid GROUP BY vol_id")
def g6_ledger_bounds(t):
    return ledger.ledger_bounds(t.lsid_gid)


# Policy


def _restorable_ts(t, every: bool = False):
    ts = t.chain().select("vol_id", "pos", "ts")
    return cat.restorable(t.meta_diff, t.base_state, every, t.chain()).join(ts, ["vol_id", "pos"], "left")


_RETAINED = """, rt AS (SELECT rs.vol_id, rs.pos, rs.gid, w.ts, row_number() OVER (PARTITION BY rs.vol_id ORDER BY rs.pos) AS rk FROM rs LEFT JOIN walk w ON w.vol_id = rs.vol_id AND w.pos = rs.pos WHERE rs.gid = rs.e{}),
nw AS (SELECT vol_id, min(pos) AS stop FROM rt WHERE rk > 1 AND ts > TIMESTAMP '1996-01-01' GROUP BY vol_id),
kept AS (SELECT rt.vol_id, arg_max(rt.gid, rt.pos) AS gid FROM rt LEFT JOIN nw ON nw.vol_id = rt.vol_id WHERE rk > 1 AND (stop IS NULL OR rt.pos < stop) GROUP BY rt.vol_id)
"""


@query(_REST + _RETAINED.format(" AND (rs.explicit OR rs.pos = 0)") + "SELECT * FROM kept")
def w1_retention_target(t):
    return policy.retention_target(_restorable_ts(t), "1996-01-01 00:00:00")


#: The scan of each volume's chain for merge ranges, a step a row: the run that is open and the best one closed.
_RUNS_SCAN = """, scan AS (
  SELECT DISTINCT vol_id, CAST(0 AS bigint) AS pos, CAST(NULL AS bigint) AS first, CAST(NULL AS bigint) AS last, CAST(0 AS bigint) AS total, CAST(0 AS bigint) AS n,
    CAST(NULL AS bigint) AS avg_, CAST(NULL AS bigint) AS b_, CAST(NULL AS bigint) AS e_, CAST(NULL AS bigint) AS n_ FROM walk
  UNION ALL
  SELECT vol_id, pos, CASE WHEN ok THEN first WHEN can THEN b_b END, CASE WHEN ok OR can THEN e_b END, CASE WHEN ok THEN t WHEN can THEN data_size ELSE 0 END, CASE WHEN ok THEN n + 1 WHEN can THEN 1 ELSE 0 END,
    CASE WHEN better THEN t // nullif(n, 0) ELSE avg_ END, CASE WHEN better THEN first ELSE b_ END, CASE WHEN better THEN last ELSE e_ END, CASE WHEN better THEN n ELSE n_ END
  FROM (SELECT *, first IS NOT NULL AND NOT ok AND n >= 2 AND (avg_ IS NULL OR t // nullif(n, 0) < avg_) AS better
    FROM (SELECT *, first IS NOT NULL AND is_mergeable AND can AND NOT coalesce(p > first AND p < e_b, false) AND t <= 600000 AND n <= 10 AS ok
      FROM (SELECT w.vol_id, w.pos, w.b_b, w.e_b, w.is_mergeable, w.data_size, s.first, s.last, s.n, s.avg_, s.b_, s.e_, s.n_, r.gid AS p, s.total + w.data_size AS t, NOT w.is_comp_diff AND w.data_size <= 600000 AS can
        FROM scan s JOIN walk w ON w.vol_id = s.vol_id AND w.pos = s.pos + 1 LEFT JOIN remote_snap r ON r.vol_id = w.vol_id) a) b) c),
best AS (SELECT vol_id, b_ AS gid_b, e_ AS gid_e, n_ AS n, avg_ AS average FROM (SELECT *, row_number() OVER (PARTITION BY vol_id ORDER BY pos DESC) AS rk FROM scan) x WHERE rk = 1 AND b_ IS NOT NULL)
"""


def _ranges(t, chain: DataFrame | None = None):
    return policy.best_merge_range(applicable_chain(t.meta_diff, t.base_state) if chain is None else chain, t.remote_snap, 600_000, 10)


@query(WALK + _RUNS_SCAN + "SELECT * FROM best")
def w2_best_merge_range(t):
    return _ranges(t)


_STOP = """, sd AS (SELECT w.vol_id, w.pos, w.e_b, w.data_size, lead(w.b_b) OVER (PARTITION BY w.vol_id ORDER BY w.pos) > r.gid - 12 AS past FROM walk w JOIN remote_snap r ON r.vol_id = w.vol_id),
sb AS (SELECT vol_id, min(pos) AS begin FROM sd WHERE past GROUP BY vol_id),
sc AS (SELECT sd.*, begin, sum(data_size) OVER (PARTITION BY sd.vol_id ORDER BY pos) AS upto FROM sd JOIN sb ON sb.vol_id = sd.vol_id AND pos >= begin),
se AS (SELECT vol_id, begin, coalesce(min(pos) FILTER (upto > 500000), max(pos)) AS last FROM sc GROUP BY vol_id, begin),
stop AS (SELECT se.vol_id, sc.e_b AS stop_gid FROM se JOIN sc ON sc.vol_id = se.vol_id AND sc.pos = CASE WHEN last = se.begin THEN last + 1 ELSE last END)
"""


def _behind(t):
    return t.remote_snap.withColumn("gid", F.col("gid") - 12)


@query(WALK + _STOP + "SELECT * FROM stop")
def w3_replication_target(t):
    return policy.replication_target(applicable_chain(t.meta_diff, t.base_state), _behind(t), 500_000)


_NOW = "1996-06-01 00:00:00"
_DUE = "(l.ts IS NULL OR epoch(TIMESTAMP '1996-06-01') - epoch(l.ts) >= {})"
_APPLY = _RETAINED.format("") + f""", ap AS (SELECT CAST(1 AS int) AS priority, vol_id, e_b AS gid, CAST(0 AS bigint) AS size FROM base_state WHERE is_applying
UNION ALL SELECT 2, k.vol_id, k.gid, CAST(coalesce((SELECT sum(data_size) FROM meta_diff d WHERE d.vol_id = k.vol_id AND d.b_b < k.gid), 0) AS bigint) FROM kept k LEFT JOIN last_action l ON l.vol_id = k.vol_id WHERE {_DUE.format(8_000_000)})
"""


def _applies(t):
    kept = policy.retention_target(_restorable_ts(t, True), "1996-01-01 00:00:00")
    return policy.apply_candidates(t.base_state, kept, t.meta_diff, t.last_action, _NOW, 8_000_000)


@query(_REST + _APPLY + "SELECT * FROM ap")
def w4_apply_candidates(t):
    return _applies(t)


_MERGE = f"""nd AS (SELECT vol_id, count(*) AS n_diffs FROM meta_diff GROUP BY vol_id),
mc AS (SELECT CAST(3 AS int) AS priority, vol_id, n_diffs FROM nd WHERE n_diffs >= 20 UNION ALL SELECT 5, nd.vol_id, n_diffs FROM nd LEFT JOIN last_action l ON l.vol_id = nd.vol_id WHERE {_DUE.format(9_000_000)})
"""


def _merges(t):
    return policy.merge_candidates(cat.diff_totals(t.meta_diff), t.last_action, _NOW, 20, 9_000_000)


@query(f"WITH {_MERGE} SELECT * FROM mc")
def w5_merge_candidates(t):
    return _merges(t)


_SERVERS = "SELECT DISTINCT dst_id, dst_id <> 'a2' AS enabled, CASE WHEN dst_id = 'a0' THEN 7000000 ELSE 10000000 END AS interval FROM remote_snap"
_ACTIVE = "SELECT vol_id, 'source' AS node FROM base_state WHERE vol_id % 13 <> 5 UNION ALL SELECT vol_id, dst_id FROM remote_snap WHERE vol_id % 17 <> 3"
_SENT_AT = "SELECT l.vol_id, r.dst_id, l.ts FROM last_action l JOIN remote_snap r ON r.vol_id = l.vol_id"
_REPL = f""", la AS ({_LATEST}), sv AS ({_SERVERS}), ac AS ({_ACTIVE}), ld AS ({_SENT_AT}),
rc AS (SELECT la.vol_id, r.dst_id, la.gid_b AS gid, r.gid AS dest_gid, ld.ts AS last FROM la JOIN remote_snap r ON r.vol_id = la.vol_id JOIN sv ON sv.dst_id = r.dst_id AND sv.enabled
  LEFT JOIN ld ON ld.vol_id = la.vol_id AND ld.dst_id = r.dst_id
  WHERE la.vol_id % 19 <> 7 AND la.gid_b <> r.gid AND la.vol_id IN (SELECT vol_id FROM ac WHERE node = 'source') AND EXISTS (SELECT 1 FROM ac WHERE ac.vol_id = la.vol_id AND ac.node = r.dst_id)
  AND (ld.ts IS NULL OR epoch(TIMESTAMP '1996-06-01') - epoch(ld.ts) >= sv.interval))
"""


def _replications(t):
    disabled = t.base_state.where("vol_id % 19 = 7").select("vol_id")
    return policy.replication_candidates(cat.latest_state(t.meta_diff, t.base_state, t.chain()), t.remote_snap, t.sql(_SERVERS), t.sql(_ACTIVE), t.sql(_SENT_AT), _NOW, disabled)


@query(WALK + _REPL + "SELECT * FROM rc")
def w6_replication_candidates(t):
    return _replications(t)


_STEPS = """, t1 AS (SELECT 1 AS priority, 'apply' AS task, vol_id, NULL AS dst_id, NULL AS gid_b, gid AS gid_e FROM ap WHERE priority = 1 ORDER BY vol_id LIMIT 1),
t2 AS (SELECT 2, 'apply', vol_id, NULL, NULL, gid FROM ap WHERE priority = 2 ORDER BY size DESC, vol_id DESC LIMIT 1),
m3 AS (SELECT vol_id FROM mc WHERE priority = 3 ORDER BY n_diffs DESC, vol_id LIMIT 1), t3 AS (SELECT 3, 'merge', m3.vol_id, NULL, b.gid_b, b.gid_e FROM m3 JOIN best b ON b.vol_id = m3.vol_id),
r4 AS (SELECT vol_id, dst_id FROM rc ORDER BY last NULLS FIRST, vol_id, dst_id LIMIT 1), t4 AS (SELECT 4, 'replicate', r4.vol_id, r4.dst_id, NULL, stop_gid FROM r4 LEFT JOIN stop ON stop.vol_id = r4.vol_id),
m5 AS (SELECT vol_id FROM mc WHERE priority = 5 ORDER BY n_diffs DESC, vol_id LIMIT 1), t5 AS (SELECT 5, 'merge', m5.vol_id, NULL, b.gid_b, b.gid_e FROM m5 JOIN best b ON b.vol_id = m5.vol_id),
tasks AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4 UNION ALL SELECT * FROM t5)
SELECT CAST(priority AS int) AS priority, task, vol_id, CAST(dst_id AS varchar) AS dst_id, CAST(gid_b AS bigint) AS gid_b, CAST(gid_e AS bigint) AS gid_e FROM tasks WHERE priority > {} ORDER BY priority LIMIT 1"""
_TASK = _REST + _APPLY + _RUNS_SCAN + _STOP + _REPL + ", " + _MERGE + _STEPS


def _next(t, applies=None, merges=None, replications=None):
    """The next task when the steps that are given as empty have nothing to do."""
    stop = policy.replication_target(t.chain(), _behind(t), 500_000)
    every = (_applies(t) if applies is None else applies, _merges(t) if merges is None else merges, _ranges(t, t.chain()), _replications(t) if replications is None else replications, stop)
    return policy.next_task(*every)


@query(_TASK.format(0))
def w7_next_task(t):
    return _next(t)


@query(_TASK.format(1))
def w7_next_task_none_interrupted(t):
    return _next(t, applies=_applies(t).where("priority = 2"))


@query(_TASK.format(2))
def w7_next_task_none_to_apply(t):
    return _next(t, applies=_applies(t).where("false"))


@query(_TASK.format(3))
def w7_next_task_few_diffs(t):
    return _next(t, applies=_applies(t).where("false"), merges=_merges(t).where("priority = 5"))


@query(_TASK.format(4))
def w7_next_task_by_interval(t):
    return _next(t, applies=_applies(t).where("false"), merges=_merges(t).where("priority = 5"), replications=_replications(t).where("false"))


_DEST = "SELECT vol_id, CAST(gid - 10 + vol_id % 12 - CASE WHEN vol_id % 8 = 5 THEN 10000 ELSE 0 END AS bigint) AS gid FROM remote_snap"
_MODE = """WITH RECURSIVE dest AS (SELECT vol_id, gid AS b_b, gid AS b_e FROM (""" + _DEST + """) d),
la AS (""" + walk_sql() + _LATEST + """),
""" + walk_sql("dest").removeprefix("WITH RECURSIVE ") + """, way AS (SELECT w.vol_id, max(s_b) AS last, sum(data_size) AS total, arg_min(w.b_b, pos) AS first_b FROM walk w JOIN la ON la.vol_id = w.vol_id AND w.s_b <= la.gid_b GROUP BY w.vol_id)
SELECT la.vol_id, CASE WHEN d.b_b >= la.gid_b THEN 'none' WHEN d.b_b < b.b_b THEN 'hash' WHEN coalesce(way.last, -1) <> la.gid_b THEN 'error' WHEN {} THEN 'diff' ELSE 'none' END AS mode
FROM la JOIN dest d ON d.vol_id = la.vol_id JOIN base_state b ON b.vol_id = la.vol_id LEFT JOIN way ON way.vol_id = la.vol_id"""


def _mode(t, by_size: bool, least: int):
    return policy.replication_mode(cat.latest_state(t.meta_diff, t.base_state), t.sql(_DEST), t.base_state, t.meta_diff, by_size, least)


@query(_MODE.format("total > 1500000"))
def w8_replication_mode(t):
    return _mode(t, True, 1_500_000)


@query(_MODE.format("first_b < 20"))
def w8_replication_mode_by_gid(t):
    return _mode(t, False, 20)


_TO = "SELECT vol_id, CAST(gid - 10 AS bigint) AS b_b, CAST(gid - 10 AS bigint) AS b_e FROM remote_snap"
_FROM_DEST = _HEAD.replace(WALK, "WITH RECURSIVE dest AS (" + _TO + "),\n" + walk_sql("dest").removeprefix("WITH RECURSIVE "))


@query(_FROM_DEST + _CUT.format("head") + f"SELECT {_CH} FROM cut WHERE rk = 1 OR upto <= 2000000 AND rk <= 5")
def w9_send_list(t):
    return policy.send_list(t.meta_diff, t.sql(_TO), 2_000_000, 5).select(*_CHL)


@query(_FROM_DEST + f"SELECT {_CH} FROM walk WHERE pos = 1")
def w9_send_single(t):
    return policy.send_single(t.meta_diff, t.sql(_TO)).select(*_CHL)


_SENDS = _M10.replace("b_b >= 5", "b_b >= 0").replace("d.is_comp_diff, w.h,", "d.is_comp_diff, d.data_size, w.h,").replace("e_e, is_comp_diff, b_b AS h FROM f", "e_e, is_comp_diff, data_size, b_b AS h FROM f").replace("e_e, is_comp_diff, h FROM (", "e_e, is_comp_diff, data_size, h FROM (")


@query(_SENDS + _CUT.format("walk") + """, k AS (SELECT *, b_b > 3 AND vol_id % 5 = 0 AS other FROM cut WHERE rk = 1 OR upto <= 1500000 AND rk <= 8)
SELECT vol_id, pos, b_b, e_b FROM k WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.vol_id = k.vol_id AND x.pos <= k.pos AND x.other)""")
def w9_proxy_send_list(t):
    diffs = t.meta_diff.withColumn("uuid", F.expr("case when vol_id % 5 = 0 and b_b > 3 then 'b' else 'a' end"))
    return policy.proxy_send_list(diffs, 1_500_000, 8).select("vol_id", "pos", "b_b", "e_b")


# Reports


@query(_REST + f""", la AS ({_LATEST}), tot AS (SELECT vol_id, count(*) AS n_diffs, CAST(sum(data_size) AS bigint) AS total_size FROM meta_diff GROUP BY vol_id),
cr AS (SELECT vol_id, count(*) FILTER (explicit OR pos = 0) AS n_restorable, count(*) AS n_clean FROM rs WHERE gid = e GROUP BY vol_id)
SELECT b.vol_id, b.b_b AS base_gid, la.gid_b AS latest_gid, coalesce(n_diffs, 0) AS n_diffs, coalesce(total_size, 0) AS total_size, coalesce(n_restorable, 0) AS n_restorable, coalesce(n_clean, 0) AS n_clean
FROM base_state b JOIN la ON la.vol_id = b.vol_id LEFT JOIN tot ON tot.vol_id = b.vol_id LEFT JOIN cr ON cr.vol_id = b.vol_id""")
def r1_archive_status(t):
    return report.archive_status(t.meta_diff, t.base_state)


_STATUS = "st AS (SELECT g.*, e.end_lsid, g.oldest_lsid AS o FROM (SELECT vol_id, min(gid) AS gid_b, max(gid) AS gid_e, arg_max(lsid, gid) AS latest_lsid, min(lsid) AS oldest_lsid FROM lsid_gid GROUP BY vol_id) g JOIN (SELECT vol_id, max(next_lsid) AS end_lsid FROM log_record GROUP BY vol_id) e ON e.vol_id = g.vol_id)"


@query(f"WITH {_STATUS} SELECT vol_id, gid_b, gid_e, latest_lsid, end_lsid, oldest_lsid, end_lsid - oldest_lsid AS used, CAST(5000 AS bigint) AS capacity FROM st")
def r2_storage_status(t):
    return report.storage_status(t.lsid_gid, t.log_record, 5000)


@query("SELECT vol_id, concat('a', vol_id % 2) AS dst_id, count(*) AS n_pending, CAST(sum(data_size) AS bigint) AS size, CAST(epoch(TIMESTAMP '2000-01-01') - epoch(min(ts)) AS bigint) AS delay, max(e_b) AS latest_gid FROM meta_diff WHERE b_b >= 10 GROUP BY vol_id")
def r3_proxy_status(t):
    return report.proxy_status(t.meta_diff.where("b_b >= 10").withColumn("dst_id", F.expr("concat('a', vol_id % 2)")), "2000-01-01 00:00:00")


@query(WALK + _LATEST)
def r4_latest_snapshots(t):
    return cat.latest_state(t.meta_diff, t.base_state)


@query(WALK + f", la AS ({_LATEST}) SELECT la.vol_id, la.gid_b AS gid, la.ts, r.dst_id, r.gid AS dest_gid, r.ts AS dest_ts, CAST(epoch(la.ts) - epoch(r.ts) AS bigint) AS ts_delta FROM la LEFT JOIN remote_snap r ON r.vol_id = la.vol_id")
def r5_ts_delta(t):
    return report.ts_delta(cat.latest_state(t.meta_diff, t.base_state), t.remote_snap)


@query(f"WITH {_STATUS} SELECT vol_id, (end_lsid - oldest_lsid) * 100.0::double / 5000 AS usage, end_lsid - oldest_lsid > 5000 AS overflow FROM st")
def r6_log_usage(t):
    return report.log_usage(report.storage_status(t.lsid_gid, t.log_record, 5000)).withColumn("usage", F.col("usage").cast("double"))


@query("SELECT protocol, client_id, count(*) AS n_calls, sum(latency) AS latency_sum, avg(latency) AS latency_mean FROM handler_call GROUP BY ALL")
def r7_handler_stats(t):
    return report.handler_stats(t.handler_call)


@query("SELECT vol_id, action, count(*) FILTER (NOT is_finished) AS n_running, max(bgn_time) AS last_begin FROM action_log GROUP BY ALL")
def r8_running_actions(t):
    return report.running_actions(t.action_log)


@query("SELECT vol_id FROM action_log GROUP BY vol_id HAVING count(*) FILTER (NOT is_finished) = 0")
def r8_idle_volumes(t):
    return report.idle_volumes(t.action_log)


@query("SELECT vol_id, concat('<|', b_b, CASE WHEN b_e > b_b THEN concat(',', b_e) ELSE '' END, '|', CASE WHEN is_applying THEN concat('-->|', e_b, '|') ELSE '' END, '>') AS state FROM base_state")
def r9_base_all(t):
    return report.base_all(t.base_state)


_T = "tr AS (SELECT vol_id AS key, CAST(floor(epoch(ts)) AS bigint) AS t, sum(blocks) * 512 AS bytes, max(lsid) AS position FROM log_record GROUP BY 1, 2)"


def _transfers(t):
    return t.log_record.groupBy(F.col("vol_id").alias("key"), F.unix_timestamp("ts").alias("t")).agg((F.sum("blocks") * 512).alias("bytes"), F.max("lsid").alias("position"))


@query(f"WITH {_T} SELECT key, t, CAST(sum(bytes) OVER w AS bigint) * 8 / CASE WHEN t = min(t) OVER w THEN 1 ELSE t - min(t) OVER w END AS bps FROM tr WINDOW w AS (PARTITION BY key ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)")
def r10_moving_bps(t):
    return report.moving_bps(_transfers(t), 3600)


@query(f"WITH {_T} SELECT key, t, (position - min(position) OVER w) / CASE WHEN t = min(t) OVER w THEN 1 ELSE t - min(t) OVER w END AS rate FROM tr WINDOW w AS (PARTITION BY key ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)")
def r11_progress_rate(t):
    return report.progress_rate(_transfers(t), 7200)


# Sources

_NAME = """concat(strftime(ts, '%Y%m%d%H%M%S'), '-', CASE WHEN is_mergeable THEN 'M' ELSE '-' END, CASE WHEN is_comp_diff THEN 'C' ELSE '-' END, '-',
  CASE WHEN b_b = b_e AND e_b = e_e THEN concat(b_b, '-', e_b) ELSE concat(b_b, '-', b_e, '-', e_b, '-', e_e) END, '.wdiff')"""


@query(f"SELECT {DIFF}, {_NAME} AS name FROM meta_diff")
def i5_diff_names(t):
    return ingest.with_diff_name(t.meta_diff).select(*_DIFF, "name")


def _listing(t):
    """File names as they are, some with a letter too many."""
    name = F.concat(F.lit("/archive/"), "name", F.expr("case when b_b % 23 = 5 then 'x' else '' end"))
    return ingest.with_diff_name(t.meta_diff).select("vol_id", name.alias("path"), F.col("data_size").alias("length"))


@query("SELECT vol_id, b_b, b_e, e_b, e_e, is_mergeable, is_comp_diff, ts, data_size FROM meta_diff WHERE b_b % 23 <> 5")
def i4_catalog_from_listing(t):
    return ingest.catalog_from_listing(_listing(t))[0]


@query(f"SELECT vol_id, concat('/archive/', {_NAME}, 'x') AS path, data_size AS length FROM meta_diff WHERE b_b % 23 = 5")
def i4_rejected_names(t):
    return ingest.catalog_from_listing(_listing(t))[1]


@query("SELECT vol_id, b_b, b_e, e_b, e_e, is_mergeable, is_comp_diff, ts, data_size FROM meta_diff")
def i6_parse_diff_lines(t):
    return ingest.parse_diff_lines(t.meta_diff.select("vol_id", ingest.diff_line().alias("value")))


@query("SELECT vol_id, is_applying, b_b, b_e, e_b FROM base_state")
def i7_read_state_dump(t):
    return ingest.read_state_dump(report.base_all(t.base_state)).select("vol_id", "is_applying", "b_b", "b_e", "e_b")


@query("SELECT vol_id, b_b, CASE WHEN vol_id % 2 = 0 THEN TIMESTAMP '1999-12-31 23:59:58' ELSE TIMESTAMP '2000-01-01' END AS ts FROM base_state")
def i7_state_times(t):
    dump = report.base_all(t.base_state).withColumn("state", F.expr("concat(state, case when vol_id % 2 = 0 then '-19991231235958' else '' end)"))
    return ingest.read_state_dump(dump, loaded=F.lit("2000-01-01").cast("timestamp")).select("vol_id", "b_b", "ts")


@query("SELECT vol_id, ord, addr, blocks, ord * 17 % 65536 AS csum FROM io_recipe")
def i9_read_recipe(t):
    line = F.concat_ws(" ", F.col("addr").cast("string"), F.col("blocks").cast("string"), F.lower(F.lpad(F.hex(F.expr("ord * 17 % 65536")), 8, "0")))
    return ingest.read_recipe(t.io_recipe.select("vol_id", "ord", line.alias("value")))


@query("SELECT vol_id, action, 'x:y' AS note FROM action_log")
def p1_parse_status(t):
    line = F.concat(F.lit("vol_id:"), F.col("vol_id").cast("string"), F.lit("\taction:"), "action", F.lit("\tnote:x:y"))
    got = ingest.parse_status(t.action_log.select(line.alias("value")))
    return got.select(F.col("status.vol_id").cast("long").alias("vol_id"), F.col("status.action").alias("action"), F.col("status.note").alias("note"))


# The flagship: a volume's blocks as of a snapshot


@query(_AT + "SELECT vol_id, addr AS block, content FROM scan")
def blocks_as_of_snapshot(t):
    return d2_image_at(t).withColumnRenamed("addr", "block")
