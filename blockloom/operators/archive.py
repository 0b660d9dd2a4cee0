"""Applying, merging, restoring and expiring on stored tables: states, catalogue, records, images.

All volumes of a call are done at once, each step as one commit of the store, so that a job
can stop anywhere and be run again:

- ``apply_to_gid`` first makes the newest restored image that serves a volume's base. It commits
  states that are applying, up to their plan's last snapshot, then writes the image's touched
  buckets, and commits these together with the states' end and without expired diffs and
  images. A volume found applying is rolled on at least to the end it had begun.
- ``merge_range`` writes the merged records, then commits one row for each volume's run of diffs
  and takes its inputs out. Volumes that are applying aren't merged.

A record belongs to a diff (its four gids) and has an order ``ord`` within it. Rows of records whose
diff is gone are no longer read; ``clean_records`` rewrites their buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.chain import applicable_chain, stop_where
from ..plans.commits import Layout, Store
from ..plans.stage import staged
from .catalog import KEY, begin_apply, merge_meta, mergeable_chain, plan_restore, truncate_by_size
from .changes import order_key
from .extent import cut_at_stripes, latest_wins
from .image import apply_runs, start_images

LAYOUTS = {
    "state": Layout("vol_id bigint, is_applying boolean, b_b bigint, b_e bigint, e_b bigint, e_e bigint", ("vol_id",)),
    "diff": Layout("vol_id bigint, b_b bigint, b_e bigint, e_b bigint, e_e bigint, is_mergeable boolean, is_comp_diff boolean, ts timestamp, data_size bigint", ("vol_id",)),
    "record": Layout("vol_id bigint, b_b bigint, b_e bigint, e_b bigint, e_e bigint, ord bigint, addr bigint, blocks bigint, off bigint, rec_type string, token string", tuple(KEY)),
    "image": Layout("vol_id bigint, addr bigint, content string", ("vol_id", "shiftright(addr, 16)")),
    "cold": Layout("vol_id bigint, gid bigint", ("vol_id",)),
    "cold_image": Layout("vol_id bigint, gid bigint, addr bigint, content string", ("vol_id", "gid", "shiftright(addr, 16)")),
}


def create(spark: SparkSession, path: str, states: DataFrame, diffs: DataFrame, records: DataFrame, image: DataFrame, buckets: int = 16) -> Store:
    """A store of these tables; more buckets suit more data: a change rewrites whole buckets."""
    store = Store(spark, path, LAYOUTS, buckets)
    store.commit(store.manifest(), "loaded", added={t: store.write(t, df) for t, df in (("state", states), ("diff", diffs), ("record", records), ("image", image))})
    return store


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, LAYOUTS)


def add_diffs(store: Store, diffs: DataFrame, records: DataFrame) -> int:
    """More diffs and their records, as one version."""
    return store.commit(store.manifest(), "diffs", added={"diff": store.write("diff", diffs), "record": store.write("record", records)})


def _rewritten(store: Store, manifest: dict, table: str, volumes: DataFrame, rows: DataFrame) -> tuple[list[int], dict]:
    """New folders for a table by volume: ``rows`` instead of those of ``volumes``."""
    at = store.touched(table, volumes)
    others = store.read(table, manifest, at).join(volumes.select("vol_id"), "vol_id", "left_anti")
    return at, store.write(table, others.unionByName(rows.select(*others.columns)))


def planned_runs(store: Store, manifest: dict, plan: DataFrame) -> DataFrame:
    """The surviving runs (vol_id, addr, blocks, off, rec_type, token) of the records of each volume's planned diffs, later diffs winning."""
    records = store.read("record", manifest, store.touched("record", plan)).join(plan.select(*KEY, "pos"), KEY).withColumn("seq", order_key("pos", "ord"))
    own = records.select("vol_id", "seq", F.col("off").alias("from"), "rec_type", "token")
    return latest_wins(records).join(own, ["vol_id", "seq"]).withColumn("off", F.col("off") + F.col("from")).select("vol_id", "addr", "blocks", "off", "rec_type", "token")


def _with_image(store: Store, manifest: dict, runs: DataFrame, discard: str) -> tuple[list[int], dict]:
    """New folders for the image's buckets that runs touch."""
    at = store.touched("image", cut_at_stripes(runs.select("vol_id", "addr", "blocks")))
    return at, store.write("image", apply_runs(store.read("image", manifest, at), runs, discard))


def _rebased(store: Store, wanted: DataFrame) -> int | None:
    """Restored images that serve become bases: the newest not after the gid and newer than the base, of volumes not applying."""
    m = store.manifest()
    states = store.read("state", m)
    idle = states.where("not is_applying").select("vol_id", "b_b", "b_e")
    start = staged(start_images(idle, wanted, store.read("cold", m)).where("is_cold"), "cold-starts")
    if start.isEmpty():
        return None
    at = start.select("vol_id", F.col("b_b").alias("gid"))
    old = store.read("image", m)
    new = store.read("cold_image", m).join(at, ["vol_id", "gid"], "left_semi").select("vol_id", "addr", "content")
    touched = store.touched("image", old.join(at, "vol_id", "left_semi").select("vol_id", "addr").unionByName(new.select("vol_id", "addr")))
    image = store.read("image", m, touched).join(at, "vol_id", "left_anti").unionByName(new)
    end = start.select("vol_id", F.lit(False).alias("is_applying"), "b_b", "b_e", F.lit(None).cast("long").alias("e_b"), F.lit(None).cast("long").alias("e_e"))
    return store.commit(m, "restored images to bases", {"image": (touched, store.write("image", image)), "state": _rewritten(store, m, "state", start, end)})


def plan_to_gid(diffs: DataFrame, states: DataFrame, wanted: DataFrame, max_nr: int | None = None) -> DataFrame:
    """Each volume's chain up to its gid and within a number, but to the end of an interrupted apply at least."""
    end = states.select("vol_id", F.coalesce("e_b", F.lit(-1)).alias("begun"))
    chain = applicable_chain(diffs, states).join(wanted.select("vol_id", "gid"), "vol_id", "left").join(end, "vol_id")
    chain = stop_where(chain.where("gid is not null or begun >= 0"), F.col("s_b") > F.greatest(F.coalesce("gid", F.lit(-1)), F.col("begun")))
    return (chain.where((F.col("pos") <= max_nr) | (F.col("s_b") <= F.col("begun"))) if max_nr else chain).drop("gid", "begun")


def begin(store: Store, wanted: DataFrame, max_nr: int | None = None) -> DataFrame | None:
    """Commit states that are applying, and give the plan; None where nothing is left to do."""
    m = store.manifest()
    states = store.read("state", m)
    plan = staged(plan_to_gid(store.read("diff", m), states, wanted, max_nr), "apply-plan")  # a row a diff
    if plan.isEmpty():
        return None
    marked = staged(begin_apply(states, plan), "applying")
    store.commit(m, "apply begins", {"state": _rewritten(store, m, "state", marked, marked)})
    return plan


def end(store: Store, plan: DataFrame, discard: str = "ignore") -> int:
    """Write the image of begun plans and commit it with the states' end, without what expires then."""
    m = store.manifest()
    runs = staged(planned_runs(store, m, plan), "apply-runs")
    done = store.read("state", m).join(plan.select("vol_id").distinct(), "vol_id", "left_semi")
    done = staged(done.select("vol_id", F.lit(False).alias("is_applying"), F.col("e_b").alias("b_b"), F.col("e_e").alias("b_e"), F.lit(None).cast("long").alias("e_b"), F.lit(None).cast("long").alias("e_e")), "applied")
    gone = done.select("vol_id", F.col("b_b").alias("gid"))
    return store.commit(m, "apply ends", {"image": _with_image(store, m, runs, discard), "state": _rewritten(store, m, "state", done, done)} | _expired(store, m, gone))


def _expired(store: Store, m: dict, upto: DataFrame) -> dict:
    """Catalogue and restored images without the diffs that end at or before each volume's gid and the images before it."""
    limit = upto.select("vol_id", F.col("gid").alias("limit"))
    diffs, cold = store.read("diff", m), store.read("cold", m)
    out = {
        "diff": _rewritten(store, m, "diff", upto, diffs.join(limit, "vol_id").where("e_b > limit").drop("limit")),
        "cold": _rewritten(store, m, "cold", upto, cold.join(limit, "vol_id").where("gid >= limit").drop("limit")),
    }
    old = staged(cold.join(limit, "vol_id").where("gid < limit").select("vol_id", "gid"), "old-images")
    if not old.isEmpty():
        images = store.read("cold_image", m)
        at = store.touched("cold_image", images.join(old, ["vol_id", "gid"], "left_semi"))
        out["cold_image"] = at, store.write("cold_image", store.read("cold_image", m, at).join(old, ["vol_id", "gid"], "left_anti"))
    return out


def apply_to_gid(store: Store, wanted: DataFrame, discard: str = "ignore", max_nr: int | None = None) -> int:
    """Volumes' bases moved on to a gid (``wanted``: vol_id, gid), as far as their chains lead; the version after.

    Where ``max_nr`` bounds the diffs of one round, rounds follow until nothing is left.
    """
    _rebased(store, wanted)
    while (plan := begin(store, wanted, max_nr)) is not None:
        end(store, plan, discard)
    return store.latest()


def recover(store: Store, discard: str = "ignore") -> int:
    """Roll interrupted applies on to the end that they had begun."""
    return apply_to_gid(store, store.read("state").select("vol_id", F.lit(-1).cast("long").alias("gid")).limit(0), discard)


def expire_before(store: Store, wanted: DataFrame) -> int:
    """Drop the diffs that end at or before each volume's gid, and its restored images before it."""
    m = store.manifest()
    return store.commit(m, "expired", _expired(store, m, wanted))


def merge_range(store: Store, gid: int, gid_e: int | None = None, max_size: int | None = None) -> DataFrame:
    """Each volume's mergeable run from a gid on, up to another or within a total size, replaced by one diff; the merged catalogue rows.

    ``data_size`` of a merged diff is what was written: the bytes of its normal blocks. Runs of
    one diff and volumes that are applying stay as they are.
    """
    m = store.manifest()
    states, diffs = store.read("state", m), store.read("diff", m)
    free = diffs.join(states.where("is_applying").select("vol_id"), "vol_id", "left_anti")
    chain = mergeable_chain(free, gid, gid_e)
    chain = staged(chain if max_size is None else truncate_by_size(chain, max_size, 1 << 30), "merge-chain")
    merged = merge_meta(chain).where("n >= 2")
    inputs = staged(chain.join(merged.select("vol_id"), "vol_id", "left_semi"), "merge-inputs")
    if inputs.isEmpty():
        return diffs.limit(0)
    own = merged.select("vol_id", "b_b", "b_e", "e_b", "e_e")
    records = staged(planned_runs(store, m, inputs).join(own, "vol_id").withColumn("ord", F.col("addr")), "merged-records")
    written = records.where("rec_type = 'Normal'").groupBy("vol_id").agg((F.sum("blocks") * 512).alias("data_size"))
    rows = merged.join(written, "vol_id", "left").select(*KEY, "is_mergeable", F.lit(False).alias("is_comp_diff"), "ts", F.coalesce("data_size", F.lit(0)).cast("long").alias("data_size"))
    rows = staged(rows, "merged-diffs")
    kept = diffs.join(inputs.select("vol_id").distinct(), "vol_id", "left_semi").join(inputs.select(*KEY), KEY, "left_anti")
    store.commit(m, "merged", {"diff": _rewritten(store, m, "diff", rows, kept.unionByName(rows))}, {"record": store.write("record", records)})
    return rows


def scan(store: Store, wanted: DataFrame, version: int | None = None, clean: bool = False) -> DataFrame:
    """The blocks of each volume as of its gid (``wanted``: vol_id, gid), where the chain of that version reaches it."""
    m = store.manifest(version)
    base = store.read("state", m)
    start = staged(start_images(base, wanted, store.read("cold", m)), "starts")
    plan = staged(plan_restore(store.read("diff", m), start, wanted, exact_clean=clean), "plan")
    here = start.join(wanted.select("vol_id", "gid"), "vol_id").where("b_b = gid" + (" and b_b = b_e" if clean else "")).select("vol_id")
    own = start.join(plan.select("vol_id").distinct().unionByName(here), "vol_id", "left_semi")
    warm, cold = own.where("not is_cold").select("vol_id"), own.where("is_cold").select("vol_id", F.col("b_b").alias("gid"))
    blocks = store.read("image", m).join(warm, "vol_id", "left_semi").unionByName(store.read("cold_image", m).join(cold, ["vol_id", "gid"], "left_semi").drop("gid"))
    return apply_runs(blocks, staged(planned_runs(store, m, plan), "runs"), "zero")


def restore(store: Store, wanted: DataFrame) -> int:
    """Images of clean snapshots, kept as starts for later scans and applies. Those kept already, and gids not reached, add nothing."""
    m = store.manifest()
    asked = staged(wanted.select("vol_id", "gid").join(store.read("cold", m), ["vol_id", "gid"], "left_anti"), "asked")
    rows = staged(scan(store, asked, m["version"], clean=True).join(asked, "vol_id"), "restored")
    chain = applicable_chain(store.read("diff", m), store.read("state", m)).where("s_b = s_e")
    reached = asked.join(chain.select("vol_id", F.col("s_b").alias("gid")), ["vol_id", "gid"], "left_semi")  # an image of zeros has no rows
    return store.commit(m, "restored", added={"cold": store.write("cold", reached), "cold_image": store.write("cold_image", rows)})


def clean_records(store: Store) -> int:
    """Rewrite the buckets of records that hold rows of diffs no longer in the catalogue."""
    m = store.manifest()
    live = store.read("diff", m).select(*KEY)
    dead = store.touched("record", store.read("record", m).join(live, KEY, "left_anti"))
    return store.commit(m, "records cleaned", {"record": (dead, store.write("record", store.read("record", m, dead).join(live, KEY, "left_semi")))})


COPY_LAYOUTS = {"image": LAYOUTS["image"], "copied": Layout("archive_uuid string, gid_b bigint, gid_e bigint, done int", ("done",))}


def copy_image(source: Store, target: Store, archive_uuid: str, gid_b: int, gid_e: int, at_once: int = 4, most: int | None = None) -> list[int]:
    """A full copy of an image to a store of ``COPY_LAYOUTS`` with as many buckets, a few buckets a commit; the buckets copied now.

    The target's table ``copied`` names the buckets that are done, in the same commit as their
    blocks; a run that starts again for the same archive and state copies the others only. For
    another archive or state it starts from the beginning. ``most`` bounds the buckets of a run.
    """
    if source.buckets != target.buckets:
        raise ValueError("source and target differ in their buckets")
    held, m = source.manifest(), target.manifest()
    done = target.read("copied", m)
    same = done.where((F.col("archive_uuid") == archive_uuid) & (F.col("gid_b") == gid_b) & (F.col("gid_e") == gid_e))
    if done.count() > same.count():
        every = range(target.buckets)
        target.commit(m, "another state: copied anew", {"image": (every, {}), "copied": (every, {})})
        m = target.manifest()
    ready = {r.done for r in target.read("copied", m).collect()}  # buckets at most
    left = [b for b in range(target.buckets) if b not in ready][:most]
    for k in range(0, len(left), at_once):
        some, m = left[k : k + at_once], target.manifest()
        image = target.write("image", source.read("image", held, some))
        rows = target.spark.createDataFrame([(archive_uuid, gid_b, gid_e, b) for b in some], COPY_LAYOUTS["copied"].ddl)
        target.commit(m, "copied", {"image": (some, image)}, {"copied": target.write("copied", rows)})
    return left
