"""Snapshot reconciliation: a source's full state against its open versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import digest_id


def diff(current: DataFrame, snapshot: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """keys, change, old and new digest for every key on either side: opened, unchanged, superseded or closed."""
    a = current.select(*keys, F.col(digest).alias("old_hash"))
    b = snapshot.select(*keys, F.col(digest).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "opened").when(F.col("new_hash").isNull(), "closed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("superseded")
    return a.join(b, keys, "full_outer").withColumn("change", change)


def counts(changes: DataFrame) -> DataFrame:
    """How many opened, closed, unchanged and superseded; a superseded key also closes one version and opens another."""
    n = lambda *kinds: F.sum(F.col("change").isin(*kinds).cast("long"))
    return changes.agg(n("opened", "superseded").alias("opened"), n("closed", "superseded").alias("closed"), n("unchanged").alias("unchanged"), n("superseded").alias("superseded"))


def apply_snapshot(ledger: DataFrame, snapshot: DataFrame, keys: list[str], observed_at: str, snapshot_id: str, apply_no: int = 1) -> DataFrame:
    """The ledger after a snapshot: versions that changed or went are closed at observed_at, new ones are opened.

    ledger: keys, version_id, content_hash, valid_from, valid_to, and payload columns that the snapshot has as well.
    Applying a snapshot twice changes nothing. Both outputs come from one full outer join.
    """
    payload = [c for c in snapshot.columns if c not in (*keys, "content_hash")]
    is_open = ledger.where("valid_to is null")
    changes = diff(is_open, snapshot, keys)
    ends = changes.where("change in ('closed', 'superseded')").select(*keys, F.lit(observed_at).alias("__end"))
    old = ledger.join(ends, keys, "left").withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("__end")).otherwise(F.col("valid_to"))).drop("__end")
    fresh = snapshot.join(changes.where("change in ('opened', 'superseded')").select(*keys), keys, "left_semi")
    salt = F.when(F.lit(apply_no) > 1, F.lit(str(apply_no)))
    version = digest_id("ver-", *(F.col(k).cast("string") for k in keys), F.lit(snapshot_id), "content_hash", salt, separator="\u001f")
    fresh = fresh.select(*keys, version.alias("version_id"), "content_hash", F.lit(observed_at).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), *payload)
    return old.unionByName(fresh, allowMissingColumns=True)


def pending(relations: DataFrame, entities: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """Relations with an end that no entity has yet: adds missing_source and missing_target."""
    known = entities.select(F.col(key).alias("__k")).distinct()
    a = known.select(F.col("__k").alias("__s"))
    b = known.select(F.col("__k").alias("__t"))
    both = relations.join(a, F.col(source) == F.col("__s"), "left").join(b, F.col(target) == F.col("__t"), "left")
    both = both.withColumn("missing_source", F.col("__s").isNull()).withColumn("missing_target", F.col("__t").isNull()).drop("__s", "__t")
    return both.where("missing_source or missing_target")


def pair_single(gone: DataFrame, new: DataFrame, subject: str, obj: str) -> DataFrame:
    """Relations of which a subject has at most one: where exactly one went and one came, the new replaces the old."""
    one = lambda df, name: df.groupBy(subject).agg(F.count("*").alias("__n"), F.min(obj).alias(name)).where("__n = 1").drop("__n")
    return one(gone, "old").join(one(new, "new"), subject)


def key_conflicts(items: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Keys that several owners hold: number of owners and the first by name."""
    return items.groupBy(*keys).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("first_owner")).where("owners > 1")


def changes_payload(changes: DataFrame, kind: str, keys: list[str], limit: int) -> DataFrame:
    """The first `limit` keys of each kind of change in order, and whether there are more."""
    size = Window.partitionBy(kind)
    place = F.row_number().over(size.orderBy(*keys))
    out = changes.withColumn("position", place.cast("long")).withColumn("truncated", F.count("*").over(size) > limit)
    return out.where(F.col("position") <= limit)


def state_token(items: DataFrame, group: list[str], version: str, prefix: str = "st1-", length: int = 40) -> DataFrame:
    """A digest of each group's open versions in order; equal tokens mean equal states. A group's ids are one array: it
    has to be the digest of all of them in order, as others make it; `state_fold` does without that array."""
    joined = F.array_join(F.array_sort(F.collect_list(F.col(version).cast("string"))), ",")
    return items.groupBy(*group).agg(F.concat(F.lit(prefix), F.substr(F.sha2(joined, 256), F.lit(1), F.lit(length))).alias("token"))


def state_fold(items: DataFrame, group: list[str], version: str, prefix: str = "st2-", length: int = 40) -> DataFrame:
    """A digest of each group's open versions that needs no order: their number and two sums of their hashes, which add up
    in parts, so that a group may be of any size."""
    sums = [F.sum((F.xxhash64(F.lit(salt), F.col(version).cast("string")) % F.lit(1 << 61)).cast("decimal(38,0)")) for salt in (1, 2)]
    whole = items.groupBy(*group).agg(F.count("*").alias("__n"), sums[0].alias("__a"), sums[1].alias("__b"))
    text = F.concat_ws("|", "__n", F.col("__a").cast("string"), F.col("__b").cast("string"))
    return whole.select(*group, F.concat(F.lit(prefix), F.substr(F.sha2(text, 256), F.lit(1), F.lit(length))).alias("token"))


class LateSnapshot(ValueError):
    """A snapshot older than the last accepted one of its source and scope."""


class StateMismatch(ValueError):
    """The open versions are not those that the caller planned for."""


def verdict(last_id: str | None, last_observed: str | None, snapshot_id: str, observed_at: str) -> str:
    """What to do with a snapshot: the last accepted one again is a duplicate, an older one than it is late."""
    if last_id is not None and last_id == snapshot_id:
        return "duplicate"
    return "late" if last_observed and observed_at < last_observed else "apply"


def accept(last_observed: str | None, last_id: str | None, observed_at: str, snapshot_id: str) -> str:
    """As verdict, by time first."""
    return verdict(last_id, last_observed, snapshot_id, observed_at)


def verdicts(snapshots: DataFrame, group: list[str], snapshot_id: str, observed_at: str, *arrival: str) -> DataFrame:
    """Adds verdict and apply_no to snapshots that arrive in an order: apply, late or duplicate, and which application of its id it is.

    A snapshot sent again right after itself is a duplicate. Late ones are older than any that came before, so they never
    are the last accepted one, and what counts for the next is the last one that was not late.
    """
    order = Window.partitionBy(*group).orderBy(*arrival)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.col(observed_at) < F.max(observed_at).over(before), F.lit(False))
    rows = snapshots.withColumn("__late", late)
    last = F.last(F.when(~F.col("__late"), F.col(snapshot_id)), ignorenulls=True).over(before)
    same = F.coalesce(F.col(snapshot_id) == last, F.lit(False))
    rows = rows.withColumn("verdict", F.when(same, "duplicate").when(F.col("__late"), "late").otherwise("apply")).drop("__late")
    applied = F.sum((F.col("verdict") == "apply").cast("long")).over(Window.partitionBy(*group, snapshot_id).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("apply_no", F.when(F.col("verdict") == "apply", applied))


def last_accepted(snapshots: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
    """The last accepted snapshot of each source and scope, and the latest time that any was observed at."""
    order = F.struct(F.col(seq), F.col("apply_no"))
    return snapshots.groupBy(*group).agg(F.max_by("snapshot_id", order).alias("snapshot_id"), F.max_by("result", order).alias("result"), F.max("observed_at").alias("last_observed_at"))


def snapshot_result(snapshots: DataFrame, group: list[str]) -> DataFrame:
    """The result of the latest application of each snapshot, and the number that the next one gets."""
    return snapshots.groupBy(*group, "snapshot_id").agg(F.max_by("result", "apply_no").alias("result"), (F.coalesce(F.max("apply_no"), F.lit(0)) + 1).cast("int").alias("next_apply_no"))


def open_refs(ledger: DataFrame) -> DataFrame:
    """kind, item_key of all entities with an open version."""
    return ledger.where("item_kind = 'entity' and valid_to is null").select("kind", "item_key").distinct()


def open_entities(ledger: DataFrame, refs: DataFrame) -> DataFrame:
    """Those of refs (kind, item_key) that have an open version."""
    return refs.select("kind", "item_key").distinct().join(open_refs(ledger), ["kind", "item_key"], "left_semi")


def other_owners(ledger: DataFrame, refs: DataFrame, own: dict[str, str], limit: int) -> DataFrame:
    """Open versions of refs (kind, item_key) that other sources or scopes than own hold, in order, one more than the limit."""
    mine = F.lit(True)
    for c, v in own.items():
        mine = mine & (F.col(c) == v)
    rows = ledger.where("item_kind = 'entity' and valid_to is null").where(~mine).join(refs.select("kind", "item_key").distinct(), ["kind", "item_key"], "left_semi")
    return rows.select("kind", "item_key", *own).distinct().orderBy("kind", "item_key", *own).limit(limit + 1)


def pending_for(relations: DataFrame, refs: DataFrame, key: str = "ref") -> DataFrame:
    """Pending relations (ref_from, ref_to) with an end among refs, each once."""
    k = refs.select(F.col(key).alias("__k")).distinct()
    waiting = relations.where("pending")
    by_from = waiting.join(k, F.col("ref_from") == F.col("__k"), "left_semi")
    return by_from.unionByName(waiting.join(k, F.col("ref_to") == F.col("__k"), "left_semi").join(k, F.col("ref_from") == F.col("__k"), "left_anti"))


def materialize_relations(relations: DataFrame, present: DataFrame, key: str = "ref") -> DataFrame:
    """Relations with pending set anew: whether an end is not among what is present."""
    k = present.select(F.col(key).alias("__k")).distinct()
    both = relations.join(k.select(F.col("__k").alias("__f")), F.col("ref_from") == F.col("__f"), "left").join(k.select(F.col("__k").alias("__t")), F.col("ref_to") == F.col("__t"), "left")
    return both.withColumn("pending", F.col("__f").isNull() | F.col("__t").isNull()).drop("__f", "__t")


def page_with_versions(versions: DataFrame, keys: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """All versions of the keys of the next page (one key more than the limit), in order of key."""
    from .resolve import after_cursor

    page = after_cursor(versions.select(*keys).distinct(), keys, cursor, limit)
    return versions.join(F.broadcast(page), keys, "left_semi")
