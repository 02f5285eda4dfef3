"""Vote cleaning: every raw vote gets a status; votes of status ok become battles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import local_stamp
from ..functions.text import strip_label
from .ranks import positions

WINNERS = {"leftvote": "model_a", "rightvote": "model_b", "tievote": "tie", "bothbadvote": "tie (bothbad)", "bothbad_vote": "tie (bothbad)"}


def canonical(name: Column, aliases: dict[str, str], tstamp: Column | None = None, dated: dict[str, tuple[float, str, str]] | None = None) -> Column:
    """Exact-match alias; ``dated`` names take one of two suffixes, by whether the vote is later than a cutoff."""
    out = name
    if aliases:
        out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), name), name)
    for old, (cutoff, before, after) in (dated or {}).items():
        out = F.when(name == old, F.concat(name, F.when(tstamp > cutoff, after).otherwise(before))).otherwise(out)
    return out


def with_status(votes: DataFrame, task: str | None = None, aliases: dict[str, str] | None = None, exclude: tuple[str, ...] = (), banned: DataFrame | None = None, dated: dict | None = None) -> DataFrame:
    """votes(type, task_type, ip, tstamp, hidden_a/b, public_a/b) -> also anony, model_a, model_b, status.

    Public names lose their markup. Where the first hidden name is blank (or null), the public pair stands for the hidden
    one. A vote without a first public name, or with "Model A", is anonymous and has the hidden pair; any other has the
    public pair, and has to agree with the hidden one. Checks are made in a fixed order: task, share, one public name
    empty, names differ, excluded model, banned address; the first that fails names the status. A banned list is joined,
    broadcast only if Spark finds it small.
    """
    public = [strip_label(F.coalesce(f"public_{x}", F.lit(""))) for x in "ab"]
    d = votes.withColumns({"_pa": public[0], "_pb": public[1], "_known": F.trim(F.coalesce("hidden_a", F.lit(""))) != ""})
    d = d.withColumns({f"_h{x}": F.when(F.col("_known"), F.coalesce(f"hidden_{x}", F.lit(""))).otherwise(F.col(f"_p{x}")) for x in "ab"})
    d = d.withColumn("anony", F.col("_pa").isin("", "Model A"))
    d = d.withColumns({f"model_{x}": canonical(F.when(F.col("anony"), F.col(f"_h{x}")).otherwise(F.col(f"_p{x}")), aliases or {}, F.col("tstamp"), dated) for x in "ab"})
    if banned is not None:
        d = d.join(banned.select(F.col("ip").alias("_ip")).distinct().withColumn("_banned", F.lit(True)), F.col("ip") == F.col("_ip"), "left").drop("_ip")
    else:
        d = d.withColumn("_banned", F.lit(None).cast("boolean"))
    one_empty = (F.col("_pa") == "") != (F.col("_pb") == "")
    differs = ~F.col("anony") & ((F.col("_pa") != F.col("_ha")) | (F.col("_pb") != F.col("_hb")))
    status = F.when(F.lower("task_type") != F.lit(task.lower()), "other_task") if task else F.when(F.lit(False), "other_task")
    status = status.when(F.col("type") == "share", "share").when(one_empty, "invalid").when(differs, "mismatch")
    if exclude:
        status = status.when(F.col("model_a").isin(*exclude) | F.col("model_b").isin(*exclude), "excluded")
    return d.withColumn("status", status.when(F.coalesce("_banned", F.lit(False)), "banned").otherwise("ok")).drop("_pa", "_pb", "_ha", "_hb", "_known", "_banned")


def clean_battles(statuses: DataFrame, key: str = "event_id", prefix: str = "user_", sanitised: bool = False, mode: str = "conv_release") -> DataFrame:
    """The battle table; an unknown vote type ends the query. A judge is the prefix and the address, or the prefix twice
    and the address's number by first appearance (``sanitised``). Mode ``simple`` has no question_id."""
    if mode not in ("simple", "conv_release"):
        raise ValueError(f"unknown mode {mode}")
    winner = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WINNERS.items() for x in kv]), "type"), F.raise_error(F.concat(F.lit("unknown vote "), "type")))
    d, judge = statuses.where("status = 'ok'"), F.concat(F.lit(prefix), F.col("ip").cast("string"))
    if sanitised:
        d = d.join(address_counts(statuses, key).select("ip", "ip_id"), "ip")
        judge = F.concat(F.lit(prefix + prefix), F.col("ip_id").cast("string"))
    out = d.select(F.col(key).alias("question_id"), "model_a", "model_b", winner.alias("winner"), judge.alias("judge"), "anony", "tstamp")
    return out.drop("question_id") if mode == "simple" else out


def address_counts(statuses: DataFrame, key: str = "event_id", with_banned: bool = True) -> DataFrame:
    """ip, n and a dense id by first appearance, over votes that pass all checks before the ban check; banned addresses
    have a number but are left out of lists (``with_banned`` false)."""
    n = statuses.where("status IN ('ok', 'banned')").groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(F.col("status") == "banned").alias("_out"))
    d = positions(n, "first", "ip_id")
    return (d if with_banned else d.where(~F.col("_out"))).select("ip", "n", "ip_id")


def remove_model_votes(votes: DataFrame, models: list[str], single: tuple[str, ...] = ("model", "model_name"), pair: tuple[str, ...] = ("0_model_name", "1_model_name")) -> DataFrame:
    """Drops votes on any of the models, where a name contains one of the texts.

    The first column of ``single`` that a vote has tells its model; a vote with none of them goes if either name of the
    ``pair`` matches. Columns that the table lacks count as null; a vote without any name stays.
    """
    there = lambda names: [F.col(f"`{c}`") for c in names if c in votes.columns]
    named = lambda c: F.coalesce(F.exists(F.array(*map(F.lit, models)), lambda m: F.contains(c, m)), F.lit(False)) if models else F.lit(False)
    either = F.lit(False)
    for c in there(pair):
        either = either | named(c)
    one = F.coalesce(*there(single), F.lit(None).cast("string"))
    return votes.where(~F.when(one.isNotNull(), named(one)).otherwise(either))


def counters(statuses: DataFrame, others: str = "other_task") -> DataFrame:
    """One row: votes of the task, how many were invalid (one public name) or showed their models or came from banned
    addresses, battles, anonymous votes among those that passed the first checks, different models of the battles, and
    the local time of the last one. Null if there are no battles."""
    d = statuses.where(F.col("status") != others)
    ok, is_ = F.col("status") == "ok", lambda *s: F.count_if(F.col("status").isin(*s))
    names = F.array_distinct(F.flatten(F.collect_set(F.when(ok, F.array("model_a", "model_b")))))
    return d.agg(
        F.count(F.lit(1)).alias("n_votes"), is_("invalid").alias("n_invalid"), is_("mismatch").alias("n_mismatch"), is_("banned").alias("n_banned"), is_("ok").alias("n_battles"),
        F.count_if(F.col("anony") & F.col("status").isin("excluded", "banned", "ok")).alias("n_anony"), F.size(names).alias("n_models"), local_stamp(F.timestamp_seconds(F.max(F.when(ok, F.col("tstamp"))))).alias("last_updated"),
    )
