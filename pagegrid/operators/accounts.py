"""Accounts, licenses, devices and keyed upserts of control tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.plans.ordered import running

c = F.col


def latest_child(df: DataFrame, parent: str, order: Column, columns: Sequence[str]) -> DataFrame:
    """Newest child per parent as a combinable aggregate, so a parent with countless children is cheap."""
    return df.groupBy(parent).agg(F.max_by(F.struct(*columns), order).alias("r")).select(parent, "r.*")


def license_status(accounts: DataFrame, licenses: DataFrame) -> DataFrame:
    """Every account with its newest license; 'none' without one. Missing dates sort last."""
    order = F.struct("created_at", "id")
    newest = latest_child(licenses, "account_id", order, ["id", "status", "created_at"]).select("account_id", c("id").alias("license_id"), c("status").alias("license_status"))
    return accounts.join(newest, accounts["id"] == newest["account_id"], "left").select(
        accounts["id"], "tier", "max_devices", "is_license_active", "license_id", F.coalesce("license_status", F.lit("none")).alias("license_status")
    )


def active_license_accounts(licenses: DataFrame, accounts: DataFrame) -> DataFrame:
    lic = licenses.filter("status = 'active'").select(c("id").alias("license_id"), "account_id")
    return lic.join(accounts.filter("is_license_active"), lic["account_id"] == accounts["id"]).select("license_id", "account_id", "tier", "max_devices")


def device_counts(accounts: DataFrame, devices: DataFrame) -> DataFrame:
    n = devices.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    return accounts.join(n, accounts["id"] == n["account_id"], "left").select(
        accounts["id"], "tier", "max_devices", F.coalesce("n", F.lit(0)).alias("current_devices"), (F.coalesce("n", F.lit(0)) >= c("max_devices")).alias("at_cap")
    )


def admit_devices(uses: DataFrame, accounts: DataFrame, ts: str) -> DataFrame:
    """Which devices an account accepts: the first ``max_devices`` to appear; known ones keep refreshing.

    Uses are folded to one row per device before numbering, and the numbering is sliced, so a busy
    account is spread over tasks.
    """
    first = uses.groupBy("account_id", "device_id").agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("uses"))
    numbered = running(first, ["account_id"], ["first_seen", "device_id"], number="device_no")
    caps = accounts.select(c("id").alias("account_id"), "max_devices")
    return numbered.join(caps, "account_id").select("account_id", "device_id", "device_no", (c("device_no") <= c("max_devices")).alias("accepted"), F.when(c("device_no") <= c("max_devices"), c("last_seen")).alias("last_seen_at"))


def rename_device(devices: DataFrame, account: object, device_id: str, name: str) -> DataFrame:
    hit = (c("account_id") == F.lit(account)) & (c("device_id") == F.lit(device_id))
    return devices.withColumn("device_name", F.when(hit, F.lit(name)).otherwise(c("device_name"))).withColumn("matched", hit)


def remove_devices(devices: DataFrame, removed: DataFrame) -> DataFrame:
    return devices.join(removed.select("account_id", "device_id").distinct(), ["account_id", "device_id"], "left_anti")


def list_devices(devices: DataFrame, accounts: DataFrame, account: object) -> DataFrame:
    one = devices.filter(c("account_id") == F.lit(account))
    caps = accounts.filter(c("id") == F.lit(account)).select(c("id").alias("account_id"), "max_devices")
    return one.join(caps, "account_id").orderBy("created_at", "device_id")


# -- upserts ------------------------------------------------------------------------------------


def upsert_policies(policies: DataFrame, requests: DataFrame) -> DataFrame:
    """Opt-in policies: webhook opt-in needs cloud opt-in, the first opt-in time is kept for good.

    ``requests``: (account_id, cloud, webhook, at). Several requests of one account fold to the
    latest; the earliest opt-in time of all of them counts as the first.
    """
    latest = requests.groupBy("account_id").agg(
        F.max_by(F.struct("cloud", "webhook"), "at").alias("r"), F.max("at").alias("at"),
        F.min(F.when(c("cloud"), c("at"))).alias("first_in"),
        F.max(F.when(~c("cloud"), c("at"))).alias("last_out"),
    ).select("account_id", "r.*", "at", "first_in", "last_out")
    j = policies.alias("old").join(latest.alias("new"), "account_id", "full_outer")
    changed = c("new.at").isNotNull()
    pick = lambda new, old: F.when(changed, new).otherwise(old)
    return j.select(
        "account_id",
        pick(c("new.cloud"), c("old.cloud")).alias("cloud"),
        pick(c("new.cloud") & c("new.webhook"), c("old.webhook")).alias("webhook"),
        pick(F.coalesce("old.opted_in_at", "new.first_in"), c("old.opted_in_at")).alias("opted_in_at"),
        pick(F.when(~c("new.cloud"), c("new.last_out")), c("old.opted_out_at")).alias("opted_out_at"),
        pick(c("new.at"), c("old.updated_at")).alias("updated_at"),
    )


def opt_in_gate(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """(.., code): null when allowed. A missing policy reads as opted out; cloud before metadata before webhook."""
    j = requests.join(policies.select("account_id", "cloud", "webhook", "metadata_only"), "account_id", "left")
    code = (
        F.when(~F.coalesce("cloud", F.lit(False)), "CLOUD_OPT_IN_REQUIRED")
        .when(~F.coalesce("metadata_only", F.lit(True)), "METADATA_POLICY_REQUIRED")
        .when(c("needs_webhook") & ~F.coalesce("webhook", F.lit(False)), "WEBHOOK_OPT_IN_REQUIRED")
    )
    return j.select(*requests.columns, code.alias("code"))


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(c("revoked_at").isNull() & (c("expires_at") > now))


def live_keys(keys: DataFrame, now: Column) -> DataFrame:
    return keys.filter(c("expires_at") > now)
