"""Campaign-month mart: spend, counters, comments, stop requests and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.numbers import clamp0
from ..operators.joins import drop_keys, flag_exists, join_on_month

SYSTEM_USER = 1  # fixed value: user id of automatic comments
STOP_PATTERN = "*USER STOP REQUEST*%"  # fixed value: the asterisks are literal
FIRST_YEAR = 2009  # fixed value: start of the published mart
LAST_COMMENT = "2018-03-31"  # fixed value: midnight, so later times of that day are out


def eligible_masters(summary: DataFrame, excluded: DataFrame, first_year: int = FIRST_YEAR) -> DataFrame:
    """Master campaigns with cost since ``first_year`` whose business is not excluded."""
    paid = summary.where((F.col("csr_year") >= first_year) & (F.col("net_cost") > 0))
    return drop_keys(paid, excluded, "idbusiness").select("idcampaign_master").distinct()


def comment_summary(comments: DataFrame, campaigns: DataFrame, advertisers: DataFrame,
                    first_day: str = f"{FIRST_YEAR}-01-01", last_day: str = LAST_COMMENT,
                    masters: DataFrame | None = None) -> DataFrame:
    """Comments per campaign and month: by people, by the system, and a stop-request flag.

    Comments are added up per campaign and month before they meet the campaign table, so
    a campaign with very many comments moves as one row per month.
    """
    stop = F.col("cc_comment").like(STOP_PATTERN)
    monthly = (
        comments.where(F.col("cc_entered").between(
            F.lit(first_day).cast("timestamp"), F.lit(last_day).cast("timestamp")
        ))
        .groupBy(F.year("cc_entered").alias("cc_year"), F.month("cc_entered").alias("cc_month"),
                 F.col("idcampaign").alias("cid"))
        .agg(F.count_if(F.col("user_id") != SYSTEM_USER).alias("businessuser"),
             F.count_if(F.col("user_id") == SYSTEM_USER).alias("system"),
             F.max(F.when(stop, 1).otherwise(0)).alias("stop_request"))
    )
    if masters is not None:
        campaigns = campaigns.join(masters, "idcampaign_master", "left_semi")
    named = campaigns.join(advertisers.select("idadvertiser", "idadvertiser_master"), "idadvertiser")
    return monthly.join(named.withColumnRenamed("idcampaign", "cid"), "cid").select(
        "cc_year", "cc_month", F.col("idcampaign_master").alias("mcid"), "cid", "campaign_name",
        F.col("idadvertiser_master").alias("maid"), "businessuser", "system", "stop_request", "idoffer",
    )


def transfer_keys(log: DataFrame, first_year: int = FIRST_YEAR) -> DataFrame:
    """Campaign months with a transfer."""
    return log.where(F.year("created") >= first_year).select(
        F.year("created").alias("csr_year"), F.month("created").alias("csr_month"), "idcampaign"
    ).distinct()


def build_churn_mart(summary: DataFrame, masters: DataFrame, report: DataFrame, advertisers: DataFrame,
                     changes: DataFrame, offers: DataFrame, comments: DataFrame, transfers: DataFrame,
                     first_year: int = FIRST_YEAR) -> DataFrame:
    """One row per campaign and month, with the columns of ``schemas.MART``.

    The published loop over master campaigns is one set-based query here. Columns outside
    the grouping key take their smallest value, which makes the result repeatable.
    """
    base = summary.where(F.col("csr_year") >= first_year).join(masters, "idcampaign_master", "left_semi")
    base = base.join(report, "idcampaign").join(advertisers, "idadvertiser")
    changed = changes.withColumnRenamed("first_aid", "idadvertiser_master")
    base = join_on_month(base, changed, ["idadvertiser_master"], "reporting_date")
    base = base.join(offers, "idoffer")
    cost = clamp0(F.col("net_cost") + F.col("net_cost_adjustment"))
    base = base.withColumnRenamed("change_type", "adv_change_type")
    keys = ["csr_year", "csr_month", "idcampaign"]
    made = {*keys, "spend", "stop_request", "businessuser", "system", "advtrans"}
    carried = [name for name in schemas.MART.fieldNames() if name not in made]
    folded = base.groupBy("csr_year", "csr_month", "idcampaign").agg(
        F.min(cost).alias("spend"), *[F.min(name).alias(name) for name in carried]
    )
    notes = comments.select(
        F.col("cc_year").alias("csr_year"), F.col("cc_month").alias("csr_month"),
        F.col("cid").alias("idcampaign"), "stop_request", "businessuser", "system",
    )
    marked = flag_exists(folded.join(notes, keys, "left"), transfers, keys, "advtrans")
    return marked.select(*schemas.MART.fieldNames())
