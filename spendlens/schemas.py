"""Explicit schemas for every source; nothing is inferred."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One row per campaign billing cycle, as delivered in text files.
CYCLES = _struct(
    ("idadvertiser_master", T.LongType()),
    ("idadvertiser", T.LongType()),
    ("idcampaign_master", T.LongType()),
    ("idcampaign", T.LongType()),
    ("idOffer", T.LongType()),
    ("Offer_Name", T.StringType()),
    ("Channel", T.StringType()),
    ("TargetType", T.StringType()),
    ("Country", T.StringType()),
    ("Currency", T.StringType()),
    ("Advertiser_URL", T.StringType()),
    ("BC_ID", T.LongType()),
    ("BusinessCategory", T.StringType()),
    ("Advertiser_BusinessCategory", T.StringType()),
    ("Primary_BSC_ID", T.LongType()),
    ("Primary_BusinessSubCategory", T.StringType()),
    ("CTL", T.DoubleType()),
    ("CPL", T.DoubleType()),
    ("CPC", T.DoubleType()),
    ("CTR", T.DoubleType()),
    ("campaign_budget", T.DoubleType()),
    ("Paid_On", T.StringType()),
    ("Cycle_Started", T.StringType()),
    ("Cycle_Ended", T.StringType()),
    ("Cycle_Number", T.IntegerType()),
    ("clicks", T.LongType()),
)

# One row per campaign and month.
MART = _struct(
    ("csr_year", T.IntegerType()),
    ("csr_month", T.IntegerType()),
    ("idcampaign_master", T.LongType()),
    ("idcampaign", T.LongType()),
    ("idadvertiser", T.LongType()),
    ("advertiser_name", T.StringType()),
    ("advertiser_city", T.StringType()),
    ("advertiser_state", T.StringType()),
    ("advertiser_zipcode", T.StringType()),
    ("idbusinesscategory", T.LongType()),
    ("business_category", T.StringType()),
    ("idbusinesssubcategory", T.LongType()),
    ("business_subcategory", T.StringType()),
    ("idoffer", T.LongType()),
    ("product", T.StringType()),
    ("stop_request", T.IntegerType()),
    ("adv_change_type", T.StringType()),
    ("campaign_budget", T.DoubleType()),
    ("spend", T.DoubleType()),
    ("clicks", T.LongType()),
    ("impressions", T.LongType()),
    ("calls", T.LongType()),
    ("qualified_calls", T.LongType()),
    ("emails", T.LongType()),
    ("cvt", T.LongType()),
    ("qualified_web_events", T.LongType()),
    ("businessuser", T.IntegerType()),
    ("system", T.IntegerType()),
    ("advtrans", T.IntegerType()),
)

# Comments summed per campaign and month.
COMMENT_SUMMARY = _struct(
    ("cc_year", T.IntegerType()),
    ("cc_month", T.IntegerType()),
    ("mcid", T.LongType()),
    ("cid", T.LongType()),
    ("campaign_name", T.StringType()),
    ("maid", T.LongType()),
    ("businessuser", T.IntegerType()),
    ("system", T.IntegerType()),
    ("stop_request", T.IntegerType()),
    ("idoffer", T.LongType()),
)
COMMENT_SUMMARY_KEY = ("cc_year", "cc_month", "cid")
