"""Labels derived from scores and probabilities."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment names from best to worst, with the lowest RFM total of each.
SEGMENTS = ["Champions", "Loyal", "At Risk", "Lost"]
CHAMPIONS_FROM, LOYAL_FROM, AT_RISK_FROM = 12, 9, 6

# Risk bands, lowest probability of each, and the advice given.
HIGH_RISK_FROM, MEDIUM_RISK_FROM = 0.70, 0.40
RISK_ACTIONS = {
    "High": "Trigger immediate re-engagement campaign with discount offer",
    "Medium": "Send personalised email with new product recommendations",
    "Low": "Customer is healthy — maintain regular comms",
}


def segment_name(score: Column) -> Column:
    champions, loyal, at_risk, lost = SEGMENTS
    return (
        F.when(score >= CHAMPIONS_FROM, champions)
        .when(score >= LOYAL_FROM, loyal)
        .when(score >= AT_RISK_FROM, at_risk)
        .otherwise(lost)
    )


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability >= HIGH_RISK_FROM, "High")
        .when(probability >= MEDIUM_RISK_FROM, "Medium")
        .otherwise("Low")
    )


def risk_action(probability: Column) -> Column:
    level = risk_level(probability)
    return (
        F.when(level == "High", RISK_ACTIONS["High"])
        .when(level == "Medium", RISK_ACTIONS["Medium"])
        .otherwise(RISK_ACTIONS["Low"])
    )
