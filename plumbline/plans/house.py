"""Cleaning and feature rules of the house-price table, as data, and one lazy chain over them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.operators import derive as d
from plumbline.operators.columns import drop_columns, filter_not_value
from plumbline.operators.encode import label_encode, ordinal_code
from plumbline.operators.missing import conditional_fill, fill_columns, replace_values
from plumbline.operators.numeric import log1p
from plumbline.spec import ColumnSpec
from plumbline.table import FeatureTable

# --- fixed values: spelling repairs, fill values and named levels of this table

REPLACEMENTS = {
    "Neighborhood": {"NAmes": "NWAmes"},
    "BldgType": {"2fmCon": "2FmCon", "Duplex": "Duplx", "Twnhs": "TwnhsE"},
    "Exterior2nd": {"Brk Cmn": "BrkComm", "CmentBd": "CemntBd", "Wd Shng": "WdShing"},
    "BsmtExposure": {"No": "None"},
}

NONE_FILLS = (
    "PoolQC", "Alley", "Fence", "FireplaceQu", "GarageType", "GarageFinish", "GarageQual",
    "GarageCond", "BsmtQual", "BsmtCond", "BsmtExposure", "BsmtFinType1", "BsmtFinType2",
    "MasVnrType", "MSSubClass", "MiscFeature",
)
ZERO_FILLS = (
    "GarageYrBlt", "GarageArea", "GarageCars", "BsmtFullBath", "BsmtHalfBath", "TotalBsmtSF",
    "BsmtFinSF1", "BsmtFinSF2", "BsmtUnfSF", "MasVnrArea",
)
USUAL_FILLS = {
    "MSZoning": "RL",
    "Functional": "Typ",
    "Electrical": "SBrkr",
    "KitchenQual": "TA",
    "Exterior1st": "VinylSd",
    "Exterior2nd": "VinylSd",
    "SaleType": "WD",
}
FILLS = {c: "None" for c in NONE_FILLS} | {c: 0 for c in ZERO_FILLS} | USUAL_FILLS

PARSED = ("OverallQual", "OverallCond")
ORDINALS = ("ExterQual", "ExterCond", "GarageQual", "GarageCond", "BsmtQual", "BsmtCond")
BASEMENT_AMOUNTS = (
    "BsmtUnfSF", "BsmtFinSF1", "BsmtFinSF2", "BsmtHalfBath", "BsmtFullBath", "TotalBsmtSF",
)

PUD_CLASSES = ("120", "150", "160", "180")
LIVING_BASEMENTS = ("GLQ", "ALQ", "BLQ", "Rec")
GARAGES_BESIDE = ("Basment", "2Types")
SUMMER = (5, 6, 7)
PORCHES = ("WoodDeckSF", "OpenPorchSF", "3SsnPorch", "ScreenPorch", "EnclosedPorch")


def clean_house(
    table: FeatureTable, drop_partial: bool = False, repair_basement: bool = False,
    strict: bool = True,
) -> FeatureTable:
    """Repair, fill, code, derive and log-transform the target, all in one lazy plan.

    ``repair_basement`` zeroes basement amounts of rows without basement quality, before any
    fill.  ``strict`` rejects ordinal values outside the declared levels, at the cost of one pass.
    """
    t = filter_not_value(table, "SaleCondition", "Partial") if drop_partial else table
    t = replace_values(t, REPLACEMENTS)
    if repair_basement:
        t = conditional_fill(t, "BsmtQual", BASEMENT_AMOUNTS, 0.0)
    t = fill_columns(t, FILLS)
    t = t.with_numeric({c: F.col(c).try_cast("double") for c in PARSED})
    if strict:
        coded = label_encode(t, ORDINALS)
        if coded is None:
            raise ValueError("an ordinal column has a single value")
        t = coded
    else:
        t = t.with_numeric(
            {c: ordinal_code(F.col(c), t.spec[c].categories) for c in ORDINALS}
        )
    return derive_house(t)


def derive_house(t: FeatureTable) -> FeatureTable:
    """The derived columns, in two layers, without the columns that only served to make them."""
    living1 = F.col("BsmtFinType1").isin(*LIVING_BASEMENTS)
    living2 = F.col("BsmtFinType2").isin(*LIVING_BASEMENTS)
    first = {
        "LotFrontage": F.coalesce(F.col("LotFrontage"), F.lit(0.0)),
        "IsMSSubClassPUD": d.membership("MSSubClass", PUD_CLASSES),
        "DateSold": d.fractional_date("YrSold", "MoSold"),
        "BsmtFinishedSF": d.elapsed("TotalBsmtSF", "BsmtUnfSF"),
        "BsmtUnfSFPct": d.share("BsmtUnfSF", "TotalBsmtSF"),
        "TotalRooms": d.total("TotRmsAbvGrd", d.flag(living1), d.flag(living2)),
        "BsmtLivingArea": d.gated("BsmtFinSF1", living1) + d.gated("BsmtFinSF2", living2),
        "AgeWhenSold": d.elapsed("YrSold", "YearBuilt"),
        "AgeWhenLastRemod": d.elapsed("YearRemodAdd", "YearBuilt"),
        "YearsSinceLastRemodel": d.elapsed("YrSold", "YearRemodAdd", floor=0.0),
        "OneFloorOnly": d.equal("2ndFlrSF", F.lit(0)),
        "SummerSale": d.membership("MoSold", SUMMER),
        "BuiltSoldSameYear": d.equal("YearBuilt", "YrSold"),
        "Remodeled": d.different("YearRemodAdd", "YearBuilt"),
        "RemodeledSoldSameYear": d.equal("YearRemodAdd", "YrSold"),
        "TotalSF": d.total("TotalBsmtSF", "1stFlrSF", "2ndFlrSF"),
        "ExtraGarageAreaApprox": d.gated("GarageArea", F.col("GarageType").isin(*GARAGES_BESIDE)),
        "TotalPorch": d.total(*PORCHES),
        "RoofMatl_CompShg": d.equal("RoofMatl", F.lit("CompShg")),
    }
    for part in ("Overall", "Bsmt", "Exter", "Garage"):
        first[f"{part}CondXQual"] = d.product(f"{part}Cond", f"{part}Qual")
        first[f"{part}Cond_Qual"] = d.total(f"{part}Cond", f"{part}Qual")
    conditions = [c for c in t.spec["Condition1"].categories if c != "Norm"]
    first |= d.multi_hot(
        ("Condition1", "Condition2"), conditions, "HasCondition", "HasCondition2"
    )
    second = {
        "TotalLivingArea": d.total("GrLivArea", "BsmtLivingArea"),
        "TotalSF_with_garage": d.total("TotalSF", "ExtraGarageAreaApprox"),
        "TotalSF_with_garage_porch": d.total("TotalSF", "ExtraGarageAreaApprox", "TotalPorch"),
    }
    out = t.with_numeric(first).with_numeric(second)
    out = drop_columns(
        out, "Condition1", "Condition2", "ExtraGarageAreaApprox", "RoofMatl", "Utilities"
    )
    out = replace(out, spec=out.spec.with_column(out.spec.target, ColumnSpec()))
    return log1p(out, out.spec.target)
