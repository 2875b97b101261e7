"""A house-price shaped table, derived by integer arithmetic from orders, customers and lines.

It has the columns that the house rules read, nulls and misspelt values included.  Each column
is an expression that Spark and the check engine evaluate alike.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import KEY_SPLIT_SQL, read
from plumbline.spec import CATEGORICAL, ColumnSpec, SchemaSpec
from plumbline.table import FeatureTable

GRADES = ("Po", "Fa", "TA", "Gd", "Ex")
FINISHES = ("Unf", "LwQ", "Rec", "BLQ", "ALQ", "GLQ")
CONDITIONS = (
    "Artery", "Feedr", "Norm", "RRNn", "RRAn", "PosN", "PosA", "RRNe", "RRAe",
)

# column -> (values as they occur in the data; None is null), declared levels
TEXT_COLUMNS: dict[str, tuple[tuple, tuple[str, ...]]] = {
    "Neighborhood": (("NAmes", "NWAmes", "Gilbert"), ("Gilbert", "NWAmes")),
    "BldgType": (
        ("1Fam", "2fmCon", "Duplex", "Twnhs", "TwnhsI"),
        ("1Fam", "2FmCon", "Duplx", "TwnhsE", "TwnhsI"),
    ),
    "Exterior1st": (("VinylSd", "Wd Sdng", None), ("VinylSd", "Wd Sdng")),
    "Exterior2nd": (
        ("Brk Cmn", "CmentBd", "Wd Shng", "VinylSd", None),
        ("BrkComm", "CemntBd", "WdShing", "VinylSd"),
    ),
    "PoolQC": ((None, "Fa", "Gd", "Ex"), GRADES),
    "Alley": ((None, "Grvl", "Pave"), ("NA", "Grvl", "Pave")),
    "Fence": ((None, "MnPrv", "GdWo"), ("NA", "MnPrv", "GdWo")),
    "FireplaceQu": ((None, *GRADES), ("NA", *GRADES)),
    "GarageType": ((None, "Attchd", "Basment", "2Types"), ("NA", "Attchd", "Basment", "2Types")),
    "GarageFinish": ((None, "Unf", "Fin"), ("NA", "Unf", "Fin")),
    "GarageQual": ((None, *GRADES), ("NA", *GRADES)),
    "GarageCond": ((None, *GRADES), ("NA", *GRADES)),
    "BsmtQual": ((None, *GRADES), ("NA", *GRADES)),
    "BsmtCond": ((None, *GRADES), ("NA", *GRADES)),
    "BsmtExposure": ((None, "No", "Mn", "Av", "Gd"), ("NA", "No", "Mn", "Av", "Gd")),
    "BsmtFinType1": ((None, *FINISHES), ("NA", *FINISHES)),
    "BsmtFinType2": ((None, *FINISHES), ("NA", *FINISHES)),
    "MasVnrType": ((None, "None", "Stone"), ("None", "Stone")),
    "MSZoning": (("RL", "RM", None), ("RL", "RM")),
    "Functional": (("Typ", "Min1", None), ("Min1", "Typ")),
    "Electrical": (("SBrkr", "FuseA", None), ("FuseA", "SBrkr")),
    "KitchenQual": ((None, *GRADES), GRADES),
    "SaleType": (("WD", "New", None), ("WD", "New")),
    "SaleCondition": (("Normal", "Partial", "Abnorml"), ("Normal", "Partial", "Abnorml")),
    "MSSubClass": (("20", "60", "120", "160", "180", None), ("20", "60", "120", "160", "180")),
    "MiscFeature": ((None, "Shed"), ("NA", "Shed")),
    "OverallQual": (("3", "5", "7", "9"), ("3", "5", "7", "9")),
    "OverallCond": (("4", "5", "6"), ("4", "5", "6")),
    "ExterQual": (GRADES, GRADES),
    "ExterCond": (GRADES, GRADES),
    "Condition1": (CONDITIONS, CONDITIONS),
    "Condition2": (("Norm", "Artery", "PosN"), CONDITIONS),
    "RoofMatl": (("CompShg", "Metal"), ("CompShg", "Metal")),
    "Utilities": (("AllPub", "NoSeWa"), ("AllPub", "NoSeWa")),
}

# column -> (largest value + 1, whether about one row in eleven is null)
AMOUNTS: dict[str, tuple[int, bool]] = {
    "GarageArea": (900, True),
    "GarageCars": (4, True),
    "BsmtFullBath": (3, True),
    "BsmtHalfBath": (2, True),
    "TotalBsmtSF": (1900, True),
    "BsmtFinSF1": (1200, True),
    "BsmtFinSF2": (500, True),
    "BsmtUnfSF": (1100, True),
    "MasVnrArea": (400, True),
    "LotFrontage": (150, True),
    "1stFlrSF": (2000, False),
    "2ndFlrSF": (3, False),
    "GrLivArea": (3000, False),
    "TotRmsAbvGrd": (12, False),
    "WoodDeckSF": (300, False),
    "OpenPorchSF": (200, False),
    "3SsnPorch": (90, False),
    "ScreenPorch": (180, False),
    "EnclosedPorch": (250, False),
}


def _pick(values: tuple, step: int) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)
    )
    return f"CASE (o_orderkey * {step} + o_custkey) % {len(values)} {whens} END"


def house_expressions() -> dict[str, str]:
    """column -> SQL expression over the orders table, valid in both engines."""
    out = {"Id": "o_orderkey", "SalePrice": "o_totalprice"}
    for i, (c, (values, _)) in enumerate(TEXT_COLUMNS.items()):
        out[c] = _pick(values, 2 * i + 3)
    for i, (c, (top, gaps)) in enumerate(AMOUNTS.items()):
        value = f"CAST((o_orderkey * {7 * i + 13} + o_custkey * {i + 5}) % {top} AS DOUBLE)"
        if gaps:
            value = f"CASE WHEN (o_orderkey + {i} * o_custkey) % 11 <> 0 THEN {value} END"
        out[c] = value
    built = "year(o_orderdate) - o_custkey % 40"
    out["YrSold"] = "CAST(year(o_orderdate) AS DOUBLE)"
    out["MoSold"] = "CAST(month(o_orderdate) AS DOUBLE)"
    out["YearBuilt"] = f"CAST({built} AS DOUBLE)"
    out["YearRemodAdd"] = f"CAST({built} + o_orderkey % 45 AS DOUBLE)"
    out["GarageYrBlt"] = f"CASE WHEN o_orderkey % 9 <> 0 THEN CAST({built} AS DOUBLE) END"
    return out


HOUSE_SPEC = SchemaSpec(
    id="Id",
    target="SalePrice",
    columns={c: ColumnSpec(CATEGORICAL, levels) for c, (_, levels) in TEXT_COLUMNS.items()}
    | {
        c: ColumnSpec()
        for c in (*AMOUNTS, "YrSold", "MoSold", "YearBuilt", "YearRemodAdd", "GarageYrBlt")
    },
)


def house(spark: SparkSession, folder: str) -> FeatureTable:
    orders = read(spark, folder, "orders")
    split = F.when(F.col("o_orderkey") % 5 < 4, "train").otherwise("test").alias("split")
    columns = [F.expr(e).alias(c) for c, e in house_expressions().items()]
    return FeatureTable(orders.select(*columns, split), HOUSE_SPEC)


HOUSE_SQL = (
    "house AS (SELECT "
    + ", ".join(f'{e} AS "{c}"' for c, e in house_expressions().items())
    + f", {KEY_SPLIT_SQL} AS split FROM orders o)"
)
