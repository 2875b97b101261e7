"""The whole cleaning and feature chain of the house-price table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query
from plumbline.plans.house import (
    FILLS,
    GARAGES_BESIDE,
    LIVING_BASEMENTS,
    ORDINALS,
    PORCHES,
    REPLACEMENTS,
    clean_house,
)
from plumbline.plans.storage import materialize_wide
from plumbline.sources.house import AMOUNTS, CONDITIONS, HOUSE_SQL, TEXT_COLUMNS, house

# columns whose value is no whole number, and the digits compared
DIGITS = {"SalePrice": 6, "DateSold": 4, "BsmtUnfSFPct": 9}
DROPPED = ("Condition1", "Condition2", "RoofMatl", "Utilities")


def _filled_sql() -> str:
    out = []
    for c in (*TEXT_COLUMNS, *AMOUNTS, "GarageYrBlt"):
        expr = f'"{c}"'
        if c in REPLACEMENTS:
            whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in REPLACEMENTS[c].items())
            expr = f'CASE "{c}" {whens} ELSE "{c}" END'
        if c in FILLS:
            fill = FILLS[c] if isinstance(FILLS[c], int) else f"'{FILLS[c]}'"
            expr = f"coalesce({expr}, {fill})"
        if c == "LotFrontage":
            expr = f"coalesce({expr}, 0)"
        if c in ("OverallQual", "OverallCond"):
            expr = f"CAST({expr} AS DOUBLE)"
        if c in ORDINALS:
            levels = ["None" if v == "NA" else v for v in TEXT_COLUMNS[c][1]]
            whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(levels))
            expr = f"CAST(CASE {expr} {whens} END AS DOUBLE)"
        out.append(f'{expr} AS "{c}"')
    return ", ".join(out)


def _in(column: str, values) -> str:
    return f"""(CASE WHEN "{column}" IN ({", ".join(repr(str(v)) for v in values)})
    THEN 1 ELSE 0 END)"""


def _derived_sql() -> dict[str, str]:
    out = {
        "IsMSSubClassPUD": _in("MSSubClass", ("120", "150", "160", "180")),
        "DateSold": '"YrSold" + "MoSold" / 12.0',
        "BsmtFinishedSF": '"TotalBsmtSF" - "BsmtUnfSF"',
        "BsmtUnfSFPct": '"BsmtUnfSF" / (1 + "TotalBsmtSF")',
        "TotalRooms": '"TotRmsAbvGrd" + '
        + _in("BsmtFinType1", LIVING_BASEMENTS) + " + " + _in("BsmtFinType2", LIVING_BASEMENTS),
        "BsmtLivingArea": '"BsmtFinSF1" * ' + _in("BsmtFinType1", LIVING_BASEMENTS)
        + ' + "BsmtFinSF2" * ' + _in("BsmtFinType2", LIVING_BASEMENTS),
        "AgeWhenSold": '"YrSold" - "YearBuilt"',
        "AgeWhenLastRemod": '"YearRemodAdd" - "YearBuilt"',
        "YearsSinceLastRemodel": 'greatest("YrSold" - "YearRemodAdd", 0)',
        "OneFloorOnly": 'CAST("2ndFlrSF" = 0 AS INT)',
        "SummerSale": 'CAST("MoSold" IN (5, 6, 7) AS INT)',
        "BuiltSoldSameYear": 'CAST("YearBuilt" = "YrSold" AS INT)',
        "Remodeled": 'CAST("YearBuilt" <> "YearRemodAdd" AS INT)',
        "RemodeledSoldSameYear": 'CAST("YearRemodAdd" = "YrSold" AS INT)',
        "TotalSF": '"TotalBsmtSF" + "1stFlrSF" + "2ndFlrSF"',
        "TotalPorch": " + ".join(f'"{c}"' for c in PORCHES),
        "RoofMatl_CompShg": """CAST("RoofMatl" = 'CompShg' AS INT)""",
    }
    for p in ("Overall", "Bsmt", "Exter", "Garage"):
        out[f"{p}CondXQual"] = f'"{p}Cond" * "{p}Qual"'
        out[f"{p}Cond_Qual"] = f'"{p}Cond" + "{p}Qual"'
    for v in CONDITIONS:
        if v != "Norm":
            both = f"""CAST("Condition1" = '{v}' AS INT) + CAST("Condition2" = '{v}' AS INT)"""
            out[f"HasCondition_{v}"] = both
            out[f"HasCondition2_{v}"] = f"CAST({both} > 0 AS INT)"
    beside = '"GarageArea" * ' + _in("GarageType", GARAGES_BESIDE)
    porch = " + ".join(f'"{c}"' for c in PORCHES)
    out["TotalLivingArea"] = f'"GrLivArea" + {out["BsmtLivingArea"]}'
    out["TotalSF_with_garage"] = f"{out['TotalSF']} + {beside}"
    out["TotalSF_with_garage_porch"] = f"{out['TotalSF']} + {beside} + {porch}"
    return out


def _house_sql() -> str:
    kept = [c for c in (*TEXT_COLUMNS, *AMOUNTS, "GarageYrBlt") if c not in DROPPED]
    kept += ["Id", "YrSold", "MoSold", "YearBuilt", "YearRemodAdd", "split"]
    derived = [
        f'round({e}, {DIGITS[c]}) AS "{c}"' if c in DIGITS else f'{e} AS "{c}"'
        for c, e in _derived_sql().items()
    ]
    return f"""WITH {HOUSE_SQL}, filled AS (SELECT "Id", "SalePrice", "YrSold", "MoSold",
      "YearBuilt", "YearRemodAdd", split, {_filled_sql()} FROM house)
    SELECT {", ".join(f'"{c}"' for c in kept)}, round(ln(1 + "SalePrice"), 6) AS "SalePrice",
      {", ".join(derived)} FROM filled"""


@query("house_features", _house_sql())
def house_features(spark, folder):
    """Typo repairs, fills, ordinal codes, derived columns and the log target, written at once."""
    df = clean_house(house(spark, folder)).df
    return materialize_wide(df.withColumns({c: F.round(c, n) for c, n in DIGITS.items()}))
