"""Canonical column names, schemas and fixed domain values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = "MANUFACTURINGORDER"
SEQ = "ROW_SEQ"

# Ledger column names and the feature order the models are trained on.
CATEGORY_COLUMNS = ["MATERIAL", "MATERIALSPECIE", "TALLYGRADE", "PLANT"]
DIMENSION_COLUMNS = ["MATERIALTHICKNESS", "TALLYLENGTH", "TALLYWIDTH"]
NUMERIC_COLUMNS = ["MATERIALTHICKNESS", "TALLYLENGTH", "TALLYWIDTH", "BFIN", "BFOUT"]
ENCODED_CATEGORIES = [
    "Input_Material", "Input_Specie", "Input_Grade", "Input_Plant",
    "Output_Material", "Output_Specie", "Output_Grade",
]
FEATURE_COLUMNS = [
    "Input_Material_Encoded", "Input_Specie_Encoded", "Input_Grade_Encoded", "Input_Plant_Encoded",
    "Input_Thickness", "Input_Length", "Input_Width", "Total_Input_BF",
]

INPUT_NAMES = {
    "MATERIAL": "Input_Material",
    "MATERIALSPECIE": "Input_Specie",
    "TALLYGRADE": "Input_Grade",
    "PLANT": "Input_Plant",
    "MATERIALTHICKNESS": "Input_Thickness",
    "TALLYLENGTH": "Input_Length",
    "TALLYWIDTH": "Input_Width",
}
OUTPUT_NAMES = {
    "MATERIAL": "Output_Material",
    "MATERIALSPECIE": "Output_Specie",
    "TALLYGRADE": "Output_Grade",
    "MATERIALTHICKNESS": "Output_Thickness",
    "TALLYLENGTH": "Output_Length",
    "TALLYWIDTH": "Output_Width",
}


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S, _D, _I, _B, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

_LEDGER = (
    (ORDER, _S), ("MATERIAL", _S), ("MATERIALSPECIE", _S), ("TALLYGRADE", _S), ("PLANT", _S),
    ("MATERIALTHICKNESS", _D), ("TALLYLENGTH", _D), ("TALLYWIDTH", _D),
)
LEDGER_261 = _struct(*_LEDGER, ("BFIN", _D), ("IS_DELETED", _B), ("POSTINGDATE", _TS))
LEDGER_101 = _struct(*_LEDGER, ("BFOUT", _D), ("BFIN", _D), ("IS_DELETED", _B), ("POSTINGDATE", _TS))

REQUEST = _struct(
    ("request_id", _S), ("line_no", _I), ("Input_Plant", _S), ("Input_Material", _S), ("Input_Thickness", _D),
    ("Input_Specie", _S), ("Input_Grade", _S), ("Input_Length", _D), ("Input_Width", _D), ("Total_Input_BF", _D),
)
REVERSE_REQUEST = T.StructType(
    REQUEST.fields + _struct(("required_output_bf", _D), ("safety_margin_pct", _D)).fields
)
KD_REQUEST = _struct(
    ("request_id", _S), ("material", _S), ("thickness", _D), ("grade", _S), ("species", _S), ("plant", _S),
    ("input_bf", _D), ("wastage_pct", _D),
)
FORWARD_REQUEST = _struct(
    ("request_id", _S), ("ks_material", _S), ("plant", _S), ("input_bf", _D), ("min_order_count", _I),
)
PRICES = _struct(("material", _S), ("price_per_bf", _D))


def has(df: DataFrame, *columns: str) -> bool:
    """True when every named column is present (the ledgers may omit optional ones)."""
    return all(c in df.columns for c in columns)


def canonicalise(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to `schema`, absent columns becoming typed nulls; extra columns are kept at the end."""
    named = [
        (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*named, *[c for c in df.columns if c not in schema.fieldNames()])
