"""Class list, palettes and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Class order (index 1..5), channels, display names, colours.
CLASSES = ("scar", "redness", "hematoma", "necrosis", "background")
FOREGROUND_CLASSES = CLASSES[:4]
CHANNELS = ("red", "green", "blue")
PIXEL_CHANNELS = ("r", "g", "b")
CLASS_NAMES_DE = {
    "scar": "In_Narbe",
    "redness": "Bei_Narbe",
    "hematoma": "Umgebung",
    "necrosis": "Entfernt",
    "background": "Hintergrund",
}
CHANNEL_NAMES_DE = {"red": "Rot", "green": "Grün", "blue": "Blau"}
PALETTES = {
    "shape": {
        "background": (0.0, 0.0, 0.0),
        "foreground": (1.0, 1.0, 1.0),
        "scar": (0.0, 1.0, 0.0),
        "redness": (1.0, 0.0, 0.0),
        "hematoma": (0.854902, 0.647059, 0.12549),
        "necrosis": (0.0, 0.0, 1.0),
    },
    "compare": {
        "scar": (0.0, 1.0, 0.0),
        "redness": (1.0, 0.0, 0.0),
        "hematoma": (0.85, 0.65, 0.125),
        "necrosis": (0.0, 0.0, 1.0),
        "background": (0.5, 0.5, 0.5),
    },
}
PALETTE_NAMES = {
    "scar": "indianred",
    "redness": "mediumseagreen",
    "hematoma": "cornflowerblue",
    "necrosis": "gold",
    "background": "slategray",
}


def p_col(class_name: str) -> str:
    return f"p_{class_name}"


P_COLUMNS = tuple(p_col(c) for c in CLASSES)

CLASS_DIM_SCHEMA = (
    "class string, class_index int, kind string, display_name string,"
    " cr double, cg double, cb double"
)

POLYGON_STRUCT = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("class", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("sample_number", T.IntegerType()),
        T.StructField("vertices", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("complete", T.BooleanType()),
        T.StructField(
            "lch_data",
            T.StructType(
                [
                    T.StructField("L_median", T.DoubleType()),
                    T.StructField("C_median", T.DoubleType()),
                    T.StructField("h_median", T.DoubleType()),
                    T.StructField("count", T.LongType()),
                ]
            ),
        ),
        T.StructField("mask_file", T.StringType()),
    ]
)

POLYGON_DOCUMENT = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("image_index", T.IntegerType()),
        T.StructField("mask_format", T.StringType()),
        T.StructField("polygons", T.ArrayType(POLYGON_STRUCT)),
    ]
)

VISIT_SCHEMA = (
    "image_index int, filename string, visit_date string, patient_id string,"
    " info string, created_at timestamp, updated_at timestamp"
)


def class_dim(spark: SparkSession, palette: str = "shape") -> DataFrame:
    """Seven-row dimension: classes, the collapsed foreground, and their colours."""
    colours = PALETTES[palette]
    rows = []
    for index, name in enumerate(CLASSES, start=1):
        cr, cg, cb = colours.get(name, (1.0, 1.0, 1.0))
        rows.append((name, index, "binary", CLASS_NAMES_DE[name], cr, cg, cb))
    cr, cg, cb = colours.get("foreground", (1.0, 1.0, 1.0))
    rows.append(("foreground", 0, "binary", "foreground", cr, cg, cb))
    return spark.createDataFrame(rows, CLASS_DIM_SCHEMA)
