"""Band descriptions, flag tables and other fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class BandSpec:
    """One measurement of a product: its type on disk and its nodata sentinel."""

    name: str
    dtype: str
    nodata: float | None = None

    @property
    def itemsize(self) -> int:
        return ITEM_SIZE[self.dtype]


@dataclass(frozen=True)
class Flag:
    """A named condition on a bit field: true where ``value & mask == match``."""

    name: str
    mask: int
    match: int


# Bytes per element of the band types.
ITEM_SIZE = {"bool": 1, "uint8": 1, "int8": 1, "int16": 2, "int32": 4, "float32": 4, "float64": 8}

SPARK_TYPE = {
    "bool": T.BooleanType(),
    "uint8": T.ShortType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
}

# Nodata sentinels.
COVER_NODATA = -1
WETNESS_NODATA = -9999
WATER_NODATA = 1
WATER_VALUE_NODATA = 0
REFLECTANCE_NODATA = -1
NODATA_TOLERANCE = 1e-5

COVER_BANDS = ("bs", "pv", "npv")
REFLECTANCE_BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")

COVER_PRODUCT = (
    BandSpec("bs", "int16", COVER_NODATA),
    BandSpec("pv", "int16", COVER_NODATA),
    BandSpec("npv", "int16", COVER_NODATA),
)
WATER_PRODUCT = (BandSpec("water", "int16", WATER_NODATA),)
SURFACE_PRODUCT = tuple(BandSpec(b, "int16", -999) for b in REFLECTANCE_BANDS) + (
    BandSpec("fmask", "uint8", 0),
    BandSpec("nbart_contiguity", "uint8", 255),
)
CANOPY_PRODUCT = (BandSpec("canopy_cover_class", "uint8", 255),)

# The water bit field. "dry" and "wet" look at every bit but sea.
WATER_FLAGS = (
    Flag("nodata", 1, 1),
    Flag("noncontiguous", 2, 2),
    Flag("sea", 4, 4),
    Flag("terrain_or_low_angle", 8, 8),
    Flag("high_slope", 16, 16),
    Flag("cloud_shadow", 32, 32),
    Flag("cloud", 64, 64),
    Flag("water_observed", 128, 128),
    Flag("dry", 251, 0),
    Flag("wet", 251, 128),
)

# Flags a pixel must have, or must not have, to count as seen ground.
CLEAR_DRY_LAND = {
    "dry": True,
    "terrain_or_low_angle": False,
    "high_slope": False,
    "cloud_shadow": False,
    "cloud": False,
    "sea": False,
}

# Tasselled-cap weights per category and band.
TASSELLED_CAP = {
    "brightness": {"blue": 0.2043, "green": 0.4158, "red": 0.5524, "nir": 0.5741,
                   "swir1": 0.3124, "swir2": 0.2303},
    "greenness": {"blue": -0.1603, "green": -0.2819, "red": -0.4934, "nir": 0.7940,
                  "swir1": -0.0002, "swir2": -0.1446},
    "wetness": {"blue": 0.0315, "green": 0.2021, "red": 0.3102, "nir": 0.1594,
                "swir1": -0.6806, "swir2": -0.6109},
}

# Wetness above this is wet, below it is vegetation or soil.
WET_THRESHOLD = -350

# Share of a polygon that must be valid for a time to be kept.
MIN_VALID_SHARE = 0.9

# Periods in which a sensor is used, inclusive, UTC midnight.
SENSOR_EPOCHS = {
    "ls8": ((("2013-01-01"), None),),
    "ls7": ((None, "2003-05-31"), ("2010-01-01", "2013-05-31")),
    "ls5": ((None, "1999-12-31"), ("2003-01-01", "2011-12-31")),
}

# Accepted range of the geometric quality figure, inclusive.
QUALITY_RANGE = (0, 1)

# Admission limits, in units of 1e9 bytes.
GB = 1.0e9
MAX_GB = 20.0
MAX_GB_PER_TIME = 2.0

# Names, units and colours of the chart series.
STYLES = {
    "water": {
        "Wet": {"units": "#", "chartLineColor": "#4F81BD", "active": True},
        "Dry": {"units": "#", "chartLineColor": "#D99694", "active": True},
        "Not Observable": {"units": "#", "chartLineColor": "#707070", "active": True},
    },
    "cover": {
        "Bare Soil": {"units": "%", "chartLineColor": "#8B0000", "active": True},
        "Photosynthetic Vegetation": {"units": "%", "chartLineColor": "green", "active": True},
        "Non-Photosynthetic Vegetation": {"units": "%", "chartLineColor": "#dac586", "active": True},
        "Unobservable": {"units": "%", "chartLineColor": "grey", "active": False},
    },
    "mangrove": {
        "Woodland": {"units": "#", "chartLineColor": "#9FFF4C", "active": True},
        "Open Forest": {"units": "#", "chartLineColor": "#5ECC00", "active": True},
        "Closed Forest": {"units": "#", "chartLineColor": "#3B7F00", "active": True},
    },
}

# Result columns, their long labels and the title of a result.
COVER_SERIES = {
    "BS": "Bare Soil",
    "PV": "Photosynthetic Vegetation",
    "NPV": "Non-Photosynthetic Vegetation",
    "Unobservable": "Unobservable",
}
MANGROVE_SERIES = {"Woodland": "Woodland", "Open Forest": "Open Forest", "Closed Forest": "Closed Forest"}
WATER_SERIES = {"observation": "Observation"}
RESULT_NAME = {"water": "WOfS", "cover": "FC", "mangrove": "Mangrove Cover"}
RESULT_ENABLED = {"water": False, "cover": True, "mangrove": True}

# Canopy classes counted by the mangrove drill.
CANOPY_CLASSES = {1: "Woodland", 2: "Open Forest", 3: "Closed Forest"}

# Colours of the point drill's ticks.
OBSERVATION_COLOURS = {"wet": "blue", "dry": "red", "not observable": "grey"}


def nodata_of(product: tuple[BandSpec, ...]) -> dict[str, float]:
    """Declared nodata of each band that has one."""
    return {b.name: b.nodata for b in product if b.nodata is not None}


def pixel_schema(bands: tuple[BandSpec, ...]) -> T.StructType:
    """Columns of a stored pixel table that carries ``bands``."""
    fields = [
        T.StructField("scene_id", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("tile_id", T.LongType(), False),
        T.StructField("y", T.IntegerType(), False),
        T.StructField("x", T.IntegerType(), False),
    ]
    for b in bands:
        meta = {} if b.nodata is None else {"nodata": b.nodata}
        fields.append(T.StructField(b.name, SPARK_TYPE[b.dtype], True, meta))
    return T.StructType(fields)
