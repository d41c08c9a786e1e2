"""Per-frame arithmetic on pixel arrays and segmentation labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driverscope.functions.geometry import c

# Segmentation class names and colours of the simulator's camera.
SEGMENTATION_CLASSES = [
    (0, "unlabeled", 0, 0, 142),
    (1, "road", 128, 64, 128),
    (2, "sidewalk", 244, 35, 232),
    (3, "building", 70, 70, 70),
    (4, "wall", 102, 102, 156),
    (5, "fence", 190, 153, 153),
    (6, "pole", 153, 153, 153),
    (7, "traffic light", 250, 170, 30),
    (8, "traffic sign", 220, 220, 0),
    (9, "vegetation", 107, 142, 35),
    (10, "terrain", 152, 251, 152),
    (11, "sky", 70, 130, 180),
    (12, "pedestrian", 220, 20, 60),
    (13, "rider", 255, 0, 0),
    (14, "car", 0, 0, 142),
    (15, "truck", 0, 0, 70),
    (16, "bus", 0, 60, 100),
    (17, "train", 0, 80, 100),
    (18, "motorcycle", 0, 0, 230),
    (19, "bicycle", 119, 11, 32),
    (20, "static", 110, 190, 160),
    (21, "dynamic", 170, 120, 50),
    (22, "other", 55, 90, 80),
    (23, "water", 45, 60, 150),
    (24, "road line", 157, 234, 50),
    (25, "ground", 81, 0, 81),
    (26, "bridge", 150, 100, 100),
    (27, "rail track", 230, 150, 140),
    (28, "guard rail", 180, 165, 180),
]
AGENT_BITS = range(12, 20)
LANE_MARKING_BIT = 24
ROAD_BIT = 1
SIDEWALK_BIT = 2
SIGN_BITS = (7, 8)

# 24-bit depth range, far plane in metres, log-depth scale.
DEPTH_STEPS = 256.0 * 256.0 * 256.0 - 1.0
FAR_PLANE_M = 1000.0
LOG_DEPTH_SCALE = 5.70378

# Colour channel means and deviations used to standardise RGB clips.
RGB_MEAN = (0.485, 0.456, 0.406)
RGB_STD = (0.229, 0.224, 0.225)


def depth_metres(high, middle, low) -> Column:
    """Depth packed into three byte channels, most significant first."""
    steps = c(high) * F.lit(65536.0) + c(middle) * F.lit(256.0) + c(low)
    return steps / F.lit(DEPTH_STEPS) * F.lit(FAR_PLANE_M)


def log_depth(metres) -> Column:
    """Logarithmic depth in [0, 1] for display; zero depth shows as 0."""
    m = c(metres)
    value = F.lit(1.0) + F.log(m / F.lit(FAR_PLANE_M)) / F.lit(LOG_DEPTH_SCALE)
    return F.when(m <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def min_max_255(pixels) -> Column:
    """Stretch one frame to 0..255; a flat frame becomes 0."""
    p = c(pixels)
    low, span = F.array_min(p), F.array_max(p) - F.array_min(p)
    return F.transform(p, lambda v: F.coalesce(F.try_divide(v - low, span), F.lit(0.0)) * F.lit(255.0))


def segmentation_table(spark: SparkSession) -> DataFrame:
    """29 fixed rows: id, name, colour."""
    return spark.createDataFrame(SEGMENTATION_CLASSES, "class_id int, class_name string, red int, green int, blue int")


def with_segmentation_class(df: DataFrame, class_id: str) -> DataFrame:
    """Name and colour of a class id; unknown ids keep no name and turn black."""
    table = F.broadcast(segmentation_table(df.sparkSession))  # 29 rows, fixed
    joined = df.join(table, df[class_id] == table["class_id"], "left").drop(table["class_id"])
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(0)) for k in ("red", "green", "blue")})


def highest_bit(mask) -> Column:
    """Index of the highest set bit of a non-negative mask, -1 for 0. Exact for all 63 bits."""
    m = c(mask)
    return F.when(m == 0, F.lit(-1)).otherwise(F.length(F.bin(m.cast("long"))) - 1)


def has_bit(mask, bit: int) -> Column:
    return c(mask).cast("long").bitwiseAND(F.lit(1 << bit).cast("long")) != 0


def most_salient(mask) -> Column:
    """Highest agent bit, else lane marking, road, sidewalk, else the highest bit of any kind."""
    ranked = [*reversed(AGENT_BITS), LANE_MARKING_BIT, ROAD_BIT, SIDEWALK_BIT]
    choice = reduce(lambda acc, bit: acc.when(has_bit(mask, bit), F.lit(bit)), ranked[1:], F.when(has_bit(mask, ranked[0]), F.lit(ranked[0])))
    return choice.otherwise(highest_bit(mask))


def class_groups(mask) -> dict[str, Column]:
    """Which of the four groups a pixel's class set touches."""
    m = c(mask).cast("long")

    def touches(bits) -> Column:
        return m.bitwiseAND(F.lit(sum(1 << b for b in bits)).cast("long")) != 0

    return {
        "is_agent": touches(AGENT_BITS),
        "is_road": touches((ROAD_BIT,)),
        "is_lane_marking": touches((LANE_MARKING_BIT,)),
        "is_sign": touches(SIGN_BITS),
    }


def scale_flow(flow, limit: float = 20.0) -> Column:
    """Clip optical-flow components to ±limit and scale to ±1."""
    return F.transform(c(flow), lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v)) / F.lit(limit))


def standardise_channel(pixels, channel: int, scale: float = 255.0) -> Column:
    """Byte pixels of one colour channel to zero mean and unit deviation."""
    return F.transform(c(pixels), lambda v: (v / F.lit(scale) - F.lit(RGB_MEAN[channel])) / F.lit(RGB_STD[channel]))


def pixel_at(pixels, width, x, y) -> Column:
    """Row-major pixel lookup; NULL when the position is NULL or outside the array."""
    return F.get(c(pixels), c(y) * F.lit(width) + c(x))
