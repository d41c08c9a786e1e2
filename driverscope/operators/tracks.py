"""Object tracks: ego and others, distances, hazards, removals, relevance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driverscope.functions.geometry import clamp_degrees, distance, quaternion_yaw, rotate
from driverscope.operators.ordered import row_index, time_bin
from driverscope.operators.spread import join_few

POSE = ("pose_x", "pose_y", "pose_z")
# Role of the driven car, of walkers, and the car type of staged hazards.
HERO = "hero"
PEDESTRIAN = "pedestrian"
HAZARD_VEHICLE = "vehicle.mercedes.coupe_2020"
OTHER_TYPE_PENALTY = 10000
# Removal rules of the traffic manager.
FAR_M = 250.0
STILL_M = 0.5
STILL_NS = 7_000_000_000
HAZARD_M = 110.0
SCREEN_M = 100.0
SCREEN_DEG = (45.0, 135.0)
# Time slots over which one recording's rows spread when they meet per-recording fields.
SLOT_NS = 600_000_000_000


def single_ego(actors: DataFrame, keys: Sequence[str], role: str = "role") -> DataFrame:
    """The ego's id of recordings with exactly one hero; others are left out."""
    heroes = actors.where(F.col(role) == HERO).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("object_id").alias("ego_id"))
    return heroes.where("__n = 1").drop("__n")


def split_ego(tracks: DataFrame, actors: DataFrame, keys: Sequence[str], role: str = "role", time: str = "t_ns") -> tuple[DataFrame, DataFrame]:
    """(ego rows, other rows) of recordings with one ego."""
    marked = join_few(tracks, single_ego(actors, keys, role), keys, bin=time_bin(time, SLOT_NS))
    ego = marked.where("object_id = ego_id").drop("ego_id", "object_id")
    return ego, marked.where("object_id <> ego_id").drop("ego_id")


def thin_tracks(tracks: DataFrame, keys: Sequence[str], every: int, slot: int, time: str = "t_ns") -> DataFrame:
    """Every n-th row of each track, the first included."""
    numbered = row_index(tracks, [*keys, "object_id"], time_bin(time, slot), [time], "__row")
    return numbered.where(F.col("__row") % every == 0).drop("__row")


def enough_objects(tracks: DataFrame, keys: Sequence[str], minimum: int = 10, time: str = "t_ns") -> DataFrame:
    """Tracks of recordings with at least ``minimum`` objects."""
    objects = tracks.groupBy(*keys, "object_id").agg(F.lit(1).alias("__one")).groupBy(*keys).agg(F.count("__one").alias("__n"))
    return join_few(tracks, objects.where(F.col("__n") >= minimum), keys, "left_semi", time_bin(time, SLOT_NS))


def ego_positions(ego: DataFrame, keys: Sequence[str], time: str = "t_ns", extra: Sequence[str] = ()) -> DataFrame:
    return ego.select(*keys, time, *[F.col(c).alias(f"ego_{c}") for c in (*POSE, *extra)])


def ego_distance() -> Column:
    return distance(*[(c, f"ego_{c}") for c in POSE])


def relevant_tracks(tracks: DataFrame, actors: DataFrame, keys: Sequence[str], time: str = "t_ns", quaternion: Sequence[str] = ("qx", "qy", "qz", "qw")) -> DataFrame:
    """Every track of a recording with one ego: distance to the ego while both exist, and yaw in degrees.

    The join key holds the time, so even a recording with a third of all rows spreads evenly.
    """
    marked = join_few(tracks, single_ego(actors, keys), keys, bin=time_bin(time, SLOT_NS))
    ego = ego_positions(marked.where("object_id = ego_id"), keys, time)
    return (
        marked.drop("ego_id")
        .join(ego, [*keys, time], "left")
        .withColumns({"relevance": ego_distance(), "yaw": F.degrees(quaternion_yaw(*quaternion))})
        .drop(*[f"ego_{c}" for c in POSE])
    )


def shared_span(tracks: DataFrame, ego: DataFrame, keys: Sequence[str], time: str = "t_ns") -> DataFrame:
    """Latest start and earliest end of each object and the ego."""
    spans = tracks.groupBy(*keys, "object_id").agg(F.min(time).alias("__s"), F.max(time).alias("__e"))
    own = ego.groupBy(*keys).agg(F.min(time).alias("__es"), F.max(time).alias("__ee"))
    return join_few(spans, own, keys).select(
        *keys, "object_id", F.greatest("__s", "__es").alias("start_ns"), F.least("__e", "__ee").alias("end_ns")
    )


def scenes(tracks: DataFrame, actors: DataFrame, keys: Sequence[str], yaw: Column, time: str = "t_ns") -> DataFrame:
    """One row per recording and time: the ego, and the other objects there with their distance to it.

    What happens at one time then stands in one row, so distances, the ego's heading and the hazard's place need no
    join. A scene holds as many objects as are on the road at once. Write the result: several steps
    read it, and all of them by recording and time.
    """
    marked = join_few(tracks, single_ego(actors, keys), keys, bin=time_bin(time, SLOT_NS))
    own = F.col("object_id") == F.col("ego_id")
    ego = F.max(F.when(own, F.struct(*POSE, yaw.alias("yaw"))))
    objects = F.collect_list(F.when(~own, F.struct("object_id", *POSE)))
    return marked.groupBy(*keys, time).agg(ego.alias("ego"), objects.alias("objects"))


def scene_distance(ego: Column, other: Column) -> Column:
    squares = [(other[c] - ego[c]) * (other[c] - ego[c]) for c in POSE]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def object_summaries(scenes: DataFrame, keys: Sequence[str], time: str = "t_ns") -> DataFrame:
    """One row per object: first time, closest distance to the ego, last row and the ego then; with the ego's first and last time."""
    seen = scenes.select(*keys, time, "ego", F.explode("objects").alias("o"))
    objects = seen.groupBy(*keys, F.col("o.object_id").alias("object_id")).agg(
        F.min(scene_distance(F.col("ego"), F.col("o"))).alias("near"), F.min(time).alias("first_ns"), F.max_by(F.struct(time, "o", "ego"), time).alias("last")
    )
    span = scenes.where(F.col("ego").isNotNull()).groupBy(*keys).agg(F.min(time).alias("ego_start"), F.max(time).alias("ego_end"))
    return join_few(objects, span, keys)


def choose_hazard(summaries: DataFrame, actors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The hazard of each recording: the first pedestrian, else the best-scoring vehicle.

    The score adds start and end mismatch (ns), closest distance (m) and a penalty for an
    unexpected type. The units are mixed on purpose: results must equal the study's.
    """
    score = (
        F.abs(F.col("start_epoch_ns") - F.col("ego_start"))
        + F.abs(F.col("end_epoch_ns") - F.col("ego_end"))
        + F.coalesce("near", F.lit(float("inf")))
        + F.when(F.col("actor_type") == HAZARD_VEHICLE, 0).otherwise(OTHER_TYPE_PENALTY)
    )
    walker = F.col("role") == PEDESTRIAN
    rank = F.struct((~walker).alias("a"), F.when(walker, F.lit(0.0)).otherwise(score).alias("b"), F.col("first_ns"), F.col("object_id"))
    return summaries.drop("last").join(actors, [*keys, "object_id"]).groupBy(*keys).agg(F.min_by("object_id", rank).alias("hazard_id"))


def hazard_tracks(scenes: DataFrame, hazards: DataFrame, keys: Sequence[str], time: str = "t_ns") -> DataFrame:
    """Rows of the chosen objects, out of their scenes."""
    chosen = join_few(scenes, hazards.where("hazard_id IS NOT NULL"), keys, bin=time_bin(time, SLOT_NS))
    return chosen.select(*keys, time, F.explode(F.filter("objects", lambda o: o["object_id"] == F.col("hazard_id"))).alias("o")).select(*keys, time, *[f"o.{c}" for c in POSE])


def removal_stats(
    scenes: DataFrame,
    summaries: DataFrame,
    hazards: DataFrame,
    keys: Sequence[str],
    hazard_rule: Column,
    time: str = "t_ns",
    far: float = FAR_M,
    still: float = STILL_M,
    still_ns: int = STILL_NS,
    near_hazard: float = HAZARD_M,
) -> DataFrame:
    """When, where and why each object left.

    ``hazard_rule`` is true for recordings of the two scenarios whose hazard removes traffic. An object's
    last row and the ego then come from its summary. Where it was ``still_ns`` before, and where the hazard
    is at its last time, are two questions per object to the scenes, asked in one join by recording and time.
    """
    objects = join_few(summaries, hazards, keys, "left")
    last = F.col("last")[time]
    asked = F.array(
        F.struct((last - F.lit(still_ns)).alias("__at"), F.col("object_id").alias("__who"), F.lit(True).alias("__self")),
        F.struct(last.alias("__at"), F.col("hazard_id").alias("__who"), F.lit(False).alias("__self")),
    )
    questions = objects.select(*keys, F.struct("object_id", "first_ns", "last", "ego_end").alias("__object"), F.inline(asked))
    answers = questions.join(scenes.select(*keys, F.col(time).alias("__at"), "objects"), [*keys, "__at"], "left")
    place = F.get(F.filter("objects", lambda o: o["object_id"] == F.col("__who")), F.lit(0))
    told = answers.withColumn("__place", place).groupBy(*keys, F.col("__object.object_id").alias("object_id")).agg(
        F.first("__object").alias("__object"),
        F.max(F.when(F.col("__self"), F.col("__place"))).alias("__before"),
        F.max(F.when(~F.col("__self"), F.col("__place"))).alias("__hazard"),
    )
    now, ego = F.col("__object.last.o"), F.col("__object.last.ego")
    at = F.col("__object.last")[time]
    apart = scene_distance(ego, now)
    heading = F.degrees(F.atan2(now["pose_y"] - ego["pose_y"], now["pose_x"] - ego["pose_x"]))
    direction = clamp_degrees(heading - ego["yaw"])
    cause = (
        F.when(at == F.col("__object.ego_end"), "end")
        .when(apart >= far, "far")
        .when(scene_distance(now, F.col("__before")) <= still, "still")
        .when(hazard_rule & (scene_distance(F.col("__hazard"), now) <= near_hazard), "hazard")
        .when(F.col("__object.first_ns") == 0, "previous")
        .otherwise("unknown")
    )
    return told.select(
        *keys,
        "object_id",
        at.alias("time_ns"),
        apart.alias("distance_from_ego"),
        direction.alias("direction_from_ego_deg"),
        ((apart < SCREEN_M) & direction.between(*SCREEN_DEG)).alias("on_screen"),
        cause.alias("cause"),
    )


def removal_totals(removals: DataFrame, recordings: DataFrame, keys: Sequence[str], seconds: Column) -> tuple[DataFrame, DataFrame]:
    """(count and visible count per cause, overall totals). Visible counts need a noticeable cause."""
    noticed = F.col("on_screen") & F.col("cause").isin("still", "hazard", "unknown")
    per_cause = removals.groupBy("cause").agg(F.count(F.lit(1)).alias("removals"), F.count_if(noticed).alias("visible"))
    per_recording = removals.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r"), F.count_if(noticed).alias("__v"))
    totals = per_recording.join(recordings, list(keys)).agg(
        F.count(F.lit(1)).alias("scenarios"), F.sum("__r").alias("removals"), F.sum(seconds).alias("duration"), F.sum("__v").alias("visible")
    )
    return per_cause, totals


def chunk_relevance(tracks: DataFrame, chunk_keys: Sequence[str], relevance: str = "relevance") -> DataFrame:
    """Smallest relevance of each object within a chunk."""
    return tracks.groupBy(*chunk_keys, "object_id").agg(F.min(relevance).alias("relevance"))


def top_objects(ranked: DataFrame, chunk_keys: Sequence[str], max_objects: int, order: Sequence[Column | str] = ()) -> DataFrame:
    """The first ``max_objects`` objects of each chunk, numbered from 0.

    The fixed limit lets Spark cut every map task's groups before the shuffle, so no
    task ever holds a whole hot group.
    """
    by = list(order) or [F.col("relevance").asc_nulls_last(), F.col("object_id")]
    slot = F.row_number().over(Window.partitionBy(*chunk_keys).orderBy(*by))
    kept = ranked.withColumn("__slot", slot).where(F.col("__slot") <= max_objects)
    return kept.withColumn("object_slot", F.col("__slot") - 1).drop("__slot")


def key_actors(actors: DataFrame, hazard_types: DataFrame, keys: Sequence[str], scenario: str, appeared: str, within: float = 0.01) -> DataFrame:
    """Ego and hazard of each recording with one ego.

    The hazard is the first actor (smallest id) of the scenario's hazard type that
    appeared less than ``within`` seconds after the ego, or earlier. ``hazard_types``
    maps scenario to type and has one row per scenario kind.
    """
    ego = single_ego(actors, keys)
    ego_time = actors.join(ego.withColumnRenamed("ego_id", "object_id"), [*keys, "object_id"]).select(
        *keys, F.col("object_id").alias("ego_id"), F.col(appeared).alias("__ego")
    )
    typed = join_few(actors, hazard_types, [scenario]).where(F.col("actor_type").contains(F.col("hazard_type")))
    timed = join_few(typed.select(*keys, "object_id", appeared), ego_time, keys)
    fitting = timed.where((F.col(appeared) - F.col("__ego")) < within)
    first = fitting.groupBy(*keys).agg(F.min("object_id").alias("hazard_id"))
    return ego_time.join(first, list(keys), "left").drop("__ego")


def trails(tracks: DataFrame, ego: DataFrame, keys: Sequence[str], trail_ns: int, time: str = "t_ns", yaw: str = "yaw_rad") -> DataFrame:
    """Per object and ego time the poses of the last ``trail_ns`` as an array in the ego's frame: ``now_ns``, ``trail``.

    Tracks are grouped once per object and slot of ``trail_ns``, ego times once per slot, and every ego time takes its stretch
    out of the object's list; a track row travels twice, under its own slot and the next, however many trails hold it.
    """
    slot = F.floor(F.col(time) / trail_ns).cast("long")
    listed = tracks.select(*keys, "object_id", F.struct(F.col(time).alias("t"), "pose_x", "pose_y").alias("p"), F.explode(F.array(slot, slot + 1)).alias("__slot"))
    poses = listed.groupBy(*keys, "object_id", "__slot").agg(F.array_sort(F.collect_list("p")).alias("poses"))
    now = F.struct(F.col(time).alias("now_ns"), F.col("pose_x").alias("x"), F.col("pose_y").alias("y"), F.col(yaw).alias("yaw"))
    times = ego.select(*keys, slot.alias("__slot"), now.alias("e")).groupBy(*keys, "__slot").agg(F.collect_list("e").alias("times"))
    met = poses.join(times, [*keys, "__slot"]).select(*keys, "object_id", "poses", F.explode("times").alias("e"))
    own = F.filter("poses", lambda p: p["t"].between(F.col("e.now_ns") - F.lit(trail_ns), F.col("e.now_ns")))

    def seen(p: Column) -> Column:
        right, ahead = rotate(p["pose_x"] - F.col("e.x"), p["pose_y"] - F.col("e.y"), F.col("e.yaw"))
        return F.struct(p["t"].alias(time), right.alias("right"), ahead.alias("ahead"))

    return met.select(*keys, "object_id", F.col("e.now_ns").alias("now_ns"), F.transform(own, seen).alias("trail")).where(F.size("trail") > 0)


def trailing_trajectories(tracks: DataFrame, ego: DataFrame, keys: Sequence[str], trail_ns: int, time: str = "t_ns", yaw: str = "yaw_rad") -> DataFrame:
    """The points of ``trails`` as rows, unfolded last."""
    return trails(tracks, ego, keys, trail_ns, time, yaw).select(*keys, "object_id", "now_ns", F.inline("trail"))
