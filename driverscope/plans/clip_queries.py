"""Frame arithmetic, pooling, collation, answers and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverscope.functions import frames as pixels
from driverscope.functions.geometry import clamp_degrees, logistic, rotate_degrees
from driverscope.functions.text import normalise_text, scenario_short
from driverscope.operators import audio, collate, metrics, models, pooling
from driverscope.operators.index import ground_truth, ground_truth_long, with_conditions
from driverscope.operators.timing import frame_in_chunk
from driverscope.plans import reports
from driverscope.plans.catalogue import query, rounded, table
from driverscope.plans.standins import INDEX_SQL, SIGNAL_SQL, TRACKS_SQL, actors, raw_scenarios, signal, tracks
from driverscope.session import settle

SECOND = 1_000_000_000


@query(
    "depth_from_bytes",
    """WITH d AS (SELECT l_orderkey, l_partkey, l_linenumber, (l_linenumber * 36 * 65536 + l_quantity * 256 + round(l_tax * 100)) / 16777215 * 1000 AS m FROM lineitem)
    SELECT l_partkey, count(*) AS n, round(sum(m), 5) AS depth, round(sum(greatest(0, least(1, 1 + ln(m / 1000) / 5.70378::DOUBLE))), 5) AS log_depth FROM d GROUP BY 1""",
)
def depth_from_bytes(spark, folder):
    rows = table(spark, folder, "lineitem")
    metres = rows.select("l_partkey", pixels.depth_metres(F.col("l_linenumber") * 36, F.col("l_quantity"), F.round(F.col("l_tax") * 100)).alias("m"))
    return metres.groupBy("l_partkey").agg(
        F.count("*").alias("n"), rounded(F.sum("m"), 5).alias("depth"), rounded(F.sum(pixels.log_depth("m")), 5).alias("log_depth")
    )


@query(
    "frame_stretch",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)
    SELECT vec_id, CAST(pos AS INT) AS pos, round((v - lo) / (hi - lo) * 255, 5) AS stretched, round(greatest(-20, least(20, v * 100)) / 20, 6) AS flow,
      round((v * 255 / 255 - 0.456) / 0.224, 5) AS standardised FROM e""",
)
def frame_stretch(spark, folder):
    e = table(spark, folder, "embeddings").withColumn("p", F.col("embedding").cast("array<double>"))
    e = e.select(
        "vec_id",
        pixels.min_max_255("p").alias("a"),
        pixels.scale_flow(F.transform("p", lambda v: v * 100)).alias("b"),
        pixels.standardise_channel(F.transform("p", lambda v: v * 255), 1).alias("c"),
    )
    cells = e.select("vec_id", F.posexplode(F.arrays_zip("a", "b", "c")).alias("pos", "z"))
    return cells.select(
        "vec_id", "pos", rounded(F.col("z.a"), 5).alias("stretched"), rounded(F.col("z.b")).alias("flow"), rounded(F.col("z.c"), 5).alias("standardised")
    )


_CLASSES = ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, n, r, g, b in pixels.SEGMENTATION_CLASSES)


@query(
    "segmentation_classes",
    f"""WITH c(class_id, class_name, red, green, blue) AS (VALUES {_CLASSES})
    SELECT l_partkey % 32 AS class, class_name, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue, count(*) AS n
    FROM lineitem LEFT JOIN c ON class_id = l_partkey % 32 GROUP BY 1, 2, 3, 4, 5""",
)
def segmentation_classes(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_partkey") % 32).alias("class"))
    return pixels.with_segmentation_class(rows, "class").groupBy("class", "class_name", "red", "green", "blue").agg(F.count("*").alias("n"))


@query(
    "segmentation_masks",
    """WITH m AS (SELECT l_orderkey, l_partkey, (l_partkey * 7919 + l_orderkey * 104729) % 33554432 * (l_linenumber % 7) AS mask FROM lineitem),
    s AS (SELECT mask, CASE WHEN mask = 0 THEN -1 ELSE length(bin(mask)) - 1 END AS highest,
      CASE WHEN mask & 524288 <> 0 THEN 19 WHEN mask & 262144 <> 0 THEN 18 WHEN mask & 131072 <> 0 THEN 17 WHEN mask & 65536 <> 0 THEN 16 WHEN mask & 32768 <> 0 THEN 15
           WHEN mask & 16384 <> 0 THEN 14 WHEN mask & 8192 <> 0 THEN 13 WHEN mask & 4096 <> 0 THEN 12 WHEN mask & 16777216 <> 0 THEN 24 WHEN mask & 2 <> 0 THEN 1
           WHEN mask & 4 <> 0 THEN 2 WHEN mask = 0 THEN -1 ELSE length(bin(mask)) - 1 END AS salient,
      mask & 1044480 <> 0 AS is_agent, mask & 2 <> 0 AS is_road, mask & 16777216 <> 0 AS is_lane_marking, mask & 384 <> 0 AS is_sign FROM m)
    SELECT CAST(highest AS INT) AS highest, CAST(salient AS INT) AS salient, is_agent, is_road, is_lane_marking, is_sign, count(*) AS n FROM s GROUP BY ALL""",
)
def segmentation_masks(spark, folder):
    mask = (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729) % 33554432 * (F.col("l_linenumber") % 7)
    rows = table(spark, folder, "lineitem").select(mask.alias("mask"))
    flags = pixels.class_groups("mask")
    return rows.groupBy(
        pixels.highest_bit("mask").alias("highest"), pixels.most_salient("mask").alias("salient"), *[c.alias(n) for n, c in flags.items()]
    ).agg(F.count("*").alias("n"))


@query(
    "angles_and_logits",
    """SELECT vec_id, round(embedding[1]::DOUBLE * cos(radians(embedding[3] * 900::DOUBLE)) + embedding[2]::DOUBLE * sin(radians(embedding[3] * 900::DOUBLE)), 6) AS rx,
      round(embedding[2]::DOUBLE * cos(radians(embedding[3] * 900::DOUBLE)) - embedding[1]::DOUBLE * sin(radians(embedding[3] * 900::DOUBLE)), 6) AS ry,
      round(embedding[4] * 9000::DOUBLE + 180 - 360 * floor((embedding[4] * 9000::DOUBLE + 180) / 360) - 180, 5) AS clamped,
      round(1 / (1 + exp(-embedding[5]::DOUBLE * 10)), 6) AS prob FROM embeddings""",
)
def angles_and_logits(spark, folder):
    v = [F.col("embedding")[i].cast("double") for i in range(5)]
    x, y = rotate_degrees(v[0], v[1], v[2] * 900)
    return table(spark, folder, "embeddings").select(
        "vec_id", rounded(x).alias("rx"), rounded(y).alias("ry"), rounded(clamp_degrees(v[3] * 9000), 5).alias("clamped"), rounded(logistic(v[4] * 10)).alias("prob")
    )


@query(
    "clip_top_scores",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS r FROM e)
    SELECT vec_id, round(avg(v) FILTER (r <= 6), 6) AS top_mean, round((max(pos) FILTER (r <= 6) - min(pos) FILTER (r <= 6)) / 5.0::DOUBLE, 6) AS top_gap,
      round(stddev_samp(v), 6) AS spread FROM r GROUP BY 1""",
)
def clip_top_scores(spark, folder):
    s = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(
        "vec_id", rounded(pooling.top_mean(s)).alias("top_mean"), rounded(pooling.top_gap(s)).alias("top_gap"), rounded(pooling.spread(s)).alias("spread")
    )


@query(
    "clip_mean_pooling",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
    SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 6) AS value FROM e GROUP BY 1, 2""",
)
def clip_mean_pooling(spark, folder):
    pooled = pooling.mean_pooling(table(spark, folder, "embeddings"), ["label"], "embedding", 64)
    return pooled.select("label", F.posexplode("embedding").alias("pos", "value")).withColumn("value", rounded("value"))


@query(
    "clip_attention_pooling",
    """WITH s AS (SELECT label, vec_id, embedding, embedding[1]::DOUBLE * 10 AS score FROM embeddings),
    w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY label)) AS w FROM s),
    a AS (SELECT *, w / sum(w) OVER (PARTITION BY label) AS a FROM w),
    h AS (SELECT label, -sum(a * ln(a + 1e-8)) AS entropy FROM a GROUP BY 1),
    e AS (SELECT label, a, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM a)
    SELECT e.label, CAST(pos AS INT) AS pos, round(sum(a * v), 6) AS value, round(any_value(entropy), 6) AS attention_entropy FROM e JOIN h ON e.label = h.label GROUP BY 1, 2""",
)
def clip_attention_pooling(spark, folder):
    frames = table(spark, folder, "embeddings").withColumn("score", F.col("embedding")[0].cast("double") * 10)
    pooled = pooling.attention_pooling(pooling.attention_weights(frames, ["label"]), ["label"], "embedding", 64)
    cells = pooled.select("label", "attention_entropy", F.posexplode("embedding").alias("pos", "value"))
    return cells.select("label", "pos", rounded("value").alias("value"), rounded("attention_entropy").alias("attention_entropy"))


CHUNK = ["recording", "chunk"]
CHUNKED_SQL = f"""{TRACKS_SQL},
c AS (SELECT *, t_ns // 12000000000 AS chunk, CAST(t_ns // 1000000000 % 12 AS INT) AS frame FROM tracks),
ids AS (SELECT DISTINCT recording, chunk FROM c)
"""


def chunked(spark, folder):
    return tracks(spark, folder).withColumns(
        {"chunk": F.expr("t_ns div 12000000000"), "frame": F.expr("int(t_ns div 1000000000 % 12)"), "speed": F.when(F.col("pose_z") > 2, F.col("pose_x"))}
    )


@query(
    "collate_table",
    f"""WITH {CHUNKED_SQL}, g AS (SELECT recording, chunk, CAST(f AS INT) AS frame FROM ids, (SELECT unnest(range(12)) AS f)),
    e AS (SELECT * FROM c WHERE object_id = 2), k AS (SELECT DISTINCT recording, chunk FROM e)
    SELECT g.recording, g.chunk, g.frame, coalesce(pose_x, 0) AS x, CASE WHEN pose_z > 2 THEN pose_x ELSE 0 END AS speed,
      CAST(pose_x IS NOT NULL AS INT) AS x_valid, CAST(coalesce(pose_z > 2, false) AS INT) AS speed_valid, CAST(k.recording IS NOT NULL AS INT) AS file_valid
    FROM g LEFT JOIN e ON g.recording = e.recording AND g.chunk = e.chunk AND g.frame = e.frame LEFT JOIN k ON k.recording = g.recording AND k.chunk = g.chunk""",
)
def collate_table(spark, folder):
    rows = chunked(spark, folder)
    out = collate.collate_table(rows.where("object_id = 2"), rows.select(*CHUNK).distinct(), CHUNK, ["pose_x", "speed"], 12)
    cells = out.select(*CHUNK, "file_valid", F.posexplode(F.arrays_zip("table", "table_valid")).alias("frame", "z"))
    t, v = F.col("z.table"), F.col("z.table_valid")
    return cells.select(*CHUNK, "frame", t[0].alias("x"), t[1].alias("speed"), v[0].alias("x_valid"), v[1].alias("speed_valid"), "file_valid")


@query(
    "collate_tracks",
    f"""WITH {CHUNKED_SQL}, o AS (SELECT recording, chunk, object_id, row_number() OVER (PARTITION BY recording, chunk ORDER BY min(pose_y), object_id) - 1 AS slot
      FROM c GROUP BY 1, 2, 3 QUALIFY slot < 4),
    g AS (SELECT recording, chunk, CAST(s AS INT) AS slot, CAST(f AS INT) AS frame FROM ids, (SELECT unnest(range(4)) AS s), (SELECT unnest(range(12)) AS f))
    SELECT g.recording, g.chunk, g.slot, g.frame, coalesce(o.object_id, 0) AS object_id, coalesce(pose_x, 0) AS x, CASE WHEN pose_z > 2 THEN pose_x ELSE 0 END AS speed,
      CAST(coalesce(pose_z > 2, false) AS INT) AS valid FROM g LEFT JOIN o ON g.recording = o.recording AND g.chunk = o.chunk AND g.slot = o.slot
    LEFT JOIN c ON c.recording = o.recording AND c.chunk = o.chunk AND c.object_id = o.object_id AND c.frame = g.frame""",
)
def collate_tracks(spark, folder):
    rows = chunked(spark, folder)
    out = collate.collate_tracks(rows, rows.select(*CHUNK).distinct(), CHUNK, ["pose_x", "speed"], 12, 4, relevance="pose_y")
    slots = out.select(*CHUNK, F.posexplode(F.arrays_zip("object_id", "tracks", "tracks_valid")).alias("slot", "o"))
    cells = slots.select(*CHUNK, "slot", F.col("o.object_id").alias("object_id"), F.posexplode(F.arrays_zip(F.col("o.tracks").alias("t"), F.col("o.tracks_valid").alias("v"))).alias("frame", "z"))
    return cells.select(*CHUNK, "slot", "frame", "object_id", F.col("z.t")[0].alias("x"), F.col("z.t")[1].alias("speed"), F.col("z.v").alias("valid"))


@query(
    "collate_attributes",
    f"""WITH {TRACKS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY object_id) - 1 AS slot FROM actors),
    g AS (SELECT DISTINCT recording, CAST(s AS INT) AS slot FROM actors, (SELECT unnest(range(5)) AS s))
    SELECT g.recording, g.slot, coalesce(object_id, 0) AS object_id, coalesce(role, '') AS role, coalesce(actor_type, '') AS actor_type, CAST(object_id IS NOT NULL AS INT) AS valid
    FROM g LEFT JOIN o ON g.recording = o.recording AND g.slot = o.slot""",
)
def collate_attributes(spark, folder):
    few = actors(tracks(spark, folder))
    out = collate.collate_attributes(few, few.select("recording").distinct(), ["recording"], ["role", "actor_type"], 5)
    cells = out.select("recording", F.posexplode(F.arrays_zip("object_id", "attributes", "attributes_valid")).alias("slot", "z"))
    a = F.col("z.attributes")
    return cells.select("recording", "slot", F.col("z.object_id").alias("object_id"), a[0].alias("role"), a[1].alias("actor_type"), F.col("z.attributes_valid").alias("valid"))


@query(
    "collate_aggregates",
    """WITH p AS (SELECT l_orderkey, avg(l_quantity) AS a, max(l_discount) AS b FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
    SELECT o_orderkey, round(coalesce(a, 0), 6) AS a, coalesce(b, 0) AS b, CAST(a IS NOT NULL AS INT) AS a_valid, CAST(b IS NOT NULL AS INT) AS b_valid
    FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""",
)
def collate_aggregates(spark, folder):
    lines = table(spark, folder, "lineitem").where("l_returnflag <> 'A'")
    found = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("a"), F.max("l_discount").alias("b"), F.min("l_tax").alias("c"))
    out = collate.collate_aggregates(found, table(spark, folder, "orders"), ["o_orderkey"], ["a", "c", "b"], ignore=["c"])
    x, v = F.col("aggregate"), F.col("aggregate_valid")
    return out.select("o_orderkey", rounded(x[0]).alias("a"), x[1].alias("b"), v[0].alias("a_valid"), v[1].alias("b_valid"))


@query(
    "collate_arrays",
    """SELECT e.event_id, round(coalesce(embedding[1]::DOUBLE, -1), 6) AS first, round(coalesce(embedding[64]::DOUBLE, -1), 6) AS last, CAST(embedding IS NOT NULL AS INT) AS valid
    FROM events e LEFT JOIN embeddings v ON v.vec_id = e.user_id""",
)
def collate_arrays(spark, folder):
    arrays = table(spark, folder, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding")
    value, valid = collate.collate_array("embedding", 64, default=-1.0)
    out = table(spark, folder, "events").join(arrays, "user_id", "left").select("event_id", value.alias("v"), valid.alias("valid"))
    return out.select("event_id", rounded(F.col("v")[0]).alias("first"), rounded(F.col("v")[63]).alias("last"), "valid")


@query(
    "frame_in_chunk",
    f"WITH {CHUNKED_SQL} SELECT recording, object_id, t_ns, frame - min(frame) OVER (PARTITION BY recording, chunk) AS frame_in_chunk FROM c",
)
def frame_numbers(spark, folder):
    return frame_in_chunk(chunked(spark, folder), CHUNK).select("recording", "object_id", "t_ns", "frame_in_chunk")


# A user's turn is what was expected, the assistant's next turn the answer.
PAIRS_SQL = """
pairs AS (SELECT u.conv_id, u.turn, u.text AS gt, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""


def answer_pairs(spark, folder):
    c = table(spark, folder, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("gt"))
    given = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(given, ["conv_id", "turn"])


NORMAL_SQL = r"trim(regexp_replace(regexp_replace(lower({0}), '[.,!?]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(
    "text_normalised",
    f"SELECT doc_id, md5({NORMAL_SQL.format('text')}) AS digest, length({NORMAL_SQL.format('text')}) AS chars FROM documents",
)
def text_normalised(spark, folder):
    t = normalise_text("text")
    return table(spark, folder, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("chars"))


@query(
    "answers_statement",
    f"""WITH {PAIRS_SQL}, n AS (SELECT conv_id, turn, list_transform(string_split({NORMAL_SQL.format('gt')}, ' '), lambda w: CASE WHEN w = 'now' THEN 'no' ELSE w END) AS g,
        list_transform(string_split({NORMAL_SQL.format('answer')}, ' '), lambda w: CASE WHEN w = 'now' THEN 'no' ELSE w END) AS a FROM pairs),
    s AS (SELECT conv_id, turn, regexp_split_to_array(array_to_string(g, ' '), '[ -]') AS g, regexp_split_to_array(array_to_string(a, ' '), '[ -]') AS a FROM n),
    w AS (SELECT conv_id, turn, unnest(g) AS w, generate_subscripts(g, 1) AS i, a FROM s),
    k AS (SELECT conv_id, turn, i, regexp_replace(w, '[^a-z]', '_', 'g') AS w, list_transform(a, lambda h: regexp_replace(h, '[^a-z]', '_', 'g')) AS a FROM w),
    b AS (SELECT conv_id, turn, i, list_max(list_transform(a, lambda h: CASE WHEN greatest(length(w), length(h)) = 0 THEN 1 ELSE 1 - levenshtein(w, h)::DOUBLE / greatest(length(w), length(h)) END)) AS best FROM k)
    SELECT conv_id, turn, round(avg(best), 6) AS score FROM b GROUP BY 1, 2""",
)
def answers_statement(spark, folder):
    """Compares plain letters, so that SQL (whose edit distance counts bytes) can follow; the default key is the word's sound."""
    scored = audio.score_answers(answer_pairs(spark, folder), "statement_task", key=lambda w: F.regexp_replace(w, "[^a-z]", "_"))
    return scored.select("conv_id", "turn", rounded("score").alias("score"))


@query("answers_statement_by_sound")
def answers_statement_by_sound(spark, folder):
    return audio.score_answers(answer_pairs(spark, folder), "statement_task").select("conv_id", "turn", rounded("score").alias("score"))



def _nback_sql() -> str:
    from driverscope.functions.text import MISHEARD_NBACK

    heard = "MAP {" + ", ".join(f"'{w}': '{d}'" for d, ws in MISHEARD_NBACK.items() for w in ws) + "}"
    return f"""WITH d AS (SELECT event_id, props, event_type, list_extract(['four', 'True,', 'seven', '3', 'Nine!', 'x'], CAST(event_id % 6 + 1 AS INT)) || ' ' ||
        list_extract(['or not', 'well-2', 'a', 'six'], CAST(user_id % 4 + 1 AS INT)) AS answer, CAST(event_id % 10 AS VARCHAR) AS gt FROM events),
      n AS (SELECT event_id, gt, list_transform(string_split({NORMAL_SQL.format('answer')}, ' '), lambda w: coalesce({heard}[w], w)) AS words FROM d)
    SELECT event_id, array_to_string(words, ' ') AS heard, CAST(list_contains(regexp_split_to_array(array_to_string(words, ' '), '[ -]'), gt) AS INT)::DOUBLE AS score FROM n"""


@query("answers_nback", _nback_sql())
def answers_nback(spark, folder):
    first = F.get(F.array(*[F.lit(w) for w in ("four", "True,", "seven", "3", "Nine!", "x")]), (F.col("event_id") % 6).cast("int"))
    second = F.get(F.array(*[F.lit(w) for w in ("or not", "well-2", "a", "six")]), (F.col("user_id") % 4).cast("int"))
    rows = table(spark, folder, "events").select(
        "event_id", F.concat(first, F.lit(" "), second).alias("answer"), (F.col("event_id") % 10).cast("string").alias("gt")
    )
    return audio.score_answers(rows, "nback_task").select("event_id", F.col("normalised_answer").alias("heard"), "score")


SOUND_SQL = f"""{SIGNAL_SQL},
steps AS (SELECT user_id, t_ns // 5000000000 AS step, bool_or(coalesce(abs(y) >= 30, false)) AS loud FROM signal GROUP BY 1, 2),
marks AS (SELECT *, lag(loud) OVER w AS was, min(CASE WHEN NOT loud THEN step END) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closing
  FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY step)),
segments AS (SELECT user_id, step * 5000000000 AS s, (closing + 1) * 5000000000 AS e FROM marks WHERE loud AND NOT coalesce(was, false) AND closing IS NOT NULL)
"""


def sounds(spark, folder):
    rows = signal(spark, folder).withColumn("level", F.coalesce(F.col("y"), F.lit(0.0)))
    return audio.sounding_segments(rows, ["user_id"], "t_ns", "level", 5 * SECOND, slot_steps=12, silence=30.0)


@query("sounding_segments", f'WITH {SOUND_SQL} SELECT user_id, s AS "start", e AS "end" FROM segments')
def sounding_segments(spark, folder):
    return sounds(spark, folder)


@query(
    "sounding_answered",
    f"""WITH {SOUND_SQL}, r AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS r FROM segments)
    SELECT user_id, count(*) AS n, coalesce(bool_or(s > 20000000000) FILTER (r <= 2), false) AS answered FROM r GROUP BY 1""",
)
def sounding_answered(spark, folder):
    """Seconds are scaled so that 0.7 s stands for 20 s of the stand-in."""
    return audio.windows_answered(sounds(spark, folder), ["user_id"], 20 * SECOND / 0.7).withColumnRenamed("segments", "n")


@query(
    "response_windows",
    f"""WITH {SIGNAL_SQL}, q AS (SELECT user_id, event_id AS asked, t_ns / 1e9::DOUBLE + 7.208::DOUBLE - 5 + 2.5 AS s, t_ns / 1e9::DOUBLE + 7.208::DOUBLE - 5 + 5 AS e
      FROM signal WHERE event_type = 'signup'),
    w AS (SELECT user_id, asked, CAST(round((s + 0.1) * 1000) AS BIGINT) * 1000000 AS a, CAST(round((e + 0.1) * 1000) AS BIGINT) * 1000000 AS b FROM q)
    SELECT asked, event_id, t_ns - a AS "offset" FROM signal x JOIN w ON x.user_id = w.user_id AND t_ns >= a AND t_ns < b""",
)
def response_windows(spark, folder):
    rows = signal(spark, folder)
    asked = rows.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("asked"), (F.col("t_ns") / 1e9).alias("startime"), F.lit(1).alias("digit"))

    def ns(column: str):
        return F.round((F.col(column) + audio.PAD_S) * 1000).cast("long") * 1_000_000

    windows = audio.nback_schedule(asked).select("user_id", "asked", ns("start_response").alias("start"), ns("end_response").alias("end"))
    inside = audio.samples_in_windows(rows, windows, ["user_id"], "t_ns", 3 * SECOND)
    return inside.select("asked", "event_id", "offset")


@query(
    "scenario_short_names",
    f"""WITH {INDEX_SQL} SELECT scenario_name, CASE WHEN scenario_name LIKE '%driving%' THEN regexp_extract(scenario_name, '^[^/]*/([^-/]*)', 1) END AS short, count(*) AS n
    FROM scenarios GROUP BY 1, 2""",
)
def scenario_short_names(spark, folder):
    return raw_scenarios(spark, folder).groupBy("scenario_name", scenario_short("scenario_name").alias("short")).agg(F.count("*").alias("n"))


FEATURES = ["mean_quantity", "spread_quantity", "mean_discount", "late_lines", "parts"]


ALL_TASKS = ["cd", "nback", "statement", "intoxicated", "impaired", "impaired_intoxicated", "sober_cd"]
#: Line items whose aggregates one task holds.
TASK_LINES = 500_000


def model_rows(spark, folder, tasks=("cd", "sober_cd")):
    """Aggregates per scenario, the tasks' labels, participant-disjoint folds.

    The line items are dealt by scenario first, to as many tasks as their number asks for: distinct parts need no
    map of scenarios and parts in front of the shuffle, and no task's map grows with the table.
    """
    lines = table(spark, folder, "lineitem")
    tasks_of_lines = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // TASK_LINES + 1)
    lines = lines.repartition(tasks_of_lines, "l_orderkey").groupBy(F.col("l_orderkey").alias("scenario_index")).agg(
        F.avg("l_quantity").alias("mean_quantity"),
        F.stddev_pop("l_quantity").alias("spread_quantity"),
        F.avg("l_discount").alias("mean_discount"),
        F.count_if(F.col("l_returnflag") == "R").alias("late_lines"),
        F.when(F.count("*") > 1, F.countDistinct("l_partkey")).alias("parts"),
    )
    index = with_conditions(raw_scenarios(spark, folder))
    gt = {f"gt_{t}": c for t, c in ground_truth(tasks).items()}
    return index.withColumns(gt).join(lines, "scenario_index").select("scenario_index", "participant_name", "fold", *gt, *FEATURES)


TASKS = {"cd": "gt_cd", "sober_cd": "gt_sober_cd"}


def _model(name: str, **options):
    def run(spark, folder):
        rows = settle(model_rows(spark, folder))
        train, test = rows.where("fold <> 0"), rows.where("fold = 0")
        fitted = models.fit_tasks(train, FEATURES, TASKS, name, ["scenario_index"], **options)
        scored = settle(models.score_tasks(test, fitted, FEATURES, TASKS, name, ["scenario_index", "fold"]))
        counts = metrics.confusion(scored, ["task"]).select("task", "tp", "tn", "fp", "fn", "uar")
        return counts.join(metrics.roc_auc(scored, ["task"]).select("task", "auc"), "task")

    run.__doc__ = f"{name} per task: counts, UAR and AUC on the test fold."
    return run


query("model_logistic")(_model("LogisticRegression", maxIter=30))
query("model_random_forest")(_model("RandomForest", numTrees=20))
query("model_gradient_boosting")(_model("GradientBoosting", maxIter=10))
query("model_svm")(_model("SVM", maxIter=20))
query("model_shallow_net")(_model("ShallowNet", maxIter=20))


@query(
    "logistic_optimum",
    f"""WITH {INDEX_SQL}, used AS (SELECT * FROM scenarios WHERE scenario_index IN (SELECT l_orderkey FROM lineitem)),
    g AS (SELECT cognitive_task <> 'no_task' AS cd, cognitive_task = 'nback_task' AS nback, cognitive_task = 'statement_task' AS statement, intoxicated AS i FROM used),
    t AS (SELECT unnest([{{'task': 'cd', 'gt': cd::INT}}, {{'task': 'nback', 'gt': nback::INT}}, {{'task': 'statement', 'gt': statement::INT}}, {{'task': 'intoxicated', 'gt': i::INT}},
      {{'task': 'impaired', 'gt': (cd OR i)::INT}}, {{'task': 'impaired_intoxicated', 'gt': CASE WHEN cd OR i THEN i::INT ELSE -1 END}}, {{'task': 'sober_cd', 'gt': CASE WHEN i THEN -1 ELSE cd::INT END}}]) AS t FROM g),
    n AS (SELECT t.task AS task, count(*) FILTER (t.gt <> -1) AS rows FROM t GROUP BY 1)
    SELECT task, input, rows, true AS is_optimum FROM n CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in (*FEATURES, 'intercept'))}) f(input)""",
)
def logistic_optimum(spark, folder):
    """All seven tasks fitted; at an optimum of the weighted log loss the slope in every coefficient is 0."""
    tasks = {t: f"gt_{t}" for t in ALL_TASKS}
    rows = settle(model_rows(spark, folder, ALL_TASKS))
    fitted = models.fit_tasks(rows, FEATURES, tasks, "LogisticRegression", ["scenario_index"], maxIter=100, tol=1e-8)
    slopes = models.log_loss_gradient(rows, fitted, FEATURES, tasks)
    return slopes.select("task", "input", "rows", (F.abs("slope") < 1e-4).alias("is_optimum"))


@query(
    "class_weights_of_all_tasks",
    f"""WITH {INDEX_SQL}, g AS (SELECT cognitive_task <> 'no_task' AS cd, cognitive_task = 'nback_task' AS nback, cognitive_task = 'statement_task' AS statement, intoxicated AS i FROM scenarios),
    t AS (SELECT unnest([{{'task': 'cd', 'gt': cd::INT}}, {{'task': 'nback', 'gt': nback::INT}}, {{'task': 'statement', 'gt': statement::INT}}, {{'task': 'intoxicated', 'gt': i::INT}},
      {{'task': 'impaired', 'gt': (cd OR i)::INT}}, {{'task': 'impaired_intoxicated', 'gt': CASE WHEN cd OR i THEN i::INT ELSE -1 END}}, {{'task': 'sober_cd', 'gt': CASE WHEN i THEN -1 ELSE cd::INT END}}]) AS t FROM g)
    SELECT t.task AS task, count(*) FILTER (t.gt <> -1) AS valid, count(*) FILTER (t.gt = 1) AS positive, round(count(*) FILTER (t.gt <> -1)::DOUBLE / count(*) FILTER (t.gt = 1) - 1, 6) AS pos_weight FROM t GROUP BY 1""",
)
def class_weights_of_all_tasks(spark, folder):
    long = ground_truth_long(with_conditions(raw_scenarios(spark, folder)), ["scenario_index"], ALL_TASKS)
    return reports.class_weights(long).withColumn("pos_weight", rounded("pos_weight"))
