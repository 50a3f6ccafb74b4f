"""Registered queries of media plans: encoder arguments, selections after edits, side-by-side collages, regions of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import encoder_plan as E
from docloom.functions import layout as L
from docloom.operators.catalogue import query
from docloom.operators.plan_queries import _images, _images_sql
from docloom.operators.text_queries import table

_clips_sql = """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 3 AS k, l_suppkey % 3 AS m, l_linenumber % 4 AS q, printf('%.3f', CAST(l_linenumber AS DOUBLE)) AS ss, printf('%.3f', greatest(0.05, l_quantity - l_linenumber)) AS tt, l_partkey || '.mov' AS i FROM lineitem),
s AS (SELECT *, ['libx264', 'libx265', 'libvpx-vp9'][k + 1] AS codec, CASE WHEN k = 2 THEN 'webm' ELSE 'mp4' END AS box, ['0', '2.5M', 'copy'][m + 1] AS rate FROM c),
a AS (SELECT *, CASE q WHEN 0 THEN ['-an'] WHEN 1 THEN ['-map', '0:a:0?', '-c:a', 'copy'] ELSE ['-map', '0:a:0?', '-c:a', CASE box WHEN 'webm' THEN 'libopus' ELSE 'aac' END, '-b:a', '128k'] || CASE WHEN q = 2 THEN ['-ar', CASE box WHEN 'webm' THEN '48000' ELSE '44100' END] ELSE [] END END AS sound,
 array_to_string(CASE q WHEN 0 THEN [] WHEN 1 THEN ['crop=min(iw\\,ih*1280/720):min(ih\\,iw*720/1280),scale=1280:720:flags=lanczos,setsar=1'] WHEN 2 THEN ['crop=min(iw\\,ih*720/720):min(ih\\,iw*720/720),scale=720:720:flags=lanczos,setsar=1'] ELSE ['scale=w=''if(lte(iw\\,ih)\\,min(iw\\,720)\\,-2)'':h=''if(gt(iw\\,ih)\\,min(ih\\,720)\\,-2)'':flags=lanczos'] END || CASE l_partkey % 4 WHEN 1 THEN ['transpose=1'] WHEN 2 THEN ['hflip', 'vflip'] WHEN 3 THEN ['transpose=2'] ELSE [] END || CASE WHEN l_partkey % 2 = 0 THEN ['hflip'] ELSE [] END, ',') AS vf FROM s)"""


@query("encoder_arguments", _clips_sql + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(['-ss', ss, '-i', i, '-t', tt, '-map', '0:v:0'] || CASE WHEN rate = 'copy' THEN ['-c:v', 'copy'] || sound || ['-avoid_negative_ts', 'make_zero'] ELSE
 CASE WHEN vf <> '' THEN ['-vf', vf] ELSE [] END || ['-c:v', codec] || CASE WHEN k = 2 THEN ['-b:v', rate, '-crf', '23', '-row-mt', '1'] WHEN rate = '0' THEN ['-preset', 'veryfast', '-crf', '23'] ELSE ['-preset', 'veryfast', '-b:v', rate, '-maxrate', rate, '-bufsize', '5M'] END || ['-threads', '4'] || CASE WHEN k = 1 THEN ['-tag:v', 'hvc1'] ELSE [] END || sound END
 || CASE WHEN box = 'mp4' AND q <> 3 THEN ['-movflags', '+faststart'] ELSE [] END || ['out.' || box], ' ') AS arguments FROM a""")
def encoder_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder arguments of every clip: codecs, bitrates, sound, sizes and turns by its columns."""
    k, m, q, p = F.col("l_partkey") % 3, F.col("l_suppkey") % 3, F.col("l_linenumber") % 4, F.col("l_partkey")
    pick = lambda n, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (n + 1).cast("int"))
    box = F.when(k == 2, "webm").otherwise("mp4")
    c = {
        "start": F.col("l_linenumber").cast("double"), "end": F.col("l_quantity"), "input": F.concat(p.cast("string"), F.lit(".mov")), "output": F.concat(F.lit("out."), box), "container": box,
        "codec": pick(k, "h264", "hevc", "vp9"), "bitrate": pick(m, "0", "2.5M", "copy"), "crf": F.lit(23), "bytes": F.when(q == 3, E.FRONT_BYTES).otherwise(1), "audio_mode": pick(q, "remove", "copy", "encode", "encode"), "audio_bitrate": F.lit("128k"),
        "audio_rate": F.when(q == 2, 45_000), "aspect": pick(q, "source", "16:9", "1:1", "source"), "resolution": pick(q, "source", "720", "720", "720"), "rotation": p % 4 * 90, "flipped": p % 2 == 0,
    }
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(E.encode(c), " ").alias("arguments"))


@query("extract_arguments", r"""SELECT event_id, array_to_string(['-ss', printf('%.3f', CAST(event_id % 60 AS DOUBLE)), '-i', user_id || '.mp4', '-t', '2.500'] || CASE WHEN event_id % 3 = 0 THEN ['-filter_complex', 'fps=12,scale=min(' || 100 + event_id % 400 || '\,iw):-2:flags=lanczos,split[s0][s1];[s0]palettegen=max_colors=192[p];[s1][p]paletteuse=dither=sierra2_4a', '-loop', '0', 'o.gif']
 ELSE ['-map', '0:a:0', '-vn', '-c:a', CASE WHEN event_id % 3 = 1 THEN 'libmp3lame' ELSE 'aac' END, '-b:a', '192k'] || CASE event_id % 4 WHEN 0 THEN [] ELSE ['-ar', CASE WHEN event_id % 3 = 1 THEN ['22050', '44100', '48000'] ELSE ['22050', '44100', '96000'] END[event_id % 4]] END || [CASE WHEN event_id % 3 = 1 THEN 'o.mp3' ELSE 'o.m4a' END] END, ' ') AS arguments FROM events""")
def extract_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments for animations and for sound alone."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    mp3 = i % 3 == 1
    rate = F.when(i % 4 > 0, F.element_at(F.array(F.lit(22_000), F.lit(44_100), F.lit(96_000)), F.greatest(F.lit(1), i % 4).cast("int")))
    rate = F.when(mp3 & (i % 4 == 1), 22_050).otherwise(rate)
    c = {"start": (i % 60).cast("double"), "end": i % 60 + 2.5, "input": F.concat("user_id", F.lit(".mp4")), "output": F.when(i % 3 == 0, "o.gif").when(mp3, "o.mp3").otherwise("o.m4a"), "fps": F.lit(12), "width": 100 + i % 400, "format": F.when(mp3, "mp3").otherwise("aac"), "audio_bitrate": F.lit("192k"), "audio_rate": rate}
    return e.select("event_id", F.array_join(F.when(i % 3 == 0, E.animation(c)).otherwise(E.audio(c)), " ").alias("arguments"))


#: The shortest selection in seconds, and the commands that leave a clip's length as it is.
SHORTEST = 0.01
IN_PLACE = ("MUTE", "FADE_IN", "FADE_OUT", "GAIN", "NORMALIZE")


@query("selection_after_edit", """WITH e AS (SELECT event_id, ['MUTE', 'FADE_IN', 'FADE_OUT', 'GAIN', 'NORMALIZE', 'TRIM', 'PASTE', 'CUT', 'DELETE', 'COPY'][event_id % 10 + 1] AS command, user_id % 40 / 10.0::DOUBLE AS a, user_id % 40 / 10.0::DOUBLE + event_id % 13 / 5.0::DOUBLE AS b, CASE event_id % 17 WHEN 0 THEN 0.005::DOUBLE ELSE event_id % 17 / 3.0::DOUBLE END AS d, event_id % 7 = 3 AS none FROM events),
w AS (SELECT *, CASE WHEN command IN ('MUTE', 'FADE_IN', 'FADE_OUT', 'GAIN', 'NORMALIZE') THEN a WHEN command = 'PASTE' THEN 1.5::DOUBLE ELSE least(CASE WHEN none THEN 0::DOUBLE ELSE a END, greatest(0::DOUBLE, d - 0.01::DOUBLE)) END AS x, CASE WHEN command IN ('MUTE', 'FADE_IN', 'FADE_OUT', 'GAIN', 'NORMALIZE') THEN b WHEN command = 'PASTE' THEN 1.5::DOUBLE + 0.75::DOUBLE END AS y FROM e),
z AS (SELECT *, coalesce(y, least(d, x + 1)) AS y2, d < 0.01 OR none AND command IN ('MUTE', 'FADE_IN', 'FADE_OUT', 'GAIN', 'NORMALIZE') AS gone FROM w),
s AS (SELECT *, greatest(0::DOUBLE, least(x, d - 0.01::DOUBLE)) AS s FROM z)
SELECT event_id, round(CASE WHEN gone THEN NULL WHEN command = 'TRIM' THEN 0 ELSE s END, 9) AS start, round(CASE WHEN gone THEN NULL WHEN command = 'TRIM' THEN d ELSE greatest(s + 0.01::DOUBLE, least(y2, d)) END, 9) AS until FROM s""")
def selection_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is selected after a command: the same, all after a trim, what was pasted, else a second from the old start."""
    i = F.col("event_id")
    commands = (*IN_PLACE, "TRIM", "PASTE", "CUT", "DELETE", "COPY")
    command = F.element_at(F.array(*[F.lit(c) for c in commands]), (i % 10 + 1).cast("int"))
    a = F.col("user_id") % 40 / 10.0
    none = i % 7 == 3
    length = F.when(i % 17 == 0, 0.005).otherwise(i % 17 / 3.0)
    d = table(spark, sf_dir, "events").select("event_id", command.alias("command"), F.when(~none, a).alias("a"), F.when(~none, a + i % 13 / 5.0).alias("b"), length.alias("d"))
    parts = L.selection_after(F.col("command"), F.col("a"), F.col("b"), F.lit(1.5), F.lit(0.75), F.col("d"), IN_PLACE, SHORTEST)
    return d.select("event_id", *[F.round(c, 9).alias(n) for n, c in parts.items()])


@query("collage_horizontal", f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p_partkey) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM {_images_sql}),
c AS (SELECT *, CASE WHEN 2000 - 6 * (n - 1) >= n THEN greatest(1, (2000 - 6 * (n - 1)) // n) END AS cell FROM i)
SELECT p_partkey, CAST(r * (cell + 6) AS BIGINT) AS x, CAST(cell AS BIGINT) AS width, CAST(max(greatest(1, floor(h * cell::DOUBLE / w + 0.5))) OVER (PARTITION BY g) AS BIGINT) AS height, CASE WHEN cell IS NULL THEN 'COLLAGE_SIZE' END AS error FROM c""")
def collage_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images side by side on 2,000 pixels with gaps of 6: equal widths, the greatest height; an error where they have no room."""
    own, all_of = Window.partitionBy("g").orderBy("p_partkey"), Window.partitionBy("g")
    d = _images(spark, sf_dir).withColumns({"r": F.row_number().over(own) - 1, "n": F.count("*").over(all_of)})
    room = 2000 - 6 * (F.col("n") - 1)
    d = d.withColumn("cell", F.when(room >= F.col("n"), F.greatest(F.lit(1), F.floor(room / F.col("n")))))
    height = F.max(F.greatest(F.lit(1), F.floor(F.col("h") * F.col("cell") / F.col("w") + 0.5))).over(all_of)
    return d.select("p_partkey", (F.col("r") * (F.col("cell") + 6)).cast("long").alias("x"), F.col("cell").cast("long").alias("width"), height.cast("long").alias("height"), F.when(F.col("cell").isNull(), "COLLAGE_SIZE").alias("error"))


@query("image_regions", f"""WITH m AS (SELECT *, CASE WHEN p_partkey % 9 = 4 THEN 0 ELSE 1 END AS s FROM {_images_sql}),
p AS (SELECT *, 0.8::DOUBLE * s AS a, 0.6::DOUBLE * s AS b, -0.6::DOUBLE AS c, 0.8::DOUBLE AS d, 5::DOUBLE AS e, 7::DOUBLE AS f FROM m), q AS (SELECT *, a * d - b * c AS det FROM p),
k AS (SELECT *, unnest([0, 80, 80, 0]) + p_partkey % 40 AS u, unnest([0, 0, 60, 60]) AS v FROM q),
t AS (SELECT p_partkey, any_value(w) AS w, any_value(h) AS h, any_value(det) AS det, min((d * (u - e) - c * (v - f)) / det + 10 + w / 2.0::DOUBLE) AS x0, max((d * (u - e) - c * (v - f)) / det + 10 + w / 2.0::DOUBLE) AS x1, min((a * (v - f) - b * (u - e)) / det + 20 + h / 2.0::DOUBLE) AS y0, max((a * (v - f) - b * (u - e)) / det + 20 + h / 2.0::DOUBLE) AS y1 FROM k WHERE det <> 0 GROUP BY p_partkey UNION ALL SELECT p_partkey, w, h, det, NULL, NULL, NULL, NULL FROM q WHERE det = 0),
r AS (SELECT *, greatest(0, floor(round(x0, 6))) AS l, greatest(0, floor(round(y0, 6))) AS tp, least(w + 15, ceil(round(x1, 6))) AS rt, least(h + 15, ceil(round(y1, 6))) AS bt FROM t)
SELECT p_partkey, CASE WHEN det = 0 THEN 'INVALID_TRANSFORM' WHEN rt <= l OR bt <= tp THEN 'NO_OVERLAP' END AS error, CAST(CASE WHEN det <> 0 AND rt > l AND bt > tp THEN l END AS BIGINT) AS left_, CAST(CASE WHEN det <> 0 AND rt > l AND bt > tp THEN tp END AS BIGINT) AS top_, CAST(CASE WHEN det <> 0 AND rt > l AND bt > tp THEN rt - l END AS BIGINT) AS width, CAST(CASE WHEN det <> 0 AND rt > l AND bt > tp THEN bt - tp END AS BIGINT) AS height FROM r""")
def image_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection on the canvas as pixels of a turned and cropped image; an error for a map that cannot be undone."""
    scale = F.when(F.col("p_partkey") % 9 == 4, 0.0).otherwise(1.0)
    m = (scale * 0.8, scale * 0.6, F.lit(-0.6), F.lit(0.8), F.lit(5.0), F.lit(7.0))
    left = (F.col("p_partkey") % 40).cast("double")
    parts = L.image_region(m, (left, F.lit(0.0), F.lit(80.0), F.lit(60.0)), (F.lit(10.0), F.lit(20.0)), (F.col("w"), F.col("h")), (F.col("w") + 15, F.col("h") + 15))
    return _images(spark, sf_dir).select("p_partkey", *[c.alias(n) for n, c in parts.items()])
