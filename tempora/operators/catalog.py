"""The library's tables: pairing files, job states, upserts and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempora import model as M
from tempora.functions.text import episode_tag, name_tokens, title_tokens

TERMINAL = ("done", "lowconf", "undone")


def match_videos(subtitles: DataFrame, videos: DataFrame) -> DataFrame:
    """dir, name -> video: the video of the folder whose name shares most words (half at least) among those whose episode
    doesn't differ, the first by name among equals; else the folder's only usable one.

    Words that only one side of a folder has are no part of any match. Without them, names fall into classes (folder,
    episode, words left and, of videos, how many there were), and classes meet by the rarer half (and one more) of a video
    class's words. Copies, and names that differ by such words alone, are never paired off; how many videos are usable is
    counted by episode."""
    s = subtitles.groupBy("dir", "name").agg(F.count(F.lit(1)).alias("copies")).withColumns({"st": title_tokens(F.col("name")), "se": episode_tag(F.col("name"))})
    v = videos.select("dir", F.col("name").alias("video")).distinct().withColumns({"vt": name_tokens(F.col("video")), "ve": episode_tag(F.col("video"))})
    words = lambda df, column: df.select("dir", F.explode(column).alias("token")).distinct()
    common = words(s, "st").join(words(v, "vt"), ["dir", "token"]).withColumn("common", F.lit(True))

    def left(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
        """Rows by their keys, with the words of column that both sides of the folder have, in order."""
        each = df.select(*keys, F.posexplode_outer(column).alias("pos", "token")).join(common, ["dir", "token"], "left")
        return each.where("common or pos = 0 or pos is null").groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("common"), F.col("token")))).alias("words"))

    s = left(s, "st", ["dir", "name", "se", "copies"])
    vc = left(v.withColumn("n_words", F.size("vt")), "vt", ["dir", "video", "ve", "n_words"]).groupBy("dir", "ve", "n_words", "words").agg(F.min("video").alias("video"))
    sc = s.where("size(words) > 0").select("dir", "se", "words").distinct()
    each = vc.where("2 * size(words) >= n_words").select("*", F.explode("words").alias("token"))
    count = each.groupBy("dir", "token").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("dir", "video").orderBy("n", "token")
    rare = each.join(count, ["dir", "token"]).withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= F.size("words") - F.ceil(F.col("n_words") / 2) + 1)
    met = sc.select("dir", "se", F.col("words").alias("st"), F.explode("words").alias("token")).join(rare.select("dir", "token", "video", "ve", "n_words", F.col("words").alias("vt")), ["dir", "token"])
    met = met.where(F.col("se").isNull() | F.col("ve").isNull() | (F.col("se") == F.col("ve")))
    score = lambda n: F.round(F.size(F.array_intersect("vt", "st")) / F.greatest(n, F.lit(1)), 6)
    good = met.withColumn("score", score(F.col("n_words"))).where("score >= 0.5").groupBy("dir", "se", "st").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("video").alias("video"))).alias("best"))
    good = good.select(F.col("dir").alias("dir_"), F.col("se").alias("se_"), F.col("st").alias("words_"), "best")
    of = v.groupBy("dir", "ve").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("video", "vt")).alias("one"))
    whole = of.groupBy("dir").agg(F.sum("n").alias("n_all"), F.min("one").alias("one_all"))
    plain = of.where("ve is null").select("dir", F.col("n").alias("n_plain"), F.col("one").alias("one_plain"))
    same = of.where("ve is not null").select("dir", F.col("ve").alias("se"), F.col("n").alias("n_same"), F.col("one").alias("one_same"))
    t = sc.unionByName(s.where("size(words) = 0").select("dir", "se", "words").distinct()).join(whole, "dir", "left").join(plain, "dir", "left").join(same, ["dir", "se"], "left")
    usable = F.when(F.col("se").isNull(), F.col("n_all")).otherwise(F.coalesce("n_plain", F.lit(0)) + F.coalesce("n_same", F.lit(0)))
    only = F.when(usable == 1, F.when(F.col("se").isNull(), F.col("one_all")).otherwise(F.coalesce("one_plain", "one_same")))
    t = t.withColumn("only", only).withColumn("vt", F.col("only.vt")).withColumn("st", F.col("words")).withColumn("only_score", score(F.size("vt")))
    t = t.join(good, (F.col("dir") == F.col("dir_")) & F.col("se").eqNullSafe(F.col("se_")) & (F.col("words") == F.col("words_")), "left")
    found = t.select("dir", "se", "words", F.coalesce("best.video", "only.video").alias("video"), F.coalesce(-F.col("best.less"), F.when(F.col("only").isNotNull(), F.col("only_score"))).alias("score"))
    found = found.select(F.col("dir").alias("dir_"), F.col("se").alias("se_"), F.col("words").alias("words_"), "video", "score")
    out = s.join(found, (F.col("dir") == F.col("dir_")) & F.col("se").eqNullSafe(F.col("se_")) & (F.col("words") == F.col("words_")), "left")
    return out.select("dir", "name", "video", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def needs_work(pairs: DataFrame, jobs: DataFrame, tolerance_s: float = 1.0, attempts: int = 3) -> DataFrame:
    """pairs with needs_work: new, changed, or unfinished with attempts left."""
    j = jobs.select("video_path", "srt_path", "status", "attempts", F.col("srt_mtime").alias("seen"))
    unfinished = ~F.col("status").isin(*TERMINAL) & (F.col("attempts") < attempts)
    work = F.when(F.col("status").isNull(), True).when(F.abs(F.col("mtime") - F.col("seen")) > tolerance_s, True).otherwise(unfinished)
    return pairs.join(j, ["video_path", "srt_path"], "left").withColumn("needs_work", work)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version for each key; new rows win among equals."""
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("new_"), F.desc(version))
    return both.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_", "new_")


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def blocked(files: DataFrame, prefixes: DataFrame, path: str = "path") -> DataFrame:
    """Files outside every excluded prefix: each file's ancestors are matched by equality."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = files.select(path, F.explode(above).alias("prefix")).join(prefixes.select("prefix").distinct(), "prefix", "left_semi").select(path).distinct()
    return files.join(hit, path, "left_anti")


def film_rollup(jobs: DataFrame, tracks: DataFrame) -> DataFrame:
    """state, n: films with all, some or none of the wanted subtitles."""
    done = jobs.groupBy("video_path").agg(F.count_if(F.col("status") == "done").alias("ok"), F.count(F.lit(1)).alias("wanted"))
    t = done.join(tracks, "video_path", "left").withColumn("ok", F.col("ok") + F.coalesce("tracks", F.lit(0)))
    state = F.when(F.col("ok") >= F.col("wanted"), "full").when(F.col("ok") > 0, "part").otherwise("none")
    return t.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def page(jobs: DataFrame, n: int = 2000) -> DataFrame:
    return jobs.orderBy(F.desc("id")).limit(n)


def visible(jobs: DataFrame, status: str | None, text: str | None, below: float | None) -> DataFrame:
    if status:
        jobs = jobs.where(F.col("status") == status)
    if text:
        jobs = jobs.where(F.lower("srt_path").contains(text.lower()))
    return jobs.where(F.col("confidence") < below) if below is not None else jobs


def verdict(sigma: Column, agreeing: Column, sure: float = 8.0) -> Column:
    return F.when(sigma < min(6.0, sure), "nothing").when((sigma >= sure) & (agreeing >= 3), "solid").otherwise("unsure")


def settle(verdict_: Column, force: Column, strict: Column) -> Column:
    """What is written: the file itself, a file beside it, or nothing."""
    return F.when(force | (verdict_ == "solid"), "write").when(strict, "keep").otherwise("beside")


def classify(f: DataFrame) -> DataFrame:
    """mode of each timeline from its features: restarts, flat, on_line, drift, groups, far."""
    mode = (
        F.when(F.col("restarts") > 0, "joined")
        .when((F.col("flat") >= 3) & ~((F.col("on_line") >= 4) & (F.abs("drift") > 1e-5) & (F.col("on_line") >= F.col("flat") + 2)) & ~F.col("far"), "shifted")
        .when((F.col("on_line") >= 4) & (F.abs("drift") > 1e-5) & ((F.col("flat") < 3) | (F.col("on_line") >= F.col("flat") + 2)), "drifting")
        .when((F.col("groups") >= 2) | F.col("far"), "recut")
        .otherwise("ratio")
    )
    return f.withColumn("mode", mode)


def judged_parts(parts: DataFrame, verdict_: str = "verdict", far: int = M.MAX_OFFSET_MS) -> DataFrame:
    """A row a key: a solid verdict falls to unsure if a slice (offset_ms, sigma; beyond far it doesn't count) contradicts all offsets in use (an array, offsets).

    A slice contradicts if its sigma is 4 or more, no offset lies within 2 s of its own, and one lies within 45 s or its sigma is 5 or more."""
    away = lambda ms: F.exists("offsets", lambda o: F.abs(o - F.col("offset_ms")) <= ms)
    bad = (F.abs("offset_ms") <= far) & (F.col("sigma") >= 4) & ~away(2000) & (away(M.REFINE_WINDOW) | (F.col("sigma") >= 5))
    g = parts.groupBy("film_id", verdict_).agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("contradicted"))
    return g.withColumn(verdict_, F.when((F.col(verdict_) == "solid") & F.col("contradicted"), "unsure").otherwise(F.col(verdict_)))


#: The catalogue's tables; upserts keep their keys unique.
SCHEMAS = {
    "sync_jobs": ("id long, video_path string, srt_path string, backup_path string, slope double, intercept_ms long, offset_ms long, confidence double, srt_mtime double, attempts int, status string, created_at timestamp", ("video_path", "srt_path")),
    "settings": ("key string, value string", ("key",)),
    "video_tracks": ("video_path string, tracks int", ("video_path",)),
    "translations": ("id long, source_path string, output_path string, language string, provider string, status string, detail string, created_at timestamp", ("source_path", "language")),
}


def evolved(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of a schema, in its order: those that it lacks are null, others that it has come last."""
    wanted = StructType.fromDDL(schema)
    known = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted], *[c for c in df.columns if c not in wanted.names])


def after_run(jobs: DataFrame, outcomes: DataFrame, attempts: int = 3) -> DataFrame:
    """jobs with status, attempts and srt_mtime after outcomes (id, outcome: done, lowconf, failed or timeout; mtime): one more attempt each.

    What failed or ran out of time is queued again until its attempts are used up; a file that has changed since begins anew."""
    j = jobs.join(outcomes.select("id", "outcome", F.col("mtime").alias("mtime_")), "id", "left")
    ran, changed = F.col("outcome").isNotNull(), F.abs(F.col("mtime_") - F.col("srt_mtime")) > 1.0
    tries = F.when(ran, F.when(F.coalesce(changed, F.lit(False)), 0).otherwise(F.col("attempts")) + 1).otherwise(F.col("attempts"))
    status = F.when(~ran, F.col("status")).when(F.col("outcome").isin("done", "lowconf"), F.col("outcome")).when(tries < attempts, "queued").otherwise("failed")
    return j.withColumns({"status": status, "attempts": tries.cast("int"), "srt_mtime": F.coalesce("mtime_", "srt_mtime")}).drop("outcome", "mtime_")


def fresh(cache: DataFrame, now_s: Column, ttl_days: int = 30, used: str = "used_s") -> DataFrame:
    """What of a cache has been used within its time to live; partitions by day let the rest go without a scan."""
    return cache.where(now_s - F.col(used) <= ttl_days * 86_400)


def progress(lines: DataFrame) -> DataFrame:
    """job, percent, stage, done of newline-delimited JSON (job, line_no, line): the latest line that parses; percent never falls."""
    x = lines.select("job", "line_no", F.from_json("line", "stage string, percent double, done boolean").alias("x")).where("x.percent is not null or x.done is not null")
    return x.groupBy("job").agg(F.max("x.percent").alias("percent"), F.max_by("x.stage", "line_no").alias("stage"), F.coalesce(F.bool_or("x.done"), F.lit(False)).alias("done"))


# Fixed values, given by the behaviour to match: suffixes of videos and subtitles, folders that hold neither.
VIDEO_SUFFIXES = (".mp4", ".mkv", ".avi", ".mov", ".m4v", ".ts", ".m2ts", ".mts", ".webm", ".wmv", ".mpg", ".mpeg", ".flv", ".ogv", ".ogm", ".divx", ".vob", ".rmvb", ".3gp")
SUBTITLE_SUFFIXES = (".srt", ".ass", ".ssa", ".vtt", ".sub", ".idx", ".sup", ".smi", ".sami", ".ttml", ".dfxp", ".sbv", ".mpl2", ".lrc", ".stl", ".scc", ".mcc", ".cap", ".xml")
SKIPPED_FOLDERS = ("@eaDir", "#recycle", "#snapshot", "lost+found", ".Trash", "@Recycle")


def library(files: DataFrame, own: str = ".unsure") -> DataFrame:
    """Files (dir, base, ext) with kind: hidden ones, skipped folders, own outputs and the picture data beside an .idx are left out."""
    hidden = F.exists(F.split("dir", "/"), lambda d: d.startswith(".") | d.isin(*SKIPPED_FOLDERS)) | F.col("base").startswith(".")
    seen = files.where(~hidden).withColumn("low", F.lower("ext"))
    kind = F.when(F.col("low").isin(*VIDEO_SUFFIXES), "video").when(F.col("low").isin(*SUBTITLE_SUFFIXES) & ~F.col("base").endswith(own), "subtitle")
    pictures = seen.where("low = '.idx'").select("dir", "base", F.lit(".sub").alias("low")).distinct()
    return seen.withColumn("kind", kind).where("kind is not null").join(pictures, ["dir", "base", "low"], "left_anti").drop("low")


def video_folder(folders: DataFrame, videos: DataFrame) -> DataFrame:
    """dir, video_dir: the folder itself if it holds videos, else its parent if that does, else null."""
    v = videos.select(F.col("dir").alias("video_dir")).distinct()
    f = folders.select("dir", F.regexp_extract("dir", "^(.*/)[^/]+/$", 1).alias("parent"))
    own, above = v.withColumnRenamed("video_dir", "own"), v.withColumnRenamed("video_dir", "above")
    return f.join(own, f.dir == own.own, "left").join(above, f.parent == above.above, "left").select("dir", F.coalesce("own", "above").alias("video_dir"))


def result(unchanged: Column, written: Column, verdict_: Column, sigma: Column, least: Column) -> Column:
    """done or lowconf: unchanged counts as done, a guess or nothing written as lowconf, and so does what is below the least confidence."""
    done = unchanged | (written & (verdict_ == "solid"))
    return F.when(done & ~F.coalesce((least > 0) & (sigma < least), F.lit(False)), "done").otherwise("lowconf")


def update(df: DataFrame, chosen: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """df with values set in the rows whose keys are among chosen."""
    t = df.join(chosen.select(*keys).distinct().withColumn("chosen_", F.lit(True)), keys, "left")
    return t.withColumns({c: F.when(F.col("chosen_"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("chosen_")
