"""Readers of tables and nested documents, and sinks.  Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<event_id:string,user_id:string,session_id:string,timestamp:timestamp,kind:string,content:string,metadata:map<string,string>>"
MUTATION = "struct<mutation_id:string,fact_id:string,kind:string,at:timestamp,value:string,source:string,carrier_event_ids:array<string>>"
FACT = "struct<fact_id:string,user_id:string,entity:string,attribute:string,category:string,description:string>"
CHECKPOINT = "struct<name:string,fraction:double,at:timestamp>"
EXPECTED = "struct<kind:string,value:string,aliases:array<string>,forbidden:array<string>>"
PROBE = f"struct<probe_id:string,user_id:string,probe_type:string,question:string,checkpoint:string,fact_ids:array<string>,as_of:timestamp,expected:{EXPECTED}>"
TIMELINE = f"schema_version string, workload_id string, generator string, seed int, events array<{EVENT}>, facts array<{FACT}>, mutations array<{MUTATION}>, checkpoints array<{CHECKPOINT}>, probes array<{PROBE}>"
CHILDREN = ("events", "facts", "mutations", "checkpoints", "probes")
CHAT = "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_timelines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A timeline document (or many) as child tables keyed by workload_id, each with
    its position in the document as ``seq``."""
    docs = spark.read.schema(TIMELINE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return {c: docs.select("workload_id", F.posexplode(c).alias("seq", "r")).select("workload_id", "seq", "r.*") for c in CHILDREN}


def write_timelines(heads: DataFrame, children: dict[str, DataFrame], path: str) -> None:
    """The inverse: heads has one row per workload."""
    out = heads
    for name, rows in children.items():
        fields = [c for c in rows.columns if c not in ("workload_id", "seq")]
        nested = rows.groupBy("workload_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("r"))), lambda a, b: a["seq"] - b["seq"]).alias("_r"))
        out = out.join(nested.select("workload_id", F.transform("_r", lambda x: x["r"]).alias(name)), "workload_id", "left")
    out.write.mode("overwrite").json(path)


def parse_chat_date(c):
    """``2023/05/20 (Sat) 02:21``; the weekday is dropped before parsing."""
    return F.to_timestamp(F.regexp_replace(c, r" \(\w+\)", ""), "yyyy/MM/dd HH:mm")


def read_chats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(instances, events) of a chat-history file; sessions in order of date, turns
    of other roles and blank turns dropped but counted in the time of a turn."""
    raw = spark.read.schema(CHAT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    abstention = F.endswith("question_id", F.lit("_abs"))
    instances = raw.select("question_id", "question_type", "question", "answer", parse_chat_date(F.col("question_date")).alias("asked_at"), abstention.alias("abstention"), F.when(abstention, "abstention").otherwise(F.col("question_type")).alias("category"))
    sessions = raw.select("question_id", F.posexplode(F.arrays_zip("haystack_dates", "haystack_session_ids", "haystack_sessions")).alias("pos", "s"))
    sessions = sessions.select("question_id", "pos", parse_chat_date(F.col("s.haystack_dates")).alias("start"), F.col("s.haystack_session_ids").alias("session_id"), F.posexplode("s.haystack_sessions").alias("j", "turn"))
    kept = sessions.where("turn.role IN ('user', 'assistant') AND trim(turn.content) <> ''")
    events = kept.select("question_id", F.concat_ws("#", "session_id", "j").alias("event_id"), "session_id", "start", "pos", "j", F.timestamp_add("SECOND", F.col("j"), F.col("start")).alias("ts"), F.concat("turn.role", F.lit("_message")).alias("kind"), F.col("turn.content").alias("content"))
    return instances, events


def read_run_logs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Run logs with system, seed and suffix taken from their file names."""
    logs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).json(pattern)
    path = F.col("_metadata.file_path")
    return logs.withColumns({"seed": F.regexp_extract(path, r"-s(\d+)/", 1).cast("int"), "system": F.regexp_extract(path, r"/([^/]+?)(?:__\w+)?\.json$", 1), "suffix": F.regexp_extract(path, r"/[^/]+?__(\w+)\.json$", 1)})


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions under a path whose manifest is complete."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_manifest/_SUCCESS")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(int(f.getPath().getParent().getParent().getName().split("=")[1]) for f in found or [])


def snapshot(tables: dict[str, DataFrame], path: str) -> int:
    """A consistent point of several tables, as a version of its own: tables first, then
    the manifest that makes it one.  Earlier versions are not touched, so a reader sees
    a whole one at any time, and a snapshot that breaks off is none."""
    spark = next(iter(tables.values())).sparkSession
    version = max([0, *_versions(spark, path)]) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
    spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").json(f"{path}/version={version}/_manifest")
    return version


def restore(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last whole version, or of one by number."""
    known = _versions(spark, path)
    chosen = version if version is not None else (known or [0])[-1]
    if chosen not in known:
        raise FileNotFoundError(f"no whole snapshot {chosen or ''} in {path}")
    root = f"{path}/version={chosen}"
    names = [r[0] for r in spark.read.schema("name string").json(f"{root}/_manifest").collect()]
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def select_ids(rows: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Rows by a list of ids, with their place in it as ``pos``; a missing id raises."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, {key} string")
    missing = wanted.join(rows.select(key).distinct(), key, "left_anti").orderBy("pos").limit(5).collect()
    if missing:
        raise KeyError(", ".join(r[key] for r in missing))
    return wanted.join(rows, key)


def write_ids(ids: DataFrame, path: str) -> None:
    ids.write.mode("overwrite").json(path)


def read_ids(spark: SparkSession, path: str) -> list[str]:
    """A saved list of ids (pos, id); lists are as long as a person picks."""
    return [r.id for r in spark.read.schema("pos int, id string").json(path).orderBy("pos").collect()]


def write_runs(log: DataFrame, path: str) -> None:
    """Run logs, a folder for each workload, system and mode."""
    log.write.mode("append").partitionBy("workload_id", "system", "mode").json(path)


def write_latex(rows: DataFrame, path: str, *columns: str) -> None:
    """Table rows as they stand in a LaTeX table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in columns]
    rows.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line")).write.mode("overwrite").text(path)


def write_plot_data(rows: DataFrame, path: str) -> None:
    """Space-separated columns under their names, in one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("sep", " ").option("nullValue", "nan").csv(path)


def options(spark: SparkSession, prefix: str = "spark.tidemark.") -> dict[str, str]:
    """Settings of the session under a prefix; blank ones count as unset."""
    found = dict(spark.sparkContext.getConf().getAll())
    return {k[len(prefix) :]: v for k, v in found.items() if k.startswith(prefix) and v.strip()}


def cached_workload(spark: SparkSession, path: str, make) -> DataFrame:
    """A saved workload if there is one, else ``make()``, saved."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_responses(requests: DataFrame, cache: DataFrame, call) -> tuple[DataFrame, DataFrame]:
    """(answers, misses): answers of requests (a struct column ``request``) by content
    address.  The address is the sha256 of the request's JSON with its fields in order
    of name; hits give what was stored, with the usage of the time, and ``call`` maps
    the distinct misses (digest, request) to (digest, response, usage, refused).  Refused
    responses are answers but are not to be stored."""
    fields = sorted(f.name for f in requests.schema["request"].dataType)
    digest = F.sha2(F.to_json(F.struct(*(F.col(f"request.{f}").alias(f) for f in fields))), 256)
    asked = requests.withColumn("digest", digest)
    held = cache.select("digest", "response", "usage")
    misses = call(asked.join(held, "digest", "left_anti").groupBy("digest").agg(F.first("request").alias("request")))
    known = held.withColumn("hit", F.lit(True)).unionByName(misses.select("digest", "response", "usage").withColumn("hit", F.lit(False)))
    return asked.join(known, "digest"), misses.where("NOT refused").select("digest", "response", "usage")
