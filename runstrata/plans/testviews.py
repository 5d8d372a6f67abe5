"""The driver's tables in the shape of the store's tables, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

SLOTS = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(df: DataFrame, path, batch, content, attrs) -> DataFrame:
    df = df.withColumn("path", path).withColumn("batch", F.lit(batch).cast("long") if isinstance(batch, int) else batch).withColumn("_c", content)
    size = F.octet_length("_c").cast("long")
    return df.select(
        "path", P.parent(F.col("path")).alias("dir"), P.basename(F.col("path")).alias("name"),
        F.when(size == 0, 2).otherwise(0).cast("short").alias("kind"), F.lit(0o644).alias("mode"), size.alias("size"),
        F.unhex(F.sha2("_c", 256)).alias("sha"), F.lit(0).cast("long").alias("mtime_ns"), "batch", attrs.alias("attrs"), F.col("_c").alias("content"),
    )


def files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """One batch: each document a file below its source and language."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    out = _row(d, path, 1, F.col("text").cast("binary"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return out if content else out.drop("content")


def history(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """Many batches over few paths; every tenth path is a file in one batch and a directory in the next."""
    d = table(spark, sf_dir, "documents").withColumn("slot", F.col("doc_id") % SLOTS)
    batch = (F.floor(F.col("doc_id") / SLOTS) + 1).cast("long")
    flip = F.concat(F.lit("x"), "slot", F.when(batch % 2 == 0, "/y").otherwise(""))
    path = F.when(F.col("slot") % 10 == 0, flip).otherwise(F.concat(F.lit("d"), F.col("slot") % 7, F.lit("/e"), F.col("slot") % 3, F.lit("/f"), "slot", F.lit(".txt")))
    out = _row(d, path, batch, F.col("text").cast("binary"), F.create_map(F.lit("lang"), "lang"))
    return out if content else out.drop("content")


def blobs(spark: SparkSession, sf_dir: str, name: str = "documents", col: str = "text") -> DataFrame:
    """Distinct contents that are not empty, in one part each."""
    c = table(spark, sf_dir, name).select(F.col(col).cast("binary").alias("content")).where(F.octet_length("content") > 0).distinct()
    return c.select(F.unhex(F.sha2("content", 256)).alias("sha"), F.lit(0).alias("part"), F.lit(1).alias("n_parts"), F.octet_length("content").cast("long").alias("size"), "content")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a walked tree: the path from the url, and a size."""
    p = table(spark, sf_dir, "pages")
    site = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    path = F.concat(site, F.lit("/p"), F.col("page_id"), F.element_at(F.array(*[F.lit(x) for x in (".html", ".pyc", ".so", "", ".tar.gz")]), (F.col("page_id") % 5 + 1).cast("int")))
    return p.select("page_id", path.alias("path"), F.when(F.col("page_id") % 11 == 0, 1).otherwise(0).alias("kind"), F.octet_length("html").cast("long").alias("size"), F.substring(F.col("html").cast("binary"), 1, 4).alias("head"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as trajectories: one for each user, in the order of time."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("users/u"), "user_id", F.lit("/events.jsonl"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(path.alias("trajectory"), seq.cast("int").alias("seq"), "ts", F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("id"), F.get_json_object("props", "$.k").try_cast("int").alias("exit_code"), F.col("props").alias("payload_json"), "user_id", "value")


#: Lines of each format from an event (id, type, k), and what a parser is to make of them (SQL over ``log`` with k).
LINES = {
    "copilot-cli": """CASE type WHEN 'click' THEN '{"type":"tool.start","id":"' || id || '","data":{"toolCallId":"c' || k % 4 || '", "toolName":"n' || k || '"}}'
 WHEN 'error' THEN '{"type":"tool.end","id":"' || id || '","data":{"toolCallId":"c' || k % 4 || '","exitCode":' || k || '}}' WHEN 'view' THEN '{"type":"assistant.turn","id":"' || id || '","data":[1e2, ' || k || ']}'
 WHEN 'purchase' THEN '{"type":"user.buy","id":"' || id || '","parentId":"p' || k || '","data":{}}' ELSE '{"type":"session.start","id":' || id || ',"data":{}}' END""",
    "codex-cli": """CASE type WHEN 'signup' THEN '{"type":"thread.started"' || CASE WHEN k % 2 = 0 THEN ',"thread_id":"t' || id || '"}' ELSE '}' END
 WHEN 'click' THEN '{"type":"item.completed","item":{"id":"i' || id || '","type":"command_execution","exit_code":' || k || '}}' WHEN 'error' THEN '{"type":"item.completed","item":{"type":"mcp_tool_call","name":"m' || k || '","exit_code":' || k || '}}'
 WHEN 'view' THEN '{"type":"item.updated","item":{"id":"i' || id || '","type":"reasoning","exit_code":' || k || '}}' ELSE '{"type":"turn.completed","id":"' || id || '","parent_id":"p' || k || '"}' END""",
    "claude-code": """CASE type WHEN 'view' THEN '{"type":"assistant","uuid":"' || id || '","message":{"role":"model","content":[{"type":"text"},{"type":"tool_use","id":"c' || k % 4 || '","name":"n' || k || '"}]}}'
 WHEN 'error' THEN '{"type":"user","uuid":"' || id || '","parentUuid":"p' || k || '","message":{"content":[{"type":"tool_result","tool_use_id":"c' || k % 4 || '"}]}}'
 WHEN 'signup' THEN '{"type":"user","uuid":"' || id || '","message":{"content":[{"type":"tool_result","tool_use_id":"c' || k % 4 || '"},{"type":"tool_use","id":"c' || (k + 1) % 4 || '","name":"s' || k || '"}]}}'
 WHEN 'click' THEN '{"type":"system","uuid":"' || id || '","message":{"content":"plain"}}' ELSE '{"type":"summary"}' END""",
    "jsonl": """'{"event":"' || type || '","event_id":"' || id || '","status_code":' || k || ',"author":' || CASE WHEN k % 3 = 0 THEN '7' ELSE '"a' || k || '"' END || '}'""",
}
_NAMED = """mentions AS (SELECT trajectory, seq, 1 AS part, k % 4 AS call, 'n' || k AS name FROM log WHERE type = 'view' UNION ALL SELECT trajectory, seq, 0, k % 4, NULL FROM log WHERE type IN ('error', 'signup') UNION ALL SELECT trajectory, seq, 1, (k + 1) % 4, 's' || k FROM log WHERE type = 'signup'),
known AS (SELECT trajectory, seq, part, last_value(name IGNORE NULLS) OVER (PARTITION BY trajectory, call ORDER BY seq, part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS name FROM mentions),
used AS (SELECT trajectory, seq, arg_min(name, part) AS name FROM known WHERE name IS NOT NULL GROUP BY trajectory, seq)"""
PARSED = {
    "copilot-cli": """SELECT trajectory, seq, CASE type WHEN 'click' THEN 'tool.start' WHEN 'error' THEN 'tool.end' WHEN 'view' THEN 'assistant.turn' WHEN 'purchase' THEN 'user.buy' ELSE 'session.start' END AS type, CASE WHEN type <> 'signup' THEN id END AS id, CASE WHEN type = 'purchase' THEN 'p' || k END AS parent_id,
 CASE type WHEN 'view' THEN 'assistant' WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'system' ELSE 'tool' END AS actor, CASE type WHEN 'click' THEN 'n' || k WHEN 'error' THEN last_value(CASE WHEN type = 'click' THEN 'n' || k END IGNORE NULLS) OVER (PARTITION BY trajectory, k % 4 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS tool_name, CASE WHEN type = 'error' THEN k END AS exit_code,
 CASE type WHEN 'click' THEN '{"toolCallId":"c' || k % 4 || '", "toolName":"n' || k || '"}' WHEN 'error' THEN '{"toolCallId":"c' || k % 4 || '","exitCode":' || k || '}' WHEN 'view' THEN '[1e2, ' || k || ']' ELSE '{}' END AS payload_json FROM log""",
    "codex-cli": f"""SELECT trajectory, seq, CASE type WHEN 'signup' THEN 'thread.started' WHEN 'view' THEN 'item.updated' WHEN 'purchase' THEN 'turn.completed' ELSE 'item.completed' END AS type, CASE type WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 't' || id END WHEN 'purchase' THEN id WHEN 'error' THEN NULL ELSE 'i' || id END AS id,
 CASE WHEN type = 'purchase' THEN 'p' || k WHEN type <> 'signup' THEN last_value(CASE WHEN type = 'signup' THEN {{'v': CASE WHEN k % 2 = 0 THEN 't' || id END}} END IGNORE NULLS) OVER (PARTITION BY trajectory ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW).v END AS parent_id,
 CASE type WHEN 'click' THEN 'tool' WHEN 'error' THEN 'tool' WHEN 'view' THEN 'assistant' END AS actor, CASE type WHEN 'click' THEN 'command_execution' WHEN 'error' THEN 'm' || k END AS tool_name, CASE WHEN type IN ('click', 'error') THEN k END AS exit_code, {LINES["codex-cli"]} AS payload_json FROM log""",
    "claude-code": f"""SELECT l.trajectory, l.seq, CASE type WHEN 'view' THEN 'assistant' WHEN 'click' THEN 'system' WHEN 'purchase' THEN 'summary' ELSE 'user' END AS type, CASE WHEN type <> 'purchase' THEN id END AS id, CASE WHEN type = 'error' THEN 'p' || k END AS parent_id,
 CASE type WHEN 'view' THEN 'model' WHEN 'click' THEN 'system' WHEN 'purchase' THEN NULL ELSE 'user' END AS actor, name AS tool_name, NULL::INTEGER AS exit_code, {LINES["claude-code"]} AS payload_json FROM log l LEFT JOIN used u ON l.trajectory = u.trajectory AND l.seq = u.seq""",
    "jsonl": f"""SELECT trajectory, seq, type, id, NULL AS parent_id, CASE WHEN k % 3 <> 0 THEN 'a' || k END AS actor, NULL AS tool_name, k AS exit_code, {LINES["jsonl"]} AS payload_json FROM log""",
}


def event_lines(spark: SparkSession, sf_dir: str, fmt: str | None = None) -> DataFrame:
    """Logs (path, content) of all users in one format, or in four by the user's number."""
    log = event_log(spark, sf_dir).withColumn("k", F.coalesce("exit_code", F.lit(0)))
    line = F.expr(LINES[fmt]) if fmt else F.expr(f"CASE user_id % 4 {' '.join(f'WHEN {i} THEN {text}' for i, text in enumerate(LINES.values()))} END")
    rows = log.groupBy(F.col("trajectory").alias("path")).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    return rows.select("path", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def parsed(fmt: str | None = None) -> str:
    """DuckDB SQL of the events of ``event_lines``."""
    log = EVENTS.replace("log AS (", "raw AS (", 1) + ", log AS (SELECT *, coalesce(exit_code, 0) AS k FROM raw)"
    one = lambda f: f"SELECT p.* FROM ({PARSED[f]}) p"
    body = one(fmt) if fmt else " UNION ALL ".join(f"SELECT p.* FROM ({PARSED[f]}) p JOIN (SELECT DISTINCT trajectory, user_id FROM raw) w ON w.trajectory = p.trajectory AND user_id % 4 = {i}" for i, f in enumerate(LINES))
    return f"WITH {log}, {_NAMED} {body}"


#: The same as CTEs.
FILES = """files AS (SELECT doc_id, source || '/' || lang || '/doc-' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path, source || '/' || lang AS dir,
 'doc-' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS name, CASE WHEN text = '' THEN 2 ELSE 0 END AS kind, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha, lang, source, text, 1::BIGINT AS batch FROM documents)"""
HISTORY = f"""history AS (SELECT doc_id, (1 + doc_id // {SLOTS})::BIGINT AS batch, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha, lang, text,
 CASE WHEN (doc_id % {SLOTS}) % 10 = 0 THEN 'x' || (doc_id % {SLOTS}) || CASE WHEN (1 + doc_id // {SLOTS}) % 2 = 0 THEN '/y' ELSE '' END
 ELSE 'd' || ((doc_id % {SLOTS}) % 7) || '/e' || ((doc_id % {SLOTS}) % 3) || '/f' || (doc_id % {SLOTS}) || '.txt' END AS path FROM documents)"""
VISIBLE = f"""{HISTORY},
latest AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY path ORDER BY batch DESC) = 1),
visible AS (SELECT * FROM latest l WHERE NOT EXISTS (SELECT 1 FROM latest a WHERE a.batch > l.batch AND (starts_with(l.path, a.path || '/') OR starts_with(a.path, l.path || '/'))))"""
ENTRIES = """entries AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '/p' || page_id || (['.html', '.pyc', '.so', '', '.tar.gz'])[page_id % 5 + 1] AS path,
 CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END AS kind, octet_length(encode(html))::BIGINT AS size FROM pages)"""
EVENTS = """log AS (SELECT 'users/u' || user_id || '/events.jsonl' AS trajectory, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS seq, ts, event_type AS type, event_id::VARCHAR AS id,
 TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS exit_code, props AS payload_json, user_id, value FROM events)"""
#: Directory rollup of a relation r(path, size).
ROLLUP = """parts AS (SELECT string_split(path, '/') AS p, size FROM r),
up AS (SELECT array_to_string(p[1:i], '/') AS dir, size FROM parts, range(0, 20) t(i) WHERE i < len(p)),
dirs AS (SELECT dir, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM up GROUP BY dir),
named AS (SELECT dir, CASE WHEN dir = '' THEN '' ELSE array_to_string(string_split(dir, '/')[1:-2], '/') END AS parent, string_split(dir, '/')[-1] AS name, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END::INTEGER AS depth, n_files, bytes FROM dirs),
rollup_ AS (SELECT n.*, (SELECT count(*) FROM named c WHERE c.parent = n.dir AND c.dir <> '') AS n_dirs FROM named n)"""
