"""Registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import content, events, ingest, maintenance, namespace, retention
from ..streaming import watch
from . import sql as S
from . import teststore as T
from . import testviews as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def hexed(df: DataFrame) -> DataFrame:
    return df.withColumn("sha", F.lower(F.hex("sha")))


FILE_COLS = ["path", "dir", "name", "kind", "size", "sha", "batch"]
F_COLS = "path, dir, name, kind::SMALLINT AS kind, size, sha, batch"


# catalog: scans, paths, listings ---------------------------------------------------------------


@query("SELECT lang, count(*) AS paths, count(DISTINCT text) AS contents, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY lang")
def attr_summary(s, d):
    """Paths, distinct contents and bytes for each value of an attribute, over the first batch of a written store."""
    return S.sql(s, [T.store(s, d)], "SELECT attrs['lang'] AS lang, count(*) AS paths, count(DISTINCT sha) AS contents, sum(size) AS bytes FROM files WHERE batch = 1 GROUP BY 1")


@query(f"WITH {V.FILES} SELECT path, array_to_string(string_split(path, '/')[1:-2], '/') AS parent, string_split(path, '/')[-1] AS base, (len(string_split(path, '/')) - 1)::INTEGER AS depth, regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1) AS ext FROM files")
def paths_parent_basename(s, d):
    p = F.col("path")
    return V.files(s, d).select("path", P.parent(p).alias("parent"), P.basename(p).alias("base"), P.depth(P.parent(p)).alias("depth"), P.extension(P.basename(p)).alias("ext"))


@query(f"WITH {V.FILES} SELECT array_to_string(string_split(path, '/')[1:i], '/') AS dir, count(*) AS n FROM files, range(0, 10) t(i) WHERE i < len(string_split(path, '/')) GROUP BY 1")
def path_ancestors(s, d):
    return V.files(s, d).select(F.explode(P.ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n"))


_ROLL = "dir, parent, name, depth, n_files, n_dirs, bytes"


@query(f"WITH {V.FILES}, r AS (SELECT path, size FROM files), {V.ROLLUP} SELECT {_ROLL} FROM rollup_")
def dir_rollup(s, d):
    return namespace.rollup(V.files(s, d))


@query(f"WITH {V.VISIBLE}, r AS (SELECT path, size FROM visible), {V.ROLLUP} SELECT {_ROLL} FROM rollup_")
def dir_rollup_visible(s, d):
    return namespace.rollup(namespace.visible(V.history(s, d)))


@query(f"WITH {V.FILES}, r AS (SELECT path, size FROM files), {V.ROLLUP} SELECT true AS is_dir, name, dir AS path, n_files, n_dirs, bytes AS size FROM rollup_ WHERE parent = 'src3' UNION ALL SELECT false, name, path, NULL, NULL, size FROM files WHERE dir = 'src3'")
def dir_children(s, d):
    return namespace.children(V.files(s, d), "src3")


@query(f"WITH {V.FILES}, r AS (SELECT path, size FROM files), {V.ROLLUP} SELECT true AS is_dir, name, dir AS path, n_files, n_dirs, bytes AS size FROM rollup_ WHERE parent = '' AND dir <> ''")
def ls_dirs_first(s, d):
    return namespace.children(V.files(s, d), "")


@query(f"WITH {V.FILES}, r AS (SELECT path, size FROM files), {V.ROLLUP} SELECT dir AS path, true AS is_dir, depth, n_files, bytes AS size FROM rollup_ WHERE depth BETWEEN 1 AND 2 UNION ALL SELECT path, false, 3, NULL, size FROM files WHERE false")
def tree_depth2(s, d):
    return namespace.tree(V.files(s, d), "", 2)


@query(f"WITH {V.FILES} SELECT dir, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM files WHERE starts_with(path, 'src1/') GROUP BY dir")
def listings_prefetch(s, d):
    e = namespace.listings(V.files(s, d), "src1").where(F.col("dir") != "src1").where("dir <> ''")
    return e.select("dir", F.size("entries").cast("long").alias("n"), F.col("entries")[0]["name"].alias("first_name"), F.element_at("entries", -1)["name"].alias("last_name"))


@query(f"WITH {V.FILES} SELECT {F_COLS} FROM files WHERE regexp_full_match(name, 'doc-.*7\\.txt')")
def find_name_glob(s, d):
    return hexed(namespace.find(V.files(s, d), name="doc-*7.txt")).select(FILE_COLS)


@query(f"WITH {V.FILES} SELECT {F_COLS} FROM files WHERE regexp_full_match(path, 'src[0-2]/.*(1|2)\\.txt')")
def find_path_glob(s, d):
    return hexed(namespace.find(V.files(s, d), path="src[0-2]/*{1,2}.txt")).select(FILE_COLS)


@query(f"WITH {V.FILES} SELECT {F_COLS} FROM files WHERE size > 8192")
def find_size_gt(s, d):
    return hexed(namespace.find(V.files(s, d), size="+8K")).select(FILE_COLS)


@query(f"WITH {V.FILES} SELECT {F_COLS} FROM files WHERE size < 512 AND starts_with(path, 'src0/')")
def find_size_lt(s, d):
    return hexed(namespace.find(V.files(s, d), "src0", size="-512")).select(FILE_COLS)


@query(f"WITH {V.FILES} SELECT kind::SMALLINT AS kind, count(*) AS n FROM files WHERE kind = 2 GROUP BY kind")
def find_kind_empty(s, d):
    return namespace.find(V.files(s, d), kind="e").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.FILES} SELECT {F_COLS} FROM files WHERE lang = 'fr' AND source = 'src2'")
def find_attr(s, d):
    return hexed(namespace.find(V.files(s, d), attrs={"lang": "fr", "source": "src2"})).select(FILE_COLS)


@query(f"WITH {V.FILES} SELECT path, '-rw-r--r--' AS mode_text, 'lang=' || lang || ',source=' || source AS attrs_text, size, sha FROM files WHERE doc_id = 3")
def stat_point(s, d):
    f = V.files(s, d)
    one = V.table(s, d, "documents").where("doc_id = 3").select("source", "lang").first()
    return hexed(namespace.stat(f, f"{one.source}/{one.lang}/doc-00000003.txt")).select("path", "mode_text", "attrs_text", "size", "sha")


@query(f"WITH {V.FILES} SELECT path, size FROM files WHERE path >= 'src1/' AND path < 'src10'")
def subtree_range(s, d):
    return namespace.files_under(V.files(s, d), "src1").select("path", "size")


@query(f"WITH {V.FILES} SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(DISTINCT sha) FILTER (size > 0) AS blobs, (SELECT sum(b)::BIGINT FROM (SELECT any_value(size) AS b FROM files GROUP BY sha)) AS blob_bytes FROM files")
def du_dedup(s, d):
    return namespace.du(V.files(s, d))


@query(f"WITH {V.FILES}, r AS (SELECT path, size FROM files), {V.ROLLUP} SELECT dir, n_files, n_dirs, bytes FROM rollup_ WHERE depth <= 1")
def du_depth1(s, d):
    return namespace.du_depth(V.files(s, d), "", 1)


@query(f"WITH {V.FILES}, n AS (SELECT path, size, size // 1024 * 10 + (size % 1024) * 10 // 1024 AS low, (size % 1024) * 10 % 1024 AS over FROM files), k AS (SELECT *, low + CASE WHEN over > 512 OR (over = 512 AND low % 2 = 1) THEN 1 ELSE 0 END AS tenths FROM n), m AS (SELECT *, size // 1048576 * 10 + (size % 1048576) * 10 // 1048576 AS mlow, (size % 1048576) * 10 % 1048576 AS mover FROM k) SELECT path, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN tenths // 10 || '.' || tenths % 10 || ' KB' ELSE (mlow + CASE WHEN mover > 524288 OR (mover = 524288 AND mlow % 2 = 1) THEN 1 ELSE 0 END) // 10 || '.' || (mlow + CASE WHEN mover > 524288 OR (mover = 524288 AND mlow % 2 = 1) THEN 1 ELSE 0 END) % 10 || ' MB' END AS shown FROM m")
def human_sizes(s, d):
    return V.files(s, d).select("path", P.human(F.col("size")).alias("shown"))


# history and visibility ------------------------------------------------------------------------


@query(f"WITH {V.VISIBLE} SELECT path, batch, size, sha FROM latest")
def latest_per_path(s, d):
    return hexed(namespace.latest(V.history(s, d))).select("path", "batch", "size", "sha")


@query(f"WITH {V.VISIBLE} SELECT path, batch, size, sha FROM visible")
def visible_namespace(s, d):
    return hexed(namespace.visible(V.history(s, d))).select("path", "batch", "size", "sha")


@query(f"WITH {V.VISIBLE} SELECT count(*) - (SELECT count(*) FROM visible) AS n FROM history")
def shadowed_count(s, d):
    return namespace.shadowed(V.history(s, d)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.HISTORY} SELECT path, batch, size, sha FROM history WHERE path = 'd1/e1/f1.txt' AND batch = 2")
def stat_version(s, d):
    return hexed(namespace.stat_version(V.history(s, d), "d1/e1/f1.txt", 2)).select("path", "batch", "size", "sha")


@query("SELECT 1::BIGINT AS batch, count(*) AS paths, sum(octet_length(encode(text)))::BIGINT AS bytes, count(DISTINCT text) FILTER (text <> '') AS contents FROM documents")
def batch_totals(s, d):
    """The summary of an append of all documents."""
    h = V.files(s, d, content=True)
    none = h.limit(0).select("sha")
    found = ingest.summary(h, ingest.as_parts(ingest.new_blobs(h, none)), h.limit(0))
    return s.createDataFrame([(1, found["paths"], found["bytes"], found["new_blobs"])], "batch long, paths long, bytes long, contents long")


@query(f"WITH {V.VISIBLE} SELECT split_part(path, '/', 1) AS top, count(*) AS n FROM visible WHERE regexp_full_match(path, '.*/f.*5\\.txt') GROUP BY 1")
def find_visible(s, d):
    """The name test stands above the shadowing."""
    return namespace.find(namespace.visible(V.history(s, d)), name="f*5.txt").groupBy(F.split("path", "/")[0].alias("top")).agg(F.count(F.lit(1)).alias("n"))


# contents --------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS sha, octet_length(encode(any_value(text)))::BIGINT AS size FROM documents WHERE text <> '' GROUP BY 1")
def blobs_distinct(s, d):
    return hexed(V.blobs(s, d)).select("sha", "size")


@query(f"WITH {V.FILES} SELECT sha, list(path ORDER BY path) AS paths FROM files WHERE size > 0 GROUP BY sha HAVING count(*) > 1")
def paths_by_sha(s, d):
    return hexed(namespace.paths_by_sha(V.files(s, d))).where(F.size("paths") > 1)


@query(f"WITH {V.HISTORY}, last AS (SELECT max(batch) AS b FROM history) SELECT DISTINCT sha, size FROM history, last WHERE size > 0 AND batch = b AND sha NOT IN (SELECT sha FROM history, last WHERE batch < b)")
def new_blobs_anti(s, d):
    """The last batch against all before it."""
    h = V.history(s, d, content=True)
    last = h.agg(F.max("batch")).first()[0]
    return hexed(ingest.new_blobs(h.where(F.col("batch") == last), h.where(F.col("batch") < last).select("sha"))).select("sha", F.octet_length("content").cast("long").alias("size"))


@query(f"WITH {V.FILES}, base AS (SELECT *, doc_id % 3 AS m FROM files) SELECT path, sha FROM base WHERE m <> 0")
def unchanged_skip(s, d):
    """A third of the tree is as stored; a third has another mode, a third another attribute."""
    f = V.files(s, d)
    third = F.pmod(F.regexp_extract("name", r"(\d+)", 1).cast("long"), F.lit(3))
    seen = f.withColumn("mode", F.when(third == 1, 0o755).otherwise(F.col("mode"))).withColumn("attrs", F.when(third == 2, F.create_map(F.lit("lang"), F.lit("zz"))).otherwise(F.col("attrs")))
    return hexed(ingest.changed(f, seen)).select("path", "sha")


@query("SELECT sha, part::INTEGER AS part, n_parts::INTEGER AS n_parts, (CASE WHEN part = n_parts - 1 THEN size - part * 4096 ELSE 4096 END)::BIGINT AS size FROM (SELECT sha256(text) AS sha, octet_length(encode(text)) AS size, greatest(1, ceil(octet_length(encode(text)) / 4096.0)::BIGINT) AS n_parts FROM (SELECT DISTINCT text FROM documents) WHERE text <> ''), range(0, 100000) t(part) WHERE part < n_parts")
def blob_parts(s, d):
    return hexed(ingest.as_parts(V.blobs(s, d).select("sha", "content"), 4096)).select("sha", "part", "n_parts", "size")


@query(f"WITH {V.FILES}, l AS (SELECT path, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS line_no FROM files WHERE size > 0) SELECT path, line_no::INTEGER AS line_no, line FROM l WHERE regexp_matches(line, 'license|(?:^The )')")
def grep_lines(s, d):
    return content.grep(V.files(s, d), V.blobs(s, d), ["license", "^The "])


@query(f"WITH {V.FILES}, l AS (SELECT path, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM files WHERE size > 0 AND starts_with(path, 'src0/')) SELECT path, count(*) AS n_lines FROM l WHERE regexp_matches(line, '[0-9]{{3}}') GROUP BY path")
def grep_count(s, d):
    return content.grep_count(content.grep(V.files(s, d), V.blobs(s, d), ["[0-9]{3}"], "src0"))


@query(f"WITH {V.FILES} SELECT path FROM files WHERE contains(text, 'token') AND regexp_full_match(name, '.*[05]\\.txt')")
def grep_files(s, d):
    return content.grep(V.files(s, d), V.blobs(s, d), ["token"], name="*[05].txt").select("path").distinct()


@query(f"WITH {V.FILES}, l AS (SELECT path, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM files WHERE size > 0) SELECT path, count(*) AS n_lines FROM l WHERE regexp_matches(line, 'RELEASED', 'i') GROUP BY path")
def grep_ignorecase(s, d):
    return content.grep_count(content.grep(V.files(s, d), V.blobs(s, d), ["RELEASED"], ignore_case=True))


@query("SELECT item_id, sha256(text) AS sha, text, octet_length(encode(text))::BIGINT AS n FROM benchmark")
def text_lookup(s, d):
    keys = V.table(s, d, "benchmark").select("item_id", F.sha2("text", 256).alias("sha"))
    return content.lookup(keys, [V.blobs(s, d, "benchmark")]).select("item_id", "sha", "text", F.octet_length("blob").cast("long").alias("n"))


@query("SELECT * FROM (VALUES ('unknown', NULL, true), ('malformed', NULL, true), ('null', NULL, true), ('empty', '', false)) t(kind, text, missing)")
def blob_lookup_unknown_null(s, d):
    rows = s.sql(f"SELECT * FROM VALUES ('unknown', '{'0' * 64}'), ('malformed', 'xyz'), ('null', NULL), ('empty', '{content.EMPTY_SHA}') AS t(kind, sha)")
    return content.lookup(rows, [V.blobs(s, d)]).select("kind", "text", F.col("blob").isNull().alias("missing"))


@query("SELECT store, sum(n)::BIGINT AS n FROM (SELECT unnest(['tables', 'again']) AS store, n FROM (SELECT (SELECT count(*) FROM documents) + (SELECT count(DISTINCT conv_id) FROM conversations) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM benchmark) AS n)) GROUP BY store")
def union_stores(s, d):
    """The history of two stores in one view, each row marked with its store."""
    one = T.store(s, d)
    two = T.store(s, d)
    two.manifest.store_id = "again"
    return S.views(s, [one, two])["files"].groupBy("store").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id, sha256(text) AS sha, text FROM benchmark")
def first_store_wins(s, d):
    """The first store has every other item; the second has all, but damaged where the first has them too: reading these would fail."""
    b = V.table(s, d, "benchmark").withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("content", F.col("text").cast("binary"))
    even = F.col("item_id") % 2 == 0
    first = b.where(even).select("sha", "content")
    second = b.select("sha", F.when(even, F.lit(b"damaged")).otherwise(F.col("content")).alias("content"))
    return content.lookup(b.select("item_id", F.sha2("text", 256).alias("sha")), [first, second]).select("item_id", "sha", "text")


# a written store -----------------------------------------------------------------------------


@query(f"WITH {T.STORED} SELECT split_part(path, '/', 1) AS top, count(*) AS n, sum(size)::BIGINT AS bytes, max(batch)::BIGINT AS newest FROM stored GROUP BY 1")
def store_find(s, d):
    """What is visible of three batches, the logs aside."""
    f = T.store(s, d).find(path="{src*,items}/*")
    return f.groupBy(F.split("path", "/")[0].alias("top")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("batch").alias("newest"))


@query(f"WITH {T.STORED} SELECT true AS is_dir, split_part(path, '/', 2) AS name, 'src1/' || split_part(path, '/', 2) AS path, count(*) AS n_files, 0::BIGINT AS n_dirs, sum(size)::BIGINT AS size FROM stored WHERE starts_with(path, 'src1/') GROUP BY 2, 3")
def store_ls(s, d):
    return T.store(s, d).children("src1")


@query(f"WITH {T.STORED} SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(DISTINCT sha) FILTER (size > 0) AS blobs, (SELECT sum(b)::BIGINT FROM (SELECT any_value(size) AS b FROM stored WHERE starts_with(path, 'src2/') GROUP BY sha)) AS blob_bytes FROM stored WHERE starts_with(path, 'src2/')")
def store_du(s, d):
    return T.store(s, d).du("src2")


@query(f"WITH {T.STORED}, l AS (SELECT path, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM stored WHERE size > 0 AND starts_with(path, 'src3/')) SELECT path, count(*) AS n_lines FROM l WHERE regexp_matches(line, '[0-9]{{2}}') GROUP BY path")
def store_grep(s, d):
    return content.grep_count(T.store(s, d).grep(["[0-9]{2}"], "src3"))


@query(f"WITH {T.STORED} SELECT path, text FROM stored WHERE path IN (SELECT min(path) FROM stored UNION ALL SELECT max(path) FROM stored)")
def store_cat(s, d):
    """The first and the last path of the documents and items."""
    store = T.store(s, d)
    ends = store.find(path="{src*,items}/*").agg(F.min("path"), F.max("path")).first()
    return store.cat(*ends).select("path", content.text_of(F.col("content")).alias("text"))


@query(f"WITH {T.STORED} SELECT path, batch::BIGINT AS batch, size, sha, '-rw-r--r--' AS mode_text, '1970-01-01T00:00:00+00:00' AS mtime_text, CASE WHEN size = 0 THEN 0 ELSE 1 END::BIGINT AS parts FROM stored WHERE path = (SELECT min(path) FROM stored)")
def store_stat(s, d):
    store = T.store(s, d)
    return hexed(store.stat(store.find(path="{src*,items}/*").agg(F.min("path")).first()[0])).select("path", "batch", "size", "sha", "mode_text", "mtime_text", "parts")


@query("SELECT type, actor, count(*) AS n, count(DISTINCT conv_id) AS logs FROM (SELECT 'turn' AS type, role AS actor, conv_id FROM conversations) GROUP BY type, actor")
def store_events(s, d):
    return T.store(s, d).events.where("trajectory like 'talk/%'").groupBy("type", "actor").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trajectory").alias("logs"))


@query('SELECT NULL::VARCHAR AS "check", NULL::VARCHAR AS subject FROM range(0)')
def store_verify(s, d):
    """No violation, all contents hashed again, nothing left for compaction."""
    return T.store(s, d).verify(deep=True, compacted=True)


@query(f"WITH {T.STORED}, h AS (SELECT sha256(coalesce(text, '')) AS sha, coalesce(text, '') AS text FROM documents UNION ALL SELECT sha256(text), text FROM benchmark) SELECT (SELECT count(*) FROM h) + (SELECT count(*) FROM talk) AS files, (SELECT count(DISTINCT sha) FROM h WHERE text <> '') + (SELECT count(*) FROM talk) AS blobs, (SELECT count(*) FROM docs WHERE path IN (SELECT path FROM items)) AS shadowed")
def store_counts(s, d):
    return T.store(s, d).verify_counts()


@query("SELECT item_id, text, octet_length(encode(text))::BIGINT AS n FROM benchmark")
def text_fn(s, d):
    """``text(sha)`` in SQL: the contents of the last batch, by name and by hex hash."""
    V.table(s, d, "benchmark").createOrReplaceTempView("benchmark_items")
    return S.sql(s, [T.store(s, d)], "SELECT item_id, text(f.sha) AS text, octet_length(text(sha2(i.text, 256))) + 0L AS n FROM benchmark_items i JOIN (SELECT DISTINCT sha FROM files WHERE batch = 3) f ON f.sha = unhex(sha2(i.text, 256))")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n, md5(text) AS digest FROM documents")
def blob_fn(s, d):
    """``blob(sha)`` of every document: these are dealt by hash, so that a batch of them asks for neighbours in the files."""
    docs = V.table(s, d, "documents").select("doc_id", "text")
    docs.repartitionByRange(F.sha2("text", 256)).sortWithinPartitions(F.sha2("text", 256)).createOrReplaceTempView("all_documents")
    return S.sql(s, [T.store(s, d)], "SELECT doc_id, cast(octet_length(b) AS bigint) AS n, md5(b) AS digest FROM (SELECT doc_id, blob(sha2(text, 256)) AS b FROM all_documents)")


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS letters FROM (SELECT lang, text FROM documents) GROUP BY lang")
def contents_join(s, d):
    """The documented join for many rows: files with the texts of their contents."""
    return S.sql(s, [T.store(s, d)], "SELECT split(path, '/')[1] AS lang, count(*) AS n, cast(sum(length(text)) AS bigint) AS letters FROM files JOIN contents USING (sha) WHERE batch = 1 GROUP BY 1")


# retention -------------------------------------------------------------------------------------

PROFILE = retention.Profile("pages", exclude_dirs=("de",), exclude_ext=("pyc",), max_bytes=40000, exclude_under=((("f",), ("so",), 6000),), always_exclude=("*/p1*7*",), always_keep=("*/p2*.pyc",))
_RULE = """CASE WHEN regexp_full_match(path, '.*/p1.*7.*') THEN 'always_exclude' WHEN regexp_full_match(path, '.*/p2.*\\.pyc') THEN NULL WHEN list_contains(dirs, 'de') THEN 'exclude_dirs' WHEN kind = 1 THEN NULL
 WHEN ext = 'pyc' THEN 'exclude_ext' WHEN size > 40000 THEN 'max_bytes' WHEN under AND ext = 'so' THEN 'exclude_under.ext' WHEN under AND size > 6000 THEN 'exclude_under.max_bytes' END"""
_DECIDED = f"{V.ENTRIES}, e AS (SELECT *, string_split(path, '/')[1:-2] AS dirs, regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1) AS ext FROM entries), u AS (SELECT *, len(list_filter(dirs, lambda x: starts_with(x, 'f'))) > 0 AS under FROM e)"


@query(f"WITH {_DECIDED} SELECT page_id, path, {_RULE} AS rule FROM u")
def retention_decision(s, d):
    return retention.decide(V.entries(s, d), PROFILE).select("page_id", "path", "rule")


@query(f"WITH {_DECIDED}, x AS (SELECT size, {_RULE} AS rule FROM u) SELECT rule, count(*) AS n, sum(size)::BIGINT AS bytes FROM x WHERE rule IS NOT NULL GROUP BY rule")
def excluded_by_rule(s, d):
    return retention.excluded(retention.decide(V.entries(s, d), PROFILE)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {V.ENTRIES}, x AS (SELECT path, size, string_split(path, '/') AS p FROM entries), t AS (SELECT *, list_position(p[1:-2], 'de') AS i FROM x) SELECT CASE WHEN i > 0 THEN array_to_string(p[1:i], '/') ELSE path END AS path, CASE WHEN i > 0 THEN 'exclude_dirs' ELSE 'exclude_ext' END AS rule, max(CASE WHEN i > 0 THEN 0 ELSE size END)::BIGINT AS size FROM t WHERE i > 0 OR (path LIKE '%.pyc') GROUP BY 1, 2")
def excluded_pruned_dirs(s, d):
    """A pruned directory is one row of size 0."""
    e = V.entries(s, d).withColumn("kind", F.lit(0))
    return retention.excluded(retention.decide(e, retention.Profile("p", exclude_dirs=("de",), exclude_ext=("pyc",)))).select("path", "rule", "size")


@query(f"WITH {V.ENTRIES} SELECT path, regexp_matches(path, '^[^/]+\\.org/(fr|es)(/|$)') AS gone FROM entries")
def deleted_prefix_filter(s, d):
    e = V.entries(s, d)
    gone = e.select(F.regexp_extract("path", r"^([^/]+\.org/(?:fr|es))(?:/|$)", 1).alias("path")).where("path <> ''").distinct()
    return retention.decide(e, retention.Profile("none"), gone).select("path", (F.col("rule") == "deleted").alias("gone")).fillna(False, ["gone"])


# events ----------------------------------------------------------------------------------------

ADAPTER = events.Adapter("docs", 1, "jsonl", ("**/*.txt",), ((r"^src(?P<round>\d+)/(?P<role>[^/]+)/", ()), (r"doc-(?P<doc>\d+)\.txt$", ("doc",))))


@query(f"WITH {V.FILES} SELECT path, substr(source, 4) AS round, lang AS role, doc_id::VARCHAR AS doc FROM files")
def attrs_extract(s, d):
    a = V.files(s, d).select("path", ADAPTER.attributes(F.col("path")).alias("a"))
    return a.select("path", *[F.col("a")[k].alias(k) for k in ("round", "role", "doc")])


@query("SELECT event_id, event_type AS type, event_id::VARCHAR AS id, user_id::VARCHAR AS actor, json_extract_string(props, '$.k')::INTEGER AS exit_code FROM events")
def json_envelope(s, d):
    line = F.to_json(F.struct(F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("author"), F.get_json_object("props", "$.k").cast("int").alias("returncode")))
    rows = V.table(s, d, "events").select("event_id", line.alias("line"))
    return events.generic_envelope(rows).select("event_id", "type", "id", "actor", "exit_code")


@query("SELECT 'conv-' || conv_id || '/events.jsonl' AS trajectory, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS seq, 'turn' AS type, turn::VARCHAR AS id, role AS actor, (turn * 1000000)::BIGINT AS ts_us, length(text)::BIGINT AS n FROM conversations")
def exact_parser(s, d):
    """Conversations written as JSON lines and parsed by the exact parser."""
    line = F.to_json(F.struct(F.lit("turn").alias("type"), F.col("turn").cast("string").alias("id"), "role", F.col("turn").alias("ts"), "text"))
    logs = V.table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    parsed = events.parse_events(logs.select(F.concat(F.lit("conv-"), "conv_id", F.lit("/events.jsonl")).alias("path"), "content"), "jsonl")
    return parsed.select("trajectory", "seq", "type", "id", "actor", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.length(F.get_json_object("payload_json", "$.text")).cast("long").alias("n"))


@query("SELECT event_type AS type, count(*) AS n, count(DISTINCT user_id) AS trajectories FROM events GROUP BY 1")
def events_by_type(s, d):
    """Counts over the events of a written store: the users' logs."""
    return S.sql(s, [T.store(s, d)], "SELECT type, count(*) AS n, count(DISTINCT trajectory) AS trajectories FROM events WHERE trajectory LIKE 'users/%' GROUP BY type")


@query(f"WITH {V.EVENTS} SELECT trajectory, count(*) AS n, sum(CASE WHEN exit_code > 50 THEN 1 ELSE 0 END)::BIGINT AS failed FROM log WHERE type IN ('click', 'error') GROUP BY trajectory")
def tool_calls_failed(s, d):
    return V.event_log(s, d).where(F.col("type").isin("click", "error")).groupBy("trajectory").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("exit_code") > 50).cast("long")).alias("failed"))


@query(f"WITH {V.EVENTS} SELECT id, seq, last_value(CASE WHEN type = 'signup' THEN 'n' || exit_code END IGNORE NULLS) OVER (PARTITION BY trajectory, exit_code % 4 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tool_name FROM log")
def call_name_asof(s, d):
    """The newest name given for a call id, as of each event."""
    name = F.when(F.col("type") == "signup", F.concat(F.lit("n"), "exit_code"))
    call = F.struct((F.col("exit_code") % 4).cast("string").alias("call"), name.alias("name"))
    return events.resolve_calls(V.event_log(s, d).withColumn("mentions", F.array(call)).withColumn("tool_name", F.lit(None).cast("string"))).select("id", "seq", "tool_name")


@query(f"WITH {V.EVENTS} SELECT id, CASE WHEN type = 'signup' THEN NULL ELSE last_value(CASE WHEN type = 'signup' THEN {{'v': CASE WHEN exit_code % 2 = 0 THEN id END}} END IGNORE NULLS) OVER (PARTITION BY trajectory ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW).v END AS parent_id FROM log")
def thread_parent_asof(s, d):
    """The thread begun last; one without an id resets the parent."""
    begins = F.col("type") == "signup"
    opens = F.when(begins, F.struct(F.when(F.col("exit_code") % 2 == 0, F.col("id")).alias("id")))
    rows = V.event_log(s, d).withColumns({"opens": opens, "follows": ~begins, "parent_id": F.lit(None).cast("string")})
    return events.resolve_threads(rows).select("id", "parent_id")


EVENT_COLS = ["trajectory", "seq", "type", "id", "parent_id", "actor", "tool_name", "exit_code", "payload_json"]


def event_format(name: str, fmt: str | None) -> None:
    def run(s, d):
        return events.parse_events(V.event_lines(s, d, fmt), fmt or events.AUTOMATIC).select(EVENT_COLS)

    run.__name__ = name
    query(V.parsed(fmt))(run)


event_format("events_calls", "copilot-cli")
event_format("events_threads", "codex-cli")
event_format("events_messages", "claude-code")
event_format("events_generic", "jsonl")
event_format("events_recognised", None)


@query("""WITH o AS (SELECT 'c' || o_custkey AS trajectory, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS seq, o_orderkey AS k, o_orderstatus AS status FROM orders)
SELECT trajectory, (2 * seq)::INTEGER AS seq, CASE WHEN k % 5 = 0 THEN '_unparsed' ELSE 'e' || status END AS type, CASE WHEN k % 5 <> 0 THEN 'u' || k END AS id, CASE WHEN k % 5 <> 0 THEN (k % 100)::INTEGER END AS exit_code,
 CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN k * 1000000 ELSE (k + 1000000000000) * 1000 END AS ts_us, CASE WHEN k % 5 = 0 THEN '"{\\"k\\": ' || k || '"' END AS unparsed FROM o""")
def event_values(s, d):
    """Values of a wrong type are skipped, seconds and milliseconds told apart, blank lines counted, broken lines kept."""
    o = V.table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    line = F.expr("""CASE WHEN k % 5 = 0 THEN '{"k": ' || k ELSE '{"type":7,"event":"e' || status || '","id":' || k || ',"uuid":"u' || k || '","exit_code":4294967296,"exitCode":' || k % 100 || '.0,"returncode":' || k % 100 || ',"timestamp":"soon","ts":' || CASE WHEN k % 2 = 0 THEN k ELSE k + 1000000000000 END || '}' END""")
    logs = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n \t\r\n").alias("content"))
    got = events.parse_events(logs.select(F.concat(F.lit("c"), "o_custkey").alias("path"), "content"), "jsonl")
    return got.select("trajectory", "seq", "type", "id", "exit_code", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.when(F.col("type") == "_unparsed", F.col("payload_json")).alias("unparsed"))


@query("SELECT doc_id, (n - 1)::INTEGER AS seq FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''")
def seq_numbering(s, d):
    """Physical lines: blank ones take a number and give no event."""
    logs = V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return events.scan_logs(logs, "jsonl").select(F.col("trajectory").cast("long").alias("doc_id"), "seq")


@query(f"WITH {V.EVENTS} SELECT type, exit_code % 10 AS k, count(*) AS n FROM log GROUP BY ROLLUP (type, exit_code % 10)")
def events_per_attr_rollup(s, d):
    return V.event_log(s, d).withColumn("k", F.col("exit_code") % 10).rollup("type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT max(lang || '-' || source) AS label FROM documents WHERE lang || '-' || source NOT IN (SELECT max(lang || '-' || source) FROM documents)")
def label_topk(s, d):
    """The greatest label that is ready and not packed yet: the second greatest."""
    listing = V.table(s, d, "documents").select(F.concat("lang", F.lit("-"), "source", F.lit("/"), "doc_id", F.lit("/DONE")).alias("path"))
    adapter = events.Adapter("labels", markers=("**/DONE",), label_ancestor_pattern="^[a-z]+-")
    first = watch.next_label(listing, adapter, [])
    return s.createDataFrame([(watch.next_label(listing, adapter, [first]),)], "label string")


# integrity and maintenance -----------------------------------------------------------------------


@query("SELECT 'parts' AS \"check\", sha256(text) AS subject FROM (SELECT DISTINCT text FROM documents) WHERE octet_length(encode(text)) > 2 * 4096")
def verify_parts(s, d):
    """Contents whose second part of three or more is lost."""
    parts = ingest.as_parts(V.blobs(s, d).select("sha", "content"), 4096)
    return maintenance.part_problems(parts.where("not (part = 1 and n_parts > 2)"))


@query(f"WITH {V.FILES} SELECT CASE WHEN starts_with(sha, '0') THEN 'missing-blob' ELSE 'size-mismatch' END AS \"check\", path AS subject FROM files WHERE size > 0 AND substr(sha, 1, 1) IN ('0', '1')")
def verify_size_mismatch(s, d):
    """Contents whose hash begins with 0 are lost, those with 1 have another size."""
    first = F.substring(F.lower(F.hex("sha")), 1, 1)
    b = V.blobs(s, d).where(first != "0").withColumn("size", F.col("size") + (first == "1").cast("long"))
    return maintenance.blob_problems(V.files(s, d), b)


@query(f"WITH {V.FILES}, r AS (SELECT path, size FROM files), {V.ROLLUP} SELECT k AS \"check\", '1:' || dir AS subject FROM rollup_, (VALUES ('dirs-extra'), ('dirs-missing')) t(k) WHERE depth = 1")
def verify_dirs_diff(s, d):
    """Stored directory rows of depth 1 count one byte too many."""
    f = V.files(s, d)
    stored = namespace.rollup(f, per_batch=True).withColumn("bytes", F.when(F.col("depth") == 1, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return maintenance.dirs_diff(f, stored)


@query(f"WITH {V.FILES} SELECT CASE m WHEN 0 THEN 'mode' WHEN 1 THEN 'dir' ELSE 'size' END AS \"check\", count(*) AS n FROM (SELECT doc_id % 10 AS m FROM files) WHERE m < 3 GROUP BY 1")
def verify_files(s, d):
    """Rows with a mode, a directory or a size that breaks the rules, by the last digit of the document."""
    digit = F.regexp_extract("name", r"(\d)\.txt$", 1)
    f = V.files(s, d).withColumns({"mode": F.when(digit == "0", 0o4644).otherwise(F.col("mode")), "dir": F.when(digit == "1", "elsewhere").otherwise(F.col("dir")), "size": F.when(digit == "2", -1).otherwise(F.col("size"))})
    return maintenance.file_problems(f).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS paths, sum(octet_length(encode(html)))::BIGINT AS bytes, count(*) > 50 OR sum(octet_length(encode(html))) > 1000000000 AS refused FROM pages WHERE regexp_matches(url, '/(en|fr)/[0-9]+')")
def raw_path_limits(s, d):
    """Staged paths that match raw patterns, against limits."""
    staged = V.table(s, d, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size"))
    return maintenance.over_limits(staged, [r"/(?P<lang>en|fr)/[0-9]+"], 50, 1_000_000_000)


@query("SELECT path, problem FROM (SELECT doc_id::VARCHAR AS path, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT conv_id * 2 FROM conversations) UNION ALL SELECT DISTINCT (conv_id * 2)::VARCHAR, 'undeclared' FROM conversations WHERE conv_id * 2 NOT IN (SELECT doc_id FROM documents))")
def inventory_diff(s, d):
    """All documents are declared; what is there is named after conversations."""
    declared = V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"))
    return maintenance.inventory_diff(declared, V.table(s, d, "conversations").select((F.col("conv_id") * 2).cast("string").alias("path")).distinct())


@query(f"WITH {V.FILES} SELECT count(*) AS rows, sum(size)::BIGINT AS logical_bytes, count(DISTINCT sha) FILTER (size > 0) AS blobs, (SELECT sum(b)::BIGINT FROM (SELECT any_value(size) AS b FROM files GROUP BY sha)) AS blob_bytes, count(DISTINCT sha) FILTER (size > 0) AS parts, count(DISTINCT sha) FILTER (size > 0) AS unique_parts, 0::BIGINT AS duplicate_parts, 0::BIGINT AS duplicate_bytes, 0::BIGINT AS unreferenced, 0::BIGINT AS unreferenced_bytes FROM files")
def storage_report(s, d):
    return maintenance.storage_report(V.files(s, d), V.blobs(s, d))


@query(f"WITH {V.FILES} SELECT sha, count(*) AS n FROM files WHERE size > 0 GROUP BY sha")
def referenced_shas(s, d):
    return hexed(maintenance.referenced(V.files(s, d)))


@query(f"WITH {V.HISTORY} SELECT sha, max(size) AS size FROM history WHERE size > 0 AND (path = 'd1' OR starts_with(path, 'd1/')) AND sha NOT IN (SELECT sha FROM history WHERE NOT (path = 'd1' OR starts_with(path, 'd1/'))) GROUP BY sha")
def private_blobs_anti(s, d):
    return hexed(maintenance.private_blobs(V.history(s, d), "d1"))


@query(f"WITH {V.VISIBLE}, g AS (SELECT * FROM history WHERE starts_with(path, 'd1/')), k AS (SELECT sha FROM history WHERE NOT starts_with(path, 'd1/')) SELECT count(*) AS paths, sum(size)::BIGINT AS bytes, count(DISTINCT batch) AS batches, (SELECT count(*) FROM visible WHERE starts_with(path, 'd1/')) AS latest_paths, (SELECT count(DISTINCT sha) FROM g WHERE size > 0 AND sha NOT IN (SELECT sha FROM k)) AS blobs, (SELECT coalesce(sum(z), 0)::BIGINT FROM (SELECT any_value(size) AS z FROM g WHERE size > 0 AND sha NOT IN (SELECT sha FROM k) GROUP BY sha)) AS blob_bytes, (SELECT count(*) FROM history WHERE NOT starts_with(path, 'd1/')) AS survivors FROM g")
def delete_plan(s, d):
    return maintenance.delete_plan(V.history(s, d), "d1")


@query("WITH RECURSIVE o AS (SELECT doc_id % 20 AS k, doc_id, octet_length(encode(text))::BIGINT AS n, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS i FROM documents), g(k, i, doc_id, chunk, filled) AS (SELECT k, i, doc_id, 0, n FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, o.doc_id, CASE WHEN g.filled + o.n > 20000 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN g.filled + o.n > 20000 THEN o.n ELSE g.filled + o.n END FROM g JOIN o ON o.k = g.k AND o.i = g.i + 1) SELECT k, doc_id, chunk::INTEGER AS chunk FROM g")
def greedy_cumulative(s, d):
    items = V.table(s, d, "documents").select((F.col("doc_id") % 20).alias("k"), "doc_id", F.octet_length("text").cast("long").alias("n"))
    return maintenance.greedy_chunks(items, "k", "doc_id", "n", 20000).select("k", "doc_id", "chunk")


@query("WITH f AS (SELECT l_orderkey % 50 AS pack, l_orderkey * 7 + l_linenumber AS \"offset\", l_quantity::BIGINT AS length FROM lineitem), e AS (SELECT *, coalesce(max(\"offset\" + length) OVER (PARTITION BY pack ORDER BY \"offset\", length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM f) SELECT pack, sum(greatest(0, \"offset\" - upto))::BIGINT AS gap, sum(greatest(0, least(upto, \"offset\" + length) - \"offset\"))::BIGINT AS overlap FROM e GROUP BY pack")
def frame_gaps(s, d):
    f = V.table(s, d, "lineitem").select((F.col("l_orderkey") % 50).alias("pack"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("offset"), F.col("l_quantity").cast("long").alias("length"))
    return maintenance.frame_gaps(f).groupBy("pack").agg(F.sum("gap").alias("gap"), F.sum("overlap").alias("overlap"))


# the relational surface users reach through SQL ---------------------------------------------------


def _sql(s, d, text, *tables):
    for t in tables:
        V.table(s, d, t).createOrReplaceTempView(t)
    return s.sql(text)


def relational(name: str, tables: tuple[str, ...], text: str, oracle: str | None = None) -> None:
    def run(s, d):
        return _sql(s, d, text, *tables)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or text


relational("join_inner_agg", ("orders", "customer", "nation"), "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
relational("join_left", ("customer", "orders"), "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
relational("join_full", ("supplier", "nation"), "SELECT n_name, s_name FROM supplier FULL OUTER JOIN nation ON s_nationkey + s_suppkey % 7 = n_nationkey")
relational("join_semi", ("orders", "lineitem"), "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority")
relational("join_anti", ("customer", "orders"), "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
relational("join_range", ("nation", "region"), "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey BETWEEN r_regionkey * 5 AND r_regionkey * 5 + 4")
relational("join_theta", ("nation", "region"), "SELECT a.r_name AS lo, b.r_name AS hi FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
relational("join_cross", ("nation", "region"), "SELECT r_name, n_name FROM region CROSS JOIN nation")
relational("window_rank", ("orders",), "SELECT o_orderkey, cast(row_number() OVER w AS bigint) AS rn, cast(rank() OVER v AS bigint) AS rk, cast(dense_rank() OVER v AS bigint) AS dr, cast(ntile(4) OVER w AS bigint) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
relational("window_lag_running", ("orders",), "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey, 2) OVER w AS next_key, first_value(o_orderkey) OVER w AS first_key, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
relational("rollup_cube", ("lineitem",), "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::TINYINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
relational("grouping_sets", ("lineitem",), "SELECT l_returnflag, l_linestatus, cast(sum(l_linenumber) AS bigint) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
relational("setops", ("customer", "supplier"), "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT 3 UNION ALL SELECT 99")
relational("setops_all", ("orders",), "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
relational("ordinals", ("lineitem",), "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1")
relational("top_k", ("orders",), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
relational("subqueries", ("orders", "customer"), "WITH big AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT c_custkey, m FROM customer JOIN big ON o_custkey = c_custkey WHERE m > (SELECT avg(m) FROM big) AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
relational("median_percentile", ("lineitem",), "SELECT l_returnflag, percentile(l_quantity, 0.5) AS med, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag")
relational("arg_max", ("orders",), "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS best FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best FROM orders GROUP BY o_custkey")
relational("string_agg", ("nation",), "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
relational("asof_join", ("events",), "SELECT event_id, last(CASE WHEN event_type = 'purchase' THEN event_id END, true) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
relational("map_unnest", ("documents",), "SELECT k, v, count(*) AS n FROM (SELECT explode(map('lang', lang, 'source', source)) AS (k, v) FROM documents) GROUP BY k, v", "SELECT k, v, count(*) AS n FROM (SELECT unnest(['lang', 'source']) AS k, unnest([lang, source]) AS v FROM documents) GROUP BY k, v")
relational("tumbling_counts", ("events",), "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY event_type, date_trunc('hour', ts)")
relational("approx_distinct", ("lineitem",), "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey) AS close FROM lineitem GROUP BY l_returnflag")


def approx_distinct(s, d):
    """That SQL as two aggregates: in one, each distinct key of a group would carry the registers of the estimate."""
    rows = V.table(s, d, "lineitem").select("l_returnflag", "l_partkey")
    exact = rows.where("l_partkey is not null").distinct().groupBy(F.col("l_returnflag").alias("f")).agg(F.count(F.lit(1)).alias("exact"))
    near = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("near"))
    both = near.join(exact, F.col("l_returnflag").eqNullSafe(F.col("f")), "left").withColumn("exact", F.coalesce("exact", F.lit(0).cast("long")))
    return both.select("l_returnflag", "exact", (F.abs(F.col("near") - F.col("exact")) <= 0.2 * F.col("exact")).alias("close"))


QUERIES["approx_distinct"] = approx_distinct
relational("window_nth_range", ("orders",), "SELECT o_orderkey, last_value(o_orderkey) OVER f AS last_key, nth_value(o_orderkey, 2) OVER f AS second_key, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
relational("join_hints", ("customer", "nation", "region"), "SELECT /*+ MERGE(nation), BROADCAST(region) */ r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
relational("text_functions", ("part",), "SELECT p_partkey, upper(p_name) AS up, substr(p_type, 2, 5) AS mid, length(p_name) AS n, replace(p_brand, '#', '-') AS brand, p_name LIKE '%a%' AS has_a, concat(p_brand, '/', p_type) AS both, md5(p_name) AS digest, trim(lpad(p_brand, 20, ' ')) AS padded FROM part", "SELECT p_partkey, upper(p_name) AS up, substr(p_type, 2, 5) AS mid, length(p_name)::INTEGER AS n, replace(p_brand, '#', '-') AS brand, p_name LIKE '%a%' AS has_a, concat(p_brand, '/', p_type) AS both, md5(p_name) AS digest, trim(lpad(p_brand, 20, ' ')) AS padded FROM part")
relational("json_functions", ("events",), "SELECT event_id, get_json_object(props, '$.k') AS k, cast(get_json_object(props, '$.k') AS int) % 7 AS week, get_json_object(props, '$.none') AS none FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k')::INTEGER % 7 AS week, json_extract_string(props, '$.none') AS none FROM events")
relational("date_functions", ("orders",), "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofyear(o_orderdate) AS doy, date_format(o_orderdate, 'yyyy-MM-dd') AS d, datediff(o_orderdate, timestamp_ntz'1992-01-01') AS days FROM orders", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, dayofyear(o_orderdate)::INTEGER AS doy, strftime(o_orderdate, '%Y-%m-%d') AS d, (o_orderdate::DATE - DATE '1992-01-01')::INTEGER AS days FROM orders")
