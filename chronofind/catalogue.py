"""The engine's registered queries over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofind.functions import scalars as S
from chronofind.functions.analyzer import path_tokens, simple_tokens
from chronofind.operators import highlight, history, rank
from chronofind.operators.items import analysed, indexable, prepared
from chronofind.operators.search import Index, by_path, hits, page, revision_filter
from chronofind.plans.parser import parse
from chronofind.sources import export
from chronofind.sources.store import Store
from chronofind.sources.terms import StoredIndex
from chronofind.streaming import updates

HEAD = S.HEAD
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# documents and pages as items


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    size = (F.col("n_chars") * F.pow(F.lit(8), F.col("doc_id") % 7).cast("long")).alias("size_bytes")
    props = F.create_map(F.lit("lang"), F.col("lang"))
    message = F.concat_ws(" ", "source", "lang")
    return read(spark, sf_dir, "documents").select(
        path.alias("id"), path.alias("path"), F.col("text").alias("content"), F.col("source").alias("author"), F.concat(F.lit("text/"), "lang").alias("mime"), size, props.alias("props"), message.alias("message")
    )


_STORED: dict[tuple, Store] = {}


def _state(spark: SparkSession, sf_dir: str, table: str) -> tuple:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [path, *(f.getPath() for f in files.listStatus(path))]
    state = tuple(sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in map(files.getFileStatus, found)))
    return spark.sparkContext.applicationId, table, state


def stored_index(spark: SparkSession, sf_dir: str, table: str, rows: Callable[[SparkSession, str], DataFrame], **options) -> StoredIndex:
    """The index of a table, made when it is first asked in a session and anew when the table's files have changed; its terms are made
    when a query first goes by them."""
    key = _state(spark, sf_dir, table)
    if key not in _STORED:
        store = Store(spark, f"{work_dir(spark)}/{table}", buckets=8)
        store.upsert(prepared(rows(spark, sf_dir)), persist=False)
        _STORED[key] = store
    return StoredIndex(_STORED[key], with_terms=True, **options)


def docs_index(spark: SparkSession, sf_dir: str, **options) -> Index:
    return stored_index(spark, sf_dir, "documents", documents, **options)


def docs_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as items, for what reads each of them: those of the index if the session has it, else of the table; to make an
    index for one reading would write everything once more."""
    stored = _STORED.get(_state(spark, sf_dir, "documents"))
    return analysed(documents(spark, sf_dir)) if stored is None else stored.items()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://[^/]+", "")
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), path.alias("path"), F.col("url").alias("externals"), F.col("html").alias("content"))


def pages_index(spark: SparkSession, sf_dir: str, **options) -> Index:
    return stored_index(spark, sf_dir, "pages", pages, **options)


# SQL pieces

_UP = "replace(upper(replace(coalesce({0}, ''), 'ß', chr(57344))), chr(57344), 'ß')"
_SIMPLE = "list_transform(regexp_extract_all(" + _UP + r", '[\p{{L}}\p{{Nd}}_]+'), lambda t: substr(t, 1, 127))"
_PATH = "list_transform(regexp_extract_all(" + _UP.replace("coalesce({0}, '')", r"replace(coalesce({0}, ''), '\', '/')") + r", '[:^]|\.[^\s\p{{Z}}/.:^]*/?|[^\s\p{{Z}}/.:^]+/?|/'), lambda t: substr(t, 1, 127))"
_DOC_PATH = "'/' || source || '/' || lang || '/doc_' || doc_id || '.txt'"
_SIZE = "CAST(n_chars * CAST(pow(8, doc_id % 7) AS BIGINT) AS BIGINT)"
_DOCS = f"(SELECT {_DOC_PATH} AS id, {_DOC_PATH} AS path, text, source, lang, doc_id, n_chars, {_SIZE} AS size, {_SIMPLE.format('text')} AS tk FROM documents)"
_PAGE_PATH = "regexp_replace(url, '^[a-z]+://[^/]+', '')"
_PAGES = f"(SELECT CAST(page_id AS VARCHAR) AS id, {_PATH.format(_PAGE_PATH)} AS tk, {_PATH.format('url')} AS ex FROM pages)"


def has(t: str, of: str = "tk") -> str:
    return f"list_contains({of}, '{t}')"


def follows(tests: list[str], of: str = "tk") -> str:
    """SQL: some place of the list where each test on `x` holds for the tokens in turn."""
    body = " AND ".join("(" + re.sub(r"\bx\b", f"{of}[i + {k}]", t) + ")" for k, t in enumerate(tests))
    return f"len(list_filter(generate_series(1, len({of})), lambda i: {body})) > 0"


def _search(name: str, text: str, where: str, index=docs_index, source: str = _DOCS, **options) -> None:
    query(name, f"SELECT id FROM {source} WHERE {where}")(lambda spark, sf_dir: index(spark, sf_dir, **options).query(text).select("id"))


_search("term_content", "c:the", has("THE"))
_search("term_must_must", "c:(the of)", f"{has('THE')} AND {has('OF')}")
_search("term_should", "c:(#la #und)", f"{has('LA')} OR {has('UND')}")
_search("term_must_not", "c:(the -of)", f"{has('THE')} AND NOT {has('OF')}")
_search("nested_group", "c:(#(in -by) #(la #en))", f"({has('IN')} AND NOT {has('BY')}) OR {has('LA')}")
_search("should_with_must", "c:(#nowhere the)", has("THE"))
# strict=False: the wildcard stands for more than a thousand terms of the larger tables
_search("wildcard_star", "c:th*on", "len(list_filter(tk, lambda t: regexp_full_match(t, 'TH.*ON'))) > 0", strict=False)
_search("wildcard_question", "c:t?e", "len(list_filter(tk, lambda t: regexp_full_match(t, 'T.E'))) > 0")
_search("mime_wildcard", "t:text/?e", "regexp_full_match('text/' || lang, 'text/.e')")
_search("phrase_exact", 'c:"of the"', follows(["x = 'OF'", "x = 'THE'"]))
_search("phrase_three", 'c:"and of the"', follows(["x = 'AND'", "x = 'OF'", "x = 'THE'"]))
_search("phrase_wildcard", 'c:"the th*n"', follows(["x = 'THE'", "regexp_full_match(x, 'TH.*N')"]), strict=False)
_search("gap_star", 'c:"the * of"', "len(list_filter(generate_series(1, len(tk)), lambda i: tk[i] = 'THE' AND list_contains(tk[i + 1 : i + 2], 'OF'))) > 0")
_search("gap_double_star", 'c:"the ** by"', "len(list_filter(generate_series(1, len(tk)), lambda i: tk[i] = 'THE' AND list_contains(tk[i + 1 : i + 101], 'BY'))) > 0")
_search("gap_mixed", 'c:"of the * and"', "len(list_filter(generate_series(1, len(tk)), lambda i: tk[i] = 'OF' AND tk[i + 1] = 'THE' AND list_contains(tk[i + 2 : i + 3], 'AND'))) > 0")
_search("path_root", "p:/en/", follows(["x = '/'", "x = 'EN/'"]), pages_index, _PAGES)
_search("path_folder", "p:fr/", has("FR/") + " OR " + has(".FR/"), pages_index, _PAGES)
_search("path_extension", "p:.html", has(".HTML") + " OR " + has(".HTML/"), pages_index, _PAGES)
_search("path_variants", "p:html", " OR ".join(has(t) for t in ("HTML", ".HTML", "HTML/", ".HTML/")), pages_index, _PAGES)
_search("path_gap", 'p:"en/ * .html"', "len(list_filter(generate_series(1, len(tk)), lambda i: tk[i] IN ('EN/', '.EN/') AND (list_contains(tk[i + 1 : i + 2], '.HTML') OR list_contains(tk[i + 1 : i + 2], '.HTML/')))) > 0", pages_index, _PAGES)
_search("externals_host", "x:example.com", follows(["x IN ('EXAMPLE', '.EXAMPLE')", "x IN ('.COM', '.COM/')"], "ex"), pages_index, _PAGES)
_search("content_or_path", "en", f"{has('EN')} OR len(list_filter({_PATH.format('path')}, lambda t: t IN ('EN', '.EN', 'EN/', '.EN/'))) > 0")
_search("property_field", "lang:de", "lang = 'de'")
_search("author_term", "a:src3", "source = 'src3'")
_search("message_term", "m:de", "lang = 'de'")


@query("hit_count", f"SELECT count(*) AS hits FROM {_DOCS} WHERE {has('THE')}")
def hit_count(spark, sf_dir):
    return docs_index(spark, sf_dir).query("c:the").agg(F.count("*").alias("hits"))


@query("hit_by_id", f"SELECT id, source AS author FROM {_DOCS} WHERE doc_id = 7")
def hit_by_id(spark, sf_dir):
    index = docs_index(spark, sf_dir)
    row = index.items.filter(F.col("path").endswith("/doc_7.txt")).select("id").first()
    hit = index.hit_by_id(row[0])
    return spark.createDataFrame([(hit["id"], hit["author"])], "id string, author string")


# history over the event log

_KINDS = {"signup": "Add", "view": "Modify", "click": "Modify", "purchase": "Replace", "error": "Delete"}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return read(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).cast("int").alias("revision"), F.try_element_at(kind, F.col("event_type")).alias("change"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.lit(False).alias("is_copy")
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.intervals(event_log(spark, sf_dir)).select("path", "rev_first", "rev_last")


_VERSIONS = f"""(SELECT path, rev_first, rev_last FROM (
  SELECT '/u/' || user_id AS path, CAST(event_id + 1 AS INTEGER) AS rev_first, event_type,
         CAST(coalesce(lead(event_id + 1) OVER (PARTITION BY user_id ORDER BY event_id) - 1, {HEAD}) AS INTEGER) AS rev_last
  FROM events) WHERE event_type <> 'error')"""


def _versions(name: str, where: str, first: int | None = None, last: int | None = None) -> None:
    def run(spark, sf_dir):
        test = None if first is None else revision_filter(first, last)
        rows = versions(spark, sf_dir)
        return rows if test is None else rows.filter(test)

    query(name, f"SELECT path, rev_first, rev_last FROM {_VERSIONS} WHERE {where}")(run)


_versions("intervals", "true")
_versions("rev_all", "true", S.ALL)
_versions("single_revision", f"rev_last = {HEAD}", HEAD)
_versions("rev_head", f"rev_last = {HEAD}", HEAD, 5)
_versions("rev_at", "rev_last >= 300 AND rev_first <= 300", 300)
_versions("rev_range", "rev_last >= 100 AND rev_first <= 200", 100, 200)


@query("live_counts", f"SELECT path, count(*) AS versions, count(*) FILTER (rev_last = {HEAD}) AS live FROM {_VERSIONS} GROUP BY path")
def live_counts(spark, sf_dir):
    return versions(spark, sf_dir).groupBy("path").agg(F.count("*").alias("versions"), F.count_if(F.col("rev_last") == HEAD).alias("live"))


@query("highest_revision", f"SELECT path, CAST(CASE WHEN arg_max(rev_last, rev_first) = {HEAD} THEN max(rev_first) ELSE 0 END AS INTEGER) AS revision FROM {_VERSIONS} GROUP BY path")
def highest_revision(spark, sf_dir):
    return history.highest_revision(versions(spark, sf_dir))


@query("as_of_revisions", f"SELECT r.revision, v.path, v.rev_first FROM {_VERSIONS} v JOIN (SELECT unnest([100, 400, 900]) AS revision) r ON r.revision BETWEEN v.rev_first AND v.rev_last")
def as_of_revisions(spark, sf_dir):
    wanted = spark.createDataFrame([(100,), (400,), (900,)], "revision int")
    return history.as_of(versions(spark, sf_dir), wanted).select("revision", "path", "rev_first")


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select((F.regexp_extract("path", r"doc_(\d+)", 1).cast("int") + 1).alias("revision"), F.lit("Add").alias("change"), "path", F.lit(False).alias("is_copy"))


@query("children", f"SELECT '/' || source AS parent, {_DOC_PATH} AS child FROM documents")
def children(spark, sf_dir):
    docs = documents(spark, sf_dir)
    parents = docs.select(F.concat(F.lit("/"), "author", F.lit("/")).alias("path")).distinct()
    return history.children(docs.select("path"), parents).select(F.col("path").alias("parent"), "child")


@query("delete_expansion", f"SELECT path, CAST(doc_id + 1 AS INTEGER) AS rev_first, CAST(CASE WHEN source = 'src3' AND doc_id < 149 THEN 149 ELSE {HEAD} END AS INTEGER) AS rev_last FROM {_DOCS} WHERE NOT (source = 'src3' AND doc_id + 1 > 149 AND doc_id + 1 < 150)")
def delete_expansion(spark, sf_dir):
    gone = spark.createDataFrame([(150, "Delete", "/src3", False)], "revision int, change string, path string, is_copy boolean")
    return history.intervals(history.expand_deletes(_added(spark, sf_dir).unionByName(gone))).select("path", "rev_first", "rev_last")


@query("copy_expansion", f"SELECT 900000 AS revision, 'Add' AS change, '/copy' || path AS path FROM {_DOCS} WHERE source = 'src2' UNION ALL SELECT 900000, 'Add', '/copy/src2'")
def copy_expansion(spark, sf_dir):
    made = spark.createDataFrame([(900000, "Add", "/copy/src2", True)], "revision int, change string, path string, is_copy boolean")
    listing = documents(spark, sf_dir).select(F.lit(900000).alias("revision"), F.concat(F.lit("/copy"), "path").alias("path"))
    return history.expand_copies(made, listing).select("revision", "change", "path")


# tokens and statistics


@query("tokens_simple", f"SELECT id, CAST(len(tk) AS INTEGER) AS n, array_to_string(tk, ' ') AS tokens FROM {_DOCS}")
def tokens_simple(spark, sf_dir):
    t = simple_tokens(F.col("content"))
    return documents(spark, sf_dir).select("id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


@query("tokens_path", f"SELECT id, array_to_string(ex, ' ') AS tokens FROM {_PAGES}")
def tokens_path(spark, sf_dir):
    return pages(spark, sf_dir).select("id", F.array_join(path_tokens(F.col("externals")), " ").alias("tokens"))


@query("term_cap", f"SELECT id, array_to_string(list_slice(tk, 1, 50), ' ') AS tokens FROM {_DOCS}")
def term_cap(spark, sf_dir):
    return documents(spark, sf_dir).select("id", F.array_join(simple_tokens(F.col("content"), 50), " ").alias("tokens"))


@query("postings", f"""SELECT term, id, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos - 1 AS VARCHAR), ' ' ORDER BY pos) AS positions
FROM (SELECT id, unnest(tk) AS term, generate_subscripts(tk, 1) AS pos FROM {_DOCS}) GROUP BY term, id""")
def postings(spark, sf_dir):
    rows = rank.postings(docs_items(spark, sf_dir), ("content",))
    return rows.select("term", "id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions"))


@query("term_stats", f"SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT id, unnest(tk) AS term FROM {_DOCS}) GROUP BY term")
def term_stats(spark, sf_dir):
    return rank.term_stats(docs_items(spark, sf_dir))


def _tfidf(t: str) -> str:
    return f"sqrt(len(list_filter(tk, lambda x: x = '{t}'))) * pow(1 + ln((SELECT count(*) FROM documents) / ((SELECT count(*) FROM {_DOCS} WHERE {has(t)}) + 1.0)), 2)"


@query("rank_tfidf", f"SELECT id, round(({_tfidf('LA')} + {_tfidf('UND')}) / sqrt(len(tk)), 6) AS score FROM {_DOCS} WHERE {has('LA')} OR {has('UND')}")
def rank_tfidf(spark, sf_dir):
    return rank.ranked(docs_items(spark, sf_dir), ["LA", "UND"]).select("id", F.round("score", 6).alias("score"))


# hits

_PACKED = "CASE WHEN size < 1024 THEN 'b' || printf('%03X', size) WHEN size < 1048576 THEN 'k' || printf('%03X', size >> 10) WHEN size < 1073741824 THEN 'm' || printf('%03X', size >> 20) ELSE 'z001' END"
_UNPACKED = "CASE WHEN size < 1024 THEN size WHEN size < 1048576 THEN ((size >> 10) + 1) * 1024 - 1 WHEN size < 1073741824 THEN ((size >> 20) + 1) * 1048576 - 1 ELSE 2147483647 END"


def _shown(s: str) -> str:
    return f"CASE WHEN {s} < 1024 THEN {s} || ' bytes' WHEN {s} < 1048576 THEN ({s} >> 10) || ' kb' WHEN {s} < 1073741824 THEN ({s} >> 20) || ' mb' ELSE ({s} >> 30) || ' gb' END"


@query("packed_size", f"SELECT id, {_PACKED} AS packed FROM {_DOCS}")
def packed_size(spark, sf_dir):
    return documents(spark, sf_dir).select("id", S.packed_size(F.col("size_bytes")).alias("packed"))


@query("size_display", f"SELECT id, {_shown('size')} AS shown FROM {_DOCS}")
def size_display(spark, sf_dir):
    return documents(spark, sf_dir).select("id", S.size_display(F.col("size_bytes")).alias("shown"))


@query("size_unpack", f"SELECT id, CAST({_UNPACKED} AS BIGINT) AS size FROM {_DOCS}")
def size_unpack(spark, sf_dir):
    return documents(spark, sf_dir).select("id", S.unpacked_size(S.packed_size(F.col("size_bytes"))).alias("size"))


@query("hit_projection", f"SELECT id, '/' || source || '/' || lang AS folder, 'doc_' || doc_id || '.txt' AS file, source AS author, 'head' AS rev_first, u AS size_in_bytes, {_shown('u')} AS size FROM (SELECT *, CAST({_UNPACKED} AS BIGINT) AS u FROM {_DOCS})")
def hit_projection(spark, sf_dir):
    return hits(docs_items(spark, sf_dir)).select("id", "folder", "file", "author", "rev_first", "size_in_bytes", "size")


@query("pretty_revision", f"SELECT path, rev_first, CASE WHEN rev_last = {HEAD} THEN 'head' ELSE CAST(rev_last AS VARCHAR) END AS last, printf('%08d', rev_first) AS packed FROM {_VERSIONS}")
def pretty_revision(spark, sf_dir):
    return versions(spark, sf_dir).select("path", "rev_first", S.pretty_revision(F.col("rev_last")).alias("last"), S.revision_text(F.col("rev_first")).alias("packed"))


@query("page_two", f"SELECT id FROM {_DOCS} WHERE {has('THE')} ORDER BY lower(path), id LIMIT 16 OFFSET 16")
def page_two(spark, sf_dir):
    return page(docs_index(spark, sf_dir).query("c:the"), 1).select("id")


@query("export_tsv", f"""SELECT path AS "Path", 'doc_' || doc_id || '.txt' AS "File", source AS "Author", CAST(NULL AS VARCHAR) AS "Modified", 'head' AS "Revision", CAST({_UNPACKED} AS BIGINT) AS "Size" FROM {_DOCS} WHERE {has('UND')}""")
def export_tsv(spark, sf_dir):
    return export.export_rows(docs_index(spark, sf_dir).query("c:und"))


@query("export_targets", f"SELECT 'http://example.org/repo' || path AS target FROM {_DOCS} WHERE {has('UND')}")
def export_targets(spark, sf_dir):
    return export.target_rows(docs_index(spark, sf_dir).query("c:und"), "http://example.org/repo")


@query("indexable", f"SELECT id, size > 0 AND size <= 1048576 AND (lang <> 'fr' OR doc_id % 2 = 0) AS yes FROM {_DOCS}")
def is_indexable(spark, sf_dir):
    even = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long") % 2 == 0
    path = F.regexp_replace("path", r"\.txt$", ".bin")
    mime = F.when((F.col("mime") == "text/fr") & ~even, F.lit("image/png")).when(F.col("mime") != "text/de", F.lit("text/plain"))
    return documents(spark, sf_dir).select("id", indexable(path, F.col("size_bytes"), F.lit(False), mime).alias("yes"))


@query("path_filter", f"SELECT path FROM {_DOCS} WHERE NOT regexp_matches(path, '/e[ns]/')")
def path_filter(spark, sf_dir):
    return history.path_filter(documents(spark, sf_dir).select("path"), "/e[ns]/")


@query("brush", "SELECT page_id, CASE WHEN regexp_full_match(x, '(?i)c|h|hpp|cpp|inl') THEN 'Cpp' WHEN regexp_full_match(x, '(?i)(.*ml)|(.*proj)|(targets)') THEN 'Xml' ELSE 'Plain' END AS brush FROM (SELECT page_id, list_extract(string_split('a/b.' || CASE page_id % 4 WHEN 0 THEN 'HPP' WHEN 1 THEN 'html' WHEN 2 THEN 'csproj' ELSE 'txt' END, '.'), -1) AS x FROM pages)")
def brush(spark, sf_dir):
    ends = F.get(F.array(*map(F.lit, ("HPP", "html", "csproj", "txt"))), (F.col("page_id") % 4).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", S.brush(F.concat(F.lit("a/b."), ends)).alias("brush"))


@query("uri_building", f"SELECT page_id, 'http://example.org/repo' || replace(replace(replace({_PAGE_PATH}, '?', '%3F'), '=', '%3D'), '&', '%26') AS uri FROM (SELECT page_id, split_part(url, '#', 1) AS url FROM pages)")
def uri_building(spark, sf_dir):
    path = F.regexp_replace(F.substring_index("url", "#", 1), r"^[a-z]+://[^/]+", "")
    return read(spark, sf_dir, "pages").select("page_id", S.uri(F.lit("http://example.org/repo"), path).alias("uri"))


@query("html_encode", "SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM pages")
def html_encode(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.html_encode(F.col("url")).alias("html"))


_SHOWN = "array_to_string(list_transform(regexp_extract_all(x, '[\\p{L}\\p{Nd}_]+|[^\\p{L}\\p{Nd}_]+'), lambda w: CASE WHEN upper(w) IN ('UND', 'SCHUNGVER') THEN '<B>' || w || '</B>' ELSE replace(replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') END), '')"
_LINES = f"""
WITH line AS (
  SELECT id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM (SELECT id, string_split(text, chr(10)) AS ls FROM {_DOCS} WHERE {has('UND')})
), scored AS (
  SELECT *, len(list_distinct(list_filter(list_transform(regexp_extract_all(x, '[\\p{{L}}\\p{{Nd}}_]+'), lambda w: upper(w)), lambda w: w IN ('UND', 'SCHUNGVER')))) AS s FROM line
), best AS (SELECT id, i, n FROM scored WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, i) <= 3),
near AS (SELECT DISTINCT id, unnest(generate_series(greatest(0, i - 2), least(n - 1, i + 2))) AS i FROM best),
told AS (
  SELECT id, i, n, {_SHOWN} AS shown, lag(i) OVER (PARTITION BY id ORDER BY i) AS before, len(CAST(max(i) OVER (PARTITION BY id) AS VARCHAR)) AS digits FROM near JOIN line USING (id, i)
)
SELECT id, string_agg(CASE WHEN before <> i - 1 THEN ' .. ' || chr(10) ELSE '' END || '<span class=''line''>L' || lpad(CAST(i + 1 AS VARCHAR), CAST(greatest(digits, len(CAST(i + 1 AS VARCHAR))) AS INTEGER), '0') || ': </span>' || shown || CASE WHEN i < n - 1 THEN chr(10) ELSE '' END, '' ORDER BY i) AS fragment
FROM told GROUP BY id
"""


@query("highlight_lines", _LINES)
def highlight_lines(spark, sf_dir):
    shown = highlight.LineHighlight(parse("c:(und #schungver)")).fragments(F.col("content"))
    return by_path(docs_index(spark, sf_dir).query("c:und")).select("id", shown.alias("fragment"))


@query("highlight_simple")
def highlight_simple(spark, sf_dir):
    shown = highlight.SimpleHighlight(parse("c:und")).fragments(F.col("content"))
    return by_path(docs_index(spark, sf_dir).query("c:und")).select("id", shown.alias("fragment"))


# the stored index, kept by a stream


def work_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="work-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


@query("stream_replay", ORACLES["intervals"])
def stream_replay(spark, sf_dir):
    root = work_dir(spark)
    log = event_log(spark, sf_dir).groupBy("revision").agg(F.collect_list(F.struct("change", "path", "is_copy")).alias("changes"))
    log = log.select("revision", F.lit("").alias("author"), F.lit(None).cast("timestamp").alias("ts"), F.lit("").alias("message"), "changes")
    half = event_log(spark, sf_dir).agg(F.max("revision")).first()[0] // 2
    store = Store(spark, f"{root}/index", buckets=8)
    # the stream is started again for the second half: what a start finds is one batch, in as many files as tasks wrote it
    for part in (log.filter(F.col("revision") <= half), log.filter(F.col("revision") > half)):
        part.write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/log")
        updates.run(spark, stream, store, f"{root}/checkpoint").awaitTermination()
    return store.items().filter("kind = 'item'").select("path", "rev_first", "rev_last")
