import glob
import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from chronofind import catalogue, cli, further
from chronofind.cache import ResultCache
from chronofind.functions import scalars as S
from chronofind.operators import highlight, history, rank
from chronofind.operators.items import analysed, from_properties, indexable, prepared
from chronofind.operators.search import HEAD, Index
from chronofind.plans.compiler import TooManyTerms
from chronofind.plans.parser import parse
from chronofind.sources.store import Locked, Store, open_stores
from chronofind.sources.terms import StoredIndex, index_terms
from chronofind.streaming import updates

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("size", "packed", "largest"), [(0, "b000", 0), (999, "b3E7", 999), (1023, "b3FF", 1023), (1024, "k001", 2047), (2**20 - 1, "k3FF", 2**20 - 1), (2**20, "m001", 2**21 - 1), (2**30 - 1, "m3FF", 2**30 - 1), (2**30, "z001", 2**31 - 1)])
def test_packed_sizes(spark, size, packed, largest):
    c = F.lit(size).cast("long")
    assert one(spark, S.packed_size(c)) == packed and one(spark, S.unpacked_size(F.lit(packed))) == largest


def test_scalars(spark):
    assert one(spark, S.unpacked_size(F.lit(None).cast("string"))) == 0
    with pytest.raises(Exception, match="bad packed size"):
        one(spark, S.unpacked_size(F.lit("q001")))
    assert one(spark, S.size_display(F.lit(5 << 20))) == "5 mb" and one(spark, S.pretty_revision(F.lit(S.HEAD))) == "head"
    assert one(spark, S.folder(F.lit("$Revision 3"))) is None and one(spark, S.file_name(F.lit("/a/b.c"))) == "b.c"
    assert one(spark, S.uri(F.lit("http://h"), F.lit("/a b/c#"))) == "http://h/a%20b/c%23"
    assert one(spark, S.brush(F.lit("x.CPP"))) == "Cpp" and one(spark, S.brush(F.lit("x.csproj"))) == "Xml" and one(spark, S.brush(F.lit("x"))) == "Plain"
    assert one(spark, S.change_text(F.lit("Add"), F.lit("/a"), F.lit(3))) == "Add    /a@3"


def test_indexable(spark):
    rows = spark.createDataFrame([("/a.bin", 5, False, None), ("/a.bin", 5, False, "image/png"), ("/a.CPP", 5, False, "image/png"), ("/a", 0, False, None), ("/a", 2**21, False, None), ("/a", 5, True, None)], "path string, size long, dir boolean, mime string")
    assert [r[0] for r in rows.select(indexable(F.col("path"), F.col("size"), F.col("dir"), F.col("mime"))).collect()] == [True, False, True, False, False, False]


def log(spark, rows):
    return spark.createDataFrame([(*r, False) for r in rows], "revision int, change string, path string, is_copy boolean")


LOG = [(1, "Add", "/d"), (1, "Add", "/d/a"), (2, "Add", "/d/e/b"), (3, "Modify", "/d/a"), (5, "Delete", "/d"), (6, "Add", "/d/a"), (7, "Delete", "/never")]
VERSIONS = {("/d", 1, 4), ("/d/a", 1, 2), ("/d/a", 3, 4), ("/d/e/b", 2, 4), ("/d/a", 6, S.HEAD)}


def test_history(spark):
    got = history.intervals(history.expand_deletes(log(spark, LOG))).select("path", "rev_first", "rev_last")
    assert {tuple(r) for r in got.collect()} == VERSIONS
    assert {tuple(r) for r in history.highest_revision(got).collect()} == {("/d", 0), ("/d/a", 6), ("/d/e/b", 0)}
    with pytest.raises(Exception, match="unknown change"):
        history.intervals(log(spark, [(1, "Move", "/x")])).collect()
    copied = history.expand_copies(spark.createDataFrame([(9, "Add", "/c", True), (9, "Delete", "/c/x", False)], "revision int, change string, path string, is_copy boolean"), spark.createDataFrame([(9, "/c/x"), (9, "/c/y/z"), (8, "/c/q")], "revision int, path string"))
    assert {(r.change, r.path) for r in copied.collect()} == {("Add", "/c"), ("Delete", "/c/x"), ("Add", "/c/y/z")}


def test_incremental_equals_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"), buckets=4)
    changes = log(spark, LOG).groupBy("revision").agg(F.collect_list(F.struct("change", "path", "is_copy")).alias("changes"))
    revisions = changes.select("revision", F.lit("me").alias("author"), F.lit(None).cast("timestamp").alias("ts"), F.lit("a message").alias("message"), "changes")
    for a, b in ((1, 2), (3, 3), (4, 5), (4, 5), (6, 9)):
        with store.writing():
            updates.apply_batch(store, revisions.filter(F.col("revision").between(a, b)))
    items = store.items()
    assert {tuple(r) for r in items.filter("kind = 'item'").select("path", "rev_first", "rev_last").collect()} == VERSIONS
    assert items.filter("kind = 'revision'").count() == 6 and store.properties()["revision"] == 7
    store.compact()
    store.set_properties(repository_name="x")
    assert [s.root for s in open_stores(spark, [str(tmp_path), str(tmp_path / "none")])] == [store.root]
    assert store.items().count() == items.count() and store.properties()["repository_name"] == "x"


def test_as_of_meets_every_revision_once(spark):
    rng = random.Random(1)
    items = [(f"/p{i}", a, rng.choice([a, a + rng.randint(0, 900), S.HEAD])) for i, a in enumerate(rng.choices(range(1, 1000), k=150))]
    wanted = sorted(rng.sample(range(1, 2000), 60)) + [S.HEAD]
    got = history.as_of(spark.createDataFrame(items, "path string, rev_first int, rev_last int"), spark.createDataFrame([(r,) for r in wanted], "revision int"))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert sorted((r.path, r.revision) for r in got.collect()) == sorted((p, r) for p, a, b in items for r in wanted if a <= r <= b)


def test_postings_group_inside_the_row(spark):
    rows = [("1", ["B", "A", "B"]), ("2", []), ("3", ["A"])]
    items = spark.createDataFrame(rows, "id string, content_tokens array<string>")
    got = rank.postings(items, ("content",))
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert sorted((r.term, r.id, r.tf, r.positions) for r in got.collect()) == [("A", "1", 1, [1]), ("A", "3", 1, [0]), ("B", "1", 2, [0, 2])]
    assert sorted(map(tuple, rank.term_stats(items).collect())) == [("A", 2, 2), ("B", 1, 2)]


def test_one_writer(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    with store.writing():
        with pytest.raises(Locked, match=str(os.getpid())):
            with store.writing():
                pass
        # a lock that its writer has left is taken over, and not taken away by the old one
        with store.writing(stale=-1):
            pass
    with store.writing():
        pass
    assert not (tmp_path / "index" / "_lock").exists()


def test_folder_copies_and_late_revisions(spark, tmp_path):
    log = [
        (1, [("Add", "/t", False, None, None), ("Add", "/t/a", False, None, None), ("Add", "/t/d/b", False, None, None)]),
        (2, [("Modify", "/t/a", False, None, None)]),
        (3, [("Add", "/b", True, "/t", 1), ("Delete", "/b/d/b", False, None, None), ("Add", "/tags/v", True, "/t", 2)]),
        (5, [("Replace", "/b", True, "/t/", None)]),
    ]
    df = spark.createDataFrame([(r, "", None, "", c) for r, c in log], further.REVISIONS)
    want = {("/t", 1, S.HEAD), ("/t/a", 1, 1), ("/t/a", 2, S.HEAD), ("/t/d/b", 1, S.HEAD), ("/b", 3, 4), ("/b/a", 3, 4), ("/b", 5, S.HEAD), ("/b/a", 5, S.HEAD), ("/b/d/b", 5, S.HEAD)}
    for n, cuts in enumerate(((0, 9), (0, 2, 9), (0, 1, 3, 9))):
        store = Store(spark, str(tmp_path / f"index{n}"), buckets=2)
        for a, b in zip(cuts, cuts[1:]):
            updates.apply_batch(store, df.filter(F.col("revision").between(a + 1, b)))
        assert {tuple(r) for r in store.items().filter("kind = 'item'").select("path", "rev_first", "rev_last").collect()} == want
        assert not any((tmp_path / f"index{n}" / "work").glob("*"))
    with pytest.raises(updates.LateRevision, match="revision 4 comes after revision 5"):
        updates.apply_batch(store, spark.createDataFrame([(4, "", None, "", log[1][1])], further.REVISIONS))
    assert updates.apply_batch(store, df) == 5


def test_relevance_and_wildcard_limit(spark):
    rows = [(f"/{i}", " ".join([f"w{i}x{j}" for j in range(600)] + ["owl"] * i)) for i in range(3)]
    index = Index(analysed(spark.createDataFrame(rows, "path string, content string")))
    assert [r.path for r in index.by_relevance("c:owl").collect()] == ["/2", "/1"]
    with pytest.raises(TooManyTerms):
        index.query("c:w*")
    assert index.query("c:w1*").count() == 1


def test_highlight(spark):
    text = "one\ntwo needle <b>\nthree\nfour\nfive\nsix\nseven\neight needle"
    tree = parse("c:needle")
    lines = one(spark, highlight.LineHighlight(tree, around=1).fragments(F.lit(text)))
    assert lines.startswith("<span class='line'>L1: </span>one\n<span class='line'>L2: </span>two <B>needle</B> &lt;b&gt;\n") and lines.endswith("L8: </span>eight <B>needle</B>")
    assert "two <B>needle</B> &lt;" in lines and " .. " in lines and "L8: " in lines and "five" not in lines
    assert one(spark, highlight.LineHighlight(tree).fragments(F.lit("none"))) == ""
    assert "<B>needle</B>" in one(spark, highlight.SimpleHighlight(tree).fragments(F.lit(text)))


def test_properties(spark):
    row = from_properties(spark.sql("select map('svn:externals', '/A b', 'svn:mergeinfo', 'x', 'Key', 'V') as props")).first()
    assert row.externals == "/a b" and row.props == {"Key": "v"} and row.mime is None


def test_cli():
    o = cli.parse("create idx repo/ -r1000 -s -v 4".split())
    assert (o.command, o.max_revision, o.single_revision, o.verbosity, o.repository) == ("create", 1000, True, 4, "repo")
    for bad in ("create idx repo -r", "create idx", "create idx repo -q", "check idx repo"):
        with pytest.raises(ValueError):
            cli.parse(bad.split())


def test_cache(spark):
    now = [0.0]
    cache = ResultCache(ttl=5, clock=lambda: now[0])
    made = []
    make = lambda: made.append(1) or spark.range(3)
    cache.get(("q",), make)
    now[0] = 4
    cache.get(("q",), make)
    assert len(made) == 1
    now[0] = 20
    assert cache.sweep() == 1


SOME = ["term_should", "phrase_three", "gap_mixed", "path_gap", "externals_host", "content_or_path", "intervals", "rev_range", "delete_expansion", "copy_expansion", "hit_projection", "page_two", "export_tsv", "rank_tfidf", "highest_revision", "highlight_lines", "postings", "as_of_revisions", "repo_log", "repo_versions", "upsert_replay", "stream_copies", "late_revision", "lexer_tokens", "cli_options", "hit_summary", "relevance_order"]


@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = catalogue.QUERIES[name](spark, SF)
    rel = con.sql(catalogue.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    want = sorted(tuple(map(str, (r[rel.columns.index(c)] for c in cols))) for r in rel.fetchall())
    assert sorted(tuple(map(str, (r[c] for c in cols))) for r in got.collect()) == want


def test_entry_without_the_corpus_operators(tmp_path):
    """With the corpus folder and pipeline gone, the entry still imports and has the engine's queries."""
    for name in ("__spark_entry__.py", "chronofind"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "chronofind").mkdir()
    for name in os.listdir(f"{ROOT}/chronofind"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/chronofind/{name}", tmp_path / "chronofind" / name)
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); assert 'term_content' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; print(len(m.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_terms_narrow_a_store_and_follow_its_commits(spark, tmp_path):
    def put(store, *rows):
        store.upsert(analysed(spark.createDataFrame(list(rows), "path string, content string, author string, rev_first int, rev_last int")))

    def ask(store, text, first=HEAD, **options):
        return sorted(r.id for r in StoredIndex(store, scan_below=0, **options).query(text, first).select("id").collect())

    store = Store(spark, f"{tmp_path}/with blank", buckets=4)
    put(store, ("/a.c", "owl fox", "x", 1, HEAD), ("/b.c", "owl hen", "y", 1, HEAD), ("/c.c", "fox", "x", 1, 2), ("/d.c", None, "x", 1, HEAD))
    assert ask(store, "c:owl") == ["/a.c@1", "/b.c@1"]  # no terms yet
    index_terms(store)
    version = store.manifest()["version"]
    index_terms(store)
    assert store.manifest()["version"] == version and StoredIndex(store, scan_below=0).uncovered == []
    assert ask(store, "c:owl") == ["/a.c@1", "/b.c@1"] and ask(store, "c:fox", 2) == ["/a.c@1", "/c.c@1"]
    assert ask(store, "c:owl", by_id=1) == ask(store, "c:owl", by_id=0) == ["/a.c@1", "/b.c@1"]
    # a commit replaces folders: their rows in the table of terms are passed over, the new ones scanned
    put(store, ("/a.c", "owl fox", "x", 1, 4), ("/a.c", "crow", "x", 5, HEAD))
    index = StoredIndex(store, scan_below=0)
    assert index.uncovered and index.covered
    assert ask(store, "c:owl") == ["/b.c@1"] and ask(store, "c:crow") == ["/a.c@5"] and ask(store, "c:fox", 4) == ["/a.c@1"]
    assert index.count_terms("content", ["^.*O.*$"]) == 3 and index.count_terms("prop:k", ["^.*$"]) == 0
    index_terms(store)
    for text in ("c:(owl -hen)", "#c:crow #a:y", "c:?o*", "c:(crow p:a)"):
        assert ask(store, text) == sorted(r.id for r in StoredIndex(store).query(text).select("id").collect()), text


def test_terms_are_inverted_where_the_items_lie(spark, tmp_path):
    rng = random.Random(2)
    texts = {f"/{i}.c": " ".join(rng.choices(["owl", "fox", "hen", "é", "crow"], k=rng.randint(0, 40))) for i in range(200)}
    store = Store(spark, str(tmp_path / "index"), buckets=3)
    store.upsert(prepared(spark.createDataFrame(list(texts.items()), "path string, content string")))
    index_terms(store)
    rows = store.parquet([store.manifest()["inverted"][0]["folder"]]).filter("field = 'content'").collect()
    held = sorted((r.term, i.partition("@")[0]) for r in rows for i in r.ids)
    assert held == sorted((t, p) for p, text in texts.items() for t in set(text.upper().split()))
    assert {r.place for r in rows} == set(store.manifest()["live"].values())
    # a task's rows come in the order of their terms, and a term's items are not spread over a row each
    assert len(rows) == len({(r.place, r.term) for r in rows}) == 15
    # terms are made when a query asks for them, not for one that has none
    other = Store(spark, str(tmp_path / "other"), buckets=3)
    other.upsert(prepared(spark.createDataFrame(list(texts.items()), "path string, content string")), persist=False)
    index = StoredIndex(other, scan_below=0, with_terms=True)
    assert index.query("a:x").count() == 0 and "inverted" not in other.manifest()
    want = sorted(p for p, text in texts.items() if "owl" in text and "hen" not in text)
    assert sorted(r.path for r in index.query("c:(owl -hen)").collect()) == want and len(other.manifest()["inverted"]) == 1


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rng = random.Random(3)
    rows = spark.createDataFrame([("/one" if i % 10 else f"/{i}", i + 1, rng.randbytes(2000).hex()) for i in range(1000)], "path string, rev_first int, content string").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        store = Store(spark, str(tmp_path / "index"), buckets=4)
        store.upsert(prepared(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = [list((tmp_path / "index" / place).glob("*.parquet")) for place in store.manifest()["live"].values()]
    assert max(map(len, files)) > 1
    items = store.items()
    assert items.count() == 1000 and items.select("id").distinct().count() == 1000 and items.filter("size(content_tokens) = 1").count() == 1000


def test_grouping_against_brute_force(spark):
    rng = random.Random(4)
    lists = {str(i): rng.choices(["A", "B", "é", "Z_" * 50, "C1"], k=rng.choice([0, 1, 7, 300])) for i in range(60)}
    items = spark.createDataFrame([(k, v) for k, v in lists.items()] + [("none", None)], "id string, content_tokens array<string>").repartition(3)
    want = {(t, i, tuple(p for p, x in enumerate(v) if x == t)) for i, v in lists.items() for t in set(v)}
    got = rank.postings(items, ("content",)).collect()
    assert {(r.term, r.id, tuple(r.positions)) for r in got} == want and len(got) == len(want) and all(r.tf == len(r.positions) for r in got)
    stats = {(t, sum(t in v for v in lists.values()), sum(v.count(t) for v in lists.values())) for t in {t for t, _, _ in want}}
    assert set(map(tuple, rank.term_stats(items).collect())) == stats
    # no sort of strings and no array function over each token of a row
    assert "array_sort" not in rank.term_stats(items)._jdf.queryExecution().toString()


def test_what_reads_every_document_once_makes_no_index(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "_STORED", {})
    for name in ("rank_tfidf", "term_stats", "postings", "item_view", "hit_projection"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert catalogue._STORED == {}, name
        if name in ("item_view", "hit_projection"):  # tokens are not made for what shows none
            assert "regexp_extract_all" not in plan, name
        if name == "rank_tfidf":  # once for the counts and once for the scores
            assert plan.count("regexp_extract_all") == 2


def test_replay_reads_a_half_in_several_files(spark, monkeypatch):
    seen = []
    run = catalogue.updates.run

    def watched(spark, log, *args):
        seen.append(log)
        return run(spark, log, *args)

    monkeypatch.setattr(catalogue.updates, "run", watched)
    wrote = []
    make = catalogue.work_dir
    monkeypatch.setattr(catalogue, "work_dir", lambda s: wrote.append(make(s)) or wrote[0])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalogue.QUERIES["stream_replay"](spark, SF)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = glob.glob(wrote[0] + "/log/*.parquet")
    assert len(seen) == 2 and len(files) > 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalogue.QUERIES["intervals"](spark, SF).collect()))
