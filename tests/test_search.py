import pytest

from chronofind.functions.scalars import HEAD
from chronofind.operators.items import analysed
from chronofind.operators.search import Index, by_path, hits, page, viewed
from chronofind.plans.parser import Group, phrase_leaf

# The search corpus (path, content, externals), in order of the numbers that the expectations name.
CORPUS = [
    ("/csharp/fileio.cs", "The quick brown fox jumps over the lazy dog", ""),
    ("/shared/general/FileIO/FileIO.cpp", "class Special:Abstract", ""),
    ("/shared/general/FileIO/FileIO.design.cpp", "obj.method(arg1, arg2, arg3) < 4711", ""),
    ("/shared/general/FileIO/FileIO.h", "aa bb cc dd ee ff ee dd cc bb aa aa bb cc dd", ""),
    ("/shared/general/FileIO/FileIO.xml", "aa bb cc dd cc", ""),
    ("/shared/general/flip/FileIO/FileIO.h", "cc dd ee ff", ""),
    ("/shared/general/FileIO/anders.h", "flip fileio cpp shared general", ""),
    ("/shared/general/FileIO/anders.cpp", "", ""),
    ("/tags/shared/general/FileIO/FileIO.cpp", '#include "FileIO.h" // another comment that is just here to generate some text that can be searched', ""),
    ("/tags/shared/general/FileIO/FileIO.h", "#include <general/path/bla.h> // some very funky and long comment that is total useless", ""),
    ("/tags/shared/general/FileIO/anders.h", "max und moritz sind anders", ""),
    ("/tags/shared/general/FileIO/anders.cpp", "anders sind moritz und max", ""),
    ("/woanders/FileIO.cpp", "elephant", ""),
    ("/woanders/FileIO.h", "cat and mice", ""),
    ("/woanders/flip.cs", "cat and dog", ""),
    ("/woanders/FileIO/hier/und/dort/fileio.cpp", "elefant, cat, dog, mice, rabbit, hedgehog and", "-r4000 /bla/bli localbli"),
    ("/woanders/FileIO/hier/und/dort/fileio.h", "Elefant Katze Maus Hase Igel", "-r5000 ^/products/internal internal"),
    ("/selt.sam/source/form1.design.cs", "Der Elefant sitzt auf dem Trommelklo", "svn://depot.example.org/one/two/three localfolder"),
    ("/woanders/", "", "/shared shared"),
    ("/project/import/", "", "/Shared/General general\r\n  /woanders woanders"),
    ("/project_zwei/import/", "", "/Shared/Animals animals"),
]
VERSIONS = [("/revisions/bla.cpp", 1, 5), ("/revisions/bla.cpp", 6, 6), ("/revisions/bla.cpp", 7, 8), ("/revisions/bla.cpp", 9, HEAD), ("/revisions/deleted.cpp", 6, 8), ("/revisions/current.cpp", 9, HEAD)]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(str(i), p, c, x, HEAD, HEAD) for i, (p, c, x) in enumerate(CORPUS)]
    rows += [(str(i), p, "", "", a, b) for i, (p, a, b) in enumerate(VERSIONS, len(CORPUS))]
    rows.append(("27", "/large/data.txt", " ".join(f"a{i}" for i in range(51)), "", HEAD, HEAD))
    items = analysed(spark.createDataFrame(rows, "id string, path string, content string, externals string, rev_first int, rev_last int"), cap=50)
    return Index(items.cache())


def ask(index, text, first=HEAD, last=None):
    return sorted(int(r.id) for r in index.query(text, first, last).select("id").collect())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("trommelklo Elefant ", [17]), ("Katze Cat", []), ("#Katze #Cat", [13, 14, 15, 16]), (".cpp -Elefant", [1, 2, 7, 8, 11, 12, 24, 26]),
        ("#Elefant Trommelklo", [17]), ("+(#Elefant Trommelklo)", [17]), ("cat +(#.h #.cpp))", [13, 15]), ("cat +(#.h #.cpp", [13, 15]),
        ("-#+Elefant -#+Cat", [15]), ("p:Flip.cs", [14]), ("p:Flip", [5, 14]), ("c:(#max #moritz #anders)", [10, 11]),
        ('"max und moritz"', [10]), ('c:"moritz und max"', [11]), ("c:El*ant", [12, 15, 16, 17]), ("c:Ele?ant", [15, 16, 17]),
        ('c:"comment ** that', [8, 9]), ('c:"#include ** bla.h"', [9]), ('c:"include ** comment ** searched"', [8]),
        ("c:(include comment searched)", [8]), ("c:(include comment)", [8, 9]), ("c:(include comment -searched)", [9]),
        ('c:"*"', []), ('c:"**/"', []), ("c:a49", [27]), ("c:a50", []),
        ("p:/shared/", [1, 2, 3, 4, 5, 6, 7]), ("p:.cs", [0, 14, 17]), ("p:cs", [0, 14, 17]), ("p:*.cs", [0, 14, 17]), ("p:flip/", [5]),
        ("p:FileIO/**/fileio.cpp", [1, 8, 15]), ("p:/woanders/FileIO/**/fileio.*", [15, 16]), ("p:shared/**/fileio", list(range(1, 12))),
        ("p:/shared/general/FileIO/*.xml", [4]), ("p:selt.sam/source/form1.design.cs", [17]), ('p:""', []),
        ("x:/shared/general", [19]), ("x:/shared", [18, 19, 20]), ("x:/woanders", [19]), ('x:"localfolder"', [17]), ('x:"svn://depot.example.org"', [17]),
        ('x:"-r5000"', [16]), ('x:"-r*"', [15, 16]), ("x:products/internal", [16]), ("p:deleted.cpp", []),
        ('c:"cc dd ** dd cc"', [3]), ('c:"dd ee * ee"', [3]), ("-cat", []), ("()", []),
    ],
)
def test_golden(index, text, expected):
    assert ask(index, text) == expected


def test_folder_with_trailing_gap(index):
    assert ask(index, "p:/general/**") == ask(index, "p:/general/")
    assert ask(index, "p:general/**") == ask(index, "p:general/") == list(range(1, 12))


@pytest.mark.parametrize(
    ("text", "first", "last", "expected"),
    [("p:bla.cpp", 1, None, [21]), ("p:bla.cpp", 5, None, [21]), ("p:bla.cpp", 6, None, [22]), ("p:bla.cpp", 8, None, [23]), ("p:deleted.cpp", 2**31 - 1, None, []), ("p:deleted.cpp", 0, None, [25]), ("p:deleted.cpp", 5, None, []), ("p:deleted.cpp", 7, None, [25]), ("p:deleted.cpp", 9, None, []), (".cpp", 4, 8, [21, 22, 23, 25])],
)
def test_revisions(index, text, first, last, expected):
    assert ask(index, text, first, last) == expected


def test_hits_and_pages(index):
    found = index.query("p:.cpp")
    row = hits(found).filter("id = '1'").first()
    assert (row.folder, row.file, row.rev_first, row["size"]) == ("/shared/general/FileIO", "FileIO.cpp", "head", "0 bytes")
    everything = [r.path for r in by_path(index.items).select("path").collect()]
    assert [r.path for r in page(index.items, 1).collect()] == everything[16:32]
    assert index.hit_by_id("3")["path"].endswith("FileIO.h") and index.hit_by_id("none") is None
    assert index.result("p:.cpp").total == found.count()
    assert viewed(index.items).count() == index.items.count()


def test_single_revision_ignores_the_range(index):
    assert Index(index.items, single_revision=True).query("p:deleted.cpp", 1).count() == 1


def test_no_token_no_leaf():
    assert phrase_leaf("content", "* **") is None and isinstance(Group(), Group)
