"""Include lists against a depth-first walk."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.sources import includes
from feedloom.sources.lines import read_bodies, read_lines, scan_lines

LISTS = {
    "a": ["x", "api://b", "y", "api://c", "api://a"],
    "b": ["api://d", "z"],
    "c": ["api://d", "api:// missing ", "w", "x"],
    "d": ["d1", "api://b", "api://c"],
    "unreached": ["u"],
}
ROOTS = {"r1": ["first", "api://a", "last", "api://a"], "r2": ["api://c"], "r3": ["only"]}


def walk(lists, roots):
    """Literal lines in the order a depth-first reader with a visited set meets them."""
    out = []
    for root, lines in roots.items():
        seen = set()

        def visit(name, content):
            for line in content:
                if not line.startswith("api://"):
                    out.append((root, name, line))
                    continue
                child = line[6:].strip()
                if child not in seen:
                    seen.add(child)
                    visit(child, lists.get(child, []))

        visit(None, lines)
    return out


def tables(spark, lists, roots):
    rows = lambda d: [(k, n, line) for k, ls in d.items() for n, line in enumerate(ls)]
    return (
        spark.createDataFrame(rows(lists), "list_id string, line_no bigint, line string"),
        spark.createDataFrame(rows(roots), "root string, line_no bigint, line string"),
    )


def random_lists(seed):
    draw = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    line = lambda: draw.choice([f"api://{draw.choice(names)}", f"t{draw.randrange(99)}"])
    lists = {n: [line() for _ in range(draw.randrange(6))] for n in names}
    return lists, {r: [line() for _ in range(3)] for r in ("p", "q")}


@pytest.mark.parametrize("lists, roots", [(LISTS, ROOTS), *map(random_lists, range(4))])
def test_depth_first_order(spark, lists, roots):
    want = walk(lists, roots)
    ordered = includes.expand_includes(*tables(spark, lists, roots), ordered=True)
    rows = ordered.orderBy("root", "path").collect()
    got = [(r["root"], r["list_id"], r["line"]) for r in rows]
    assert got == sorted(want, key=lambda t: t[0])
    bag = includes.expand_includes(*tables(spark, lists, roots)).collect()
    assert sorted(map(str, ((r["root"], r["list_id"], r["line"]) for r in bag))) == sorted(map(str, want))


def test_long_chain_merges_its_pieces(spark):
    lists = {f"c{i}": [f"api://c{i + 1}", str(i)] for i in range(2 * includes.MERGE_EVERY + 3)}
    got = includes.expand_includes(*tables(spark, lists, {"r": ["api://c0"]})).collect()
    assert sorted(int(r["line"]) for r in got) == list(range(len(lists)))


def test_rounds_neither_shuffle_nor_sort_the_include_lines(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists, roots = tables(spark, LISTS, ROOTS)
        frontier = roots.select("root", includes.included(F.col("line")).alias("list_id"))
        with includes._edges(lists) as edges:
            joined = frontier.join(edges, F.col("list_id") == F.col("parent"))
            joined.collect()
            plan = joined._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
            assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
            assert edges.is_cached
        assert not edges.is_cached
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("least, most", [(0, 9), (-5, 10**9), (-(2**60), 2**60), (None, None)])
def test_codes_are_in_the_order_of_paths(spark, least, most):
    codes, draw = includes._Codes(least, most), random.Random(3)
    places = [None] + ([] if least is None else [least, most] + [draw.randint(least, most) for _ in range(3)])
    length = max(n for n in (1, 2, 3) if codes.kind(n))
    kind = codes.kind(length)
    paths = [[draw.choice(places) for _ in range(length)] for _ in range(60)]
    df = spark.createDataFrame([(p,) for p in paths], "path array<bigint>")
    code = (codes.code(F.col("path"), length - 1, kind, more=1) if length > 1 else F.lit(0).cast(kind)) + codes.digit(F.col("path")[length - 1], kind)
    rows = df.select("path", code.cast(kind).alias("code")).withColumn("back", codes.path(F.col("code"), length, kind)).collect()
    assert all(r["back"] == r["path"] for r in rows)
    order = lambda p: [(x is not None, x or 0) for x in p]
    assert [r["path"] for r in sorted(rows, key=lambda r: r["code"])] == sorted(paths, key=order)


@pytest.mark.parametrize("apart", [1, 10**6, 2**58])
def test_smallest_paths_by_places_near_and_far(spark, apart):
    lists, roots = random_lists(7)
    lists["n0"] = [f"api://n{i}" for i in range(11, 0, -1)]
    roots["p"].append("api://n0")
    roots["q"].append("api://n1")
    far = lambda df: df.withColumn("line_no", F.col("line_no") * apart - 3)
    want = {(r, c): p for r, ls in roots.items() for c, p in smallest_paths(lists, ls).items()}
    got = includes.arrival_paths(*map(far, tables(spark, lists, roots))).collect()
    assert len(got) == len(want)
    assert {(r["root"], r["list_id"]): [(p + 3) // apart for p in r["path"]] for r in got} == want


def smallest_paths(lists, lines):
    found, todo = {}, [([], lines)]
    while todo:
        path, content = todo.pop()
        for n, line in enumerate(content):
            name = line[6:].strip()
            if line.startswith("api://") and (name not in found or [*path, n] < found[name]):
                found[name] = [*path, n]
                todo.append((found[name], lists.get(name, [])))
    return found


def test_missing_lists_are_named(spark):
    got = includes.missing_lists(*tables(spark, LISTS, ROOTS)).collect()
    assert sorted(tuple(r) for r in got) == [("r1", "missing"), ("r2", "missing")]


def test_one_level(spark):
    got = includes.expand_one_level(*tables(spark, LISTS, ROOTS)).orderBy("root", "path").collect()
    assert [(r["root"], r["list_id"], r["line"]) for r in got] == [
        ("r1", None, "first"), ("r1", "a", "x"), ("r1", "a", "y"), ("r1", None, "last"),
        ("r1", "a", "x"), ("r1", "a", "y"), ("r2", "c", "w"), ("r2", "c", "x"), ("r3", None, "only"),
    ]


def test_scan_lines(spark):
    df = spark.createDataFrame([(1, " \n# c\n a\t\n\n\nb\r\n#"), (2, None), (3, "")], "id int, body string")
    got = [(r["id"], r["line_no"], r["line"]) for r in scan_lines(df, "body").orderBy("id", "line_no").collect()]
    assert got == [(1, 1, "a"), (1, 2, "b")]
    commas = scan_lines(df.select(F.lit("x, y,,#z").alias("body")).limit(1), "body", separator=",")
    assert [r["line"] for r in commas.orderBy("line_no").collect()] == ["x", "y"]


def test_big_files_keep_their_line_order(spark, tmp_path):
    want = {}
    for name in ("one", "two"):
        lines = [f"{name} {i} " + "x" * (i % 50) for i in range(4000)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        want[name] = lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        rows = df.orderBy("source", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, lines in want.items():
        mine = [r for r in rows if r["source"].endswith(f"{name}.txt")]
        assert [r["line"] for r in mine] == lines
        assert len({r["line_no"] for r in mine}) == len(lines)
    bodies = {r["source"].rsplit("/", 1)[1]: r["body"] for r in read_bodies(spark, str(tmp_path)).collect()}
    assert bodies["one.txt"] == "\n".join(want["one"]) + "\n"


def test_lines_end_at_newlines_only(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"a\rb\nc#tag\r\n\r\nlast")
    rows = read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["a\rb", "c#tag", "", "last"]
