"""Scripts over small CSV inputs: expected output texts, in order."""

import pytest

from millrace.engine import Engine
from millrace.plans.errors import ScriptError
from millrace.sources.writers import csv_text, table_text

BASE = """id,flag,name,a,z
1,t,red,10,5
2,f,blue,-3,40
3,t,red,7,12
4,t,green,,8
5,f,blue,25,1
"""


@pytest.fixture
def run(spark, tmp_path):
    def go(script, text=BASE, **options):
        (tmp_path / "in.csv").write_text(text)
        return list(csv_text(Engine(spark, str(tmp_path)).run(script, "in.csv", **options)))

    go.folder = tmp_path
    return go


@pytest.mark.parametrize(
    ("script", "lines"),
    [
        ("cols id,name", ["id,name", "1,red", "2,blue", "3,red", "4,green", "5,blue"]),
        ("cols -v 2-4", ["id,z", "1,5", "2,40", "3,12", "4,8", "5,1"]),
        ("select a > 5 && flag == 't' | cols 1", ["id", "1", "3"]),
        ("select -v name =~ '^(red|blue)$' | cols id", ["id", "4"]),
        ("select name *= 'ee' || z >= 40 | cols id", ["id", "2", "4"]),
        ("sort a | cols id,a", ["id,a", "2,-3", "4,", "3,7", "1,10", "5,25"]),
        ("sort name=r z=n | cols id", ["id", "1", "3", "4", "5", "2"]),
        ("uniq name | cols id,name", ["id,name", "1,red", "2,blue", "4,green"]),
        ("agg n=count, sum(a), count(a) by name", ["name,n,a_sum,a_count", "red,2,17,2", "blue,2,22,2", "green,1,,0"]),
        ("agg count by name | sort count=nr name | head 1", ["name,count", "blue,2"]),
        ("select a > 1000 | agg sum(a)", ["a_sum"]),
        ("head -n -3 | cols id", ["id", "1", "2"]),
        ("tail 2 | cols id", ["id", "4", "5"]),
        ("tail +4 | cols id", ["id", "4", "5"]),
        ("add d = z - prev(z) | cols id,d", ["id,d", "1,0", "2,35", "3,-28", "4,-4", "5,-7"]),
        ("select z > prev(z) | cols id", ["id", "2"]),
        ("select name == 'red' | add r = rownum() | cols id,r", ["id,r", "1,1", "3,3"]),
        ("select -A1 id == 2 | cols id", ["id", "2", "3"]),
        ("add q = z / 3 | cols q | head 1", ["q", "1.66666666666667"]),
        ("add c = coalesce(a, 'none') | cols c | tail 2", ["c", "none", "25"]),
        ("add b = a > 0 ? 'up' : a | cols b", ["b", "up", "-3", "up", "", "up"]),
        ("rename name=colour | cols colour | head 1", ["colour", "red"]),
        ("fn top(n, c) { sort c=nr | head n } top(2, z) | cols id", ["id", "2", "3"]),
        ("sort z=nr | agg n=count by name", ["name,n", "blue,2", "red,2", "green,1"]),
        ("sort name=r | add r = rownum() | cols id,r", ["id,r", "1,1", "3,2", "4,3", "2,4", "5,5"]),
        ("sort name | add p = prev(id) | cols id,p", ["id,p", "2,2", "5,2", "4,5", "1,4", "3,1"]),
        ("# note\nselect id > 3 # more\n| cols id", ["id", "4", "5"]),
        ("graph hist z -b 2 -D", ["bin_lo,bin_hi,count", "1,20.5,4", "20.5,40,1"]),
    ],
)
def test_scripts(run, script, lines):
    assert run(script) == lines


def test_stats(run):
    assert run("stats a,name | cols -v stddev") == ["field,count,empty,min,max,sum,mean", "a,4,1,-3,25,39,9.75", "name,5,0,blue,red,,"]


def test_join_kinds(run):
    (run.folder / "r.csv").write_text("name,price\nred,1\nred,2\npink,9\n")
    assert run("cols id,name | join r.csv on name") == ["id,name,price", "1,red,1", "1,red,2", "3,red,1", "3,red,2"]
    assert run("cols id,name | join -l r.csv on name | tail 2") == ["id,name,price", "4,green,", "5,blue,"]
    assert run("cols id,name | join -r r.csv on name | tail 1") == ["id,name,price", ",pink,9"]
    assert run("cols id,name | join -F r.csv on name")[-1] == ",pink,9"


def test_from_patterns(run, spark):
    for n in (9, 10):
        (run.folder / f"pv.{n}.csv").write_text(f"ts,v\n1,{n}\n")
    out = Engine(spark, str(run.folder)).run("from pv.*.csv on ts")
    assert list(csv_text(out)) == ["ts,v_9,v_10", "1,9,10"]


def test_csv_shapes(run):
    text = 'a,b\n"x,1","say ""hi"""\n\nshort\nlong,2,3\n'
    assert run("head 9", text) == ["a,b", '"x,1","say ""hi"""', ",", "short,", "long,2"]


def test_what_follows_a_closing_quote_is_dropped(run):
    text = 'a,b,c\n"x"junk,"y,""z"" "more,3\n1,"two" ,\n'
    assert run("head 9", text) == ["a,b,c", 'x,"y,""z"" ",3', "1,two,"]
    with pytest.raises(ScriptError):
        run("join - on a", text)


@pytest.fixture
def parts(spark, tmp_path):
    """A folder of two CSV files with a header each."""
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "a.csv").write_text("id,v,t\n1,3,x\n2,1,pear\n3,2,x\n")
    (tmp_path / "parts" / "b.csv").write_text("id,v,t\n4,5,x\n5,4,apple\n6,12,x\n")
    return lambda script: list(csv_text(Engine(spark, str(tmp_path)).run(script, "parts")))


def test_headers_of_many_files_are_not_read_as_numbers(parts):
    assert parts("select v <= 5 | add k = v > 3 ? '' : v | agg n=count, m=count(k) by k") == ["k,n,m", "3,1,1", "1,1,1", "2,1,1", ",2,0"]
    assert parts("select num(v) > 3 | cols id") == ["id", "4", "5", "6"]


def test_mixed_sort_of_many_files(parts):
    assert parts("add k = v % 3 == 0 ? '' : v % 3 == 1 ? t : v | sort k id=n | cols id,k") == ["id,k", "1,", "6,", "3,2", "4,5", "5,apple", "2,pear"]
    assert parts("add k = v % 3 == 0 ? '' : v | sort k id=n | head 5 | select rownum() % 2 == 0 | cols id") == ["id", "6", "3"]


def test_headerless(run):
    assert run("cols c2", "1,x\n2,y\n", header="-") == ["c2", "x", "y"]


def test_auto_sort_puts_numbers_first(run):
    assert run("sort n", "n,k\nb,1\n10,2\n9,3\nNaN,4\na,5\n") == ["n,k", "9,3", "10,2", "NaN,4", "a,5", "b,1"]


def test_table(spark, run):
    run("head 2")
    out = Engine(spark, str(run.folder)).run("cols name,a | head 2 | fmt", "in.csv")
    assert list(table_text(out)) == ["name   a", "red   10", "blue  -3"]


@pytest.mark.parametrize("script", ["colz a", "cols nope", "select a", "select a >", "add x = foo(1)", "agg sum", "sort a=x", "graph hist", "cols a |"])
def test_script_errors(run, script):
    with pytest.raises(ScriptError):
        run(script)


@pytest.mark.parametrize("script", ["select name > 3", "add x = 1 / (z - 5) | cols id", "add x = name + 1 | cols x"])
def test_row_errors_stop_the_run(run, script):
    with pytest.raises(Exception, match="not a number|division by zero"):
        run(script)


def test_patterns_are_unicode_and_end_at_the_end(run):
    text = "t\n٣\né\na\nab\n"
    assert run(r"select t =~ '^\d$'", text) == ["t", "٣"]
    assert run(r"select t =~ '^\w$'", text) == ["t", "٣", "é", "a"]
    assert run(r"select t =~ '(?P<x>A)b' || t =~ '(?i)^É'", text) == ["t", "é"]
    for bad in ("(?=a)", r"\1", "(?>a)", "a*+", "[a", r"\Qa"):
        with pytest.raises(ScriptError):
            run(f"select t =~ '{bad}'", text)


def test_nan_compares_with_nothing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "i int, q double")
    rows = lambda s: [r.i for r in Engine(spark).run(s, df).frame().collect()]
    assert rows("select i < nan") == [] and rows("select i != nan") == [1, 2, 3]
    assert rows("select num(q) >= i") == [1] and rows("select num(q) != i") == [2, 3]
    assert rows("select q > 0") == [1] and rows("select i < num(q) + 1") == [1]


def test_numbers_are_alike_by_their_text(run, spark):
    df = spark.createDataFrame([(0.1 + 0.2, 1), (0.3, 2), (-0.0, 3), (0.0, 4)], "k double, v int")
    got = [tuple(r) for r in Engine(spark).run("agg n=count by k", df).frame().collect()]
    assert sorted(got, key=str) == sorted([(0.3, 2), (-0.0, 1), (0.0, 1)], key=str)
    assert Engine(spark).run("uniq k", df).frame().count() == 3


NUMBERS = [0.0, -0.0, 1 / 3, 0.1 + 0.2, 1e-7, 1e11 + 0.1, 1727136000.123456, 1e22, 2.5, -7.0, 9.9999999999999995, 1e15 + 0.5, 123456.789, 5e-324, 1e-9, 0.000123456789012345678]


def test_number_text(spark):
    """Native texts against the plain rules, for known numbers, ties and random ones of every size."""
    import random

    from pyspark.sql import functions as F

    from millrace.functions.values import format_number, formatted

    random.seed(3)
    known = {1 / 3: "0.333333333333333", 0.1 + 0.2: "0.3", 1e-7: "0.0000001", 1e11 + 0.1: "100000000000.10001", 1727136000.123456: "1727136000.123456"}
    assert all(format_number(v) == t for v, t in known.items()) and format_number(-0.0) == "-0"
    some = [v for v in NUMBERS if v == 0 or abs(v) >= 1e-7]
    some += [random.choice([1, -1]) * random.random() * 10 ** random.uniform(-6, 22) for _ in range(3000)]
    some += [random.randint(1, 2**53) / 2 ** random.randint(1, 60) for _ in range(2000)] + [round(random.uniform(0, 1e5), 2) for _ in range(500)]
    some = [v for v in some if v == 0 or abs(v) >= 1e-7] + [float("nan"), float("inf"), -float("inf"), None]
    df = spark.createDataFrame([(v,) for v in some], "v double")
    plan = df.select(formatted(F.col("v")).alias("t"))
    assert [r.t for r in plan.collect()] == [format_number(v) for v in some]
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_braces_in_quotes_stay_in_the_fragment(run):
    assert run("fn f(c) { select c == '}' || c == 'red' | cols id } f(name)") == ["id", "1", "3"]


def test_rows_around_matches_over_buckets(run, monkeypatch):
    """Numbers, the row before and rows around a match, where every bucket has a few rows, against plain lists."""
    text = "id,v\n" + "".join(f"{i},{i * 7 % 50}\n" for i in range(200))
    rows = [(i, i * 7 % 50) for i in range(200)]
    monkeypatch.setattr("millrace.sources.files.CHUNK_BYTES", 64)
    by_value = sorted(rows, key=lambda r: r[1])
    for script, order in (("", rows), ("sort v | ", by_value), ("sort v=r id=r | ", sorted(rows, reverse=True, key=lambda r: (r[1], r[0])))):
        ids = [str(i) for i, _ in order]
        assert run(f"{script}add n = rownum() | cols id,n", text) == ["id,n", *(f"{i},{n}" for n, i in enumerate(ids, 1))]
        assert run(f"{script}add p = prev(id) | cols id,p", text) == ["id,p", *(f"{i},{ids[max(0, n - 1)]}" for n, i in enumerate(ids))]
        hits = [n for n, (i, _) in enumerate(order) if i % 60 == 7]
        near = [i for n, i in enumerate(ids) if any(n - 3 <= h <= n + 2 for h in hits)]
        assert run(f"{script}select -B 2 -A 3 id % 60 == 7 | cols id", text) == ["id", *near]
        assert run(f"{script}tail +150 | cols id", text) == ["id", *ids[149:]]
        assert run(f"{script}head -n -150 | cols id", text) == ["id", *ids[:50]]


def test_rows_around_matches_go_through_a_bucket_once(spark, tmp_path):
    """No frame ends at its partition's end: Spark goes through such a frame again for every row."""
    spark.range(0, 20000, 1, 1).write.parquet(f"{tmp_path}/t.parquet")
    out = Engine(spark, str(tmp_path)).run("select -B 1 -A 2 id % 5000 == 4999", "t.parquet")
    assert "unboundedfollowing" not in out.frame()._jdf.queryExecution().toString().lower()
    near = [i for h in range(4999, 20000, 5000) for i in range(h - 1, h + 3) if i < 20000]
    assert [r[0] for r in out.frame(ordered=True).collect()] == near


def test_wide_context_over_the_buckets_of_a_sort(spark, tmp_path):
    """Context that reaches over whole buckets on both sides, and no frame to the end of one."""
    spark.range(0, 3000, 1, 3).selectExpr("(id * 7) % 3000 as id").write.parquet(f"{tmp_path}/t.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put the buckets together
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = Engine(spark, str(tmp_path)).run("sort id=nr | select -B 500 -A 900 id == 2600 || id == 40", "t.parquet")
        assert "unboundedfollowing" not in out.frame()._jdf.queryExecution().toString().lower()
        assert [r[0] for r in out.frame(ordered=True).collect()] == [*range(2999, 1699, -1), *range(540, -1, -1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_many_files_are_cut_into_many_buckets(spark, tmp_path):
    """Eight files: windows by piece of the scan, no single partition over rows and no nested loops; order kept after agg."""
    spark.range(0, 8000, 1, 8).selectExpr("id", "cast(id % 13 as int) as g").write.parquet(f"{tmp_path}/t.parquet")
    engine = Engine(spark, str(tmp_path))
    out = engine.run("add p = prev(id) | select id != p + 1 || rownum() == 8000 | cols id,p", "t.parquet")
    assert [tuple(r) for r in out.frame(ordered=True).collect()] == [(0, 0), (7999, 7998)]
    plan = out.frame()._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    out = engine.run("agg n=count, first=min(id) by g | add p = prev(g) | add r = rownum()", "t.parquet")
    assert [tuple(r)[0] for r in out.frame(ordered=True).collect()] == list(range(13))
    plan = engine.run("agg n=count by g", "t.parquet").frame(ordered=True)._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_removed_verbs_and_typed_result(run, spark):
    with pytest.raises(ScriptError, match="agg"):
        run("group name")
    (run.folder / "typed.csv").write_text("n,code,blank,text\n1,007,,x\n,8,,2\n")
    made = Engine(spark, str(run.folder)).run("cols 1-4", "typed.csv").columns()
    assert made["n"][0] == 1.0 and made["n"][1] != made["n"][1] and made["code"] == ["007", "8"] and made["text"] == ["x", "2"]
    assert all(v != v for v in made["blank"])
