"""Drawings, colours, explain, and streaming."""

import xml.dom.minidom

import pytest

from millrace.engine import Engine
from millrace.plans.errors import ScriptError
from millrace.sources import draw
from millrace.streaming.pipeline import stream


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "in.csv").write_text("g,x,y\n" + "".join(f"{'ab'[i % 2]},{i},{i * i}\n" for i in range(20)))
    return Engine(spark, str(tmp_path))


@pytest.mark.parametrize("chart", ["hist x", "spark y", "line x y", "scatter x y", "heatmap x y -b 4", "bar g x", "line x y -A"])
def test_drawings(engine, chart):
    out = engine.run(f"graph {chart} -t title", "in.csv")
    lines = list(draw.terminal(out))
    assert lines[0].strip() == "title" and len(lines) > 1
    xml.dom.minidom.parseString(draw.svg(out))


def test_colours(engine):
    out = engine.run("head 2 | color -c x bold+red x > 0 | color -g y", "in.csv")
    rows = list(draw.colored(out))
    assert rows[0][:2] == ["a", "0"] and rows[1][1] == "\x1b[1;31m1\x1b[0m" and "38;2;" in rows[1][2]


def test_explain(engine):
    text = engine.explain("select x > 3 | cols g", "in.csv")
    assert "select" in text and "output: g" in text


def test_pushdown(spark):
    plan = Engine(spark).explain("select l_linenumber > 5 | cols l_orderkey", "/root/testdata/sf0.001/lineitem.parquet")
    assert "GreaterThan(l_linenumber,5)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int" in plan and "l_quantity" not in plan


def test_stream(spark, tmp_path):
    folder = str(tmp_path / "s")
    spark.createDataFrame([(i, f"k{i % 3}") for i in range(10)], "v long, k string").write.parquet(folder)
    source = spark.readStream.schema("v long, k string").parquet(folder)
    for script, rows in (("select v > 6 | add w = v * 2 | cols w", 3), ("agg n=count by k", 3), ("uniq k", 3), ("cols v | head 4", 4)):
        df, mode = stream(spark, script, source)
        q = df.writeStream.format("memory").queryName(f"q{rows}{mode}{len(script)}").outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        assert spark.sql(f"select * from q{rows}{mode}{len(script)}").count() == rows
    with pytest.raises(ScriptError):
        stream(spark, "sort v", source)


def test_notes_and_ramps(engine, tmp_path):
    (tmp_path / "n.csv").write_text("g,x,y,c\n" + "".join(f"g{i},{i},{i - 3 if i != 5 else 'none'},{i if i else ''}\n" for i in range(60)))
    lines = list(draw.terminal(engine.run("graph line x y -l -y -1:40 -c c -r blue:red", "n.csv"), depth=24))
    assert lines[-1] == "1 cells hold no number; 18 values lie outside the range; 2 values are not above zero; 1 points have no number to colour by"
    assert any("38;2;" in x for x in lines)
    assert "10 more bars are not drawn" in list(draw.terminal(engine.run("graph bar g x", "n.csv")))[-1]
    assert len(list(draw.terminal(engine.run("graph scatter x y -s 0.5", "n.csv")))) == 12
    with pytest.raises(ScriptError):
        list(draw.terminal(engine.run("graph scatter x y -c c -r blue:teal", "n.csv"), depth=8))


def test_depth_and_gradient_bounds(engine):
    assert draw.color_depth("auto", True, {"NO_COLOR": "1"}) == 0 and draw.color_depth("always", False, {}) == 8
    assert draw.color_depth("auto", False, {"CLICOLOR_FORCE": "1", "COLORTERM": "truecolor"}) == 24
    rows = list(draw.colored(engine.run("cols x | head 3 | color -g x 0 2 blue:red", "in.csv")))
    assert [r[0] for r in rows] == [f"\x1b[38;2;{r};{g};{b}m{i}\x1b[0m" for i, (r, g, b) in enumerate([(52, 101, 164), (128, 50, 82), (204, 0, 0)])]
    assert draw.gradient(0, 0, 1, "blue", "red", 8).startswith("38;5;")


def test_one_file_by_all_tasks(engine, tmp_path):
    from millrace.sources import writers

    out = engine.run("sort y=nr | cols x,g", "in.csv")
    writers.write_file(out, f"{tmp_path}/out.csv")
    assert (tmp_path / "out.csv").read_text().splitlines() == list(writers.csv_text(out))


def test_striped_table(engine):
    from millrace.sources import writers

    lines = list(writers.table_text(engine.run("head 3 | fmt -s", "in.csv")))
    assert lines[0] == "g  x  y" and lines[1] == "a  0  0" and lines[2].startswith("\x1b[48;5;236m") and "\x1b" not in lines[3]


def test_command_line(tmp_path, monkeypatch, capsys, spark):
    import io

    from millrace import __main__ as cli

    monkeypatch.setattr(spark, "stop", lambda: None)
    given = io.BytesIO(b"a,b\n1,x\n2,y\n3,z\n")
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(given))
    monkeypatch.setattr(cli, "PIECE_BYTES", 6)
    assert cli.main(["select a > 1", "-"]) == 0
    assert capsys.readouterr().out.splitlines() == ["a,b", "2,y", "3,z"]
    (tmp_path / "f.csv").write_text("a,b\n1,x\n2,y\n")
    assert cli.main(["sort a=nr", f"{tmp_path}/f.csv", "-o", f"{tmp_path}/o.csv"]) == 0
    assert (tmp_path / "o.csv").read_text() == "a,b\n2,y\n1,x\n"
    assert cli.main(["--explain", "select a > 1 | sort b", f"{tmp_path}/f.csv"]) == 0
    assert "1  select (a#1 > 1 as numeric)" in capsys.readouterr().out
    assert cli.main(["help", "modes"]) == 0 and "auto" in capsys.readouterr().out
    assert cli.main(["help", "mods"]) == 1 and "modes" in capsys.readouterr().err
    assert cli.main(["group a", f"{tmp_path}/f.csv"]) == 1 and "agg" in capsys.readouterr().err
