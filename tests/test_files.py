"""Reading, routing, parsing, rendering and writing of positional files."""

from pathlib import Path
from urllib.parse import unquote

import pytest
from conftest import text_of
from fixtures import (
    CONTROL_LINES,
    DATA_COLUMNS,
    DETAIL_CSV,
    HEADER_COLUMNS,
    HEADER_NAMES,
    HEADER_VALUES,
    RENDERED,
    SYNTHETIC_ROWS,
    write_layout,
    write_metadata,
    write_sample,
)
from pyspark.sql import functions as F

from claimweave.operators.generate import CLAIM_FIELDS
from claimweave.operators.parse import parse_fields
from claimweave.operators.render import (
    common_folder,
    join_sections,
    render_line,
    section_lines,
    synthetic_name,
    synthetic_name_column,
    write_sections,
)
from claimweave.operators.trailer import page_trailers
from claimweave.plans import flows
from claimweave.sources.delimited import write_delimited
from claimweave.sources.layout import (
    fields_from_widths,
    fields_of,
    read_layout,
    section_of,
    with_offsets,
)
from claimweave.sources.lines import read_lines, route


def test_layout_offsets_and_sections(spark, folder):
    layout = read_layout(spark, write_layout(folder))
    detail = with_offsets(section_of(layout, "DE")).orderBy("Row").collect()
    assert [(r["Column_Name"], r["Start"], r["Length"]) for r in detail] == [
        ("tag", 1, 2), ("unit", 3, 3), ("grade", 6, 2), ("net_amount_due", 8, 9), ("due", 17, 8),
    ]
    assert [f.start for f in fields_of(layout, "HDR")] == [1, 4, 8]
    assert [f.name for f in fields_of(layout, "DE") if f.sensitive] == ["unit"]


def test_layout_without_sections(spark, folder):
    path = Path(folder) / "header.csv"
    path.write_text("Column_Name,DataTtype,Length\nB,varchar,2\nA,varchar,3\n")
    layout = read_layout(spark, str(path))
    assert layout.columns[-4:] == ["Type", "IsSensitive", "Block_ID", "Row"]
    assert [(f.name, f.start, f.length) for f in fields_of(layout)] == [("B", 1, 2), ("A", 3, 3)]


@pytest.mark.parametrize("widths", [[("a", 0)], [("a", 1), ("A", 2)]])
def test_bad_layouts_are_refused(widths):
    with pytest.raises(ValueError):
        fields_from_widths(widths)


def test_parsed_detail_matches_golden(spark, folder):
    sections = flows.read_positional(spark, write_sample(folder), write_layout(folder), ["due", "none"])
    out = f"{folder}/detail.csv"
    rows = sections.detail.orderBy("line_no").drop("file", "line_no").coalesce(1)
    write_delimited(rows, out)
    assert text_of(out) == DETAIL_CSV.encode()
    assert [r["line_no"] for r in sections.detail.orderBy("line_no").collect()] == [3, 4, 5, 6]
    assert sections.header.drop("file").collect() == [(1, *HEADER_VALUES)]
    assert sections.control.drop("file").orderBy("line_no").collect() == list(zip([2, 7], CONTROL_LINES))


def test_line_numbers_do_not_depend_on_splits(spark, folder):
    sizes = {"a.txt": 5000, "b.txt": 1, "c.txt": 777}
    for name, n in sizes.items():
        write_sample(folder, name, [f"{name}-{i}" if i % 7 != 3 else "" for i in range(n)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    results = []
    for limit in ("4096", "1000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            lines = read_lines(spark, f"{folder}/*.txt")
            results.append(sorted((r["file"], r["line_no"], r["value"]) for r in lines.collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == sum(sizes.values())
    for file, line_no, value in results[0]:
        name = file.rsplit("/", 1)[-1]
        assert value == (f"{name}-{line_no - 1}" if (line_no - 1) % 7 != 3 else "")


def test_routing_rules(spark):
    rows = [
        ("f", 1, "CDfirst"), ("f", 2, "CD100x"), ("f", 3, ""), ("f", 4, "PT"),
        ("g", 1, "PA"), ("g", 2, "CD200"),
    ]
    lines = spark.createDataFrame(rows, "file string, line_no long, value string")

    def sections(**kw):
        return [r["section"] for r in route(lines, **kw).orderBy("file", "line_no").collect()]

    assert sections() == ["control", "control", "detail", "detail", "header", "control"]
    assert sections(control_prefix="CD100") == [
        "dropped", "control", "detail", "detail", "header", "dropped",
    ]
    assert sections(detail_exclude=("CD", "PT"))[3] == "dropped"


def test_rendered_file_matches_golden(spark, folder):
    layout = read_layout(spark, write_layout(folder))
    detail = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(SYNTHETIC_ROWS)],
        "seq long, tag string, unit string, grade string, net_amount_due string, due string",
    ).withColumn("due", F.col("due").cast("timestamp"))
    header = spark.createDataFrame([HEADER_VALUES], HEADER_NAMES)
    control = spark.createDataFrame(list(enumerate(CONTROL_LINES)), "seq long, CD_Record string")
    name, zero = F.lit("claims_syn.txt"), F.lit(0)
    sections = join_sections(
        section_lines(page_trailers(detail), "trailer", F.col("line"), name, zero),
        section_lines(control, "control", F.col("CD_Record"), name, F.col("seq")),
        section_lines(
            detail, "detail", render_line(fields_of(layout, "DE"), ["due"]), name, F.col("seq")
        ),
        section_lines(header, "header", render_line(fields_of(layout, "HDR")), name, zero),
    )
    write_sections(sections, f"{folder}/out", partitions=3)
    assert text_of(f"{folder}/out/file=claims_syn.txt") == RENDERED.encode()
    assert len(RENDERED) == 10 + 3 * 25 + 21 + 12 + 49


def test_large_sections_keep_their_order(spark, folder):
    rows = spark.range(5000).repartition(8).select(
        F.lit("big").alias("file"), F.lit(1).alias("section_no"),
        F.col("id").alias("seq"), F.col("id").cast("string").alias("line"),
    )
    write_sections(rows, f"{folder}/out", partitions=5)
    expected = "".join(f"{i}\n" for i in range(5000)).encode()
    assert text_of(f"{folder}/out/file=big") == expected
    assert len(list(Path(f"{folder}/out/file=big").glob("part-*"))) > 1


def test_overflow_rules(spark):
    fields = fields_from_widths([("a", 2), ("b", 2)])
    df = spark.createDataFrame([("xyz", None)], "a string, b string")
    assert df.select(render_line(fields)).first()[0] == "xyz  "
    assert df.select(render_line(fields, overflow="truncate")).first()[0] == "xy  "
    with pytest.raises(Exception, match="value too long for field a"):
        df.select(render_line(fields, overflow="error")).collect()


def test_short_and_long_lines_parse(spark):
    fields = fields_from_widths([("a", 2), ("b", 3), ("c", 1)])
    lines = spark.createDataFrame([("",), ("x",), (" y\tzz",), ("éàüöß extra",)], "value string")
    got = [tuple(r) for r in parse_fields(lines, fields).collect()]
    assert got == [("", "", ""), ("x", "", ""), ("y", "zz", ""), ("éà", "üöß", "")]


def test_file_flow_end_to_end(spark, folder):
    base = write_metadata(folder, "header", HEADER_COLUMNS, 1)
    write_metadata(folder, "data", DATA_COLUMNS, 1)
    result = flows.synthesize_file(
        spark, write_sample(folder), write_layout(folder), base, f"{folder}/out", ["due"]
    )
    lines = text_of(f"{result.text_path}/file=claims_syn.txt").decode().splitlines()
    assert lines[0] == "".join(HEADER_VALUES)
    assert lines[-3:] == [*CONTROL_LINES, "PT000000000400000000000A00000000000G00000000000D"]
    assert len(lines) == 8 and all(len(x) == 24 for x in lines[1:5])
    header_quality = {r["property"]: r["score"] for r in result.header_scores[1].collect()}
    assert header_quality["Overall"] == 1.0
    diagnostic = {r["column"]: r["score"] for r in result.detail_scores[0].collect()}
    assert set(diagnostic.values()) - {None} == {1.0}
    assert text_of(f"{folder}/out/detail.csv") == DETAIL_CSV.encode()
    assert text_of(f"{folder}/out/synthetic.csv").decode().startswith("tag,unit,grade,")


def test_file_flow_keeps_files_apart(spark, folder):
    layout = write_layout(folder)
    first, second = "DE001A100000001J20010101", "DE002B200000002J20010102"
    write_sample(folder, "in/a/day one.txt", ["HX1AAAA11", first, "CD1  "])
    write_sample(folder, "in/b/day one.txt", ["HX2BBBB22", *[second] * 5, "CD2"])
    write_sample(folder, "in/b/day one.dat", ["HX3CCCC33"])
    write_sample(folder, "in/b/größe+%20.txt", ["HX4DDDD44"])
    result = flows.synthesize_file(
        spark, f"{folder}/in/*/*", layout, f"{folder}/m", f"{folder}/out", ["due"],
        amounts="decode", mask=["unit"], evaluate=False,
    )
    written = {unquote(p.name[5:]): text_of(p).decode().splitlines() for p in Path(result.text_path).glob("file=*")}
    assert sorted(written) == ["a/day one_syn.txt", "b/day one.dat_syn.txt", "b/day one_syn.txt", "b/größe+%20_syn.txt"]
    one, two = written["a/day one_syn.txt"], written["b/day one_syn.txt"]
    assert (one[2], len(one), two[6], len(two)) == ("CD1", 4, "CD2", 8)
    for name in ("b/day one.dat_syn.txt", "b/größe+%20_syn.txt"):
        header, trailer = written[name]
        assert len(header) == 9 and trailer == "PT000000000000000000000A00000000000G00000000000D"
    total = [sum(10 * int(x[7:15]) + 1 for x in lines) for lines in (one[1:2], two[1:6])]
    assert one[-1].startswith(f"PT0000000001{total[0]:011d}A")
    assert two[-1].startswith(f"PT0000000005{total[1]:011d}A")
    assert latest_versions_written(spark, folder) == (1, 1)


def test_generated_claims_stay_positional(spark, folder):
    """Fresh ids have the width of the real ones, so every synthetic line has its 138 characters."""
    flows.generate_file(spark, f"{folder}/claims", 2000, seed=3)
    lines = text_of(f"{folder}/claims").decode().splitlines()
    claims = write_sample(folder, "claims.txt", lines)
    layout = Path(folder) / "layout.csv"
    rows = [f"{name},varchar,{width},{s}" for s in ("HDR", "DE") for name, width, _ in CLAIM_FIELDS]
    layout.write_text("\n".join(["Column_Name,DataTtype,Length,Type", *rows]))
    dates = [name for name, _, kind in CLAIM_FIELDS if kind == "date"]
    result = flows.synthesize_file(spark, claims, str(layout), f"{folder}/m", f"{folder}/out", dates, evaluate=False)
    made = text_of(f"{result.text_path}/file=claims_syn.txt").decode().splitlines()
    assert len(made) == 2001
    assert {len(x) for x in made[1:-1]} == {138}
    ids = [x[:10] for x in made[1:-1]]
    assert len(set(ids)) == len(ids) and not any(" " in i for i in ids)


def latest_versions_written(spark, folder):
    from claimweave.sources.metadata import latest_metadata_version

    return tuple(latest_metadata_version(spark, f"{folder}/m", k) for k in ("header", "data"))


def test_output_names(spark):
    assert synthetic_name("/a/b/sample.txt") == "/a/b/sample_syn.txt"
    assert common_folder("/a/b/c", "/a/bb/c") == "/a/" and common_folder("/a/b", "/a/b") == "/a/"
    paths = ["file:/a/b/sample.txt", "a/.txt", "two.parts/x", "/x/noext", "/x/.hidden", "/x/two.dots.dat"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(synthetic_name_column(F.col("p"))).collect()]
    assert got == [synthetic_name(p) for p in paths]


def test_claims_to_csv(spark, folder):
    flows.generate_file(spark, f"{folder}/claims", 1000, seed=3)
    text = text_of(f"{folder}/claims").decode()
    lines = text.splitlines()
    assert len(lines) == 1000 and {len(x) for x in lines} == {138}
    flows.positional_to_csv(spark, f"{folder}/claims", f"{folder}/csv", ordered=True)
    rows = []
    for part in sorted(Path(f"{folder}/csv").glob("part-*")):
        content = part.read_bytes().decode()
        assert content.endswith("\r\n")
        rows += content.split("\r\n")[1:-1]
    assert [r.split(",")[0] for r in rows] == [x[:10] for x in lines]
