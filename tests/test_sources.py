"""JSON walks and workbooks."""

import json
import zipfile

from pyspark.sql import functions as F

from quotelake.plans import records
from quotelake.sources import variants, workbook


def review(i, stars=5, **more):
    return {"$kind": "Review", "id": i, "rating": stars, **more}


def test_walk_finds_records_at_any_depth(spark):
    deep = {"x": [1, [review("d"), {"y": {"z": [review("e", reply=review("f"))]}}]]}
    pages = [
        (1, json.dumps([review("a"), {"data": {"items": [review("b"), {"$kind": "Other", "id": "no"}]}, "ratingCounts": [5, 4, 3, 2, 1]}])),
        (2, json.dumps(deep)), (3, "not json"), (4, None), (5, json.dumps({"ratingCounts": [1, 2], "q": {"ratingCounts": ["x", 1, 1, 1, 1]}})), (6, json.dumps(review("a"))), (7, "[]"),
        (8, json.dumps({"ratingCounts": [1, 1, 1, 1, 1], "in": {"ratingCounts": [0, 0, 2, 0, 2]}, "r": [review("a", 1), review("a", 1)]})),
    ]
    frame = spark.createDataFrame([(i, d, "x") for i, d in pages], "page int, document string, node string")
    got = {(r["page"], r["id"]) for r in variants.reviews(frame, ["page"], F.col("document")).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "d"), (2, "e"), (2, "f"), (6, "a"), (8, "a")}
    counts = variants.star_counts(frame, ["page"], F.col("document")).withColumn("s", variants.star_distribution(F.col("counts")))
    assert {r["page"]: tuple(r["s"]) for r in counts.collect()} == {1: (15, 3.67, 9, 1, False), 8: (4, 2.0, 0, 2, True)}
    assert variants.reviews(frame.limit(0), ["page"], F.col("document")).collect() == []


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write(path, sheets, texts=(), dimension=True):
    """A small workbook: ``sheets`` maps names to rows of raw cell XML."""
    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        if texts:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{t}</si>" for t in texts) + "</sst>")
        for i, n in enumerate(names, 1):
            last = max([r for r, _ in sheets[n]], default=1)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}>" + (f'<dimension ref="A1:D{last}"/>' if dimension else "") + "<sheetData>" + "".join(f'<row r="{r}">{cells}</row>' for r, cells in sheets[n]) + "</sheetData></worksheet>")


def test_workbook_rows(spark, tmp_path):
    workbook.register(spark)
    first = [
        (1, '<c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c>'), (2, '<c r="B2"><v>12.5</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="e"><v>#REF!</v></c>'),
        (3, '<c r="A3" t="s"><v>2</v></c>'), (5, '<c r="AA5" t="inlineStr"><is><t>far</t></is></c>'),
    ]
    write(tmp_path / "a.xlsx", {"Catalog": first, "Sumar": [(1, '<c r="A1" t="str"><f>1</f><v>formula</v></c>')]}, ["<t>Cod</t>", "<r><t>Denu</t></r><r><t>mire</t></r>", "<t>  </t>"])
    write(tmp_path / "b.xlsx", {"Mare": [(i, f"<c><v>{i}</v></c><c><v>{i * i}</v></c>") for i in range(1, 101)]}, dimension=False)
    rows = spark.read.format("workbook").load(str(tmp_path))
    got = {(r["file"], r["sheet"], r["row"]): r["cells"] for r in rows.where("file = 'a.xlsx'").collect()}
    assert got == {
        ("a.xlsx", "Catalog", 1): ["Cod", None, "Denumire"], ("a.xlsx", "Catalog", 2): [None, "12.5", "true", None], ("a.xlsx", "Catalog", 5): [None] * 26 + ["far"], ("a.xlsx", "Sumar", 1): ["formula"],
    }
    big = spark.read.format("workbook").option("sheet", "Mare").option("rowsPerPartition", "30").load(str(tmp_path / "b.xlsx"))
    assert sorted((r["row"], r["cells"]) for r in big.collect()) == [(i, [str(i), str(i * i)]) for i in range(1, 101)]
    write(tmp_path / "c.xlsx", {"Mare": [(i, f"<c><v>{i}</v></c>") for i in range(1, 101)]})
    split = spark.read.format("workbook").option("rowsPerPartition", "30").load(str(tmp_path / "c.xlsx"))
    assert split.rdd.getNumPartitions() == 4 and sorted(r["row"] for r in split.collect()) == list(range(1, 101))


def test_items_are_trimmed_and_packed_texts_unpacked(spark):
    import gzip

    from quotelake.functions import text
    from quotelake.sources import readers

    frame = spark.createDataFrame([(" a | |b c|  ", gzip.compress("é".encode())), (None, b"plain"), ("", gzip.compress(b"x")[:-6]), ("0 1|1 0", None)], "s string, b binary")
    got = frame.select(text.items(F.col("s")), readers.unpacked("b")).collect()
    assert [tuple(r) for r in got] == [(["a", "b c"], "é"), ([], "plain"), ([], None), (["0 1", "1 0"], None)]
    assert [r[0] for r in frame.select(readers.unpacked(readers.gzipped(F.col("b")))).collect()][1] == "plain"


def test_record_files_hold_some_thousand_records(spark, small):
    """The number of files to open and list is far below the number of records."""
    assert len(records.src03_json_records(spark, small).inputFiles()) == 1
    assert len(records.src04_json_by_key(spark, small).inputFiles()) == 1
