"""Records over line breaks and stray quotes: the same for every split size, and as a plain reader finds them."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from wattlens.sources import readers, records


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def in_splits(spark, size, action):
    """`action` with scans in splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    spark.conf.set(names[0], size)
    spark.conf.set(names[1], 1)
    try:
        return action()
    finally:
        for name in names:
            spark.conf.unset(name)


def scanned(spark, path):
    rows, names = readers.scan_rows(spark, path)
    return [(r.fate, tuple(r.cells) if r.cells else None) for r in rows.collect()], tuple(readers.scan_counts(rows).first())


def test_codes_of_lines():
    code, after, _, found, _ = records.automaton(",", 3)
    assert [code(x) for x in ("a,b", '"a","b"', 'a,"b', 'b",c', '"', 'b" c', 'a,""', 'x "y" z', '"a""', 'a",b,"c')] == [
        2, 4, 5, 0, 1, 4, 2, 4, 5, 3]
    assert after(bytes([3, 2, 2, 2]), 0) == (1, False) and after(bytes([3, 2]), 0) == (0, False)
    assert after(bytes([3, 2]), 0, True) == (1, False) and after(bytes([3, 0]), 0) == (2, True)
    assert found(['a,"b', 'c",d', 'e "f",g', '"h,i']) == [('a,"b\nc",d', 3, False), ('e "f",g', 2, False), ("h,i", 2, True)]


def plain_records(lines, delimiter=",", most=records.MOST_LINES):
    return records.automaton(delimiter, most)[3](lines)


@pytest.mark.parametrize("seed", range(4))
def test_every_split_size_gives_the_same_records(spark, tmp_path, seed):
    rng = random.Random(seed)
    pieces = ["a,1,2", '"x', 'y",3,4', '"a ""b"" c",5,6', '7,"8', "", "  ", '9",10', 'one "two" three,1,1', 'k,"l,m",n', ',"', '",o,p',
              "1,2,3,4,5", 'end,1,"2"', "é,ü,日本"]
    lines = ["id,v,w"] + [rng.choice(pieces) for _ in range(120)]
    if seed == 3:  # walks from even and odd lines never meet
        lines = ["id,v,w"] + ['a,1,"', '2"'] * 20 + ['x,"'] * 70
    path = write(tmp_path / "m.csv", "\n".join(lines) + "\n")
    write(tmp_path / "n.csv", "id,v,w\nfirst,1,2\nopen,\"\n")  # another file's open quote ends with the file
    expected = [(n, t, r) for t, n, r in plain_records(lines[1:]) if t.strip()]
    results = [in_splits(spark, size, lambda: scanned(spark, path)) for size in (1 << 20, 200, 37, 8)]
    assert all(r == results[0] for r in results)
    rows, counts = results[0]
    assert [f for f, _ in rows] == ["skipped" if n > 3 else "repaired" if r else "row" for n, _, r in expected]
    assert counts == (len(rows), sum(f == "repaired" for f, _ in rows), sum(f == "skipped" for f, _ in rows))
    both = in_splits(spark, 50, lambda: scanned(spark, str(tmp_path)))[0]
    key = lambda row: (row[0], str(row[1]))
    assert sorted(both, key=key) == sorted(rows + [("row", ("first", "1", "2")), ("repaired", ("open", None, None))], key=key)


def test_well_formed_files_equal_the_standard_reader(spark, tmp_path):
    rng = random.Random(9)
    values = ["a", "b c", 'say "hi"', "two\nlines", "three\n\nlines,here", "x,y", "", "7", '"', "end\n"]
    rows = [[f"r{i}", *(rng.choice(values) for _ in range(3))] for i in range(150)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["id", "a", "b", "c"], *rows])
    path = write(tmp_path / "w.csv", text.getvalue())
    for size in (1 << 20, 64):
        got = in_splits(spark, size, lambda: [tuple(r) for r in readers.scan_csv(spark, path).collect()])
        assert got == [tuple(v or None for v in r) for r in rows]


def test_a_stray_quote_costs_no_other_row(spark, tmp_path):
    path = write(tmp_path / "s.csv", 'id,date,kwh\na,2024-01-01,5\n"bad,2024-01-02,6\nc,2024-01-03,7\n"d e",2024-01-04,8\n')
    rows, counts = scanned(spark, path)
    assert rows == [("row", ("a", "2024-01-01", "5")), ("repaired", ("bad", "2024-01-02", "6")), ("row", ("c", "2024-01-03", "7")),
                    ("row", ("d e", "2024-01-04", "8"))] and counts == (4, 1, 0)
    long = "id,v\n" + '"open,1\n' + "".join(f"r{i},{i}\n" for i in range(3 * records.MOST_LINES)) + 'z,"9"\n'
    rows, counts = in_splits(spark, 500, lambda: scanned(spark, write(tmp_path / "l.csv", long)))
    assert len(rows) == 3 * records.MOST_LINES + 2 and counts[1:] == (1, 0)


def test_no_task_reads_a_whole_file(spark, tmp_path):
    path = write(tmp_path / "p.csv", "id,v\n" + '"a\nb",1\n' * 2000)
    parts = in_splits(spark, 1000, lambda: readers.scan_csv(spark, path).groupBy(F.spark_partition_id()).count().collect())
    assert len(parts) > 10 and sum(r["count"] for r in parts) == 2000
